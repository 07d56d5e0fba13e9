"""Queries of index upkeep, git text, trees, memories, metrics, sessions and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import metrics as M
from tessera.plans.fixture import Fixture, ctes
from tessera.plans.indexing import folder
from tessera.sources import workspace as S
from tessera.streaming import state as Z
from tessera.streaming import watch as W


def _files(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id")


def _state(spark, d):
    """What an earlier run has left: even documents as they are, every third with an old hash."""
    f = I.with_hash(_files(spark, d)).where("doc_id % 2 = 0 OR doc_id % 3 = 0")
    gone = spark.createDataFrame([("gone/1", "x")], "path string, hash string")
    return f.select("path", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash")).unionByName(gone)


def hash_skip_anti(spark, d):
    return I.changed(_files(spark, d), _state(spark, d)).select("doc_id", "hash")


def index_state_merge(spark, d):
    f = _files(spark, d)
    done = I.changed(f, _state(spark, d)).select("path", "hash")
    return I.merge_state(_state(spark, d), f.select("path"), done)


def chunk_merge(spark, d):
    """Chunks (one for each document) after documents divisible by 5 changed and those by 7 went."""
    f = _files(spark, d)
    c = f.select("path", F.md5("content").alias("content"), "doc_id")
    new = c.where("doc_id % 5 = 0").withColumn("content", F.lit("new"))
    gone = c.where("doc_id % 7 = 0 AND doc_id % 5 <> 0").select("path")
    return I.merge_chunks(c, new, gone).select("doc_id", "content")


def tree_top_entries(spark, d):
    return I.tree(_files(spark, d).select("path"), 4, 50)


def file_slice(spark, d):
    f = _files(spark, d)
    return f.select("doc_id", F.md5(I.file_slice(F.col("content"), F.lit(2), F.lit(4))).alias("md5"))


GIT = Fixture("git", "repo string, output string", [("r", "a1|Ann|2 days ago|fix | and more\nb2|Bob|3 days ago|add\n"), ("s", "")])
BLAME = Fixture("blame", "file string, output string", [("f.ts", "h1 1 1\nauthor Ann\nauthor-time 1700000000\n\tline one\nh2 2 2\nauthor Bob\nauthor-time 1700100000\n\tline two\n\tline three\n")])
SHORT = Fixture("shortlog", "repo string, output string", [("r", "   12\tAnn Lee\n    3\tBob\n\n"), ("s", "x")])
STATUS = Fixture("status", "repo string, output string", [("r", "M  a.ts\n M b.ts\nMM c.ts\n?? d.ts\n"), ("s", "")])


def git_log_parse(spark, d):
    return I.git_log(GIT.df(spark))


def blame_lines(spark, d):
    return I.blame(BLAME.df(spark))


def blame_ownership(spark, d):
    return I.ownership(I.blame(BLAME.df(spark)))


def contributors(spark, d):
    return I.contributors(SHORT.df(spark))


def git_status_counts(spark, d):
    return I.status_counts(STATUS.df(spark))


MEMORIES = Fixture("memories", "category string, content string", [("facts", "### [2024-01-01] t\n- a\n  - b\ntext"), ("decisions", "")])


def memory_counts(spark, d):
    return I.memory_counts(MEMORIES.df(spark))


NOTES = Fixture("notes", "id int, title string, content string", [(0, "One", "first\n\n- second\n  third "), (1, "Empty", "")])


def memory_entries(spark, d):
    return NOTES.df(spark).select("id", I.memory_entry(F.col("title"), F.col("content"), F.lit("2024-05-01")).alias("entry"))


PATHS = Fixture("paths", "path string", [(p,) for p in ("src/a.ts", "src/gen/a.ts", "dist/x.js", "a/node_modules/y.js", ".env", "docs/b.md", "logs/x.log", "deep/logs/y.log", "root.cfg", "src/root.cfg", "src/.hid/z.ts", "Makefile", "src/tmp1.ts", "src/tmpx/q.ts")])
IGNORE = "# comment\n\n!keep\n/root.cfg\ngen/\n*.log\ntmp?.ts\nsrc/tmpx/**\n"


def ignore_match(spark, d):
    p = PATHS.df(spark)
    return p.select("path", S.ignored(F.col("path"), S.ignore_patterns(IGNORE)).alias("ignored"), S.skipped(F.col("path")).alias("skipped"))


def workspace_crawl(spark, d):
    return S.crawl(PATHS.df(spark), [".ts", ".js", ".md", ".log", ".cfg"], ["makefile"], S.ignore_patterns(IGNORE), ["src", "docs", "Makefile", "logs"])


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def metric_histogram(spark, d):
    return M.histogram(_events(spark, d), ["event_type"], "value").withColumn("sum", F.round("sum", 4))


def metric_counter(spark, d):
    return M.counter(_events(spark, d), ["event_type"])


def metric_gauge_last(spark, d):
    return M.gauge(_events(spark, d), ["event_type"], "value", ["ts", "event_id"])


def metric_lines(spark, d):
    return M.exposition(M.counter(_events(spark, d), ["event_type"]), "events_total", ["event_type"])


def metric_series_limit(spark, d):
    return M.limit_series(M.counter(_events(spark, d), ["user_id"]), ["user_id"], 100)


def cache_hit_rate(spark, d):
    return M.hit_rate(_events(spark, d), "event_type", F.col("value") > 50)


def _changes(spark, d):
    return _events(spark, d).select("ts", F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"))


_GAP = 60_000  # the events are minutes apart


def watcher_sessions(spark, d):
    return W.sessions(_changes(spark, d), _GAP).select("ord", "session")


def watcher_coalesce(spark, d):
    return W.coalesce_changes(W.sessions(_changes(spark, d), _GAP))


def watcher_batches(spark, d):
    b = W.batches(W.coalesce_changes(W.sessions(_changes(spark, d), _GAP)), 3)
    return b.groupBy("session", "batch").agg(F.count("*").alias("changes"))


def finding_dedupe_ttl(spark, d):
    e = _events(spark, d).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_millis("ts").alias("at_ms"), F.col("event_id").alias("ord"))
    return Z.dedupe_with_ttl(e, 2 * 24 * 3600 * 1000, folder(spark, "findings"))


def click_dedupe_ttl(spark, d):
    """Clicks as findings of a client and kind that are told again after six hours; clients and kinds are skewed, some unknown, some times too."""
    c = spark.read.parquet(f"{d}/clicks.parquet")
    e = c.select(F.concat_ws("|", F.coalesce(F.col("client_id").cast("string"), F.lit("?")), F.coalesce("kind", F.lit("?"))).alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("click_id").alias("ord"))
    return Z.dedupe_with_ttl(e, 6 * 3600 * 1000, folder(spark, "clicks"))


def finding_dedupe_stats(spark, d):
    f = finding_dedupe_ttl(spark, d)
    return f.agg(F.count("*").alias("checked"), F.count_if(~F.col("is_new")).alias("duplicates"), F.round(F.avg((~F.col("is_new")).cast("int")), 6).alias("rate"))


def session_timeout(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("at_ms"))
    return Z.session_states(e, 1706572800000, 6 * 3600 * 1000, 20)


def session_totals(spark, d):
    """Sessions of clients in clicks, hot and unknown clients included, at the end of February: a client idle for a day is through."""
    c = spark.read.parquet(f"{d}/clicks.parquet").where("ts < '2024-03-01'").select(F.col("client_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return Z.session_totals(Z.session_states(c, 1709251200000, 24 * 3_600_000, 20))


def cache_last_used(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("layer"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    return Z.last_used(e, 10)


def cache_replay(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("layer"), F.col("event_id").alias("seq"), F.unix_millis("ts").alias("at_ms"), F.col("user_id").cast("string").alias("key"))
    return Z.replay_cache(e, 20, 24 * 3600 * 1000).groupBy("layer", "hit").agg(F.count("*").alias("n"))


def cache_layers(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("seq"), F.unix_millis("ts").alias("at_ms"), F.col("event_type").alias("commit"), F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 3).cast("string").alias("content_hash"))
    return Z.replay_layers(e, 3 * 24 * 3600 * 1000).groupBy("hit").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    hash_skip_anti, index_state_merge, chunk_merge, tree_top_entries, file_slice, git_log_parse, blame_lines, blame_ownership, contributors, git_status_counts, memory_counts, memory_entries,
    ignore_match, workspace_crawl, metric_histogram, metric_counter, metric_gauge_last, metric_lines, metric_series_limit, cache_hit_rate, watcher_sessions, watcher_coalesce, watcher_batches,
    finding_dedupe_ttl, finding_dedupe_stats, click_dedupe_ttl, session_timeout, session_totals, cache_last_used, cache_replay, cache_layers,
)}
_F = "f AS (SELECT source || '/' || doc_id AS path, text, doc_id, sha256(text) AS hash FROM documents), s AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN hash ELSE 'old' END AS hash FROM f WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 UNION ALL SELECT 'gone/1', 'x'), c AS (SELECT f.* FROM f LEFT JOIN s USING (path, hash) WHERE s.path IS NULL)"
_S = f"g AS (SELECT ts, event_id AS ord, user_id::VARCHAR AS path, event_type AS type, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {_GAP} * 1000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS p FROM events)), k AS (SELECT CAST(session AS BIGINT) AS session, path, arg_max(type, (ts, ord)) AS type, min((ts, ord)) AS first FROM g GROUP BY session, path), n AS (SELECT session, path, type, CAST(row_number() OVER (PARTITION BY session ORDER BY first, path) AS INTEGER) AS place FROM k)"
ORACLES = {
    "click_dedupe_ttl": """WITH RECURSIVE f AS (SELECT coalesce(client_id::VARCHAR, '?') || '|' || coalesce(kind, '?') AS key, epoch_us(ts) // 1000 AS at_ms, click_id AS ord FROM clicks),
l AS (SELECT key, at_ms, min(at_ms) OVER (PARTITION BY key ORDER BY at_ms RANGE BETWEEN 21600001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT DISTINCT key, at_ms FROM f WHERE at_ms IS NOT NULL)),
c AS (SELECT key, min(at_ms) AS at_ms, 1 AS n FROM l GROUP BY key UNION ALL SELECT c.key, l.next, c.n + 1 FROM c JOIN l ON l.key = c.key AND l.at_ms = c.at_ms WHERE l.next IS NOT NULL)
SELECT f.key, f.at_ms, f.ord, c.n IS NOT NULL AND row_number() OVER (PARTITION BY f.key, f.at_ms ORDER BY f.ord) = 1 AS is_new, max(c.n) OVER (PARTITION BY f.key ORDER BY f.at_ms) AS occurrence FROM f LEFT JOIN c ON c.key = f.key AND c.at_ms = f.at_ms WHERE f.at_ms IS NOT NULL
UNION ALL SELECT key, at_ms, ord, NULL, NULL FROM f WHERE at_ms IS NULL""",
    "hash_skip_anti": f"WITH {_F} SELECT doc_id, hash FROM c",
    "index_state_merge": f"WITH {_F} SELECT path, hash FROM s WHERE path IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM c) UNION ALL SELECT path, hash FROM c",
    "chunk_merge": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE md5(text) END AS content FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0",
    "tree_top_entries": "WITH e AS (SELECT '' AS parent, source AS name, true AS is_dir, count(DISTINCT doc_id) AS entries FROM documents GROUP BY source UNION ALL SELECT source, doc_id::VARCHAR, false, 0 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS place, count(*) OVER (PARTITION BY parent) AS n FROM e) SELECT parent, name, is_dir, entries, CAST(place AS INTEGER) AS place FROM r WHERE place <= 50 UNION ALL SELECT parent, '... and ' || (n - 50) || ' more entries', false, 0, 51 FROM r WHERE place = 1 AND n > 50",
    "file_slice": "SELECT doc_id, md5(CASE WHEN len(l) >= 2 THEN array_to_string(l[2:4], chr(10)) END) AS md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "contributors": ctes(SHORT) + r", l AS (SELECT repo, trim(replace(unnest(string_split(output, chr(10))), chr(9), ' ')) AS x FROM shortlog) SELECT repo, regexp_extract(x, '^(\d+)\s+(.+)$', 2) AS author, CAST(regexp_extract(x, '^(\d+)\s+(.+)$', 1) AS BIGINT) AS commits FROM l WHERE regexp_matches(x, '^\d+\s+.+$')",
    "metric_histogram": "SELECT event_type, le, CASE WHEN le = '+Inf' THEN count(*) ELSE count(*) FILTER (value <= CASE WHEN le = '+Inf' THEN 0 ELSE try_cast(le AS DOUBLE) END) END AS count, round(sum(value), 4) AS sum FROM events, (SELECT unnest(['0.001', '0.0025', '0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10', '30', '60', '+Inf']) AS le) GROUP BY event_type, le",
    "metric_counter": "SELECT event_type, count(*) AS value FROM events GROUP BY event_type",
    "metric_gauge_last": "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type",
    "metric_lines": "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "metric_series_limit": "SELECT user_id, value, greatest(0, n - 100) AS dropped FROM (SELECT user_id, count(*) AS value, count(*) OVER () AS n, row_number() OVER (ORDER BY user_id) AS r FROM events GROUP BY user_id) WHERE r <= 100",
    "cache_hit_rate": "SELECT event_type, count(*) AS lookups, round(avg((value > 50)::INT), 6) AS hit_rate FROM events GROUP BY event_type",
    "watcher_sessions": f"WITH {_S} SELECT ord, CAST(session AS BIGINT) AS session FROM g",
    "watcher_coalesce": f"WITH {_S} SELECT * FROM n",
    "watcher_batches": f"WITH {_S} SELECT session, CAST((place - 1) // 3 AS INTEGER) AS batch, count(*) AS changes FROM n GROUP BY ALL",
    "session_timeout": "WITH g AS (SELECT user_id AS session, count(*) AS events, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id) SELECT session, events, last_ms, CASE WHEN 1706572800000 - last_ms > 21600000 THEN 'timed_out' ELSE 'active' END AS state, 1706572800000 - last_ms <= 21600000 AND row_number() OVER (ORDER BY last_ms DESC, session) <= 20 AS kept FROM g",
    "session_totals": "WITH g AS (SELECT client_id, count(*) AS n, max(epoch_us(ts) // 1000) AS t FROM clicks WHERE ts < '2024-03-01' GROUP BY client_id), s AS (SELECT *, 1709251200000 - t <= 86400000 AS active, row_number() OVER (ORDER BY t DESC, client_id NULLS FIRST) AS r FROM g) SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS terminal, count(*) FILTER (active AND r <= 20) AS kept, sum(n)::BIGINT AS events FROM s",
    "cache_last_used": "SELECT * FROM (SELECT event_type AS layer, user_id AS key, max(event_id) AS last FROM events GROUP BY event_type, user_id) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY last DESC) <= 10",
}
