"""Queries of the text, statistics and scan family."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import scan as S
from tessera.plans.fixture import Fixture, ctes, spread


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "lang", "doc_id", "source")


def line_explode(spark, d):
    return S.explode_lines(_docs(spark, d).select("doc_id", "content")).select("doc_id", "line", F.length("text").alias("chars"))


def line_stats(spark, d):
    return spread(_docs(spark, d).select("doc_id", "content")).select("doc_id", S.line_counts(F.col("content")).alias("c")).select("doc_id", "c.*")


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("content")).alias("tokens"))


def language_stats(spark, d):
    f = _docs(spark, d).select(F.col("lang").alias("language"), F.size(F.split("content", "\n", -1)).cast("long").alias("lines"), F.octet_length("content").cast("long").alias("bytes"))
    return S.language_stats(f)


def largest_files(spark, d):
    f = _docs(spark, d).select("path", "doc_id", F.size(F.split("content", "\n", -1)).cast("long").alias("lines"), F.octet_length("content").cast("long").alias("bytes"))
    return f.orderBy(F.col("lines").desc(), "doc_id").limit(10).select("path", "lines", T.human_bytes(F.col("bytes")).alias("size"))


def _blocks(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("file"), F.size(F.split("content", "\n", -1)).alias("lines"), F.col("content").alias("code"))


def duplicate_groups(spark, d):
    return S.duplicate_groups(_blocks(spark, d), most=100)


def duplicate_line_total(spark, d):
    """Over all groups, not only those that are shown."""
    return S.duplicate_groups(_blocks(spark, d), most=None).agg(F.count("*").alias("groups"), F.sum("redundant").alias("redundant_lines"))


def content_hash(spark, d):
    c = F.regexp_replace("content", "\r\n", "\n")
    return _docs(spark, d).select("doc_id", F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"), F.substring(F.sha2(c, 256), 1, 16).alias("short"))


def binary_reject(spark, d):
    return _docs(spark, d).groupBy(T.is_binary(F.col("content")).alias("binary")).agg(F.count("*").alias("files"))


_KEY = "A" * 16
FILES = Fixture(
    "files",
    "path string, content string",
    [
        ("a.ts", f"const k = 'AKIA{_KEY}';\n// example of eval(\nel.innerHTML = x;\nTODO: fix this\nq = query(`select ${{x}}`)\nfetch('http://10.0.0.1/')\nhost = '10.0.0.1'"),
        ("b.py", "password = 'hunter2hunter2'\npickle.loads(x)\nverify_ssl = False\n# fixme later\n# note\nx = 1"),
        ("c.md", "nothing here\n\nwarn   \nDEPRECATED: " + "z" * 250),
        ("d.js", "ghp_" + "a1" * 18 + " and postgres://user:secret@host/db\nevaluate(1)\nexec(cmd)\ndocument.write(s)\n// example x = eval(y)"),
        ("e.txt", ""),
    ],
)


def security_scan(spark, d):
    return S.scan_security(FILES.df(spark))


def security_scan_documents(spark, d):
    """All documents, pages and conversations."""
    docs = _docs(spark, d).select("path", "content")
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("content"))
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", F.lit("conversation"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    return S.scan_security(spread(docs).unionByName(pages).unionByName(turns)).groupBy("type", "message", "severity").agg(F.count("*").alias("hits"))


def planted(spark, d):
    """(path, content) of documents with a line of their own at the end that one of eight rules finds, made of the document's MD5."""
    docs = _docs(spark, d)
    h = F.md5(F.coalesce("content", F.lit("")))
    lines = ["concat('key = AKIA', upper(substr(h, 1, 16)))", "concat('ghp_', substr(concat(h, h), 1, 36))", "concat('password: \"', substr(h, 1, 12), '\"')", "concat('x = eval(', h, ')')",
             "concat('SG.', substr(h, 1, 22), '.', substr(concat(h, h), 1, 43))", "concat('rejectUnauthorized: false // ', h)", "concat('postgres://u:', h, '@host')", "concat('-----BEGIN RSA PRIVATE KEY-----', h)"]
    own = F.element_at(F.array(*map(F.expr, lines)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return spread(docs).withColumn("h", h).select("path", F.concat_ws("\n", "content", own).alias("content"))


def security_scan_planted(spark, d):
    return S.scan_security(planted(spark, d)).groupBy("type", "message", "severity").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


def secret_scrub(spark, d):
    return FILES.df(spark).select("path", S.scrub(F.col("content")).alias("clean"))


#: An extension beyond the list: a bare token assignment of 40 hex digits, as in the documents.
TOKEN = ("Token Assignment", r"token = \"[0-9a-f]{40}\"")


def secret_scrub_documents(spark, d):
    """Every document that a rule changes, of the list or TOKEN."""
    docs = _docs(spark, d).withColumn("clean", S.scrub(F.col("content"), [TOKEN]))
    return docs.where("clean <> content").select("doc_id", F.md5("clean").alias("clean_md5"))


def marker_scan(spark, d):
    return S.scan_markers(FILES.df(spark))


def markers_by_tag(spark, d):
    return S.markers_by_tag(S.scan_markers(FILES.df(spark)))


INPUTS = Fixture(
    "inputs",
    "id int, content string, content_type string",
    [
        (0, "function f() { return [1, 2); }", "generated_code"),
        (1, '{"a": 1}', "plan_output"),
        (2, '{"a": ', "plan_output"),
        (3, "   \n", "review"),
        (4, "// TODO one FIXME two\nconsole.log('x'); console.error (y)\nfetch('https://api.service.io/v1'); go('http://example.com')\n" + "w" * 121, "generated_code"),
        (5, "((", "review"),
    ],
)


def validation_findings(spark, d):
    return S.validate(INPUTS.df(spark))


def validation_by_severity(spark, d):
    return S.validate(INPUTS.df(spark)).groupBy("severity").agg(F.count("*").alias("findings"))


def validate_line_length(spark, d):
    """Lines over 120 signs of all documents, the first five of each."""
    found = S.validate(_docs(spark, d).select(F.col("doc_id").alias("id"), "content", F.lit("review").alias("content_type")), rules=["T2-004"])
    return found.select(F.col("id").alias("doc_id"), "line")


PATHS = Fixture("paths", "id int, path string, base string", [(0, "src/a/../b/c.test.ts", "./x"), (1, "./README.md", "../y"), (2, "../../up/x.go", "z"), (3, ".gitignore", "."), (4, "a//b/./c.TSX", "..")])


def path_parts(spark, d):
    p = F.col("path")
    return PATHS.df(spark).select("id", T.normal_path(p).alias("normal"), T.extension(p).alias("ext"), T.basename(p).alias("base_name"), T.dirname(p).alias("folder"), T.strip_extension(p).alias("stem"), T.parser_language(p).alias("language"))


def language_of_extension(spark, d):
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in S.LANGUAGES.items()))
    return PATHS.df(spark).select("id", F.coalesce(pairs[T.extension(F.col("path"))], F.lit("Other")).alias("language"))


SIZES = Fixture("sizes", "n bigint", [(0,), (1023,), (1024,), (1536,), (1048576,), (5000000,)])


def human_bytes(spark, d):
    return SIZES.df(spark).select("n", T.human_bytes(F.col("n")).alias("size"))


URLS = Fixture("urls", "id int, url string", [(0, "git@github.com:own/repo.git"), (1, "https://github.com/o2/r2"), (2, "https://gitlab.com/a/b"), (3, "https://github.com/a/b.c/d")])


def repo_url_parse(spark, d):
    return URLS.df(spark).select("id", T.repository(F.col("url")).alias("r")).select("id", "r.owner", "r.repo")


STAMPS = Fixture("stamps", "id int, last string", [(0, None), (1, "2024-05-01 12:00:00"), (2, "2024-05-02 11:59:59"), (3, "never"), (4, "2024-05-02 23:00:00")])


def index_stale(spark, d):
    return STAMPS.df(spark).select("id", T.is_stale(F.col("last"), F.lit("2024-05-03 11:59:59").cast("timestamp")).alias("stale"))


GOALS = Fixture("goals", "id int, goal string", [(0, "fix the Login page!"), (1, "  "), (2, "add OAuth2 (google) support for all of the internal services and more"), (3, "???")])


def plan_names(spark, d):
    return GOALS.df(spark).select("id", T.plan_name(F.col("goal")).alias("name"))


_LINES = "string_split(text, chr(10))"
_SCAN = " UNION ALL ".join(
    [f"SELECT path, line, 'secret' AS type, 'Potential {n} found.' AS message, '{s}' AS severity FROM l WHERE regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for n, p, s in S.SECRETS]
    + [f"SELECT path, line, 'vulnerability' AS type, '{m}' AS message, '{s}' AS severity FROM l WHERE regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for p, s, m in S.RISKS]
)
_NOTE = "WHERE NOT (starts_with(ltrim(t), '//') AND contains(t, 'example') AND NOT contains(t, '='))"
_L = "SELECT path, CAST(i AS INTEGER) AS line, string_split(content, chr(10))[i] AS t FROM (SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {f})"


def _scrubbed(c: str, rules) -> str:
    for n, p in rules:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED:{n}]', 'g')"
    return c


_RULES = [(n, p) for n, p, _ in S.SECRETS]
_TAGS = "|".join(S.MARKERS)
_MARK = rf"""m AS (SELECT path, line, upper(regexp_extract(t, '(?i)\b({_TAGS})\b[:\s]?', 1)) AS tag, trim(regexp_extract(t, '(?i)\b({_TAGS})\b[:\s]?(.*)$', 2)) AS rest, trim(t) AS whole FROM l WHERE regexp_matches(t, '(?i)\b({_TAGS})\b[:\s]?')),
s AS (SELECT path, line, tag, CASE WHEN rest <> '' THEN rest ELSE whole END AS x FROM m)"""
_NORMAL = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#|\*|/\*)')), chr(10))"
_DUP = f"""n AS (SELECT doc_id, source, len({_LINES}) AS lines, {_NORMAL} AS n FROM documents),
g AS (SELECT md5(n) AS hash, count(*) AS copies, arg_min(lines, doc_id) AS lines, arg_min(source || ':' || doc_id, doc_id) AS first FROM n WHERE lines >= 5 AND length(n) >= 20 GROUP BY md5(n) HAVING count(*) > 1),
d AS (SELECT hash, copies, CAST(lines AS BIGINT) AS lines, CAST(lines * (copies - 1) AS BIGINT) AS redundant, first FROM g ORDER BY lines * copies DESC, hash LIMIT 100)"""

#: Lines (l) of the documents with planted secrets.
PLANTED = f"""h AS (SELECT source || '/' || doc_id AS path, doc_id, text, md5(coalesce(text, '')) AS h FROM documents), f AS (SELECT path, concat_ws(chr(10), text, [concat('key = AKIA', upper(substr(h, 1, 16))), concat('ghp_', substr(h || h, 1, 36)), concat('password: "', substr(h, 1, 12), '"'), concat('x = eval(', h, ')'),
concat('SG.', substr(h, 1, 22), '.', substr(h || h, 1, 43)), concat('rejectUnauthorized: false // ', h), concat('postgres://u:', h, '@host'), concat('-----BEGIN RSA PRIVATE KEY-----', h)][doc_id % 8 + 1]) AS content FROM h),
l AS (SELECT * FROM ({_L.format(f='f')}) {_NOTE})"""
QUERIES = {f.__name__: f for f in (
    line_explode, line_stats, token_estimate, language_stats, largest_files, duplicate_groups, duplicate_line_total, content_hash, binary_reject, security_scan, security_scan_documents, security_scan_planted,
    secret_scrub, secret_scrub_documents, marker_scan, markers_by_tag, validation_findings, validation_by_severity, validate_line_length, path_parts, language_of_extension, human_bytes, repo_url_parse, index_stale, plan_names,
)}
ORACLES = {
    "line_explode": f"SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(length({_LINES}[i]) AS INTEGER) AS chars FROM (SELECT doc_id, text, unnest(range(1, len({_LINES}) + 1)) AS i FROM documents)",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents",
    "language_stats": f"SELECT lang AS language, count(*) AS files, CAST(sum(len({_LINES})) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(len({_LINES})) / sum(sum(len({_LINES}))) OVER () * 100, 1) AS pct FROM documents GROUP BY lang",
    "largest_files": f"SELECT source || '/' || doc_id AS path, CAST(len({_LINES}) AS BIGINT) AS lines, CASE WHEN strlen(text) < 1024 THEN printf('%d B', strlen(text)) WHEN strlen(text) < 1048576 THEN printf('%.1f KB', strlen(text) / 1024) ELSE printf('%.1f MB', strlen(text) / 1048576) END AS size FROM documents ORDER BY len({_LINES}) DESC, doc_id LIMIT 10",
    "duplicate_groups": f"WITH {_DUP} SELECT * FROM d",
    "duplicate_line_total": f"WITH {_DUP.rsplit(' ORDER BY', 1)[0]}) SELECT count(*) AS groups, CAST(sum(redundant) AS BIGINT) AS redundant_lines FROM d",
    "content_hash": r"SELECT doc_id, sha256(c) AS sha256, md5(c) AS md5, substr(sha256(c), 1, 16) AS short FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS c FROM documents)",
    "security_scan": ctes(FILES) + f", l AS (SELECT * FROM ({_L.format(f='files')}) {_NOTE}) {_SCAN}",
    "security_scan_documents": f"WITH f AS (SELECT source || '/' || doc_id AS path, text AS content FROM documents UNION ALL SELECT url, html FROM pages UNION ALL SELECT 'conversation/' || conv_id || '/' || turn, text FROM conversations), l AS (SELECT * FROM ({_L.format(f='f')}) {_NOTE}) SELECT type, message, severity, count(*) AS hits FROM ({_SCAN}) GROUP BY ALL",
    "secret_scrub": ctes(FILES) + f" SELECT path, {_scrubbed('content', _RULES)} AS clean FROM files",
    "security_scan_planted": f"""WITH {PLANTED} SELECT type, message, severity, count(*) AS hits, count(DISTINCT path) AS files FROM ({_SCAN}) GROUP BY ALL""",
    "secret_scrub_documents": f"""SELECT doc_id, md5(clean) AS clean_md5 FROM (SELECT doc_id, text, {_scrubbed('text', [*_RULES, (TOKEN[0], TOKEN[1].replace(chr(92) + '"', '"'))])} AS clean FROM documents) WHERE clean <> text""",
    "marker_scan": ctes(FILES) + f", l AS ({_L.format(f='files')}), {_MARK} SELECT path, line, tag, CASE WHEN length(x) > 200 THEN substr(x, 1, 200) || '...' ELSE x END AS text FROM s",
    "markers_by_tag": ctes(FILES) + f", l AS ({_L.format(f='files')}), {_MARK} SELECT tag, count(*) AS items, count(DISTINCT path) AS files FROM s GROUP BY tag",
    "validate_line_length": f"SELECT doc_id, line FROM (SELECT doc_id, CAST(i AS INTEGER) AS line FROM (SELECT doc_id, text, unnest(range(1, len({_LINES}) + 1)) AS i FROM documents) WHERE length({_LINES}[i]) > 120 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)",
    "human_bytes": ctes(SIZES) + " SELECT n, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM sizes",
    "repo_url_parse": ctes(URLS) + " SELECT id, nullif(regexp_extract(url, 'github\\.com[:/]([^/]+)/([^/.]+)', 1), '') AS owner, nullif(regexp_extract(url, 'github\\.com[:/]([^/]+)/([^/.]+)', 2), '') AS repo FROM urls",
    "index_stale": ctes(STAMPS) + " SELECT id, coalesce(epoch(TIMESTAMP '2024-05-03 11:59:59') - epoch(try_cast(last AS TIMESTAMP)) > 86400, true) AS stale FROM stamps",
}
