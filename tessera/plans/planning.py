"""Queries of the planning family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import planning as P
from tessera.plans.fixture import Fixture, ctes

STEPS = Fixture(
    "steps",
    "plan_id int, step int, title string, depends_on array<int>, blocks array<int>, modify array<string>, create array<string>, delete array<string>",
    [
        (0, 1, "a", [], [2], ["x.ts"], [], []), (0, 2, "b", [1], [3], ["x.ts", "y.ts"], None, []), (0, 3, 'say "c"', [2], [], [], ["z.ts"], ["old.ts", ""]), (0, 4, "d", [3], [], None, None, None),
        (1, 1, "a", [], [], [], [], []), (1, 2, "b", [1], [], [], [], []), (1, 3, "c", [1], [4], [], [], []), (1, 4, "d", [2, 3, 9], [], ["q"], [], []),
        (2, 1, "a", [], [], [], [], []), (2, 2, "b", [], [], [], [], []), (2, 3, "c", [], [], [], [], []),
        (3, 1, "a", [2], [], [], [], []), (3, 2, "b", [1], [], [], [], []), (3, 3, "c", [], [], [], [], []),
    ],
)
STATES = Fixture("states", "plan_id int, step int, status string", [(0, 1, "completed"), (0, 2, "pending"), (0, 3, "pending"), (0, 4, "pending"), (1, 1, "failed"), (1, 2, "pending"), (1, 3, "skipped"), (1, 4, "pending"), (2, 1, "completed"), (2, 2, "skipped"), (2, 3, "completed"), (3, 1, "ready"), (3, 2, "in_progress"), (3, 3, "blocked")])


def plan_edges(spark, d):
    return P.edges(STEPS.df(spark))


def plan_analysis(spark, d):
    a = P.analyse(STEPS.df(spark).select("plan_id", "step", "depends_on", "blocks"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select("plan_id", text("execution_order").alias("execution_order"), text("critical_path").alias("critical_path"), F.array_join("parallel_groups", "|").alias("parallel_groups"), text("cyclic").alias("cyclic"))


def plan_mermaid(spark, d):
    return P.mermaid(STEPS.df(spark))


def ready_steps(spark, d):
    return P.readiness(STEPS.df(spark), STATES.df(spark))


def plan_progress(spark, d):
    return P.progress(STATES.df(spark))


def order_progress(spark, d):
    """Orders of each priority as steps of a plan: F is completed, O is pending, P is in progress."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    return P.progress(o.select(F.col("o_orderpriority").alias("plan_id"), s.alias("status"))).withColumnRenamed("plan_id", "priority")


def plan_progress_stateless(spark, d):
    return P.stateless_progress(STEPS.df(spark), [1, 2])


def plan_select_steps(spark, d):
    return P.select_steps(STATES.df(spark), "full_plan", most=2).select("plan_id", "step")


def affected_files(spark, d):
    return P.affected_files(STEPS.df(spark))


def _versions(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    words = F.posexplode(F.split("text", " ")).alias("step", "body")
    return c.select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("version"), words)


def version_diff(spark, d):
    return P.version_diff(_versions(spark, d), 0, 2)


def version_prune(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("version"))
    return P.prune(c, 3)


HISTORY = Fixture("history", "plan_id int, version int, created_at string, change_type string", [(1, 1, "2024-01-01T00:00:00Z", "created"), (1, 2, "2024-01-02T00:00:00Z", "modified"), (1, 3, "2024-01-03T00:00:00Z", "modified"), (2, 1, "2024-01-02T12:00:00Z", "created")])


def version_range(spark, d):
    return P.history(HISTORY.df(spark), "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", 1)


def version_rollback(spark, d):
    return P.rollback(HISTORY.df(spark), 1, 1, F.lit("2024-02-01T00:00:00Z"))


PLANS = Fixture("plans", "plan_id int, name string, status string, tags array<string>, created_at string, updated_at string", [(1, "Beta", "ready", ["api", "db"], "2024-01-01", "2024-01-09"), (2, "alpha", "ready", ["ui"], "2024-01-02", "2024-01-08"), (3, "Gamma", "done", [], "2024-01-03", "2024-01-07"), (4, "delta", "ready", ["db"], "2024-01-04", "2024-01-06")])
NEW = Fixture("new", "plan_id int, name string, status string, tags array<string>, created_at string, updated_at string", [(1, "Beta 2", "ready", [], "2024-02-01", "2024-02-01"), (9, "GAMMA", "ready", ["x"], "2024-02-02", "2024-02-02"), (7, "new", "ready", [], "2024-02-03", "2024-02-03")])


def plan_list(spark, d):
    return P.list_plans(PLANS.df(spark), "ready", sort="name", descending=False, most=2).select("plan_id", "name")


def plan_tag_overlap(spark, d):
    return P.list_plans(PLANS.df(spark), tags=["db", "zz"]).select("plan_id")


def plan_upsert(spark, d):
    return P.upsert(PLANS.df(spark), NEW.df(spark), True).drop("tags")


def plan_insert(spark, d):
    return P.upsert(PLANS.df(spark), NEW.df(spark), False).drop("tags")


REQUESTS = Fixture("requests", "request_id int, plan_id int, step int", [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 2, None)])
RESPONSES = Fixture("responses", "request_id int, at_ms int, decision string", [(1, 5, "approved"), (1, 2, "rejected"), (2, 3, "rejected"), (4, 1, "modification_requested")])


def approvals_latest(spark, d):
    return P.approvals(REQUESTS.df(spark), RESPONSES.df(spark))


GOALS = Fixture("goals", "plan_id int, goal string, questions int, n_steps int", [(1, "g" * 120, 0, 3), (2, "short", 2, 0), (3, "x", 0, 7), (4, "y", 1, 11), (5, "z", 0, 6)])


def plan_summary(spark, d):
    return P.summary(GOALS.df(spark))


REPLIES = Fixture("replies", "id int, reply string", [(0, '{"id":"p","confidence_score":1.5,"steps":[{"title":"a","priority":"urgent","depends_on":["1","x"]},{"id":"s2","step_number":5,"priority":"high","complexity":"simple"}]}'), (1, "{}"), (2, "no")])


def plan_coerce(spark, d):
    return P.coerce(REPLIES.df(spark))


EVENTS = Fixture("events_log", "plan_id int, seq int, step int, event string", [(0, 0, 0, "init"), (0, 1, 1, "start"), (0, 2, 1, "fail"), (0, 3, 1, "start"), (0, 4, 1, "complete"), (0, 5, 2, "start"), (0, 6, 3, "skip"), (1, 0, 0, "init"), (1, 1, 1, "start"), (1, 2, 1, "fail"), (1, 3, 1, "start"), (1, 4, 1, "fail"), (1, 5, 1, "start"), (1, 6, 1, "fail"), (2, 0, 0, "init")])


def step_state_machine(spark, d):
    return P.step_states(STEPS.df(spark).select("plan_id", "step", "depends_on", "blocks"), EVENTS.df(spark))


CALLS = Fixture("calls", "key int, seq int, at_ms bigint, ok boolean", [(1, 0, 0, True), (1, 1, 1, False), (1, 2, 2, False), (1, 3, 3, False), (1, 4, 50_000, True), (1, 5, 60_003, True), (1, 6, 60_004, False), (1, 7, 130_000, True), (1, 8, 130_001, True), (2, 0, 0, False), (2, 1, 1, True)])


def circuit_breaker(spark, d):
    return P.breaker(CALLS.df(spark))


PATHS = Fixture("paths", "ord int, path string", [(i, f"f{i:02d}.ts") for i in range(30)])
TASKS = Fixture("tasks", "step int, paths array<string>", [(1, []), (2, ["f09.ts", "gone.ts"]), (3, []), (4, [])])


def review_file_assignment(spark, d):
    return P.assign_files(TASKS.df(spark), PATHS.df(spark))


LOADS = Fixture("loads", "worker int, load_ms bigint", [(0, 30_000), (1, 45_000), (2, 0)])


def worker_utilisation(spark, d):
    return P.utilisation(LOADS.df(spark))


QUERIES = {f.__name__: f for f in (
    plan_edges, plan_analysis, plan_mermaid, ready_steps, plan_progress, order_progress, plan_progress_stateless, plan_select_steps, affected_files, version_diff, version_prune, version_range, version_rollback,
    plan_list, plan_tag_overlap, plan_upsert, plan_insert, approvals_latest, plan_summary, plan_coerce, step_state_machine, circuit_breaker, review_file_assignment, worker_utilisation,
)}
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in P.STATUSES)
_PROGRESS = f"count(*) AS total, {_COUNTS}, CAST(floor(count(*) FILTER (status IN ('completed', 'skipped')) * 100 / count(*) + 0.5) AS BIGINT) AS percentage, CASE WHEN bool_and(status IN ('completed', 'skipped', 'failed')) AND bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('completed', 'skipped', 'failed')) THEN 'completed' ELSE 'executing' END AS overall"
_V = "v AS (SELECT conv_id AS plan_id, turn AS version, CAST(i - 1 AS INTEGER) AS step, string_split(text, ' ')[i] AS body FROM (SELECT *, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations))"
ORACLES = {
    "plan_edges": ctes(STEPS) + """, e AS (SELECT plan_id, unnest(depends_on) AS a, step AS b, step AS s, 0 AS k, unnest(range(len(depends_on))) AS p FROM steps UNION ALL SELECT plan_id, step, unnest(blocks), step, 1, unnest(range(len(blocks))) FROM steps),
f AS (SELECT plan_id, a, b, min((s, k, p)) AS o FROM e WHERE (plan_id, a) IN (SELECT plan_id, step FROM steps) AND (plan_id, b) IN (SELECT plan_id, step FROM steps) GROUP BY ALL)
SELECT plan_id, a AS "from", b AS "to", CAST(row_number() OVER (PARTITION BY plan_id ORDER BY o) AS INTEGER) AS ord FROM f""",
    "ready_steps": ctes(STEPS, STATES) + """, p AS (SELECT * FROM steps JOIN (SELECT plan_id, step FROM states WHERE status = 'pending') USING (plan_id, step)), x AS (SELECT plan_id, step, unnest(CASE WHEN len(depends_on) = 0 THEN [NULL] ELSE depends_on END) AS o FROM p),
j AS (SELECT x.plan_id, x.step, x.o, s.status FROM x LEFT JOIN states s ON s.plan_id = x.plan_id AND s.step = x.o)
SELECT plan_id, step, CASE WHEN bool_or(coalesce(status = 'failed', false)) THEN 'blocked' WHEN bool_and(o IS NULL OR coalesce(status IN ('completed', 'skipped'), false)) THEN 'ready' ELSE 'pending' END AS status FROM j GROUP BY plan_id, step""",
    "plan_progress": ctes(STATES) + f" SELECT plan_id, {_PROGRESS} FROM states GROUP BY plan_id",
    "order_progress": f"WITH s AS (SELECT o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status FROM orders) SELECT priority, {_PROGRESS} FROM s GROUP BY priority",
    "plan_progress_stateless": ctes(STEPS) + " SELECT plan_id, c AS completed, r AS ready, t - c - r AS blocked, t - c AS pending FROM (SELECT plan_id, count(*) AS t, count(*) FILTER (step IN (1, 2)) AS c, count(*) FILTER (step NOT IN (1, 2) AND len(list_filter(depends_on, lambda x: x NOT IN (1, 2))) = 0) AS r FROM steps GROUP BY plan_id)",
    "plan_select_steps": ctes(STATES) + " SELECT plan_id, step FROM states WHERE status NOT IN ('completed', 'skipped') QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY step) <= 2",
    "affected_files": ctes(STEPS) + """, f AS (SELECT DISTINCT plan_id, unnest(coalesce(modify, []) || coalesce("create", []) || coalesce("delete", [])) AS file FROM steps) SELECT plan_id, string_agg(file, ',' ORDER BY file) AS files, count(*) AS n FROM f WHERE file <> '' GROUP BY plan_id""",
    "version_diff": f"WITH {_V}, a AS (SELECT * FROM v WHERE version = 0), b AS (SELECT * FROM v WHERE version = 2) SELECT coalesce(a.plan_id, b.plan_id) AS plan_id, coalesce(a.step, b.step) AS step, CASE WHEN a.step IS NULL THEN 'added' WHEN b.step IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.plan_id = b.plan_id AND a.step = b.step WHERE a.step IS NULL OR b.step IS NULL OR a.body IS DISTINCT FROM b.body",
    "version_prune": "SELECT conv_id AS plan_id, turn AS version FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "version_range": ctes(HISTORY) + " SELECT * FROM history WHERE created_at BETWEEN '2024-01-02T00:00:00Z' AND '2024-01-03T00:00:00Z' QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY version DESC) <= 1",
    "version_rollback": ctes(HISTORY) + " SELECT * FROM history UNION ALL SELECT plan_id, CAST((SELECT max(version) FROM history WHERE plan_id = 1) + 1 AS INTEGER), '2024-02-01T00:00:00Z', 'rolled_back' FROM history WHERE plan_id = 1 AND version = 1",
    "plan_list": ctes(PLANS) + " SELECT plan_id, name FROM plans WHERE status = 'ready' ORDER BY lower(name), plan_id LIMIT 2",
    "plan_tag_overlap": ctes(PLANS) + " SELECT plan_id FROM plans WHERE list_has_any(tags, ['db', 'zz'])",
    "plan_insert": ctes(PLANS, NEW) + " SELECT * EXCLUDE (tags) FROM plans UNION ALL SELECT * EXCLUDE (tags) FROM new n WHERE NOT EXISTS (SELECT 1 FROM plans p WHERE p.plan_id = n.plan_id OR lower(p.name) = lower(n.name))",
    "approvals_latest": ctes(REQUESTS, RESPONSES) + ", s AS (SELECT r.*, coalesce(x.decision, 'pending') AS s FROM requests r LEFT JOIN (SELECT request_id, arg_max(decision, at_ms) AS decision FROM responses GROUP BY request_id) x USING (request_id)) SELECT request_id, plan_id, step, CASE WHEN s = 'pending' AND bool_or(step IS NULL AND s = 'approved') OVER (PARTITION BY plan_id) THEN 'approved' ELSE s END AS status FROM s",
    "plan_summary": ctes(GOALS) + " SELECT plan_id, CASE WHEN length(goal) > 100 THEN substr(goal, 1, 97) || '...' ELSE goal END AS goal, CASE WHEN questions > 0 THEN 'needs_clarification' ELSE 'ready' END AS status, CASE WHEN n_steps = 0 THEN '0 hours' WHEN n_steps <= 3 THEN '2-4 hours' WHEN n_steps <= 6 THEN '4-8 hours' WHEN n_steps <= 10 THEN '1-2 days' ELSE '2+ days' END AS effort FROM goals",
    "worker_utilisation": ctes(LOADS) + " SELECT least(1.0::DOUBLE, sum(load_ms) / (count(*) * 60000)) AS utilisation FROM loads",
}
