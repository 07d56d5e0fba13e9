"""Plans: dependency graphs, progress, history, approvals, upserts, over tables of plans and steps.

steps(plan_id, step, depends_on array<int>, blocks array<int>) holds any number of plans; each graph is small, so a plan's
graph is one row of arrays where an order has to be followed, and joins and windows elsewhere.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(steps: DataFrame) -> DataFrame:
    """(plan_id, from, to, ord): dependencies that exist, then blocks that no dependency covers."""
    own = steps.select("plan_id", F.col("step").alias("known"))
    dep = steps.select("plan_id", F.col("step").alias("to"), F.posexplode("depends_on").alias("pos", "from")).select("plan_id", "from", "to", F.struct(F.col("to").alias("step"), F.lit(0).alias("kind"), "pos").alias("o"))
    blk = steps.select("plan_id", F.col("step").alias("from"), F.posexplode("blocks").alias("pos", "to")).select("plan_id", "from", "to", F.struct(F.col("from").alias("step"), F.lit(1).alias("kind"), "pos").alias("o"))
    both = dep.unionByName(blk).join(own.withColumnRenamed("known", "from"), ["plan_id", "from"], "left_semi").join(own.withColumnRenamed("known", "to"), ["plan_id", "to"], "left_semi")
    first = both.groupBy("plan_id", "from", "to").agg(F.min("o").alias("o"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy("o"))).drop("o")


def _order(nodes: list[int], out: dict[int, list[int]], degree: dict[int, int]) -> list[int]:
    """First-come order of nodes whose predecessors are done; nodes on a cycle never come."""
    left, queue, done = dict(degree), deque(n for n in nodes if not degree[n]), []
    while queue:
        done.append(n := queue.popleft())
        for m in out[n]:
            left[m] -= 1
            if not left[m]:
                queue.append(m)
    return done


def _analyse(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = [int(s) for s in pdf["step"]]
    own = set(nodes)
    arcs: dict[tuple[int, int], None] = {}
    for s, dep, blk in zip(pdf["step"], pdf["depends_on"], pdf["blocks"], strict=True):
        for d in dep if dep is not None else []:
            arcs.setdefault((int(d), int(s)))
        for b in blk if blk is not None else []:
            arcs.setdefault((int(s), int(b)))
    arcs = {a: None for a in arcs if a[0] in own and a[1] in own}
    out, degree = {n: [] for n in nodes}, dict.fromkeys(nodes, 0)
    for a, b in arcs:
        out[a].append(b)
        degree[b] += 1
    order = _order(nodes, out, degree)
    level, via = {n: 0 for n in order if not degree[n]}, {}
    for a in order:
        for b in out[a]:
            if b in degree and level[a] + 1 > level.get(b, -1):
                level[b], via[b] = level[a] + 1, a
    level = {n: level[n] for n in nodes if n in set(order)}
    path, at = [], max(level, key=lambda n: level[n], default=None)
    while at is not None:
        path.insert(0, at)
        at = via.get(at)
    groups = [[n for n in nodes if level.get(n) == k] for k in range(max(level.values(), default=-1) + 1)]
    row = (int(pdf["plan_id"].iloc[0]), order, path, [",".join(map(str, g)) for g in groups if len(g) > 1], [n for n in nodes if n not in level])
    return pd.DataFrame([row], columns=["plan_id", "execution_order", "critical_path", "parallel_groups", "cyclic"])


def analyse(steps: DataFrame) -> DataFrame:
    """(plan_id, execution_order, critical_path, parallel_groups, cyclic) of each plan.

    The order is first come, first served; the critical path is the first of the longest; a group is a level with two or
    more steps. Steps on or behind a cycle are in none of them but in `cyclic`.
    """
    schema = "plan_id int, execution_order array<int>, critical_path array<int>, parallel_groups array<string>, cyclic array<int>"
    return steps.groupBy("plan_id").applyInPandas(lambda pdf: _analyse(pdf.sort_values("step")), schema)


def readiness(steps: DataFrame, states: DataFrame) -> DataFrame:
    """(plan_id, step, status) of pending steps after an update: ready if all dependencies are completed or skipped,
    blocked if one failed, else pending. An unknown dependency keeps a step pending."""
    pending = steps.join(states.where("status = 'pending'").select("plan_id", "step"), ["plan_id", "step"], "left_semi")
    dep = pending.select("plan_id", "step", F.explode_outer("depends_on").alias("on"))
    met = dep.join(states.select("plan_id", F.col("step").alias("on"), "status"), ["plan_id", "on"], "left")
    g = met.groupBy("plan_id", "step").agg(
        F.bool_or(F.coalesce(F.col("status") == "failed", F.lit(False))).alias("failed"),
        F.bool_and(F.col("on").isNull() | F.coalesce(F.col("status").isin("completed", "skipped"), F.lit(False))).alias("done"),
    )
    return g.select("plan_id", "step", F.when(F.col("failed"), "blocked").when(F.col("done"), "ready").otherwise("pending").alias("status"))


STATUSES = ["completed", "failed", "skipped", "in_progress", "blocked", "ready", "pending"]


def progress(states: DataFrame) -> DataFrame:
    """(plan_id, total, one count for each status, percentage, overall) of each plan."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    done = count("completed", "skipped")
    over = count("completed", "skipped", "failed") == F.count("*")
    return states.groupBy("plan_id").agg(
        F.count("*").alias("total"),
        *(count(s).alias(s) for s in STATUSES),
        F.floor(done * 100 / F.count("*") + 0.5).cast("long").alias("percentage"),
        F.when(over & (count("failed") > 0), "failed").when(over, "completed").otherwise("executing").alias("overall"),
    )


def stateless_progress(steps: DataFrame, completed: list[int]) -> DataFrame:
    """(plan_id, completed, ready, blocked, pending) for a set of completed steps."""
    done = F.array(*map(F.lit, completed)) if completed else F.array().cast("array<int>")
    is_done = F.array_contains(done, F.col("step"))
    ready = ~is_done & (F.size(F.array_except("depends_on", done)) == 0)
    g = steps.groupBy("plan_id").agg(F.count("*").alias("total"), F.count_if(is_done).alias("completed"), F.count_if(ready).alias("ready"))
    return g.select("plan_id", "completed", "ready", (F.col("total") - F.col("completed") - F.col("ready")).alias("blocked"), (F.col("total") - F.col("completed")).alias("pending"))


def select_steps(states: DataFrame, mode: str, step: int | None = None, most: int = 5) -> DataFrame:
    """Steps to run: one by number, all that are ready, or every open one; at most `most` of a plan."""
    if mode == "single_step":
        return states.where(F.col("step") == step)
    wanted = states.where(F.col("status") == "ready") if mode == "all_ready" else states.where(~F.col("status").isin("completed", "skipped"))
    return wanted.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id").orderBy("step"))).where(F.col("_n") <= most).drop("_n")


def affected_files(steps: DataFrame) -> DataFrame:
    """(plan_id, files, n): different files that steps modify, create or delete."""
    every = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("modify", "create", "delete")))
    return steps.select("plan_id", F.explode(every).alias("file")).where("file <> ''").groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"), F.countDistinct("file").alias("n"))


def version_diff(versions: DataFrame, old: int, new: int) -> DataFrame:
    """(plan_id, step, change): steps added, removed or modified between two versions(plan_id, version, step, body)."""
    a = versions.where(F.col("version") == old).select("plan_id", "step", F.col("body").alias("_a"), F.lit(True).alias("_in_a"))
    b = versions.where(F.col("version") == new).select("plan_id", "step", F.col("body").alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, ["plan_id", "step"], "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select("plan_id", "step", change.alias("change")).where("change is not null")


def prune(versions: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` versions of each plan."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("version").desc()))).where(F.col("_n") <= keep).drop("_n")


def history(versions: DataFrame, since=None, until=None, last: int | None = None) -> DataFrame:
    """Versions from `since` to `until`, both included, the last `last` of each plan."""
    v = versions
    if since is not None:
        v = v.where(F.col("created_at") >= since)
    if until is not None:
        v = v.where(F.col("created_at") <= until)
    return prune(v, last) if last else v


def rollback(versions: DataFrame, plan_id: int, to: int, at: Column) -> DataFrame:
    """versions with a copy of version `to` of one plan as its next version."""
    own = versions.where(F.col("plan_id") == plan_id)
    top = own.agg(F.max("version").alias("_top"))
    copy = own.where(F.col("version") == to).join(F.broadcast(top))
    copy = copy.withColumn("version", F.col("_top") + 1).withColumn("change_type", F.lit("rolled_back")).withColumn("created_at", at).drop("_top")
    return versions.unionByName(copy.select(*versions.columns))


def list_plans(plans: DataFrame, status: str | None = None, tags: list[str] | None = None, sort: str = "updated_at", descending: bool = True, most: int = 50) -> DataFrame:
    """Plans by status and by any of the tags, ordered by name (whatever the case), created_at or updated_at."""
    p = plans
    if status:
        p = p.where(F.col("status") == status)
    if tags:
        p = p.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    key = F.lower("name") if sort == "name" else F.col(sort)
    return p.orderBy(key.desc() if descending else key.asc(), "plan_id").limit(most)


def upsert(plans: DataFrame, new: DataFrame, overwrite: bool) -> DataFrame:
    """plans with new ones; an old plan of the same id, or of the same name whatever the case, stays unless overwritten,
    and created_at stays in any case."""
    old = plans.select(F.col("plan_id").alias("_id"), F.lower("name").alias("_name"), F.col("created_at").alias("_created"))
    # two equi-joins: an OR would compare all pairs
    met = new.join(old, F.col("plan_id") == F.col("_id"), "left").unionByName(new.join(old, F.lower("name") == F.col("_name"), "left"))
    met = met.groupBy(*new.columns).agg(F.min("_id").alias("_id"), F.min("_created").alias("_created"))
    if not overwrite:
        return plans.unionByName(met.where("_id is null").select(*new.columns))
    put = met.withColumn("plan_id", F.coalesce("_id", "plan_id")).withColumn("created_at", F.coalesce("_created", "created_at")).select(*new.columns)
    return plans.join(put.select("plan_id"), "plan_id", "left_anti").select(*plans.columns).unionByName(put)


def approvals(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(plan_id, step, status) of each request by its latest response; an approved plan approves its steps.

    Requests without step are for the whole plan.
    """
    last = responses.groupBy("request_id").agg(F.max_by("decision", F.struct("at_ms", "decision")).alias("decision"))
    r = requests.join(last, "request_id", "left").withColumn("status", F.coalesce("decision", F.lit("pending")))
    whole = F.bool_or(F.col("step").isNull() & (F.col("status") == "approved")).over(Window.partitionBy("plan_id"))
    return r.select("request_id", "plan_id", "step", F.when(whole & (F.col("status") == "pending"), "approved").otherwise(F.col("status")).alias("status"))


def summary(plans: DataFrame) -> DataFrame:
    """(plan_id, goal, status, effort) of plans(plan_id, goal, questions, n_steps)."""
    n = F.col("n_steps")
    effort = F.when(n == 0, "0 hours").when(n <= 3, "2-4 hours").when(n <= 6, "4-8 hours").when(n <= 10, "1-2 days").otherwise("2+ days")
    return plans.select("plan_id", F.when(F.length("goal") > 100, F.concat(F.substring("goal", 1, 97), F.lit("..."))).otherwise(F.col("goal")).alias("goal"), F.when(F.col("questions") > 0, "needs_clarification").otherwise("ready").alias("status"), effort.alias("effort"))


def mermaid(steps: DataFrame) -> DataFrame:
    """(plan_id, graph): the dependency graph of each plan as Mermaid text."""
    node = steps.select("plan_id", F.lit(0).alias("k"), F.col("step").alias("a"), F.lit(0).alias("b"), F.format_string('    step_%d["%d. %s"]', "step", "step", F.regexp_replace(F.coalesce("title", F.lit("")), '"', "'")).alias("line"))
    arc = edges(steps).select("plan_id", F.lit(1).alias("k"), F.col("from").alias("a"), F.col("to").alias("b"), F.format_string("    step_%d --> step_%d", "from", "to").alias("line"))
    g = node.unionByName(arc).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "line"))).alias("ls"))
    return g.select("plan_id", F.concat(F.lit("graph TD\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("graph"))


PLAN = "struct<id string, goal string, confidence_score double, steps array<struct<id string, step_number int, title string, priority string, complexity string, change_type string, depends_on array<string>>>>"


def coerce(replies: DataFrame) -> DataFrame:
    """Typed steps (id, plan, confidence, step, step_id, title, priority, complexity, depends_on) of replies(id, reply).

    Missing or odd values get defaults: priority medium, complexity moderate, a confidence outside 0 to 1 is 0.5, ids are
    step_<n>, dependencies that are no numbers go.
    """
    p = replies.select("id", F.from_json("reply", PLAN).alias("p")).select("id", F.col("p.id").alias("plan"), F.col("p.confidence_score").alias("c"), F.posexplode("p.steps").alias("i", "s"))
    one_of = lambda c, values, other: F.when(c.isin(values), c).otherwise(F.lit(other))
    deps = F.filter(F.transform(F.coalesce("s.depends_on", F.array().cast("array<string>")), lambda x: F.try_to_number(x, F.lit("999999")).cast("int")), lambda x: x.isNotNull())
    return p.select(
        "id",
        "plan",
        F.when(F.col("c").between(0, 1), F.col("c")).otherwise(0.5).alias("confidence"),
        F.coalesce("s.step_number", F.col("i") + 1).alias("step"),
        F.coalesce("s.id", F.format_string("step_%d", F.col("i") + 1)).alias("step_id"),
        F.coalesce("s.title", F.lit("")).alias("title"),
        one_of(F.col("s.priority"), ["low", "medium", "high", "critical"], "medium").alias("priority"),
        one_of(F.col("s.complexity"), ["simple", "moderate", "complex"], "moderate").alias("complexity"),
        F.array_join(F.transform(deps, lambda x: x.cast("string")), ",").alias("depends_on"),
    )


def assign_files(steps: DataFrame, files: DataFrame) -> DataFrame:
    """(step, path): a step's own files that are in files(ord, path), or, without any, its slice of ceil(n / 12) files."""
    named = steps.select("step", F.explode("paths").alias("path")).join(files.select("path"), "path", "left_semi").select("step", "path")
    free = steps.join(named.select("step").distinct(), "step", "left_anti").select("step")
    n = files.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 12)).alias("k"))
    slot = files.join(F.broadcast(n)).select("path", (F.floor((F.row_number().over(Window.orderBy("ord")) - 1) / F.col("k")) + 1).cast("int").alias("step"))
    return named.unionByName(slot.join(free, "step", "left_semi").select("step", "path"))


_EVENTS = "plan_id int, step int, status string, retries int"


def step_states(steps: DataFrame, events: DataFrame, retries: int = 3) -> DataFrame:
    """(plan_id, step, status, retries) after events(plan_id, seq, step, event) in order of seq.

    init readies steps without open dependencies; start needs ready; complete readies those that waited; fail goes back to
    ready until `retries` failures, then blocks dependents; skip passes on along `blocks`. A plan's events are one group.
    """

    def run(key, plan: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        deps = {int(s): [int(d) for d in (x if x is not None else [])] for s, x in zip(plan["step"], plan["depends_on"], strict=True)}
        blocks = {int(s): [int(d) for d in (x if x is not None else [])] for s, x in zip(plan["step"], plan["blocks"], strict=True)}
        state, tries = dict.fromkeys(deps, "pending"), dict.fromkeys(deps, 0)

        def settle() -> None:
            for s in sorted(deps):
                if state[s] == "pending":
                    if any(state.get(d) == "failed" for d in deps[s]):
                        state[s] = "blocked"
                    elif all(state.get(d) in ("completed", "skipped") for d in deps[s]):
                        state[s] = "ready"

        def skip(s: int) -> None:
            todo = [s]
            while todo:
                if (x := todo.pop()) in state and state[x] not in ("skipped", "completed"):
                    state[x] = "skipped"
                    todo += blocks[x]

        for e, s in zip(log.sort_values("seq")["event"], log.sort_values("seq")["step"], strict=True):
            if e == "start" and state.get(s) == "ready":
                state[s] = "in_progress"
            elif e == "complete" and state.get(s) == "in_progress":
                state[s] = "completed"
            elif e == "fail" and state.get(s) == "in_progress":
                tries[s] += 1
                state[s] = "ready" if tries[s] < retries else "failed"
            elif e == "skip":
                skip(s)
            settle()
        return pd.DataFrame([(int(key[0]), s, state[s], tries[s]) for s in sorted(state)], columns=["plan_id", "step", "status", "retries"])

    return steps.groupBy("plan_id").cogroup(events.groupBy("plan_id")).applyInPandas(run, _EVENTS)


def breaker(events: DataFrame, failures: int = 3, reset_ms: int = 60_000, successes: int = 2) -> DataFrame:
    """(key, seq, state, allowed) of a circuit breaker after each event(key, seq, at_ms, ok) of a key, in order.

    Closed until `failures` in a row; open lets nothing through for reset_ms, then half open; `successes` in a row close it,
    any failure opens it again. What isn't allowed isn't recorded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, bad, good, since, rows = "closed", 0, 0, 0, []
        for key, seq, at, ok in pdf.sort_values("seq")[["key", "seq", "at_ms", "ok"]].itertuples(index=False):
            if state == "open" and at - since >= reset_ms:
                state, good = "half-open", 0
            allowed = state != "open"
            if allowed and ok:
                bad, good = 0, good + 1
                if state == "half-open" and good >= successes:
                    state, good = "closed", 0
            elif allowed:
                good, bad = 0, bad + 1
                if state == "half-open" or bad >= failures:
                    state, since = "open", at
            rows.append((int(key), int(seq), state, bool(allowed)))
        return pd.DataFrame(rows, columns=["key", "seq", "state", "allowed"])

    return events.groupBy("key").applyInPandas(run, "key int, seq int, state string, allowed boolean")


def assign_workers(tasks: Iterator[tuple[str, int]], workers: int) -> list[tuple[str, int]]:
    """(task, worker) of tasks (id, milliseconds), each to the worker with the least load; Spark's scheduler does this for
    jobs, here it is for plans of a few tasks."""
    load, out = [0] * workers, []
    for task, ms in tasks:
        w = min(range(workers), key=load.__getitem__)
        load[w] += ms
        out.append((task, w))
    return out


def utilisation(loads: DataFrame) -> DataFrame:
    """One row: the share of a minute that workers(load_ms) are busy, at most 1."""
    return loads.agg(F.least(F.lit(1.0), F.sum("load_ms") / (F.count("*") * 60_000)).alias("utilisation"))


def gantt(steps: DataFrame) -> DataFrame:
    """(plan_id, chart): the steps of each plan as a Mermaid gantt chart, a day each, after their first dependency."""
    title = F.substring(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("Step "), F.col("step").cast("string"))), 1, 20)
    after = F.when(F.size("depends_on") > 0, F.concat(F.lit("after step"), F.get("depends_on", F.lit(0)).cast("string"))).otherwise("a1")
    line = F.concat(F.lit("    "), title, F.lit(" :step"), F.col("step").cast("string"), F.lit(", "), after, F.lit(", 1d\n"))
    g = steps.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("ls"))
    head = "gantt\n    title Implementation Plan\n    dateFormat YYYY-MM-DD\n    excludes weekends\n\n    section All Steps\n"
    return g.select("plan_id", F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["line"]), "")).alias("chart"))


def approval_requests(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, step, type, status, summary): the pending requests of plans(plan_id, goal): one for the plan, and one for
    each of its steps."""
    whole = plans.select("plan_id", F.lit(None).cast("int").alias("step"), F.lit("full_plan").alias("type"), F.concat(F.lit("Approve plan: "), "goal").alias("summary"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Untitled"))
    each = steps.join(plans.select("plan_id"), "plan_id", "left_semi").select("plan_id", "step", F.lit("step").alias("type"), F.concat(F.lit("Approve step "), F.col("step").cast("string"), F.lit(": "), title).alias("summary"))
    return whole.unionByName(each).withColumn("status", F.lit("pending"))


def find_plans(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, plan_id): the plan of each asked(asked) id or name; an id comes before a name, whatever its case."""
    by_id = asked.join(plans, F.col("asked") == F.col("plan_id").cast("string")).select("asked", F.lit(0).alias("_o"), "plan_id")
    by_name = asked.join(plans, F.lower("asked") == F.lower("name")).select("asked", F.lit(1).alias("_o"), "plan_id")
    return by_id.unionByName(by_name).groupBy("asked").agg(F.min_by("plan_id", F.struct("_o", "plan_id")).alias("plan_id"))


def delete_plans(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """plans without those that `find_plans` finds."""
    return plans.join(find_plans(plans, asked).select("plan_id"), "plan_id", "left_anti")
