"""The task graph as tables: edges, cycles, invalidation to a fixed point, and the status view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources import storage

STARTED = ("in_progress", "implemented", "verified")


def prerequisites(tasks: DataFrame) -> DataFrame:
    """(id, needs): a task's own dependencies and, for a child, its parent's."""
    own = tasks.select("id", F.explode("dependencies").alias("needs"))
    parents = tasks.select(F.col("id").alias("parent"), "dependencies")
    inherited = tasks.where("parent is not null").select("id", "parent").join(parents, "parent").select("id", F.explode("dependencies").alias("needs"))
    return own.unionByName(inherited).distinct()


def edges(tasks: DataFrame) -> DataFrame:
    """(id, needs) of prerequisites, and of each parent its children: what must be done first."""
    return prerequisites(tasks).unionByName(tasks.where("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("needs"))).distinct()


def cycles(tasks: DataFrame) -> DataFrame:
    """(id) of the tasks on a cycle, or that wait for one: what is left when tasks without open needs are taken away, round by round.

    The rounds are as many as the longest chain that ends; each writes the edges that are left,
    and the driver sees their number.
    """
    left = storage.held(edges(tasks), "edges")
    n = left.count()
    while n:
        waiting = left.select(F.col("id").alias("needs")).distinct()
        before, left = left, storage.held(left.join(waiting, "needs", "left_semi").select("id", "needs"), "edges")
        storage.delete_held(before)
        m = left.count()
        if m == n:
            break
        n = m
    return left.select("id").distinct()


def rule_errors(tasks: DataFrame, states: tuple[str, ...], gates: tuple[str, ...]) -> DataFrame:
    """(rule, id) of the tasks that break one: states, names, gates, dependencies, parents, blockers, prerequisites, children."""
    e = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), F.col("id"))
    ids = tasks.select(F.col("id").alias("other"), F.col("status").alias("other_status"), F.col("parent").alias("other_parent"))
    needs = prerequisites(tasks).join(ids, F.col("needs") == F.col("other"), "left").join(tasks.select("id", "status"), "id")
    kids = tasks.where("parent is not null").join(ids, F.col("parent") == F.col("other"), "left")
    started = F.col("status").isin(*STARTED)
    known_gates = F.array(*map(F.lit, gates))
    active = tasks.where("status = 'in_progress'").join(tasks.select(F.col("parent").alias("p")).dropna(), F.col("id") == F.col("p"), "left_anti")
    parts = [
        e(tasks.groupBy("id").count().where("count > 1"), "id repeated"),
        e(tasks.where(~F.coalesce(F.col("status").isin(*states), F.lit(False))), "invalid status"),
        e(tasks.where(F.coalesce(F.length("name"), F.lit(0)) == 0), "empty name"),
        e(tasks.where((F.size("required_gates") < 1) | (F.size(F.array_distinct("required_gates")) != F.size("required_gates")) | (F.size(F.array_except("required_gates", known_gates)) > 0) | ~F.array_contains("required_gates", "harness")), "gates"),
        e(needs.where("other is null or id = needs"), "dependency"),
        e(kids.where("other is null or parent = id or other_parent is not null"), "parent"),
        e(kids.where(started & ~F.coalesce(F.col("other_status").isin(*STARTED, "blocked"), F.lit(False))), "parent must be opened first"),
        e(tasks.where("status = 'blocked' and coalesce(length(trim(blocker)), 0) = 0"), "blocker"),
        e(needs.where(started & ~F.coalesce(F.col("other_status") == "verified", F.lit(False))), "unverified dependency"),
        e(kids.where((F.col("other_status") == "verified") & (F.col("status") != "verified")).select(F.col("other").alias("id")), "unverified child"),
        e(cycles(tasks), "dependency cycle"),
    ]
    if active.count() > 1:
        parts.append(e(active, "several leaf tasks are active"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def evidence_errors(tasks: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """(id, problem) of the verified tasks whose evidence doesn't hold: the first problem of each, null without one left out.

    tasks: id, status, required_gates, evidence (paths); records: rows of schemas.EVIDENCE_RECORD
    with their path. A record counts if its path is in the folder, it is the task's, passed with
    exit code 0, and says its command, time, output and the SHA-256 of the state it ran on; the
    records must cover all gates, on one state.
    """
    done = tasks.where("status = 'verified'").select("id", "required_gates", F.posexplode_outer("evidence").alias("i", "path"))
    parts = F.split("path", "/")
    inside = F.startswith("path", F.lit(f"{folder.rstrip('/')}/")) & ~F.array_contains(parts, "..")
    full = (
        (F.col("task_id") == F.col("id")) & (F.col("r.status") == "passed") & (F.col("exit_code") == 0) & (F.size("command") > 0) & (F.length("timestamp") > 0)
        & (F.length(F.trim("stdout")) > 0) & (F.length("snapshot_sha256") == 64)
    )
    met = done.alias("t").join(records.alias("r"), "path", "left").select("id", "required_gates", "path", "gate", "snapshot_sha256", F.coalesce(inside, F.lit(False)).alias("inside"), F.col("task_id").isNotNull().alias("there"), F.coalesce(full, F.lit(False)).alias("good"))
    some = F.col("path").isNotNull()
    told = met.groupBy("id", "required_gates").agg(
        F.bool_or(some & ~F.col("inside")).alias("outside"), F.bool_or(some & ~F.col("there")).alias("missing"), F.bool_or(some & F.col("there") & ~F.col("good")).alias("bad"),
        F.collect_set("gate").alias("gates"), F.count_distinct("snapshot_sha256").alias("states"),
    )
    problem = (
        F.when(F.col("outside"), "evidence outside its folder").when(F.col("missing"), "missing evidence").when(F.col("bad"), "unusable evidence")
        .when(F.size(F.array_except("required_gates", "gates")) > 0, "a gate without evidence").when(F.col("states") != 1, "evidence of several states")
    )
    return told.select("id", problem.alias("problem")).where("problem is not null")


def invalidate(tasks: DataFrame) -> DataFrame:
    """(id, status) when no started task lacks a verified prerequisite and no verified one has an unverified child.

    Each round writes what has to change because of the round before (blocked, or taken back to
    implemented) and what follows from that alone is looked at next. The rounds are as many as
    the graph is deep; the driver sees one count of each.
    """
    needs = storage.held(prerequisites(tasks), "needs")
    parents = tasks.where("parent is not null").select("id", "parent")
    base = tasks.select("id", "status")
    fresh = base.where("status is null or status <> 'verified'").select("id")  # not verified since the last round
    told: DataFrame | None = None  # (id, new) of all rounds
    while True:
        waiting = needs.join(fresh.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct().join(base.where(F.col("status").isin(*STARTED)).select("id"), "id", "left_semi").select("id", F.lit("blocked").alias("new"))
        open_kids = parents.join(fresh, "id", "left_semi").select(F.col("parent").alias("id")).distinct().join(base.where("status = 'verified'").select("id"), "id", "left_semi").select("id", F.lit("implemented").alias("new"))
        found = waiting.unionByName(open_kids).groupBy("id").agg(F.min("new").alias("new"))  # blocked before implemented
        if told is not None:  # what is blocked stays so
            known = told.groupBy("id").agg(F.min("new").alias("old"))
            found = found.join(known, "id", "left").where("old is null or new < old").select("id", "new")
        step = storage.held(found, "invalid")
        if step.isEmpty():
            break
        told = step if told is None else told.unionByName(step)
        fresh = step.join(base.where("status = 'verified'"), "id", "left_semi").select("id")
    if told is None:
        return base
    last = told.groupBy("id").agg(F.min("new").alias("new"))
    return base.join(last, "id", "left").select("id", F.coalesce("new", "status").alias("status"))


def status_view(tasks: DataFrame) -> DataFrame:
    """(milestone, id, standing, reasons) of the current milestone's tasks that aren't verified.

    The milestone is the active leaf's; else the first open one that was begun, or that could be, or
    the first. Standing: Active, Eligible task, Awaiting verification or Blocked. tasks has ``at``.
    """
    have_kids = tasks.select(F.col("parent").alias("id")).dropna().distinct()
    active = tasks.where("status = 'in_progress'").join(have_kids, "id", "left_anti").orderBy("at").select("id", F.coalesce("parent", "id").alias("milestone")).first()
    unmet = prerequisites(tasks).join(tasks.where("status <> 'verified'").select(F.col("id").alias("needs")), "needs", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("needs")).alias("waiting"))
    pending = tasks.where("parent is null and status <> 'verified'").join(unmet.select("id", "waiting"), "id", "left")
    begun = F.when(F.col("status").isin("in_progress", "implemented", "blocked"), 0).when(F.col("waiting").isNull(), 1).otherwise(2)
    chosen = pending.orderBy(begun, "at").select("id").first()
    if active is None and chosen is None:
        return tasks.select(F.col("id").alias("milestone"), "id", F.lit("").alias("standing"), F.array("id").alias("reasons")).limit(0)
    milestone = active["milestone"] if active is not None else chosen["id"]
    kids = tasks.where(F.col("parent") == milestone)
    rows = (tasks.where(F.col("id") == milestone) if kids.isEmpty() else kids).where("status <> 'verified'").join(unmet, "id", "left")
    current = tasks.where(F.col("id") == milestone).select("status", "blocker").first()
    reasons = F.array_compact(F.array(
        F.when(F.col("waiting").isNotNull(), F.concat(F.lit("waiting for "), F.array_join("waiting", ", "))),
        F.when((F.col("id") != milestone) & F.lit(current["status"] == "blocked"), F.concat(F.lit(f"{milestone}: "), F.lit(current["blocker"] or ""))),
        F.when(F.col("status") == "blocked", F.concat("id", F.lit(": "), F.coalesce("blocker", F.lit("")))),
        F.when(F.lit(active is not None) & (F.col("id") != (active["id"] if active is not None else "")), F.lit(f"after the active task {active['id'] if active is not None else ''}")),
    ))
    standing = F.when(F.size(reasons) > 0, "Blocked").when(F.col("status") == "in_progress", "Active").when(F.col("status") == "implemented", "Awaiting verification").otherwise("Eligible task")
    return rows.select(F.lit(milestone).alias("milestone"), "id", standing.alias("standing"), reasons.alias("reasons"))
