"""Versions, bindings, assignments, rollout and retention as relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Times of the control loop, in seconds.
BUILD_TIMEOUT, BACKOFF, UNMOUNT_BACKOFF = 1800, (1.0, 30.0), (0.5, 5.0)
#: Ids in a list that meets other lists as a whole.
LIST_IDS = 65_536
HOLDING = ["building", "ready", "active", "failed"]


def selector_matches(selector: Column, labels: Column) -> Column:
    """``selector``: map of wanted labels; null or empty matches everything, a null value nothing (malformed)."""
    wanted = F.forall(F.map_entries(selector), lambda e: F.coalesce(F.element_at(labels, e["key"]) == e["value"], F.lit(False)))
    return F.when(selector.isNull(), F.lit(True)).otherwise(wanted)


def requirement_matches(labels: Column, key: str, operator: str, values: list[str] | None = None) -> Column:
    """One set-based requirement: In, NotIn, Exists, DoesNotExist."""
    v = F.element_at(labels, F.lit(key))
    if operator == "In":
        return F.coalesce(v.isin(values or []), F.lit(False))
    if operator == "NotIn":
        return ~F.coalesce(v.isin(values or []), F.lit(False))
    if operator == "Exists":
        return F.array_contains(F.map_keys(labels), key)
    if operator == "DoesNotExist":
        return ~F.array_contains(F.map_keys(labels), key)
    return F.lit(False)


def active_versions(versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Active versions with their dataset's prefix and labels; without a dataset the row is left out."""
    return versions.where("state = 'active'").join(datasets, "dataset")


def assignments(nodes: DataFrame, datasets: DataFrame, bindings: DataFrame) -> DataFrame:
    """``node, dataset`` pairs: the union over bindings that match the node, or every dataset if none does.

    ``nodes(node, labels)``, ``datasets(dataset, dataset_labels)``,
    ``bindings(binding, node_selector, dataset_selector)``.  Selectors are
    expanded to their first label, so nodes and datasets meet bindings by
    equi-joins; selectors without labels match all by definition.

    Nodes matched by the same bindings form a class, and so do datasets: classes
    that share a binding are paired, and pairs of rows are only made when they are
    read.  So no pair is shuffled or compared with another.
    """
    def classes(side: DataFrame, labels: str, selector: str, name: str) -> DataFrame:
        """Each ``name`` with the sorted set of bindings that match any row of it, which may be empty."""
        own = side.select(name, labels)
        picked = bindings.select("binding", F.col(selector).alias("sel"), F.coalesce(F.map_entries(selector)[0], F.lit(None)).alias("one"))
        every = picked.where("sel is null or cardinality(sel) = 0").agg(F.collect_set("binding").alias("every"))
        some = picked.where("cardinality(sel) > 0")
        exploded = own.select(name, labels, F.explode(labels).alias("lk", "lv"))
        hit = some.join(exploded, (F.col("one.key") == F.col("lk")) & (F.col("one.value") == F.col("lv"))).where(selector_matches(F.col("sel"), F.col(labels))).select(name, "binding")
        sets = hit.unionByName(own.select(name), allowMissingColumns=True).groupBy(name).agg(F.collect_set("binding").alias("own"))
        return sets.crossJoin(F.broadcast(every)).select(name, F.array_sort(F.array_union("own", "every")).alias(f"{name}_class"))

    on_node = classes(nodes, "labels", "node_selector", "node").where("cardinality(node_class) > 0")
    on_data = classes(datasets, "dataset_labels", "dataset_selector", "dataset").where("cardinality(dataset_class) > 0")
    a, b = (x.select(c).distinct().select(c, F.explode(c).alias("binding")) for x, c in ((on_node, "node_class"), (on_data, "dataset_class")))
    first = F.array_min(F.array_intersect("node_class", "dataset_class"))  # classes that share several bindings meet once
    pairs = a.join(b, "binding").where(F.col("binding") == first).select("node_class", "dataset_class")

    cuts = {name: max(least, -(-side.count() // LIST_IDS)) for name, side, least in (("node", nodes, 4), ("dataset", datasets, 16))}

    def lists(rows: DataFrame, name: str) -> DataFrame:
        """Ids by class (if there is one) and cut, as lists."""
        cut = F.pmod(F.xxhash64(name), F.lit(cuts[name])).alias(f"{name}_cut")
        return rows.groupBy(*[c for c in rows.columns if c != name], cut).agg(F.collect_list(F.struct(name)).alias(f"{name}s"))

    def crossed(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        """All pairs of ids whose lists agree in ``by``, cell by cell of (node cut, dataset cut)."""
        cell = [*by, "node_cut", "dataset_cut"]
        tasks = min(10_000, 4 * cuts["node"] * cuts["dataset"])  # a number that is asked for is not lowered for lists being short
        every = {name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(f"{name}_cut") for name, n in cuts.items()}
        met = left.select("*", every["dataset"]).repartition(tasks, *cell).join(right.select("*", every["node"]).repartition(tasks, *cell), cell)
        # generated code would hold all pairs of two lists before it gives one away; an explode of a transform is not compiled and gives them one by one
        one = met.select("datasets", F.explode(F.transform("nodes", lambda x: x["node"])).alias("node"))
        return one.select("node", F.explode(F.transform("datasets", lambda x: x["dataset"])).alias("dataset"))

    bound = crossed(lists(on_node, "node").join(pairs, "node_class").drop("node_class"), lists(on_data, "dataset"), "dataset_class")
    free = nodes.select("node").join(on_node.select("node"), "node", "left_anti")
    return bound.unionByName(crossed(lists(free, "node"), lists(datasets.select("dataset"), "dataset")))


def with_gone_nodes(assigned: DataFrame, known: DataFrame, present: DataFrame) -> DataFrame:
    """Assignment lists by node; a known node that is not present any more gets an empty list."""
    lists = assigned.groupBy("node").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
    gone = known.join(present, "node", "left_anti").select("node", F.array().cast("array<string>").alias("datasets"))
    return lists.unionByName(gone)


def latest(reports: DataFrame, key: str, order: list) -> DataFrame:
    """The last report of each key."""
    return reports.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def rollout(nodes: DataFrame, states: DataFrame, versions: DataFrame) -> DataFrame:
    """Nodes by convergence for each ``versions(dataset, version_id)``.

    ``states(node, dataset, version_id, phase)`` is the latest report; a node
    without an entry is pending.  Counted from the states alone and the number of
    nodes, so nodes and versions are never crossed.
    """
    total = nodes.select("node").distinct()
    s = states.join(total, "node", "left_semi")
    failed = s.where("phase = 'error'").groupBy("dataset").agg(F.count("*").alias("error"))
    active = s.where("phase = 'active'").groupBy("dataset", "version_id").agg(F.count("*").alias("converged"))
    zero = F.lit(0).cast("long")
    counts = versions.join(failed, "dataset", "left").join(active, ["dataset", "version_id"], "left").select(
        "dataset", "version_id", F.coalesce("error", zero).alias("error"), F.coalesce("converged", zero).alias("converged")
    )
    n = total.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(n)).withColumn("pending", F.col("total") - F.col("error") - F.col("converged"))


def drained(nodes: DataFrame, states: DataFrame, versions: DataFrame) -> DataFrame:
    """Whether every node has reported and none holds the version."""
    reported = states.select("node").distinct()
    silent = nodes.select("node").join(reported, "node", "left_anti").agg((F.count("*") > 0).alias("silent"))
    held = states.select("dataset", "version_id").distinct().withColumn("held", F.lit(True))
    return versions.join(held, ["dataset", "version_id"], "left").crossJoin(F.broadcast(silent)).select(
        *versions.columns, (~F.col("silent") & F.col("held").isNull()).alias("drained")
    )


def retirable(versions: DataFrame, attachments: DataFrame) -> DataFrame:
    """Retired versions whose volume is attached nowhere."""
    return versions.where("state = 'retired'").join(attachments.select("volume").distinct(), "volume", "left_anti")


def touched_by(attachments: DataFrame, versions: DataFrame) -> DataFrame:
    """Retired versions to look at again after attachment events on their volume."""
    return versions.where("state = 'retired'").join(attachments.select("volume"), "volume", "left_semi")


def retention_excess(versions: DataFrame, keep: int) -> DataFrame:
    """The oldest retired versions of each dataset beyond ``keep``; none if keep is not positive."""
    retired = versions.where("state = 'retired'")
    if keep <= 0:
        return retired.limit(0)
    newest = Window.partitionBy("dataset").orderBy(F.desc("created"), F.desc("version_id"))
    return retired.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") > keep).drop("_r")


def version_number(version_id: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(version_id, "^v(\\d{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def next_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """The version to create for each dataset that has none building, ready, active or failed."""
    high = versions.groupBy("dataset").agg(F.max(version_number(F.col("version_id"))).alias("top"))
    need = datasets.join(versions.where(F.col("state").isin(HOLDING)).select("dataset").distinct(), "dataset", "left_anti")
    return need.join(high, "dataset", "left").select("dataset", F.concat(F.lit("v"), F.coalesce("top", F.lit(0)) + 1).alias("version_id"))


def promoted(versions: DataFrame) -> DataFrame:
    """States after promotion: the latest ready version becomes active and retires the others that were ready or active."""
    ready = F.max(F.when(F.col("state") == "ready", F.struct("created", "version_id"))).over(Window.partitionBy("dataset"))
    mine = F.struct("created", "version_id") == F.col("_win")
    out = versions.withColumn("_win", ready)
    state = F.when(F.col("_win").isNull(), F.col("state")).when(mine, "active").when(F.col("state").isin("active", "ready"), "retired").otherwise(F.col("state"))
    return out.withColumn("state", state).drop("_win")


def active_of(versions: DataFrame) -> DataFrame:
    return versions.where("state = 'active'").groupBy("dataset").agg(F.max_by("version_id", F.struct("created", "version_id")).alias("active_version"))


# Moves of a version's state.
VERSION_STEPS = {
    ("building", "done"): "ready", ("building", "fail"): "failed", ("ready", "promote"): "active", ("active", "retire"): "retired", ("retired", "drop"): "deleted",
}


def fold_version(events: DataFrame, timeout: int = BUILD_TIMEOUT) -> DataFrame:
    """Last state of each ``version`` after its ``events(version, seq, at, event)``, and the states passed.

    start: "" to building; done: building to ready; promote: ready to active;
    retire: active to retired; drop: retired to deleted; fail: building to
    failed.  A done or fail later than the timeout after the start is a failure.
    Other events change nothing.
    """
    def step(s, row):
        state, since = s
        if state == "building" and row[1] is not None and since is not None and (row[1] // 1_000_000 - since // 1_000_000) > timeout:
            return "failed", since
        if state == "" and row[0] == "start":
            return "building", row[1]
        return VERSION_STEPS.get((state, row[0]), state), since

    rows = events.select("version", "seq", "event", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    return _folded(rows, "version", ["event", "at"], ("", None), step, "state")


def _folded(rows: DataFrame, key: str, fields: list[str], start: tuple, step, name: str) -> DataFrame:
    """Last state of each key's rows in ``seq`` order and how often it changed.

    Rows stream through in sorted order (a sort spills), and one state is held, so
    a key may have any number of rows.
    """
    def run(batches):
        at, state, moves = None, start, 0
        done: list[tuple] = []
        for pdf in batches:
            for k, *row in zip(pdf[key], *(pdf[f] for f in fields)):
                if at is None or at[0] != k:
                    if at is not None:
                        done.append((at[0], state[0], moves))
                    at, state, moves = (k,), start, 0
                row = [None if isinstance(x, float) and x != x else int(x) if isinstance(x, (float, np.integer)) else x for x in row]
                after = step(state, row)
                moves += after[0] != state[0]
                state = after
            if done:
                yield pd.DataFrame(done, columns=[key, name, "moves"])
                done = []
        if at is not None:
            yield pd.DataFrame([(at[0], state[0], moves)], columns=[key, name, "moves"])

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.repartition(key).sortWithinPartitions(key, "seq")
    return dealt.mapInPandas(run, f"{key} {kind}, {name} string, moves long")


def generations(updates: DataFrame, key: str, order: list, content: Column) -> DataFrame:
    """Number of content changes up to each update; the first update counts, equal content does not."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(content).over(w)
    first = F.row_number().over(w) == 1
    changed = updates.withColumn("_c", F.when(first | ~content.eqNullSafe(before), 1).otherwise(0))
    return changed.withColumn("generation", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def upserted(current: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``change`` in place of those of equal keys."""
    return current.join(change.select(*keys), keys, "left_anti").unionByName(change)


def long_poll(state: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients to answer now: the generation is beyond the one they have."""
    return clients.join(state, "node").where("generation > seen")


def schedule_fires(due: DataFrame, versions: DataFrame) -> DataFrame:
    """Scheduled builds to start: none while a version is building; version id is the UTC time."""
    busy = versions.where("state = 'building'").select("dataset").distinct()
    return due.join(busy, "dataset", "left_anti").withColumn("version_id", F.date_format("at", "yyyyMMdd-HHmmss"))


def cron_field(text: str, low: int, high: int) -> set[int]:
    """Values of one field: ``*``, numbers, ranges ``a-b``, steps ``/n`` and lists of them."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if (step and (not step.isdigit() or int(step) == 0)) or not span:
            raise ValueError(f"bad step in {text!r}")
        a, dash, b = span.partition("-")
        if span == "*":
            first, last = low, high
        elif a.isdigit() and (not dash or b.isdigit()):
            first, last = int(a), int(b) if dash else (high if step else int(a))
        else:
            raise ValueError(f"bad field {text!r}")
        if not low <= first <= last <= high:
            raise ValueError(f"{part!r} is outside {low}-{high}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


# The ranges of minute, hour, day of month, month and day of week (0 and 7 are Sunday).
CRON_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def cron_due(expression: str, at: Column) -> Column:
    """Whether the five-field ``expression`` fires in the minute of ``at`` (UTC).

    If both day fields are restricted, either may match.
    """
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"a schedule has five fields: {expression!r}")
    minute, hour, day, month, week = (cron_field(f, *r) for f, r in zip(fields, CRON_RANGES))
    week = {d % 7 for d in week}
    in_day, in_week = F.dayofmonth(at).isin(sorted(day)), (F.dayofweek(at) - 1).isin(sorted(week))
    days = (in_day | in_week) if not fields[2].startswith("*") and not fields[4].startswith("*") else (in_day & in_week)
    return F.minute(at).isin(sorted(minute)) & F.hour(at).isin(sorted(hour)) & days & F.month(at).isin(sorted(month))


def due_schedules(schedules: DataFrame, clock: DataFrame) -> DataFrame:
    """``dataset, at`` of each ``schedules(dataset, cron)`` that fires at a minute of ``clock(at)``.

    The distinct expressions, few by nature, become one condition each.
    """
    crons = [r.cron for r in schedules.select("cron").distinct().collect()]
    out = None
    for c in crons:
        hits = clock.where(cron_due(c, F.col("at"))).select("at", F.lit(c).alias("cron"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return schedules.join(clock, F.lit(False)).select("dataset", "at")
    return schedules.join(out, "cron").select("dataset", "at")


def status_patches(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` that differ from ``current`` in any column or are new: what has to be written."""
    columns = [c for c in wanted.columns if c != key]
    old = current.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    same = F.col("_old").eqNullSafe(F.struct(*[F.col(c) for c in columns])) & F.col("_k").isNotNull()
    return wanted.join(old, wanted[key] == F.col("_k"), "left").where(~same).select(*wanted.columns)


def catch_up_delays(datasets: DataFrame) -> DataFrame:
    """Seconds to wait before each scheduled dataset's first build: its place in the list."""
    # as long as the list of datasets, which one control plane holds
    return datasets.withColumn("delay", F.row_number().over(Window.orderBy("dataset")) - 1)


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds before retry ``attempt`` (from 1): doubling from ``first`` up to ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62))), F.lit(most))


# Moves of a node's phase; assign starts anew from any.
NODE_MOVES = {("attaching", "attached"): "mounting", ("mounting", "mounted"): "active"}


def fold_node(events: DataFrame) -> DataFrame:
    """Last phase of each node after ``events(node, seq, event)`` of its reconcile loop.

    assign starts attaching from any phase but active of the same assignment;
    attached and mounted advance from the phase before; failed is an error.
    """
    def step(s, row):
        phase, event = s[0], row[0]
        if event == "failed":
            return ("error" if phase in ("attaching", "mounting") else phase,)
        return (NODE_MOVES.get((phase, event), "attaching" if event == "assign" else phase),)

    return _folded(events.select("node", "seq", "event"), "node", ["event"], ("",), step, "phase")
