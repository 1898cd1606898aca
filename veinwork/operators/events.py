"""Event logs: density, folds by step, transitions, streaks, order and exactly-once audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density(log: DataFrame, sequence: str) -> DataFrame:
    """One row: how many events, how many numbers are missing or repeated, and whether 0 to n - 1 each occur once.

    No global sort: a dense sequence is one whose least is 0, largest n - 1 and whose numbers are distinct.
    """
    per = log.groupBy(sequence).agg(F.count("*").alias("n"))
    s = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.count("*").alias("n_numbers"), F.min(sequence).alias("first"), F.max(sequence).alias("last"))
    repeated = F.col("n_events") - F.col("n_numbers")
    missing = F.coalesce(F.greatest(F.col("last") + 1, F.col("n_events")) - F.col("n_numbers"), F.lit(0))
    return s.select("n_events", repeated.alias("repeated"), missing.alias("missing"), ((repeated == 0) & (missing == 0) & (F.coalesce("first", F.lit(0)) == 0)).alias("dense"))


def step_fold(log: DataFrame, step: str, sequence: str, kind: str, started: str, completed: str, failed: str) -> DataFrame:
    """Per step: attempts, status (completed stays completed after a later failure), resumed, first and last event."""
    k = F.col(kind)
    return log.groupBy(step).agg(
        F.count_if(k == started).alias("attempts"),
        F.when(F.bool_or(k == completed), "completed").when(F.bool_or(k == failed), "failed").otherwise("running").alias("status"),
        (F.count_if(k == started) > 1).alias("resumed"),
        F.min(sequence).alias("first_event"),
        F.max_by(kind, sequence).alias("last_kind"),
    )


def transition_audit(log: DataFrame, entity: str, sequence: str, state: str, allowed: DataFrame) -> DataFrame:
    """Steps from one state to the next that the table allowed(from_state, to_state) doesn't list."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(sequence))
    steps = log.select(entity, sequence, before.alias("from_state"), F.col(state).alias("to_state")).filter("from_state IS NOT NULL")
    return steps.join(allowed, ["from_state", "to_state"], "left_anti").select(entity, sequence, "from_state", "to_state")


def trailing_streak(log: DataFrame, entity: str, sequence: str, good: Column) -> DataFrame:
    """How many events stand behind each entity's last one that isn't good: two aggregates, no window."""
    marked = log.select(entity, sequence, good.alias("good"))
    last_bad = marked.groupBy(entity).agg(F.max(F.when(~F.col("good"), F.col(sequence))).alias("last_bad"))
    return marked.join(last_bad, entity).groupBy(entity).agg(F.count_if(F.col("last_bad").isNull() | (F.col(sequence) > F.col("last_bad"))).alias("streak"))


def order_check(log: DataFrame, entity: str, sequence: str, kind: str, first: str, then: str) -> DataFrame:
    """Entities whose first event of one kind doesn't precede the first of another, or that have none of the one."""
    k = F.col(kind)
    seen = log.groupBy(entity).agg(F.min(F.when(k == first, F.col(sequence))).alias("first_seq"), F.min(F.when(k == then, F.col(sequence))).alias("then_seq"))
    return seen.filter("then_seq IS NOT NULL AND (first_seq IS NULL OR first_seq > then_seq)")


def exactly_once(log: DataFrame, key: Sequence[str], kind: str, required: Sequence[str]) -> DataFrame:
    """Keys for which some required kind doesn't occur exactly once, with the counts."""
    counts = log.groupBy(*key).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in required))
    bad = None
    for k in required:
        bad = (F.col(f"n_{k}") != 1) if bad is None else bad | (F.col(f"n_{k}") != 1)
    return counts.filter(bad)


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, created: str, id_column: str, within_hours: float | None = None) -> DataFrame:
    """Each left row with the newest right row of the same keys created at or before its time; null if there is none.

    One union sorted by time within the keys, and the last right row so far: no pair of rows is ever made. Of right rows
    with equal times the one with the larger id counts. Ties with a left row count as before it.
    """
    order = F.struct(F.col("_t"), F.col("_side"), F.col("_id"))
    r = right.select(*keys, F.col(created).alias("_t"), F.lit(0).alias("_side"), F.col(id_column).alias("_id"), F.struct(F.col(id_column).alias("id"), F.col(created).alias("at")).alias("_r"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in left.columns))
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[id_column].dataType).alias("_id"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), *(F.col(c).alias(f"l_{c}") for c in left.columns))  # noqa: E741
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = r.unionByName(l).withColumn("m", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if within_hours is not None:
        fresh = F.unix_micros(F.col(f"l_{at}").cast("timestamp")) - F.unix_micros(F.col("m.at").cast("timestamp")) <= F.lit(int(within_hours * 3_600_000_000))
        found = found.withColumn("m", F.when(fresh, F.col("m")))
    return found.select(*(F.col(f"l_{c}").alias(c) for c in left.columns), F.col("m.id").alias("matched_id"), F.col("m.at").alias("matched_at"))


def first_match(rows: DataFrame, keys: Sequence[str], order: str, verdict: str) -> DataFrame:
    """For each key the verdict of its first row: an explicit rejection there stands against later approvals."""
    return rows.groupBy(*keys).agg(F.min_by(verdict, order).alias("verdict"), F.min(order).alias("decided_by"), F.count("*").alias("n_rows"))


def chain_breaks(nodes: DataFrame, run: str, place: str, parent: Column, identifier: Column) -> DataFrame:
    """Nodes whose parent isn't the node before them; the first node must have none."""
    before = F.lag("_id").over(Window.partitionBy(run).orderBy(place))
    marked = nodes.withColumn("_id", identifier).withColumn("_parent", parent)
    return marked.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col("_parent"))).select(run, place)


def missing_kinds(nodes: DataFrame, run: str, kind: str, required: DataFrame) -> DataFrame:
    """Required kinds (a small table) that a run doesn't have."""
    per_run = nodes.select(run).distinct().join(required)
    return per_run.join(nodes.select(run, kind).distinct(), [run, kind], "left_anti")


def config_changes(history: DataFrame, run: str, sequence: str, protected: Sequence[str]) -> DataFrame:
    """History rows in which a protected value differs from the run's first, with the names of those values."""
    first = history.groupBy(run).agg(*(F.min_by(p, sequence).alias(f"first_{p}") for p in protected))
    changed = F.array_compact(F.array(*(F.when(~F.col(p).eqNullSafe(F.col(f"first_{p}")), F.lit(p)) for p in protected)))
    return history.join(first, run).select(run, sequence, changed.alias("changed")).filter(F.size("changed") > 0)


def topological_depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and depth (longest path from a node without parents); raises on a cycle. edges: parent, child; nodes: node, position.

    A pass moves depths one edge on; there are as many as the longest path is long. Each level holds a node once,
    so a node with very many parents costs one maximum.
    """
    from veinwork.sources.tables import written

    depth = nodes.select("node", F.lit(0).alias("depth"))
    level, n, passes = depth, nodes.count(), 0
    while True:
        level = written(level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth")).distinct(), "depths")
        if level.isEmpty():
            break
        passes += 1
        if passes > n:
            raise ValueError("the graph has a cycle")
        depth = written(depth.unionByName(level).groupBy("node").agg(F.max("depth").alias("depth")), "depths")
    return depth.join(nodes, "node")
