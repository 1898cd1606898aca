"""Leakage-safe splits: whole groups, chosen by counts, and the invariants that any split must keep."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.qualify import non_unique


def seeded_order(*columns: Column | str, seed: int) -> Column:
    """A hash that orders rows by seed, the same whatever order they come in."""
    return F.sha2(F.concat_ws("~", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)), 256)


#: Sums that a subset search tells apart: exact for targets up to half as many rows, beyond that one set for each step.
STEPS = 1 << 18


def choose_subset(sizes: Mapping[str, int], target: int, seed: int, minimum: int = 1, max_groups: int | None = None) -> list[str]:
    """Whole groups, one at least and max_groups at most, whose sizes add up to minimum or more and as near to target
    as they can; of equally near sums the smaller, of equal sums the set that was reached first in the groups' seeded
    order. Nothing for a target of 0; an error where no set is allowed.

    sizes are group counts, one number for each group. The table of sums has STEPS rows at most, whatever the target.
    """
    if target <= 0:
        return []
    order = sorted(sizes, key=lambda g: hashlib.sha256(f"{seed}~{g}".encode()).hexdigest())
    chosen = _nearest_subset(sizes, order, target, minimum, None)
    if chosen and max_groups is not None and len(chosen) > max_groups:
        chosen = _nearest_subset(sizes, order, target, minimum, max_groups)
    if not chosen:
        raise ValueError(f"no set of whole groups has {minimum} rows or more")
    return sorted(chosen)


def _nearest_subset(sizes: Mapping[str, int], order: Sequence[str], target: int, minimum: int, most: int | None) -> list[str]:
    """With most, sets of different numbers of groups are kept apart."""
    top = 2 * max(target, minimum)
    step = -(-top // STEPS)
    reached: dict[tuple[int, int], tuple[int, str, tuple[int, int]]] = {(0, 0): (0, "", (0, 0))}  # sum, last group, what it was added to
    over: tuple[int, str, tuple[int, int]] | None = None  # the smallest sum above top
    for g in order:
        for key, (total, _, _) in sorted(reached.items(), key=lambda x: -x[1][0]):
            more = total + sizes[g]
            if most is not None and key[0] >= most:
                continue
            if more > top:
                if over is None or more < over[0]:
                    over = (more, g, key)
            else:
                reached.setdefault((key[0] + 1 if most is not None else 0, -(-more // step)), (more, g, key))
        if most is None and minimum <= target and reached.get((0, -(-target // step)), (0,))[0] == target:
            break
    allowed = [x for x in reached.values() if x[0] and x[0] >= minimum]
    best = min(allowed, key=lambda x: (abs(x[0] - target), x[0]), default=over)
    chosen = []
    while best and best[1]:
        chosen.append(best[1])
        best = reached[best[2]]
    return chosen


def pick_grouping(rows: DataFrame, fields: Sequence[str], least_groups: int) -> str:
    """The first field without blanks that has enough groups and not only single rows."""
    aggs = []
    for f in fields:
        aggs += [F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).alias(f"{f}_blank"), F.count_distinct(f).alias(f"{f}_groups")]
    got = rows.agg(F.count("*").alias("n"), *aggs).first()
    for f in fields:
        if not got[f"{f}_blank"] and least_groups <= got[f"{f}_groups"] < got["n"]:
            return f
    raise ValueError("no field groups the rows")


def assign(rows: DataFrame, group: str, targets: Mapping[str, int], rest: str, seed: int, minima: Mapping[str, int] | None = None) -> DataFrame:
    """rows with a column partition: each target in turn takes whole groups, the rest keeps what is left.
    A group stays for each later target and one for the rest; an error where a target's minimum, 1 by default, can't be met.

    Only group counts come to the driver; the assignment is joined back on the group.
    """
    left = {r[0]: r["count"] for r in rows.groupBy(group).count().collect()}
    placed = []
    for i, (name, target) in enumerate(targets.items()):
        groups = {k: v for k, v in left.items() if k is not None}
        later = sum(t > 0 for t in list(targets.values())[i + 1 :]) + (None not in left)
        if target > 0 and len(groups) <= later:
            raise ValueError(f"no group is left for {name}")
        for g in choose_subset(groups, target, seed, (minima or {}).get(name, 1), len(groups) - later):
            placed.append((g, name))
            left.pop(g)
    table = rows.sparkSession.createDataFrame(placed, f"{group} {rows.schema[group].dataType.simpleString()}, partition string")
    return rows.join(table, group, "left").withColumn("partition", F.coalesce("partition", F.lit(rest)))


def _take(left: dict[int, int], target: int, keep: int) -> dict[int, int]:
    """How many groups of each size to take, of those left (size to number), for a sum near target, leaving `keep` groups at least: of every size the target's share of
    all rows, then from the largest size down what still fits, then one group more if that comes nearer."""
    rows, groups = sum(s * n for s, n in left.items()), sum(left.values())
    taken = {s: min(n * target // rows, n) for s, n in left.items()}
    gap, free = target - sum(s * k for s, k in taken.items()), groups - keep - sum(taken.values())
    for s in sorted(left, reverse=True):
        more = max(0, min(gap // s, left[s] - taken[s], free))
        taken[s], gap, free = taken[s] + more, gap - s * more, free - more
    nearer = [s for s in left if taken[s] < left[s] and (s - gap < gap or not any(taken.values()))]
    if free > 0 and nearer:
        taken[min(nearer, key=lambda s: (abs(s - gap), s))] += 1
    return {s: k for s, k in taken.items() if k}


def assign_by_sizes(rows: DataFrame, group: str, targets: Mapping[str, int], rest: str, seed: int, minima: Mapping[str, int] | None = None) -> DataFrame:
    """rows with a column partition, whole groups together, for any number of groups: as assign, but what comes to the driver is the histogram of group
    sizes, at most about the square root of twice the rows. Which groups of a size are taken goes by their seeded order; they are numbered by range partitions.

    Every partition with a target gets one group at least and the rest keeps one; an error where that can't be, or where a partition falls below its minimum.
    The sum is not always the nearest that some set of groups has; with groups of size 1 it is the target. Rows with a null group go to the rest.
    """
    from veinwork.operators.ranks import numbered
    from veinwork.sources.tables import written

    sizes = written(rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")), "split-sizes")
    left = {r["_size"]: r["n"] for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    wanted = [(name, t) for name, t in targets.items() if t > 0]
    cuts, begin = [], dict.fromkeys(left, 0)
    for i, (name, target) in enumerate(wanted):
        keep = len(wanted) - i
        if sum(left.values()) < keep + 1:
            raise ValueError(f"no group is left for {name}")
        taken = _take(left, target, keep)
        got = sum(s * k for s, k in taken.items())
        if got < max(1, (minima or {}).get(name, 1)):
            raise ValueError(f"{name} has {got} rows, below its minimum")
        for s, k in taken.items():
            cuts.append((s, begin[s], begin[s] + k, name))
            begin[s] += k
            left[s] -= k
        left = {s: n for s, n in left.items() if n}
    ordered = numbered(sizes.withColumn("_order", seeded_order(group, seed=seed)), ["_size"], ["_order", group], name="_place")
    table = rows.sparkSession.createDataFrame(cuts, "_size long, _low long, _high long, partition string")
    placed = ordered.join(table, "_size").filter((F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_high"))).select(group, "partition")
    return rows.join(placed, group, "left").withColumn("partition", F.coalesce("partition", F.lit(rest)))


def hash_split(rows: DataFrame, group: Column, shares: Sequence[tuple[str, int]], seed: int) -> DataFrame:
    """rows with a column partition from the group's seeded hash: shares are parts of 100. No driver step, no shuffle."""
    slot = F.conv(F.substring(seeded_order(group, seed=seed), 1, 8), 16, 10).cast("long") % 100
    out, top = None, 0
    for name, share in shares[:-1]:
        top += share
        out = F.when(slot < top, name) if out is None else out.when(slot < top, name)
    return rows.withColumn("partition", out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0]))


def violations(split: DataFrame, record: str, group: str) -> DataFrame:
    """Records listed twice and groups that stand in more than one partition."""
    twice = non_unique(split, record).select(F.lit("record_repeated").alias("problem"), F.col(record).cast("string").alias("key"))
    torn = split.groupBy(group).agg(F.count_distinct("partition").alias("n")).filter("n > 1").select(F.lit("group_torn").alias("problem"), F.col(group).cast("string").alias("key"))
    return twice.unionByName(torn)


def summary(split: DataFrame, record: str, group: str) -> DataFrame:
    return split.groupBy("partition").agg(F.count("*").alias("n_records"), F.count_distinct(record).alias("n_distinct"), F.count_distinct(group).alias("n_groups"))


def against(split: DataFrame, manifest: DataFrame, record: str) -> DataFrame:
    """Ids of the manifest that the split misses, and ids of the split that the manifest doesn't know."""
    missing = manifest.join(split, record, "left_anti").select(F.lit("missing").alias("problem"), F.col(record).alias("record_id"))
    return missing.unionByName(split.join(manifest, record, "left_anti").select(F.lit("unknown").alias("problem"), F.col(record).alias("record_id")))
