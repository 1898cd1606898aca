"""Exact ranks without one task that holds a whole group: range partitions of bounded size, counted and then numbered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.sources.tables import written


#: Rows of a group that one task's aggregate may hold.
LARGE = 1_000_000
#: Share of a group's rows on either side of a percentile's place that its bounds leave.
MARGIN = 0.001


def placed(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """rows in range partitions of their order, with the number of their partition (part); written, so that it stays.

    The last term of the order should tell equal rows apart, else they share a partition.
    """
    return written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranks")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], wanted: DataFrame | None = None, name: str = "place") -> DataFrame:
    """rows with their 0-based place in their group by order. Each partition numbers its own part of a group; the parts before it
    are counted beforehand, one row for each partition and group that it has. wanted: groups and places to keep.
    """
    at = placed(rows, [*by, *order])
    counts = at.groupBy("part", *by).agg(F.count("*").alias("n"))
    # A group's parts are the partitions that it reaches over, not its rows.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("before", before)
    if wanted is not None:
        cells = _with(cells, wanted, by).filter((F.col(name) >= F.col("before")) & (F.col(name) < F.col("before") + F.col("n"))).select("part", *by, "before").distinct()
    found = at.join(cells.select("part", *by, "before"), ["part", *by])
    mine = Window.partitionBy("part", *by).orderBy(*order)
    found = found.withColumn(name, F.row_number().over(mine) - 1 + F.col("before")).drop("part", "before")
    return found if wanted is None else _with(found, wanted, by, [name])


def _with(rows: DataFrame, wanted: DataFrame, by: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    keys = [*by, *more]
    return rows.join(wanted.distinct(), keys) if keys else rows.crossJoin(wanted.distinct())  # without groups, one or two places


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row per group with type-7 percentiles, exactly: name to share. Nulls are left out.

    Groups of up to LARGE rows are aggregated whole. For larger ones quantile sketches give bounds around each place; one scan counts the rows below
    the bounds, another the distinct values between them, a few thousandths of the rows, so what is shuffled doesn't grow with the rows.
    Where the counts show that a sketch missed its place, the group takes one shuffle of group and value by ranges.
    """
    v = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sizes = v.groupBy(*by).agg(F.count("*").alias("size"))
    large = written(sizes.filter(F.col("size") > LARGE), "large")
    whole = [F.percentile("v", q).alias(n) for n, q in shares.items()]
    if large.isEmpty():
        return v.groupBy(*by).agg(*whole)
    found = _bounded(v, by, large, shares)
    return v.join(large.select(*by), by, "left_anti").groupBy(*by).agg(*whole).unionByName(found) if by else found


def _bounded(v: DataFrame, by: Sequence[str], sizes: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """percentiles of the large groups in sizes, of which there is one for LARGE rows at most."""
    names, n = list(shares), F.col("_size")
    big = v.join(F.broadcast(sizes.withColumnRenamed("size", "_size")), list(by)) if by else v.crossJoin(F.broadcast(sizes.withColumnRenamed("size", "_size")))
    near = [x for q in shares.values() for x in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    sketch = big.groupBy(*by).agg(F.percentile_approx("v", near, int(4 / MARGIN)).alias("_near"))
    bounds = written(sketch.select(*by, *(F.col("_near")[i].alias(f"_{'high' if i % 2 else 'low'}{i // 2}") for i in range(len(near)))), "bounds")
    inside = big.join(F.broadcast(bounds), list(by)) if by else big.crossJoin(F.broadcast(bounds))
    low, high = ([F.col(f"_{side}{i}") for i in range(len(names))] for side in ("low", "high"))
    at = [(n - 1) * q for q in shares.values()]
    counts = inside.groupBy(*by, "_size").agg(*(F.count_if(F.col("v") < low[i]).alias(f"_below{i}") for i in range(len(names))), *(F.count_if(F.col("v") <= high[i]).alias(f"_upto{i}") for i in range(len(names))))
    fits = F.lit(True)
    for i in range(len(names)):
        fits = fits & (F.col(f"_below{i}") <= F.floor(at[i])) & (F.least(F.floor(at[i]) + 1, n - 1) < F.col(f"_upto{i}"))
    counts = written(counts.withColumn("_fits", fits), "bounds")
    which = F.array_compact(F.array(*(F.when(F.col("v").between(low[i], high[i]), F.lit(i)) for i in range(len(names)))))
    values = inside.select(*by, "v", F.explode(which).alias("_which")).groupBy(*by, "_which", "v").agg(F.count("*").alias("_n"))
    good = F.broadcast(counts.filter("_fits"))
    values = values.join(good, list(by)) if by else values.crossJoin(good)
    pick = lambda cols: F.element_at(F.array(*cols), F.col("_which") + 1)
    # A window holds the distinct values between two bounds.
    upto = F.sum("_n").over(Window.partitionBy(*by, "_which").orderBy("v")) + pick([F.col(f"_below{i}") for i in range(len(names))])
    values = values.select(*by, "_which", "v", pick(at).alias("_at"), "_size", (upto - F.col("_n")).alias("_first"), upto.alias("_end"))
    holds = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_end")), F.col("v")))
    two = values.groupBy(*by, "_which", "_at").agg(holds(F.floor("_at")).alias("x"), holds(F.least(F.floor("_at") + 1, n - 1)).alias("y"))
    value_at = F.col("x") + (F.col("y") - F.col("x")) * (F.col("_at") - F.floor("_at"))
    found = two.groupBy(*by).agg(*(F.max(F.when(F.col("_which") == i, value_at)).alias(name) for i, name in enumerate(names)))
    missed = counts.filter("NOT _fits").select(*by, F.col("_size").alias("size"))
    if missed.isEmpty():
        return found
    rest = v.join(missed.select(*by), list(by), "left_semi") if by else v
    return found.filter(found[names[0]].isNotNull()).unionByName(_ranked(rest, by, missed, shares))


def _ranked(v: DataFrame, by: Sequence[str], sizes: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    asked = sizes.select(*by, "size", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), ((F.col("size") - 1) * q).alias("at")) for n, q in shares.items()))).alias("x"))
    asked = asked.select(*by, F.col("x.name").alias("name"), F.col("x.at").alias("at"), F.floor("x.at").alias("low"), F.least(F.floor("x.at") + 1, F.col("size") - 1).alias("high"))
    places = asked.select(*by, F.explode(F.array("low", "high")).alias("place"))
    got = written(numbered(v.withColumn("tie", F.rand(7)), by, ["v", "tie"], places).select(*by, "place", "v"), "percentiles")
    both = asked.join(got.withColumnsRenamed({"place": "low", "v": "x"}), [*by, "low"]).join(got.withColumnsRenamed({"place": "high", "v": "y"}), [*by, "high"])
    value_at = F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.col("low"))
    return both.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, value_at)).alias(n) for n in shares))


def top(rows: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k rows with the highest score, of equal ones those with the smaller key, however large k is: the score at place k
    is looked up, and rows are filtered by it and by the key where scores tie."""
    if k <= 0:
        return rows.limit(0)
    held = written(rows.withColumn("_score", -score), "top")
    cut = numbered(held.select("_score", key), [], ["_score", key], rows.sparkSession.createDataFrame([(k - 1,)], "place long"))
    cut = cut.select(F.col("_score").alias("_cut"), F.col(key).alias("_key"))
    inside = (F.col("_score") < F.col("_cut")) | (F.col("_score") == F.col("_cut")) & (F.col(key) <= F.col("_key"))
    n = held.count()
    return held.drop("_score") if k >= n else held.join(F.broadcast(cut), inside).select(*rows.columns)  # the cut is one row
