"""Data qualification: finite, range and uniqueness checks, histograms, exact and near duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row per check: name, violations, passed; a check is a condition that a bad row meets. One pass over the rows."""
    sums = rows.agg(*(F.count_if(bad).alias(name) for name, bad in checks.items()))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks)))
    return sums.select(listed.alias("x")).select("x.check_name", "x.violations", (F.col("x.violations") == 0).alias("passed"))


def non_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def histogram(rows: DataFrame, family: str, distinct: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.count_distinct(distinct).alias("n_distinct")] if distinct else [])
    return rows.groupBy(family).agg(*aggs)


def duplicates(rows: DataFrame, exact_key: Column, near_key: Column) -> DataFrame:
    """Rows beyond the first of each exact key, and those of each near key that are not exact duplicates.

    The exact keys are counted first; near keys are then summed over the exact ones, so each row is shuffled once.
    """
    exact = rows.select(exact_key.alias("exact"), near_key.alias("near")).groupBy("near", "exact").agg(F.count("*").alias("n"))
    near = exact.groupBy("near").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("exact_extra"))
    return near.agg(F.coalesce(F.sum("exact_extra"), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum(F.col("n") - 1 - F.col("exact_extra")), F.lit(0)).alias("near_duplicates"))


def rounded_key(array: Column, decimals: int) -> Column:
    """A hash of the numbers at that many decimals."""
    return F.sha2(F.array_join(F.transform(array, lambda x: F.format_string(f"%.{decimals}f", F.round(x.cast("double"), decimals) + 0.0)), ","), 256)


def drift(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one of two tables has, told apart by side; both empty means equal sets."""
    a = left.select(*keys).exceptAll(right.select(*keys)).withColumn("side", F.lit("left"))
    return a.unionByName(right.select(*keys).exceptAll(left.select(*keys)).withColumn("side", F.lit("right")))
