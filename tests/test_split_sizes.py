"""Splits by the histogram of group sizes: whole groups, targets met, seeded, for very many groups."""

import pytest
from pyspark.sql import functions as F

from veinwork.operators import split
from veinwork.plans import catalogue


def sizes(df):
    return {r.partition: r.n for r in df.groupBy("partition").agg(F.count("*").alias("n")).collect()}


def test_a_hundred_thousand_groups(spark):
    """Groups of 1 to 7 rows: every target is met to the row, no group is torn, another seed deals otherwise, the order of rows plays no part."""
    rows = spark.range(100_000).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.pmod(F.xxhash64("id"), F.lit(7)) + 1)).alias("i"))
    n = rows.count()
    targets = {"initial": 1234, "test": n // 10, "validation": n // 3}
    got = split.assign_by_sizes(rows, "g", targets, "pool", 5)
    assert sizes(got) == targets | {"pool": n - sum(targets.values())}
    assert got.groupBy("g").agg(F.count_distinct("partition").alias("p")).filter("p > 1").isEmpty()
    again = split.assign_by_sizes(rows.repartition(7), "g", targets, "pool", 5)
    test = lambda df: df.filter("partition = 'test'").agg(F.sum(F.xxhash64("g").cast("decimal(38,0)"))).first()[0]
    assert test(got) == test(again) != test(split.assign_by_sizes(rows, "g", targets, "pool", 6))


def test_few_and_large_groups(spark):
    rows = spark.createDataFrame([(g, i) for g, n in (("a", 50), ("b", 30), ("c", 20), ("d", 1)) for i in range(n)] + [(None, 0)], "g string, i int")
    got = sizes(split.assign_by_sizes(rows, "g", {"initial": 10, "test": 25}, "pool", 1))
    assert sum(got.values()) == 102 and got["initial"] in (1, 20) and got["test"] in (20, 30) and got["pool"] >= 51
    with pytest.raises(ValueError, match="minimum"):
        split.assign_by_sizes(rows.filter("g = 'a' OR g = 'd'"), "g", {"initial": 2}, "pool", 1, {"initial": 40})
    with pytest.raises(ValueError, match="no group"):
        split.assign_by_sizes(rows.filter("g = 'a'"), "g", {"initial": 10}, "pool", 1)


def test_query_deals_whole_orders(spark):
    got = {r.partition: r for r in catalogue.QUERIES["split_by_sizes"](spark, "/root/testdata/sf0.001").collect()}
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    n = lines.count()
    assert sum(r.n_rows for r in got.values()) == n and sum(r.n_groups for r in got.values()) == lines.select("l_orderkey").distinct().count()
    for name, target in (("test", n // 10), ("validation", n // 10), ("pool", n // 2)):
        assert abs(got[name].n_rows - target) <= 1
