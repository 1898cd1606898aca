"""Groups of any size, dealt into units of bounded size in which every pair of a group meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import growing


def in_units(members: DataFrame, key: list[str], number: str, home: Column, block: int) -> DataFrame:
    """The members of groups in which at least one is at home, once or more for every unit that needs them, with what they do there.

    A unit is (key, t, q): block t of a group's home members, which are looked for (target), and block q of all its members, which
    look for them (asking). A group of up to block members is one unit (t = q = 0), in which a home member is one row that does both; in a larger one
    each pair of a member and a home member meets in just one unit, of 2 * block rows on average. A block is chosen by a hash of number,
    so a hot group spreads over as many units as its size asks for. Groups of one member make none.
    """
    sizes = members.groupBy(*key).agg(F.count(F.when(home, 1)).alias("homes"), F.count("*").alias("all")).filter("homes > 0 AND all > 1")
    sizes = sizes.select(*key, F.ceil(F.col("homes") / block).cast("int").alias("ts"), F.ceil(F.col("all") / block).cast("int").alias("qs"))
    spread = members.join(growing(sizes), key)
    single, own = F.col("qs") == 1, lambda parts: F.pmod(F.xxhash64(F.col(number)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    does = lambda target, asking: (F.lit(target).alias("target") if isinstance(target, bool) else target.alias("target"), F.lit(asking).alias("asking"))
    zero = F.lit(0)
    whole = spread.filter(single).select(*members.columns, zero.alias("t"), zero.alias("q"), *does(home, True))
    targets = spread.filter(~single & home).select(*members.columns, own("ts").alias("t"), every("qs").alias("q"), *does(True, False))
    asking = spread.filter(~single).select(*members.columns, every("ts").alias("t"), own("qs").alias("q"), *does(False, True))
    return whole.unionByName(targets).unionByName(asking)
