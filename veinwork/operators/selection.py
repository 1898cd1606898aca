"""Selection under a budget: seeded, by uncertainty, by distance, and through a gate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.scalars import all_finite, euclid
from veinwork.operators.ranks import top
from veinwork.operators.split import seeded_order
from veinwork.sources.tables import written


def random_select(pool: DataFrame, key: str, budget: int, seed: int) -> DataFrame:
    """budget rows by the seeded order of their ids, with their 0-based rank; each task keeps its own best only."""
    top = pool.select(key, seeded_order(key, seed=seed).alias("order_key")).orderBy("order_key", key).limit(budget)
    return ranked(top, [F.col("order_key"), F.col(key)])


def ranked(few: DataFrame, order: list[Column]) -> DataFrame:
    """A bounded table with a 0-based rank: its rows are the budget's, so one task may number them."""
    from pyspark.sql import Window

    return few.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def disagreement(members: DataFrame) -> DataFrame:
    """members: member_id, candidate_id, atom, k, value. Per candidate: mean and largest norm of the components'
    population deviation over the members, the members with a value that isn't finite, and whether it is invalid.
    """
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    parts = members.groupBy("candidate_id", "atom", "k").agg(F.stddev_pop(F.when(ok, F.col("value"))).alias("s"), F.collect_set(F.when(~ok, F.col("member_id"))).alias("bad"))
    atoms = parts.groupBy("candidate_id", "atom").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.flatten(F.collect_list("bad")).alias("bad"))
    out = atoms.groupBy("candidate_id").agg(F.avg("norm").alias("mean_disagreement"), F.max("norm").alias("max_disagreement"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))).alias("invalid_members"))
    return out.withColumn("invalid", F.size("invalid_members") > 0)


#: Rows that a pass brings to the driver at most, of which it takes as many picks as it can be sure of; passes between writes.
AHEAD, PASSES = 64, 8


def farthest_points(pool: DataFrame, key: str, vector: str, budget: int) -> DataFrame:
    """key, rank, distance: the row farthest from the centroid, then again and again the one farthest from all chosen.

    Ties go to the smaller id; the first distance is that to the centroid. A pass brings the AHEAD rows that are farthest
    from all chosen so far. Distances only shrink as rows are chosen, so the driver may go on choosing among them as
    long as the best is no nearer than the last of them was: whatever was left behind is nearer still. The distance to the nearest
    chosen row is carried along and written every PASSES passes, so a lost executor costs a few passes at most.
    """
    spark = pool.sparkSession
    state = written(pool.select(F.col(key).alias("k"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")), "farthest")
    means = state.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    picks: list[tuple] = []
    if means and budget > 0:
        center = euclid(F.col("v"), _literal([r.m for r in means]))
        first = state.select("k", "v", F.round(center, 12).alias("d")).orderBy(F.desc("d"), "k").first()
        picks, fresh, passes = [(first.k, 0, float(first.d))], [list(first.v)], 0
        while fresh and len(picks) < budget:
            nearer = [euclid(F.col("v"), _literal(v)) for v in fresh]
            known = [F.col("d")] if passes else []
            state = state.filter(~F.col("k").isin([k for k, *_ in picks[-len(fresh) :]])).withColumn("d", F.least(*known, *nearer) if len(known + nearer) > 1 else nearer[0])
            passes += 1
            if passes % PASSES == 0:
                state = written(state, "farthest")
            # Distances equal to 12 places are ties, so the order of summing decides nothing.
            near = [[-r.r, r.k, list(r.v), r.d] for r in state.select("k", "v", "d", F.round("d", 12).alias("r")).orderBy(F.desc("r"), "k").limit(AHEAD).collect()]
            bound = (near[-1][0], near[-1][1]) if len(near) == AHEAD else None
            fresh = []
            while near and len(picks) < budget:
                best = min(near, key=lambda x: (x[0], x[1]))
                if bound and (best[0], best[1]) > bound:
                    break
                picks.append((best[1], len(picks), float(best[3])))
                fresh.append(best[2])
                near.remove(best)
                for x in near:
                    d = math.sqrt(sum((p - q) ** 2 for p, q in zip(x[2], best[2], strict=True)))
                    if d < x[3]:
                        x[0], x[3] = -_rounded(d), d
    return spark.createDataFrame(picks, f"{key} {pool.schema[key].dataType.simpleString()}, rank int, distance double")


def _rounded(d: float) -> float:
    """As Spark rounds to 12 places: half up."""
    return float(Decimal(repr(d)).quantize(Decimal("1e-12"), ROUND_HALF_UP))


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def decision_gate(scored: DataFrame, key: str, score: str, invalid: str, vector: str, budget: int, fraction: float) -> DataFrame:
    """Drops invalid rows, keeps the max(budget, ceil(fraction * valid)) with the highest score, spreads the budget over them."""
    valid = scored.filter(~F.col(invalid))
    n = valid.count()
    if n < budget:
        raise ValueError(f"{n} valid candidates for a budget of {budget}")
    window = top(valid, F.round(score, 12), key, max(budget, math.ceil(fraction * n)))
    return farthest_points(window, key, vector, budget)


def mean_pairwise_distance(selected: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean distance of all pairs of a selection (bounded by its budget); 0 for one row."""
    a, b = selected.select(F.col(key).alias("a"), F.col(vector).alias("va")), selected.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(euclid(F.col("va"), F.col("vb"))), F.lit(0.0)).alias("mean_distance"))


def keyword_relevance(rows: DataFrame, key: str, text: Column, query: str, limit: int) -> DataFrame:
    """How many distinct query terms of more than two letters a text holds; the best by score, then id."""
    terms = sorted({t for t in query.lower().split() if len(t) > 2})
    low = F.lower(text)
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return rows.select(key, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(limit)


def selection_problems(selected: DataFrame, pool: DataFrame, key: str, budget: int) -> DataFrame:
    """What is wrong with a selection: its size, repeated ids, ids outside the pool."""
    repeated = selected.groupBy(key).count().filter("count > 1").select(F.lit("repeated").alias("problem"), F.col(key).cast("string").alias("key"))
    outside = selected.join(pool, key, "left_anti").select(F.lit("outside_pool").alias("problem"), F.col(key).cast("string").alias("key"))
    size = selected.agg(F.count("*").alias("n")).filter(F.col("n") != budget).select(F.lit("wrong_size").alias("problem"), F.col("n").cast("string").alias("key"))
    return repeated.unionByName(outside).unionByName(size)


def descriptor_problems(descriptors: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of another length than the rest, with values that aren't finite, or that occur twice."""
    size = descriptors.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)
    odd = descriptors.join(F.broadcast(size), F.size(vector) != F.col("size")).select(F.lit("dimension").alias("problem"), F.col(key).cast("string").alias("key"))
    bad = descriptors.filter(~all_finite(vector)).select(F.lit("not_finite").alias("problem"), F.col(key).cast("string").alias("key"))
    twice = descriptors.groupBy(F.sha2(F.array_join(F.col(vector).cast("array<string>"), ","), 256).alias("h")).agg(F.count("*").alias("n"), F.min(key).alias("k")).filter("n > 1").select(F.lit("duplicate").alias("problem"), F.col("k").cast("string").alias("key"))
    return odd.unionByName(bad).unionByName(twice)
