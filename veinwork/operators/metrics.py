"""Error metrics at four grains: component, atom, structure, group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.ranks import percentiles
from veinwork.sources.tables import written


def structure_errors(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row per structure that has atoms, with sums that every coarser grain can be made from, and its atoms' norms.

    structures: record_id, group_id, energy_predicted, energy_target. atoms: record_id, dx, dy, dz (errors).
    Atoms are summed before the join, so the join moves one row per structure.
    """
    sq = F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2
    sums = atoms.groupBy("record_id").agg(
        F.count("*").alias("n_atoms"),
        F.sum(F.abs("dx") + F.abs("dy") + F.abs("dz")).alias("abs_sum"),
        F.sum(sq).alias("sq_sum"),
        F.avg(F.sqrt(sq)).alias("mean_norm"),
        F.collect_list(F.sqrt(sq)).alias("norms"),  # as many as the structure has atoms; pruned where nothing reads them
    )
    return structures.join(sums, "record_id").withColumn("energy_error", F.abs(F.col("energy_predicted") - F.col("energy_target")) / F.col("n_atoms"))


def _summed(threshold: float) -> list[Column]:
    """Macro energy error over structures, micro force errors over components, share of structures above the threshold."""
    return [
        F.count("*").alias("n_structures"),
        F.sum("n_atoms").alias("n_atoms"),
        F.avg("energy_error").alias("energy_mae"),
        (F.sum("abs_sum") / (3 * F.sum("n_atoms"))).alias("force_mae"),
        F.sqrt(F.sum("sq_sum") / (3 * F.sum("n_atoms"))).alias("force_rmse"),
        F.avg((F.col("mean_norm") > threshold).cast("double")).alias("high_error_fraction"),
    ]


def overall_metrics(structures: DataFrame, atoms: DataFrame, threshold: float) -> DataFrame:
    """One row. Atoms and structures are joined once, and the table that this leaves gives the sums and the percentile."""
    errors = written(structure_errors(structures, atoms), "errors")
    p95 = percentiles(errors.select(F.explode("norms").alias("norm")), [], "norm", {"force_p95": 0.95})
    return errors.agg(*_summed(threshold)).join(p95)  # one row each


def grouped_metrics(structures: DataFrame, atoms: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """One row per group of least structures or more; smaller groups are suppressed."""
    errors = written(structure_errors(structures, atoms), "errors")
    per_group = errors.groupBy("group_id").agg(*_summed(threshold)).filter(F.col("n_structures") >= least)
    p95 = percentiles(errors.select("group_id", F.explode("norms").alias("norm")), ["group_id"], "norm", {"force_p95": 0.95})
    return per_group.join(p95, "group_id")


def suppressed(structures: DataFrame, atoms: DataFrame, least: int = 3) -> DataFrame:
    """How many structures stand in groups that grouped_metrics leaves out, and how many groups it keeps."""
    sizes = structure_errors(structures, atoms).groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).alias("suppressed_structures"), F.count_if(F.col("n") >= least).alias("groups"))


def coverage(predicted: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side that lacks them: empty when both cover the same."""
    p = predicted.select(F.col(key), F.lit(True).alias("in_predicted")).distinct()
    t = target.select(F.col(key), F.lit(True).alias("in_target")).distinct()
    both = p.join(t, key, "full_outer")
    problem = F.when(F.col("in_predicted").isNull(), "missing").otherwise("unknown")
    return both.filter(F.col("in_predicted").isNull() | F.col("in_target").isNull()).select(key, problem.alias("problem"))


def offset_diagnostic(rows: DataFrame, model: str, group: str, value: str) -> DataFrame:
    """Per model: mean, median, population deviation, MAE and 95th percentile of the offsets, and the largest group offset."""
    per_group = rows.groupBy(model, group).agg(F.avg(value).alias("group_mean"))
    worst = per_group.groupBy(model).agg(F.max(F.abs("group_mean")).alias("max_group_offset"))
    v = F.col(value)
    sums = rows.groupBy(model).agg(F.count("*").alias("n"), F.avg(v).alias("mean_offset"), F.stddev_pop(v).alias("std_offset"), F.avg(F.abs(v)).alias("mae"))
    halves = percentiles(rows, [model], value, {"median_offset": 0.5})
    tails = percentiles(rows.withColumn(value, F.abs(v)), [model], value, {"p95_abs": 0.95})
    return sums.join(halves, model).join(tails, model).join(worst, model)


def group_offsets(rows: DataFrame, model: str, group: str, value: str) -> DataFrame:
    return rows.groupBy(model, group).agg(F.avg(value).alias("mean_offset"), F.stddev_pop(value).alias("std_offset"), F.count("*").alias("n"))


def rerun_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """0.0 if both runs gave the same rows, as often, else 1.0, with the number of rows that differ."""
    tagged = first.withColumn("_n", F.lit(1)).unionByName(second.withColumn("_n", F.lit(-1)))
    differing = tagged.groupBy(*first.columns).agg(F.sum("_n").alias("n")).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differing_rows"))
    return differing.select(F.when(F.col("differing_rows") == 0, 0.0).otherwise(1.0).alias("rerun_delta"), "differing_rows")


def mean_baseline(train: DataFrame, holdout: DataFrame, value: str) -> DataFrame:
    """The training rows' mean as a prediction for the held-out rows."""
    mean = train.agg(F.avg(value).alias("prediction"), F.count("*").alias("n_train"))
    # One row, whatever the input's size.
    return holdout.select(value).join(F.broadcast(mean)).agg(F.first("n_train").alias("n_train"), F.count("*").alias("n_holdout"), F.round(F.first("prediction"), 6).alias("prediction"), F.round(F.avg(F.abs(F.col(value) - F.col("prediction"))), 6).alias("mae"))


def parity(left: DataFrame, right: DataFrame, key: str, values: list[str], tolerance: float) -> DataFrame:
    """Largest absolute difference of each value between two runs, joined by id, and whether it is tolerated."""
    r = right.select(key, *(F.col(v).alias(f"r_{v}") for v in values))
    joined = left.join(r, key)
    long = joined.select(F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.abs(F.col(v) - F.col(f"r_{v}")).alias("d")) for v in values))).alias("x"))
    return long.groupBy(F.col("x.value").alias("value")).agg(F.max("x.d").alias("max_abs_delta")).withColumn("within", F.col("max_abs_delta") <= tolerance)
