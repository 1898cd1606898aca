"""Bundles of inputs that must agree: evaluations and their provenance, training subsets and their split, signals and their pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.operators.policy import reasons
from veinwork.operators.ranks import percentiles

# The units that energies and forces must be in.
UNITS = ("eV", "eV/angstrom")
#: What an evaluation's provenance binds: name of the break, the column that says, the column that it must equal, in the order in which they are asked for.
PROVENANCE = (
    ("dataset_bytes", "manifest_file_sha256", "dataset_file_sha256"),
    ("dataset_lineage", "derived_manifest_sha256", "manifest_sha256"),
    ("split_manifest", "split_manifest_sha256", "manifest_artifact_sha256"),
    ("dataset_id", "predicted_dataset_id", "dataset_id"),
    ("dataset_content", "predicted_content_sha256", "dataset_content_sha256"),
    ("split_identity", "predicted_split_sha256", "split_sha256"),
    ("model_manifest", "predicted_model_manifest", "model_manifest_artifact"),
    ("predictions_artifact", "model_predictions_artifact", "predictions_artifact"),
    ("model_id", "predicted_model_id", "model_id"),
    ("checkpoint", "predicted_checkpoint_sha256", "checkpoint_sha256"),
    ("structure_set", "predicted_structures_sha256", "structures_sha256"),
)


def provenance_breaks(evaluations: DataFrame, key: str) -> DataFrame:
    """key and, in order, what of an evaluation's provenance doesn't hold: each pair of PROVENANCE, and units. evaluations has the columns of all pairs, energy_unit and
    force_unit; a null on either side is a break unless both are null."""
    rules = {name: ~F.col(a).eqNullSafe(F.col(b)) for name, a, b in PROVENANCE}
    rules["units"] = ~(F.col("energy_unit").eqNullSafe(F.lit(UNITS[0])) & F.col("force_unit").eqNullSafe(F.lit(UNITS[1])))
    return evaluations.select(key, reasons(rules).alias("broken")).filter(F.size("broken") > 0)


def subset_problems(subsets: DataFrame, split: DataFrame, roles: dict[str, str], lineage: DataFrame | None = None) -> DataFrame:
    """role, record_id, problem: outside (a subset's record isn't in the partition that its role draws on), overlap (it is in two subsets), repeated (twice in one),
    and with a training lineage (record_id), for the first role: not_in_lineage, lineage_not_used.

    subsets: role, record_id. split: record_id, partition. roles: role to partition.
    """
    wanted = split.sparkSession.createDataFrame(list(roles.items()), "role string, partition string")
    marked = subsets.groupBy("role", "record_id").agg(F.count("*").alias("n"))
    joined = marked.join(wanted, "role").join(split.select("record_id", F.col("partition").alias("_partition")), "record_id", "left")
    problem = lambda df, name: df.select("role", "record_id", F.lit(name).alias("problem"))
    both = marked.groupBy("record_id").agg(F.count("*").alias("roles"), F.min("role").alias("role")).filter("roles > 1")
    out = problem(joined.filter(~F.col("_partition").eqNullSafe(F.col("partition"))), "outside").unionByName(problem(both, "overlap")).unionByName(problem(marked.filter("n > 1"), "repeated"))
    if lineage is not None:
        first = next(iter(roles))
        own, known = marked.filter(F.col("role") == first), lineage.select("record_id").distinct()
        out = out.unionByName(problem(own.join(known, "record_id", "left_anti"), "not_in_lineage"))
        out = out.unionByName(problem(known.join(own, "record_id", "left_anti").withColumn("role", F.lit(first)), "lineage_not_used"))
    return out


def signal_problems(signals: DataFrame, pool: DataFrame, descriptors: DataFrame, members: Sequence[str]) -> DataFrame:
    """candidate_id and problem: signals and pool must hold the same candidates, each member must have scored every one of them, and each must have a descriptor.

    signals: member, candidate_id. Nothing of the size of members times pool is made: scores are counted for each candidate.
    """
    names = F.array(*map(F.lit, members))
    scored = signals.groupBy("candidate_id").agg(F.collect_set(F.when(F.col("member").isin(*members), F.col("member"))).alias("by"))
    have = pool.select("candidate_id", F.lit(True).alias("in_pool")).distinct()
    described = descriptors.select("candidate_id", F.lit(True).alias("described")).distinct()
    joined = have.join(scored, "candidate_id", "full").join(described, "candidate_id", "left")
    missing = F.array_except(names, F.coalesce("by", F.array().cast("array<string>")))
    wrong = reasons({"not_in_pool": F.col("in_pool").isNull(), "no_descriptor": F.col("in_pool").isNotNull() & F.col("described").isNull()})
    gaps = F.when(F.col("in_pool").isNotNull(), F.transform(missing, lambda m: F.concat(F.lit("not_scored:"), m))).otherwise(F.array().cast("array<string>"))
    return joined.select("candidate_id", F.explode(F.concat(wrong, gaps)).alias("problem"))


def residual_summary(rows: DataFrame, by: Sequence[str], predicted: str, target: str, again: str | None = None) -> DataFrame:
    """Per group: n, mean absolute residual, its exact p95 (type 7), and with the predictions of a second run the largest absolute difference between both.

    Fails on an empty table, and where either side of a pair is null or not finite: a mean over what is left would say nothing.
    """
    a, b = F.col(predicted).cast("double"), F.col(target).cast("double")
    sound = F.coalesce(F.abs(a) < float("inf"), F.lit(False)) & F.coalesce(F.abs(b) < float("inf"), F.lit(False)) & ~F.isnan(a) & ~F.isnan(b)
    state = rows.agg(F.count("*").alias("n"), F.count_if(~sound).alias("bad")).first()
    if not state.n or state.bad:
        raise ValueError("no pairs" if not state.n else f"{state.bad} pairs lack a finite prediction or target")
    residual = rows.withColumn("_residual", F.abs(a - b))
    delta = F.max(F.abs(a - F.col(again).cast("double"))) if again else F.lit(None).cast("double")
    means = residual.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_residual").alias("mean"), delta.alias("rerun_delta"))
    return means.join(percentiles(residual, by, "_residual", {"p95": 0.95}), list(by)) if by else means.join(F.broadcast(percentiles(residual, by, "_residual", {"p95": 0.95})))
