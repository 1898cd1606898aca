"""Contracts of claims, decisions, experiments, approvals and runs: each lists what breaks it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.policy import reasons

# The evidence tier that each class of claim must state.
TIER_OF_CLASS = {"infrastructure": "non_scientific", "pilot_scientific": "pilot_only", "replicated_scientific": "replicated", "publication": "publication_eligible"}
# The dimensions of a decision.
DIMENSIONS = ("legality", "scientific_objective", "engineering_validity", "metric_result", "tail_risk", "compute_budget", "reproducibility", "uncertainty")


def claim_contract(claims: DataFrame) -> DataFrame:
    """claims: claim_id, claim_class, tier, refs, metric_refs, run_refs, approval_refs, dataset_ref, is_number. Per claim the rules it breaks."""
    lacks = lambda part: F.size(F.array_except(F.coalesce(part, F.array()), F.coalesce("refs", F.array()))) > 0
    tier = F.create_map(*(F.lit(x) for kv in TIER_OF_CLASS.items() for x in kv))
    scientific = F.col("claim_class") != "infrastructure"
    runs = F.size(F.array_distinct(F.coalesce("run_refs", F.array())))
    empty = lambda c: F.size(F.coalesce(c, F.array())) == 0
    broken = reasons(
        {
            "tier": ~F.col("tier").eqNullSafe(tier[F.col("claim_class")]),
            "metric_refs_outside": lacks("metric_refs"),
            "approvals_outside": lacks("approval_refs"),
            "no_dataset": scientific & F.col("dataset_ref").isNull(),
            "number_without_metric": scientific & F.col("is_number") & empty("metric_refs"),
            "one_run_only": F.col("claim_class").isin("replicated_scientific", "publication") & (runs < 2),
            "no_approval": (F.col("claim_class") == "publication") & empty("approval_refs"),
        }
    )
    return claims.select("claim_id", broken.alias("broken"), (F.size(broken) == 0).alias("sound"))


def decision_contract(decisions: DataFrame, key: str, decision: str, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Accepted with a failing dimension, or not accepted with none failing; a null dimension counts as failing."""
    failing = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(d), F.lit(False)), F.lit(d)) for d in dimensions)))
    problem = F.when((F.col(decision) == "accept") & (F.size(failing) > 0), "accepted_with_failures").when((F.col(decision) != "accept") & (F.size(failing) == 0), "no_failing_dimension")
    return decisions.select(key, failing.alias("failing"), problem.alias("problem")).filter("problem IS NOT NULL")


def unequal_arms(arms: DataFrame, name: str, left: str, right: str, fields: Sequence[str]) -> DataFrame:
    """Fields in which two arms of an experiment differ though they must be equal; arms are few rows."""
    both = arms.filter(F.col(name) == left).select(*(F.col(f).alias(f"l_{f}") for f in fields)).join(arms.filter(F.col(name) == right).select(*(F.col(f).alias(f"r_{f}") for f in fields)))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").cast("string").alias("left_value"), F.col(f"r_{f}").cast("string").alias("right_value")) for f in fields)))
    return both.select(rows.alias("x")).select("x.*").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def spent_authorizations(requests: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Requests whose one-shot authorization a verified result has used already."""
    return requests.join(used.select(key).distinct(), key, "left_semi")


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per key the fields in which two records disagree: an identity chain is sound if there is no row."""
    r = right.select(key, *(F.col(f).alias(f"r_{f}") for f in fields))
    unequal = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields)))
    return left.join(r, key).select(key, unequal.alias("unequal")).filter(F.size("unequal") > 0)


def accepted_configs(log: DataFrame, run: str, sequence: str, action: str, config: str) -> DataFrame:
    """The configuration in force: that of a run's last commit; candidates and rollbacks change nothing."""
    return log.filter(F.col(action) == "commit").groupBy(run).agg(F.max_by(config, sequence).alias(config), F.max(sequence).alias("since"))


def repair_state(attempts: DataFrame, step: str, sequence: str, repairs: str) -> DataFrame:
    """Repairs of a step's attempts merged in order: of a repeated key the later value stands. repairs: map<string, double>."""
    entries = attempts.select(step, sequence, F.explode(repairs).alias("key", "value"))
    last = entries.groupBy(step, "key").agg(F.max_by("value", sequence).alias("value"))
    return last.groupBy(step).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("repairs"))


def prior_outcome(decision: Column, metric_ok: Column, tail_ok: Column, budget_ok: Column, rerun_ok: Column) -> Column:
    """Whether a rejection was for a constraint and not for the metric."""
    return (decision == "reject") & metric_ok & ~(tail_ok & budget_ok & rerun_ok)


def next_move(decision: Column, constraint_failed: Column, mutated_key: Column, was_decrease: Column, rotation: Sequence[str]) -> Column:
    """key and factor of the next proposal: a failure halves the learning rate, a broken constraint the batch size,
    a plain rejection turns to the next key of the rotation, an acceptance goes on in its direction."""
    place = F.array_position(F.array(*map(F.lit, rotation)), mutated_key)
    following = F.element_at(F.array(*map(F.lit, rotation)), (place % len(rotation) + 1).cast("int"))
    move = lambda key, factor: F.struct(key.alias("key"), factor.cast("double").alias("factor"))
    return (
        F.when(decision.isin("refine", "escalate"), move(F.lit("learning_rate"), F.lit(0.5)))
        .when((decision == "reject") & constraint_failed, move(F.lit("batch_size"), F.lit(0.5)))
        .when(decision == "reject", move(following, F.lit(0.5)))
        .otherwise(move(mutated_key, F.when(was_decrease, 0.5).otherwise(2.0)))
    )


def review_trigger(flags: Mapping[str, Column], failures: Column, first: Column, classes: Column, many_failures: int = 2, long_streak: int = 3) -> Column:
    """The most specific reason to pause: the flags in their order, then repeated failures, a first proposal, a streak of one class."""
    out = None
    for name, flag in flags.items():
        out = F.when(flag, name) if out is None else out.when(flag, name)
    last = F.element_at(classes, -1)
    streak = F.size(classes) - F.coalesce(F.array_max(F.transform(classes, lambda c, i: F.when(c != last, i + 1).otherwise(0))), F.lit(0))
    rest = F.when(failures >= many_failures, "consecutive_failures").when(first, "first_proposal").when((F.size(classes) > 0) & (streak >= long_streak), "repeated_class").otherwise("iteration_boundary")
    return rest if out is None else out.otherwise(rest)


def failure_repair(message: Column, batch_size: Column, learning_rate: Column, gradient_clip: Column) -> Column:
    """class, retryable and repaired values of a training failure, by words of its message."""
    low = F.lower(message)
    full = low.contains("out of memory") | low.contains("cuda oom")
    unstable = low.contains("non-finite") | low.contains("nan")
    can = batch_size > 1
    return F.struct(
        F.when(full, "resource_exhausted").when(unstable, "simulation_instability").otherwise("tool_error").alias("failure_class"),
        F.when(full, can).otherwise(unstable).alias("retryable"),
        F.when(full & can, F.greatest(F.lit(1), F.floor(batch_size / 2))).alias("batch_size"),
        F.when(~full & unstable, learning_rate * 0.5).alias("learning_rate"),
        F.when(~full & unstable, F.least(gradient_clip, F.lit(5.0))).alias("gradient_clip"),
    )


def synthetic_surface(lr: Column, clip: Column, force_weight: Column, energy_weight: Column, patience: Column) -> Column:
    """The demonstration loss surface: squared distances of log10 values from fixed optima."""
    # Weight, optimum.
    terms = ((lr, 0.4, 2e-3), (clip, 0.01, 0.5), (force_weight, 0.005, 20.0), (energy_weight, 0.002, 1.0))
    out = F.lit(0.05)
    for value, weight, best in terms:
        out = out + weight * F.pow(F.log10(value) - F.log10(F.lit(best)), 2.0)
    return out + 0.001 * F.pow(patience - 5.0, 2.0) / 25.0


def parameter_changes(before: DataFrame, after: DataFrame, name: str, value: str) -> DataFrame:
    """One row: how many parameters changed, the largest absolute change and its name; both runs must have the same names."""
    both = before.select(name, F.col(value).alias("b")).join(after.select(name, F.col(value).alias("a")), name, "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count_if(d > 0).alias("n_changed"), F.max(d).alias("max_abs_change"), F.max_by(name, F.struct(d, name)).alias("most_changed"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))


def trainable(layers: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """Layers of the given prefixes in their last numbered block."""
    chosen = None
    for p in prefixes:
        chosen = F.col(name).startswith(p) if chosen is None else chosen | F.col(name).startswith(p)
    number = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("int")
    rows = layers.filter(chosen).withColumn("block", number)
    last = rows.agg(F.max("block").alias("last_block"))  # one row
    return rows.join(F.broadcast(last), F.col("block").eqNullSafe(F.col("last_block"))).select(name)


def stage_gaps(done: DataFrame, stages: DataFrame, run: str) -> DataFrame:
    """Stages that a run left out before its last one. stages: stage, position (a small table)."""
    s = stages
    last = done.join(s, "stage").groupBy(run).agg(F.max("position").alias("last"))
    wanted = last.join(s.withColumnRenamed("stage", "wanted_stage"), F.col("position") <= F.col("last"))
    return wanted.join(done.select(F.col(run).alias("r"), F.col("stage").alias("s")).distinct(), (F.col(run) == F.col("r")) & (F.col("wanted_stage") == F.col("s")), "left_anti").select(run, F.col("wanted_stage").alias("stage"))


def bound_values(claims: DataFrame, metrics: DataFrame, within: float = 0.0) -> DataFrame:
    """claims: claim_id, artifact_id, field, value. metrics: artifact_id, payload (JSON). Claims whose value isn't that of the metric file."""
    found = F.expr("try_variant_get(try_parse_json(payload), concat('$.aggregate.', field), 'double')")
    joined = claims.join(metrics, "artifact_id", "left").withColumn("found", found)
    return joined.filter(F.col("found").isNull() | (F.abs(F.col("found") - F.col("value")) > within)).select("claim_id", "field", "value", "found")


def resolved_references(params: DataFrame, outputs: DataFrame, value: str) -> DataFrame:
    """Values of the form $steps.<id>.<field> replaced by that step's output; others stay; unknown ones are null."""
    pattern = r"^\$steps\.([^.]+)\.(.+)$"
    parts = params.withColumn("step_id", F.regexp_extract(value, pattern, 1)).withColumn("field", F.regexp_extract(value, pattern, 2))
    joined = parts.join(outputs.select("step_id", "field", F.col("output").alias("_output")), ["step_id", "field"], "left")
    return joined.withColumn("resolved", F.when(F.col("field") != "", F.col("_output")).otherwise(F.col(value))).drop("step_id", "field", "_output")
