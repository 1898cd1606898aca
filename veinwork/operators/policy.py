"""Policies and decisions as expressions: the order of the rules is the order of the cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.scalars import clamp, relative_improvement


def reasons(rules: Mapping[str, Column]) -> Column:
    """The names of all rules that hold, in order; a rule that is null counts as holding (fail closed)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))


def recovery(severity: Column, retryable: Column, failure_class: Column, recommended: Column, budget_left: Column, has_repair: Column) -> Column:
    """abort what is critical; what can't be retried goes to a human, or to the recommended pivot unless it is a claim
    or validation failure; without budget escalate; with repaired parameters refine; else retry."""
    human = failure_class.isin("unsupported_claim", "validation_error")
    return (
        F.when(severity == "critical", "abort")
        .when(~retryable & ~human & (recommended == "pivot"), "pivot")
        .when(~retryable, "escalate")
        .when(budget_left <= 0, "escalate")
        .when(has_repair, "refine")
        .otherwise("retry")
    )


def acceptance(legal: Column, failed: Column, has_repair: Column, baseline: Column, candidate: Column, least: float, constraints: Mapping[str, tuple[Column, Column]], optional: Mapping[str, tuple[Column, Column]] | None = None) -> Column:
    """illegal: reject; failed with a repair: refine, without: escalate; improved enough within all limits: accept; else reject.

    constraints: name to (observed, limit); a missing observation fails. In optional ones it counts as 0.
    """
    within = F.lit(True)
    for observed, limit in constraints.values():
        within = within & F.coalesce(observed <= limit, F.lit(False))
    for observed, limit in (optional or {}).values():
        within = within & (F.coalesce(observed, F.lit(0)) <= limit)
    return (
        F.when(~legal, "reject")
        .when(failed & has_repair, "refine")
        .when(failed, "escalate")
        .when((relative_improvement(baseline, candidate) >= least) & within, "accept")
        .otherwise("reject")
    )


def mutation_legality(mutations: DataFrame, policy: DataFrame, max_changes: int) -> DataFrame:
    """mutations: proposal, name, value. policy: name, class, low, high (a small table). Violations per proposal, sorted.

    A name that the policy doesn't know is immutable.
    """
    joined = mutations.join(policy, "name", "left")
    kind = F.coalesce("class", F.lit("immutable"))
    v = F.col("value").cast("double")
    problem = F.when(kind == "immutable", F.concat(F.lit("immutable:"), "name")).when(kind == "owner_gated", F.concat(F.lit("owner_gated:"), "name")).when(~F.coalesce(v.between(F.col("low"), F.col("high")), F.lit(False)), F.concat(F.lit("out_of_range:"), "name"))
    per = joined.groupBy("proposal").agg(F.count("*").alias("n_changes"), F.array_sort(F.collect_set(problem)).alias("violations"))
    too_many = F.when(F.col("n_changes") > max_changes, F.array(F.lit("too_many_changes"))).otherwise(F.array().cast("array<string>"))
    return per.withColumn("violations", F.concat("violations", too_many)).withColumn("legal", F.size("violations") == 0)


def bounded_move(value: Column, factor: float, low: float, high: float, integer: bool = False) -> Column:
    moved = clamp(value * factor, low, high)
    return F.bround(moved, 0) if integer else moved


def range_permits(kind: Column, value: Column, is_integer: Column, low: Column, high: Column) -> Column:
    """Whether a value may stand in a range: an integer range refuses fractions, a number range takes integers."""
    return value.between(low, high) & ((kind != "integer") | is_integer)


def review_direction(note: Column, value: Column, low: float, high: float, integer: bool = False) -> Column:
    """Doubles on a word for more, halves on a word for less, keeps the value if both or none occur."""
    up = F.lower(note).rlike(r"\b(increase|raise|higher|more)\b")
    down = F.lower(note).rlike(r"\b(decrease|reduce|lower|less)\b")
    moved = F.when(up & ~down, value * 2).when(down & ~up, value * 0.5).otherwise(value)
    bounded = clamp(moved, low, high)
    return F.bround(bounded, 0) if integer else bounded


def stopping(decision: Column, iteration: Column, max_iterations: int, budget_left: Column) -> Column:
    return F.when(decision == "escalate", "blocked").when(iteration >= max_iterations, "complete").when(budget_left <= 0, "partial").otherwise("continue")


def lock_in_risk(options: Column) -> Column:
    return F.when(F.size(options) <= 1, "high").when(F.size(options) == 2, "medium").otherwise("low")


def pairwise_overlap(sets: DataFrame, name: str, member: str) -> DataFrame:
    """Members that stand in more than one set, with the sets."""
    return sets.select(name, member).distinct().groupBy(member).agg(F.count("*").alias("n_sets"), F.array_sort(F.collect_list(name)).alias("sets")).filter("n_sets > 1")


def cost_card(hourly: Column, minutes: Column, total: Column) -> Column:
    return F.abs(hourly * minutes / 60 - total) <= 1e-9


def tier_allowed(tier: Column, ceiling: str, order: Sequence[str]) -> Column:
    """Whether a claim tier stands no higher than the ceiling; unknown tiers don't."""
    place = F.array_position(F.array(*map(F.lit, order)), tier)
    return (place > 0) & (place <= order.index(ceiling) + 1)
