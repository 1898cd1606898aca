"""The next change of a loop's configuration, from the last decision to the move, within its bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_mutation(runs: DataFrame, rotation: Sequence[str], ranges: Mapping[str, tuple[float, float, bool]]) -> DataFrame:
    """runs with move (key, old, new) and blocked (why there is none, else null).

    runs: decision (null for the first proposal), constraint_failed, mutated_key (null counts as learning_rate), was_decrease, config (map of numbers). ranges: key to low, high and whether
    it is an integer, which is rounded half to even. A move multiplies the key's value by a factor and keeps it in its range; one that changes nothing is none.

    first: learning_rate x 0.2. refine and escalate: learning_rate x 0.5, or where that stands at its bound gradient_clip x 2. reject for a constraint: batch_size x 0.5. another reject: the
    next key of the rotation after the one moved before that x 0.5 moves, that one left out. accept: the same key in its direction (x 0.5 or x 2), or at its bound the first
    other key of the rotation that x 0.5 moves.
    """

    def move(key: str, factor: Column | float) -> Column:
        low, high, whole = ranges[key]
        old = F.element_at("config", key)
        new = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), old * factor))
        new = F.bround(new, 0) if whole else new
        return F.when(old.isNotNull() & (new != old), F.struct(F.lit(key).alias("key"), old.alias("old"), new.alias("new")))

    decision, prior = F.col("decision"), F.coalesce("mutated_key", F.lit("learning_rate"))
    names = list(rotation)
    following = F.coalesce(*(F.when(prior == k, F.coalesce(*(move(names[(i + j) % len(names)], 0.5) for j in range(1, len(names))))) for i, k in enumerate(names)), F.when(~prior.isin(names), F.coalesce(*(move(k, 0.5) for k in names))))
    onward = F.coalesce(*(F.when(prior == k, move(k, F.when(F.col("was_decrease"), 0.5).otherwise(2.0))) for k in ranges))
    others = F.coalesce(*(F.when(prior != k, move(k, 0.5)) for k in names))
    repair = F.coalesce(move("learning_rate", 0.5), move("gradient_clip", 2.0))
    stable, resource = decision.isin("refine", "escalate"), (decision == "reject") & F.coalesce("constraint_failed", F.lit(False))
    made = F.when(decision.isNull(), move("learning_rate", 0.2)).when(stable, repair).when(resource, move("batch_size", 0.5)).when(decision == "reject", following).when(decision == "accept", F.coalesce(onward, others))
    why = F.when(decision.isNull(), "first_move").when(stable, "no_stability_repair").when(resource, "no_resource_repair").when(decision.isin("reject", "accept"), "no_key_moves").otherwise("unknown_decision")
    return runs.withColumn("move", made).withColumn("blocked", F.when(F.col("move").isNull(), why))
