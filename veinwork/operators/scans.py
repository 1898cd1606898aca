"""Folds over long histories: each range of a history is folded by itself, the ranges' results are composed, and every row gets what came before it.

No entity's history is one task's work: rows are placed in ranges of (entity, order), and a range passes on one row for each entity that it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.operators.ranks import placed


def _cells(at: DataFrame, by: Sequence[str], folded: Column, compose) -> DataFrame:
    """For each range and entity the composed value of the ranges before it."""
    cells = at.groupBy("part", *by).agg(folded.alias("_own"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("part", *by, compose(F.col("_own")).over(earlier).alias("_carried"))


def prefix(at: DataFrame, by: Sequence[str], order: Sequence[str], kind: str, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Rows in ranges (ranks.placed over by and order) with the sum, min, max or last of value over the entity's rows before each, or up to it. Nulls are
    passed over; without a value before it a row gets null. order tells an entity's rows apart."""
    marked = at.withColumn("_value", value)
    within = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if kind == "last":
        own = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
        cells, here = _cells(marked, by, own, lambda c: F.last(c, ignorenulls=True)), F.last("_value", ignorenulls=True).over(within)
        both = F.coalesce(F.col("_here"), F.col("_carried"))
    else:
        fn = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
        cells, here = _cells(marked, by, fn("_value"), fn), fn("_value").over(within)
        both = {"sum": F.when(F.col("_here").isNull() & F.col("_carried").isNull(), F.lit(None)).otherwise(F.coalesce("_here", F.lit(0)) + F.coalesce("_carried", F.lit(0))), "min": F.least("_here", "_carried"), "max": F.greatest("_here", "_carried")}[kind]
    joined = marked.withColumn("_here", here).join(cells, ["part", *by])
    return joined.withColumn(name, both).drop("_value", "_here", "_carried")


def transition_audit(log: DataFrame, entity: str, sequence: str, state: str, allowed: DataFrame) -> DataFrame:
    """As events.transition_audit, for histories of any length: steps that allowed(from_state, to_state) doesn't list. Sequences tell an entity's events apart."""
    at = placed(log.select(entity, sequence, F.col(state).alias("to_state")), [entity, sequence])
    steps = prefix(at, [entity], [sequence], "last", F.col("to_state"), "from_state").filter("from_state IS NOT NULL")
    return steps.join(allowed, ["from_state", "to_state"], "left_anti").select(entity, sequence, "from_state", "to_state")


def chain_breaks(nodes: DataFrame, run: str, place: str, parent: Column, identifier: Column) -> DataFrame:
    """As events.chain_breaks, for chains of any length: nodes whose parent isn't the node before them; the first must have none. Identifiers aren't null."""
    at = placed(nodes.select(run, place, identifier.alias("_id"), parent.alias("_parent")), [run, place])
    return prefix(at, [run], [place], "last", F.col("_id"), "_before").filter(~F.col("_before").eqNullSafe(F.col("_parent"))).select(run, place)


def early_stopping(history: DataFrame, run: str, step: str, value: str, patience: int) -> DataFrame:
    """One row per run: n_steps that were needed, stopped_early, best and best_step among them, patience_count at the end.

    A step improves if its value is below all before it (the first if it is finite; NaN and null never do). The run stops at the first step that is the
    patience-th in a row without an improvement; what follows doesn't count.
    """
    v = F.col(value).cast("double")
    at = placed(history.select(run, step, F.when(v.isNotNull() & ~F.isnan(v), v).alias("_v")), [run, step])
    counted = prefix(at, [run], [step], "sum", F.lit(1), "_n", inclusive=True)
    lowest = prefix(counted, [run], [step], "min", F.col("_v"), "_lowest")
    better = F.coalesce(F.col("_v") < F.coalesce("_lowest", F.lit(float("inf"))), F.lit(False))
    marked = prefix(lowest.withColumn("_better", better), [run], [step], "max", F.when(F.col("_better"), F.col("_n")), "_improved", inclusive=True)
    waited = marked.withColumn("_wait", F.col("_n") - F.coalesce("_improved", F.lit(0)))
    stops = waited.groupBy(run).agg(F.min(F.when(F.col("_wait") >= patience, F.col("_n"))).alias("_stop"))
    done = waited.join(stops, run).filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    best = F.max(F.when(F.col("_better"), F.struct(F.col("_n"), F.col("_v").alias("v"), F.col(step).alias("s"))))
    out = done.groupBy(run).agg(F.max("_n").alias("n_steps"), F.max("_stop").isNotNull().alias("stopped_early"), best.alias("b"), F.max_by("_wait", "_n").alias("patience_count"))
    return out.select(run, "n_steps", "stopped_early", F.col("b.v").alias("best"), F.col("b.s").alias("best_step"), "patience_count")
