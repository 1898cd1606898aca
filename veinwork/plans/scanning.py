"""Folds over histories that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import scans
from veinwork.plans.logs import PAIRS, VALUES
from veinwork.plans.registry import query
from veinwork.sources.tables import table


@query(
    f"""WITH t AS (SELECT 0 AS log, event_id, lag(event_type) OVER (ORDER BY event_id) AS from_state, event_type AS to_state FROM events)
    SELECT * FROM t WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {VALUES})"""
)
def long_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the history of one entity: the same audit, over ranges that are composed."""
    log = table(spark, sf_dir, "events").select(F.lit(0).alias("log"), "event_id", "event_type")
    return scans.transition_audit(log, "log", "event_id", "event_type", spark.createDataFrame(PAIRS, "from_state string, to_state string"))


@query("SELECT o_orderpriority AS run, o_orderkey AS place FROM orders WHERE o_orderkey % 97 = 5")
def long_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each priority, each order the parent of the next; some name another parent."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("place"))
    at = scans.placed(orders, ["run", "place"])
    linked = scans.prefix(at, ["run"], ["place"], "max", F.col("place"), "parent").drop("part")
    parent = F.when(F.col("place") % 97 == 5, -1).otherwise(F.col("parent"))
    return scans.chain_breaks(linked, "run", "place", parent, F.col("place"))


@query(
    """WITH a AS (SELECT o_orderpriority AS run, o_orderkey AS step, o_totalprice AS v, row_number() OVER w AS n,
           min(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)),
    i AS (SELECT *, max(CASE WHEN lowest IS NULL OR v < lowest THEN n END) OVER (PARTITION BY run ORDER BY step) AS improved FROM a),
    s AS (SELECT run, min(n) FILTER (WHERE n - improved >= 150) AS stop FROM i GROUP BY 1),
    d AS (SELECT i.*, stop FROM i JOIN s USING (run) WHERE stop IS NULL OR n <= stop)
    SELECT run, max(n) AS n_steps, max(stop) IS NOT NULL AS stopped_early, min(v) AS best, arg_min(step, v) AS best_step, max(n) - max(improved) AS patience_count FROM d GROUP BY 1"""
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long runs; each stops once 150 steps in a row bring nothing better."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"))
    return scans.early_stopping(history, "run", "step", "value", 150)
