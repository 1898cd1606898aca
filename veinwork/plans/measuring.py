"""Error metrics. Orders stand for structures, their line items for atoms, a customer for a group.

Predictions are the targets moved by a rule on the keys, so both engines see the same errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import metrics
from veinwork.plans.registry import query
from veinwork.sources.tables import table

THRESHOLD = 0.0567


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    target = F.col("o_totalprice") / 1000
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"), target.alias("energy_target"), (target + ((F.col("o_custkey") + F.col("o_orderkey")) % 11 - 5) * 0.1).alias("energy_predicted"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("record_id"), ((F.col("l_partkey") % 7 - 3) * 0.01).alias("dx"), ((F.col("l_suppkey") % 5 - 2) * 0.02).alias("dy"), ((F.col("l_linenumber") % 3 - 1) * 0.05).alias("dz"))


SOURCES = """
    WITH structures AS (
        SELECT o_orderkey AS record_id, o_custkey AS group_id, o_totalprice / 1000 AS energy_target,
               o_totalprice / 1000 + ((o_custkey + o_orderkey) % 11 - 5) * 1e-1 AS energy_predicted FROM orders),
    atoms AS (
        SELECT l_orderkey AS record_id, (l_partkey % 7 - 3) * 1e-2 AS dx, (l_suppkey % 5 - 2) * 2e-2 AS dy,
               (l_linenumber % 3 - 1) * 5e-2 AS dz FROM lineitem),
    sums AS (
        SELECT record_id, count(*) AS n_atoms, sum(abs(dx) + abs(dy) + abs(dz)) AS abs_sum,
               sum(dx * dx + dy * dy + dz * dz) AS sq_sum, avg(sqrt(dx * dx + dy * dy + dz * dz)) AS mean_norm
        FROM atoms GROUP BY 1),
    errors AS (
        SELECT s.*, n_atoms, abs_sum, sq_sum, mean_norm, abs(energy_predicted - energy_target) / n_atoms AS energy_error
        FROM structures s JOIN sums USING (record_id)),
    norms AS (
        SELECT group_id, sqrt(dx * dx + dy * dy + dz * dz) AS norm FROM atoms JOIN structures USING (record_id))
"""
AGGREGATES = f"""
    count(*) AS n_structures, sum(n_atoms)::BIGINT AS n_atoms, round(avg(energy_error) + 1e-10, 6) AS energy_mae,
    round(sum(abs_sum) / (3 * sum(n_atoms)) + 1e-10, 6) AS force_mae, round(sqrt(sum(sq_sum) / (3 * sum(n_atoms))) + 1e-10, 6) AS force_rmse,
    round(avg(CASE WHEN mean_norm > {THRESHOLD} THEN 1e0 ELSE 0e0 END) + 1e-10, 6) AS high_error_fraction
"""
MEASURES = ("energy_mae", "force_mae", "force_rmse", "high_error_fraction", "force_p95")


def rounded_up(df: DataFrame) -> DataFrame:
    """Measures at six digits. Errors are multiples of a hundredth, so means can lie on a tie, where the order of
    summing would decide the last digit; the small term makes every tie go up, here and in the SQL."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in MEASURES})


def rounded(df: DataFrame, columns: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"{SOURCES} SELECT {AGGREGATES}, (SELECT round(quantile_cont(norm, 0.95) + 1e-10, 6) FROM norms) AS force_p95 FROM errors")
def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_up(metrics.overall_metrics(structures(spark, sf_dir), atoms(spark, sf_dir), THRESHOLD))


@query(
    f"""{SOURCES}, p AS (SELECT group_id, round(quantile_cont(norm, 0.95) + 1e-10, 6) AS force_p95 FROM norms GROUP BY 1),
    g AS (SELECT group_id, {AGGREGATES} FROM errors GROUP BY 1 HAVING count(*) >= 3)
    SELECT g.*, force_p95 FROM g JOIN p USING (group_id)"""
)
def metrics_by_group_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_up(metrics.grouped_metrics(structures(spark, sf_dir), atoms(spark, sf_dir), THRESHOLD))


@query(
    f"""{SOURCES}, g AS (SELECT group_id, count(*) AS n FROM errors GROUP BY 1)
    SELECT sum(CASE WHEN n < 3 THEN n ELSE 0 END)::BIGINT AS suppressed_structures, count(*) FILTER (WHERE n >= 3) AS groups FROM g"""
)
def metrics_suppressed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.suppressed(structures(spark, sf_dir), atoms(spark, sf_dir))


@query(
    """SELECT coalesce(o_orderkey, l_orderkey) AS record_id, CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'unknown' END AS problem
    FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey
    WHERE o_orderkey IS NULL OR l_orderkey IS NULL"""
)
def prediction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(atoms(spark, sf_dir), structures(spark, sf_dir), "record_id")


OFFSETS = """
    WITH t AS (
        SELECT m AS model, o_orderpriority AS grp, (o_orderkey % (7 + m) - 3) * 1e-2 + o_totalprice / 1e6 * m AS v
        FROM orders, (SELECT unnest([1, 2, 3]) AS m) k)
"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("model")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("grp"), models)
    return rows.select("model", "grp", ((F.col("o_orderkey") % (7 + F.col("model")) - 3) * 0.01 + F.col("o_totalprice") / 1e6 * F.col("model")).alias("v"))


@query(
    f"""{OFFSETS}, w AS (SELECT model, max(abs(a)) AS x FROM (SELECT model, grp, avg(v) AS a FROM t GROUP BY 1, 2) GROUP BY 1)
    SELECT t.model, count(*) AS n, round(avg(v), 6) AS mean_offset, round(median(v), 6) AS median_offset, round(stddev_pop(v), 6) AS std_offset,
           round(avg(abs(v)), 6) AS mae, round(quantile_cont(abs(v), 0.95), 6) AS p95_abs, round(any_value(x), 6) AS max_group_offset
    FROM t JOIN w USING (model) GROUP BY 1"""
)
def offset_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.offset_diagnostic(_offsets(spark, sf_dir), "model", "grp", "v")
    return rounded(got, ("mean_offset", "median_offset", "std_offset", "mae", "p95_abs", "max_group_offset"))


@query(f"{OFFSETS} SELECT model, grp, round(avg(v), 6) AS mean_offset, round(stddev_pop(v), 6) AS std_offset, count(*) AS n FROM t GROUP BY 1, 2")
def offset_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.group_offsets(_offsets(spark, sf_dir), "model", "grp", "v"), ("mean_offset", "std_offset"))


@query(
    """WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem),
    b AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem),
    d AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, sum(n) AS n FROM
          (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2, 3, 4)
    SELECT CASE WHEN coalesce(sum(abs(n)), 0) = 0 THEN 0e0 ELSE 1e0 END AS rerun_delta, coalesce(sum(abs(n)), 0)::BIGINT AS differing_rows FROM d"""
)
def rerun_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    moved = F.when(F.col("l_partkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return metrics.rerun_delta(first, first.withColumn("l_quantity", moved))


@query(
    """WITH t AS (SELECT avg(o_totalprice) AS p, count(*) AS n FROM orders WHERE o_orderkey % 5 != 0)
    SELECT any_value(n) AS n_train, count(*) AS n_holdout, round(any_value(p), 6) AS prediction, round(avg(abs(o_totalprice - p)), 6) AS mae
    FROM orders, t WHERE o_orderkey % 5 = 0"""
)
def mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return metrics.mean_baseline(o.filter("o_orderkey % 5 != 0"), o.filter("o_orderkey % 5 = 0"), "o_totalprice")


@query(
    """WITH x AS (SELECT abs(o_totalprice * 1.0000001e0 - o_totalprice) AS e, 1e-9 * (o_custkey % 3) AS f FROM orders)
    SELECT 'energy' AS value, round(max(e), 9) AS max_abs_delta, max(e) <= 1e-3 AS "within" FROM x
    UNION ALL SELECT 'force', round(max(f), 9), max(f) <= 1e-3 FROM x"""
)
def device_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = o.select("o_orderkey", F.col("o_totalprice").alias("energy"), F.lit(0.0).alias("force"))
    right = o.select("o_orderkey", (F.col("o_totalprice") * 1.0000001).alias("energy"), (F.col("o_custkey") % 3 * 1e-9).alias("force"))
    return rounded(metrics.parity(left, right, "o_orderkey", ["energy", "force"], 1e-3), ("max_abs_delta",), 9)
