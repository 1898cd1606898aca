"""Contracts of claims, decisions and experiments; the tables' columns stand for their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import governance
from veinwork.plans.registry import query
from veinwork.sources.tables import table

CLASSES = list(governance.TIER_OF_CLASS)
TIERS = list(governance.TIER_OF_CLASS.values())


def _pick(values: list[str], place: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({place} + 1 as int)"))


@query(
    f"""WITH c AS (SELECT p_partkey AS claim_id, {CLASSES}[p_size % 4 + 1] AS cls, {TIERS}[p_partkey % 4 + 1] AS tier, {TIERS}[p_size % 4 + 1] AS want, range(1, p_size % 6 + 2) AS refs, p_size % 9 AS metric,
        p_size, p_size % 2 = 0 AS num FROM part),
    b AS (SELECT claim_id, list_filter([CASE WHEN tier != want THEN 'tier' END, CASE WHEN p_size % 3 != 0 AND NOT list_contains(refs, metric) THEN 'metric_refs_outside' END,
        CASE WHEN p_size % 5 = 0 AND NOT list_contains(refs, 1) THEN 'approvals_outside' END, CASE WHEN cls != 'infrastructure' AND p_size % 7 = 0 THEN 'no_dataset' END,
        CASE WHEN cls != 'infrastructure' AND num AND p_size % 3 = 0 THEN 'number_without_metric' END, CASE WHEN cls IN ('replicated_scientific', 'publication') AND p_size % 2 = 1 THEN 'one_run_only' END,
        CASE WHEN cls = 'publication' AND p_size % 5 != 0 THEN 'no_approval' END], lambda x: x IS NOT NULL) AS l FROM c)
    SELECT claim_id, array_to_string(l, ',') AS broken, len(l) = 0 AS sound FROM b"""
)
def claim_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    none = F.array().cast("array<int>")
    claims = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("claim_id"),
        _pick(CLASSES, "p_size % 4").alias("claim_class"),
        _pick(TIERS, "p_partkey % 4").alias("tier"),
        F.sequence(F.lit(1), size % 6 + 1).alias("refs"),
        F.when(size % 3 != 0, F.array(size % 9)).otherwise(none).alias("metric_refs"),
        F.array(F.lit(1), size % 2).alias("run_refs"),
        F.when(size % 5 == 0, F.array(F.lit(1))).otherwise(none).alias("approval_refs"),
        F.when(size % 7 != 0, 1).alias("dataset_ref"),
        (size % 2 == 0).alias("is_number"),
    )
    return governance.claim_contract(claims).withColumn("broken", F.array_join("broken", ","))


@query(
    f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision,
        list_filter([{", ".join(f"CASE WHEN o_orderkey % {k + 9} = 0 THEN '{d}' END" for k, d in enumerate(governance.DIMENSIONS))}], lambda x: x IS NOT NULL) AS f FROM orders)
    SELECT o_orderkey, array_to_string(f, ',') AS failing, CASE WHEN decision = 'accept' THEN 'accepted_with_failures' ELSE 'no_failing_dimension' END AS problem
    FROM d WHERE (decision = 'accept') = (len(f) > 0)"""
)
def decision_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [(F.col("o_orderkey") % (k + 9) != 0).alias(d) for k, d in enumerate(governance.DIMENSIONS)]
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "accept").otherwise("reject").alias("decision"), *flags)
    return governance.decision_contract(d, "o_orderkey", "decision").withColumn("failing", F.array_join("failing", ","))


@query("SELECT user_id, arg_max(props, event_id) AS config, max(event_id) AS since FROM events WHERE event_type = 'purchase' GROUP BY 1")
def accepted_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "commit").otherwise("candidate").alias("action"), F.col("props").alias("config"))
    return governance.accepted_configs(log, "user_id", "event_id", "action", "config")


@query(
    """WITH e AS (SELECT user_id, 'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS key, arg_max(value, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, string_agg(key || '=' || printf('%.2f', v), ',' ORDER BY key) AS repairs FROM e GROUP BY 1"""
)
def repair_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    log = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("user_id", "event_id", F.create_map(k, F.col("value")).alias("m"))
    got = governance.repair_state(log, "user_id", "event_id", "m")
    return got.select("user_id", F.array_join(F.transform(F.map_entries("repairs"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.2f", e["value"]))), ",").alias("repairs"))


ROTATION = ("click", "view", "signup", "purchase")


@query(
    f"""WITH t AS (SELECT event_id, event_type AS k, {list(ROTATION)} AS r, CASE WHEN value > 60 THEN 'accept' WHEN value > 20 THEN 'reject' WHEN value > 10 THEN 'refine' ELSE 'escalate' END AS d, event_id % 3 = 0 AS c FROM events)
    SELECT event_id, CASE WHEN d IN ('refine', 'escalate') THEN 'learning_rate' WHEN d = 'reject' AND c THEN 'batch_size' WHEN d = 'reject' THEN r[coalesce(list_position(r, k), 0) % 4 + 1] ELSE k END AS key,
           CASE WHEN d = 'accept' AND event_id % 2 != 0 THEN 2e0 ELSE 0.5e0 END AS factor FROM t"""
)
def next_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    decision = F.when(v > 60, "accept").when(v > 20, "reject").when(v > 10, "refine").otherwise("escalate")
    move = governance.next_move(decision, F.col("event_id") % 3 == 0, F.col("event_type"), F.col("event_id") % 2 == 0, ROTATION)
    return table(spark, sf_dir, "events").select("event_id", move.alias("m")).select("event_id", "m.key", "m.factor")


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS l, count(*) AS n FROM conversations GROUP BY 1),
    s AS (SELECT *, n - list_max(list_transform(l, lambda x, i: CASE WHEN x != l[-1] THEN i ELSE 0 END)) AS streak FROM c)
    SELECT conv_id, CASE WHEN conv_id % 13 = 0 THEN 'pivot_request' WHEN conv_id % 11 = 0 THEN 'claim_rendering' WHEN conv_id % 7 >= 5 THEN 'consecutive_failures'
    WHEN n = 1 THEN 'first_proposal' WHEN streak >= 2 THEN 'repeated_class' ELSE 'iteration_boundary' END AS trigger FROM s"""
)
def review_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's roles in order stand for the classes of prior mutations; their number is small."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"))
    i = F.col("conv_id")
    why = governance.review_trigger({"pivot_request": i % 13 == 0, "claim_rendering": i % 11 == 0}, F.when(i % 7 >= 5, 2).otherwise(0), F.size("roles") == 1, F.col("roles"), long_streak=2)
    return c.select("conv_id", why.alias("trigger"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'resource_exhausted' WHEN 'click' THEN 'simulation_instability' ELSE 'tool_error' END AS failure_class,
    CASE event_type WHEN 'error' THEN event_id % 4 > 1 WHEN 'click' THEN true ELSE false END AS retryable, coalesce(CASE WHEN event_type = 'error' AND event_id % 4 > 1 THEN greatest(1, event_id % 4 // 2) END, -1) AS batch_size,
    coalesce(CASE WHEN event_type = 'click' THEN 0.005e0 END, -1) AS learning_rate, coalesce(CASE WHEN event_type = 'click' THEN least(event_id % 9, 5) END, -1)::DOUBLE AS gradient_clip FROM events"""
)
def failure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_type") == "error", "CUDA out of memory").when(F.col("event_type") == "click", "loss is NaN").otherwise("lost connection")
    r = governance.failure_repair(message, F.col("event_id") % 4, F.lit(0.01), (F.col("event_id") % 9).cast("double"))
    got = table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.*")
    return got.fillna(-1, ["batch_size", "learning_rate", "gradient_clip"]).withColumn("batch_size", F.col("batch_size").cast("long"))


@query(
    """SELECT p_partkey, round(0.05e0 + 0.4e0 * (log10(p_retailprice / 1e6) - log10(2e-3)) ** 2 + 0.01e0 * (log10(p_size) - log10(0.5e0)) ** 2
    + 0.005e0 * (log10(p_size * 2) - log10(20e0)) ** 2 + 0.002e0 * (log10(p_size + 1) - log10(1e0)) ** 2 + 0.001e0 * (p_size - 5) ** 2 / 25, 6) AS loss FROM part WHERE p_size > 0"""
)
def synthetic_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    loss = governance.synthetic_surface(F.col("p_retailprice") / 1e6, size, size * 2, size + 1, size)
    return table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", F.round(loss, 6).alias("loss"))


@query(
    """WITH x AS (SELECT p_name || '/' || p_partkey AS n, CASE WHEN p_size > 25 THEN p_size / 1e2 ELSE 0e0 END AS d FROM part)
    SELECT count(*) FILTER (WHERE d > 0) AS n_changed, round(max(d), 6) AS max_abs_change, arg_max(n, struct_pack(a := round(d, 6), b := n)) AS most_changed, 0::BIGINT AS unmatched FROM x"""
)
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", F.col("p_partkey")).alias("name"), "p_size")
    before = p.select("name", F.lit(0.0).alias("v"))
    after = p.select("name", F.when(F.col("p_size") > 25, F.round(F.col("p_size") / 100, 6)).otherwise(0.0).alias("v"))
    return governance.parameter_changes(before, after, "name", "v").withColumn("max_abs_change", F.round("max_abs_change", 6))


@query(
    """WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS found FROM events)
    SELECT event_id AS claim_id, 'k' AS field, found + 1 AS value, found FROM x WHERE event_id % 10 = 3"""
)
def bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth claim states a value that its metric file doesn't have."""
    e = table(spark, sf_dir, "events")
    metrics = e.select(F.col("event_id").alias("artifact_id"), F.concat(F.lit('{"aggregate": '), "props", F.lit("}")).alias("payload"))
    stated = F.get_json_object("props", "$.k").cast("double") + (F.col("event_id") % 10 == 3).cast("int")
    claims = e.select(F.col("event_id").alias("claim_id"), F.col("event_id").alias("artifact_id"), F.lit("k").alias("field"), stated.alias("value"))
    return governance.bound_values(claims, metrics)


@query(
    """WITH o AS (SELECT 's' || r_regionkey AS step_id, r_name AS output FROM region)
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN output ELSE p_name END AS resolved FROM part LEFT JOIN o ON step_id = 's' || (p_size % 7)"""
)
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the parameters refer to a step's output; two of the seven steps named don't exist."""
    reference = F.concat(F.lit("$steps.s"), (F.col("p_size") % 7).cast("string"), F.lit(".name"))
    params = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, reference).otherwise(F.col("p_name")).alias("value"))
    outputs = table(spark, sf_dir, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("step_id"), F.lit("name").alias("field"), F.col("r_name").alias("output"))
    return governance.resolved_references(params, outputs, "value").select("p_partkey", "resolved")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def spent_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.spent_authorizations(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").filter("lang = 'de'"), "doc_id")


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 50 = 0 THEN 'o_custkey' END, CASE WHEN o_orderkey % 40 = 1 THEN 'o_orderstatus' END) AS unequal
    FROM orders WHERE o_custkey % 50 = 0 OR o_orderkey % 40 = 1"""
)
def identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 == 1, "?").otherwise(F.col("o_orderstatus"))).withColumn("o_custkey", F.when(F.col("o_custkey") % 50 == 0, -1).otherwise(F.col("o_custkey")))
    return governance.mismatches(o, other, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]).withColumn("unequal", F.array_join("unequal", ","))


@query(
    """WITH s(stage, position) AS (VALUES ('system', 0), ('user', 1), ('assistant', 2)), l AS (SELECT conv_id, max(position) AS z FROM conversations JOIN s ON role = stage GROUP BY 1)
    SELECT conv_id, stage FROM l JOIN s ON position <= z WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = l.conv_id AND x.role = s.stage)"""
)
def stage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = spark.createDataFrame([("system", 0), ("user", 1), ("assistant", 2)], "stage string, position int")
    done = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("stage"))
    return governance.stage_gaps(done, stages, "conv_id")


@query("SELECT 'rounds' AS field, '4' AS left_value, '5' AS right_value")
def arm_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix whose random and hybrid arms differ in one field that must be equal."""
    arms = spark.createDataFrame([("zero_shot", 0, 0, 0), ("static", 32, 0, 0), ("random", 32, 40, 4), ("hybrid", 32, 40, 5)], "arm string, initial_labels int, budget int, rounds int")
    return governance.unequal_arms(arms, "arm", "random", "hybrid", ["initial_labels", "budget", "rounds"])
