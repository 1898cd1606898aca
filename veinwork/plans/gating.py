"""Gates with every reason planted, failure records and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import gates, policy, split
from veinwork.plans.registry import query
from veinwork.sources.tables import table


@query(
    """WITH s AS (SELECT p_brand AS partition, count(*) FILTER (WHERE p_brand != 'Brand#13') AS actual, 80 AS requested, CASE WHEN p_brand < 'Brand#20' THEN 90 ELSE 1 END AS minimum FROM part GROUP BY 1)
    SELECT partition, requested, actual, concat_ws(',', CASE WHEN actual < minimum THEN 'below_minimum' END, CASE WHEN abs(actual - requested) > requested * 0.125e0 THEN 'deviation' END) AS problems,
           CASE WHEN actual != requested THEN partition || ': ' || requested || ' requested, whole groups gave ' || actual END AS warning FROM s"""
)
def split_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are partitions, of which one is empty: some are too small, some too far from the size that was asked for."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "partition")
    spec = p.select("partition").distinct().select("partition", F.lit(80).alias("requested"), F.when(F.col("partition") < "Brand#20", 90).otherwise(1).alias("minimum"))
    sizes = p.filter("partition != 'Brand#13'").groupBy("partition").agg(F.count("*").alias("n_records"))
    return gates.split_gates(sizes, spec, 0.125).withColumn("problems", F.array_join("problems", ","))


@query(
    """WITH s AS (SELECT l_suppkey % 97 AS family, CASE WHEN l_suppkey % 97 % 3 = 0 THEN l_returnflag ELSE 'N' END AS partition FROM lineitem)
    SELECT family, array_to_string(list_sort(list(DISTINCT partition)), ',') AS partitions FROM s GROUP BY 1 HAVING count(DISTINCT partition) > 1"""
)
def divided_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose units a split has put into several partitions."""
    family = F.col("l_suppkey") % 97
    split = table(spark, sf_dir, "lineitem").select(family.alias("family"), F.when(family % 3 == 0, F.col("l_returnflag")).otherwise("N").alias("partition"))
    return gates.divided_families(split, "family").withColumn("partitions", F.array_join("partitions", ","))


@query(
    """WITH d AS (SELECT c_custkey AS dataset, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN false ELSE true END AS passed, c_custkey % 11 = 0 AS no_file, c_custkey % 13 = 0 AS changed_file, c_custkey % 17 = 0 AS changed_content, c_custkey % 19 = 0 AS refused, c_custkey % 23 = 0 AS unasked FROM customer),
    l AS (SELECT o_custkey AS dataset, count(*) AS n FROM orders WHERE o_orderkey % 29 = 3 GROUP BY 1),
    r AS (SELECT d.dataset, concat_ws(',', CASE WHEN passed IS NULL THEN 'no_report' END, CASE WHEN NOT passed THEN 'not_qualified' END, CASE WHEN no_file THEN 'no_file' END, CASE WHEN changed_file AND NOT no_file THEN 'file_changed' END,
          CASE WHEN changed_content THEN 'content_changed' END, CASE WHEN n > 0 THEN 'lineage_changed' END, CASE WHEN refused OR unasked THEN 'not_approved' END) AS reasons FROM d LEFT JOIN l USING (dataset))
    SELECT dataset, reasons = '' AS qualified, reasons FROM r"""
)
def dataset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are datasets and their orders the records: report, file, content, lineage derived again, and the approval that decides."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sha = F.sha2("c_name", 256)
    datasets = c.select(
        k.alias("dataset"), F.when(k % 5 == 0, F.lit(None)).otherwise(k % 7 != 0).alias("report_passed"), F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "x").otherwise("f").alias("file_sha256"), F.lit("f").alias("listed_file_sha256"),
        F.when(k % 17 == 0, "x").otherwise(sha).alias("content_sha256"), sha.alias("listed_content_sha256"),
    )
    # A second, later approval changes nothing.
    asked = c.filter(k % 23 != 0).select(F.lit("dataset_promotion").alias("gate"), sha.alias("subject_sha256"), (k % 19 != 0).alias("approved"), F.lit(1).alias("sequence"))
    other = c.select(F.lit("release").alias("gate"), sha.alias("subject_sha256"), F.lit(True).alias("approved"), F.lit(0).alias("sequence"))
    approvals = asked.unionByName(asked.withColumn("approved", ~F.col("approved")).withColumn("sequence", F.lit(2))).unionByName(other)
    derived = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("group"))
    listed = derived.withColumn("group", F.when(F.col("record") % 29 == 3, F.lit(None)).otherwise(F.col("group")))
    drift = gates.lineage_drift(derived, listed, "dataset", "record", ["group"])
    return gates.dataset_gate(datasets, approvals, drift).withColumn("reasons", F.array_join("reasons", ","))


@query(
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_pending, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'pending_fields' END, CASE WHEN p_partkey % 7 = 0 THEN 'no_approval' END, CASE WHEN p_partkey % 7 != 0 AND p_partkey % 3 = 0 THEN 'approval_not_valid' END) AS reasons FROM part)
    SELECT p_partkey, n_pending::BIGINT AS n_pending, reasons = '' AS open, reasons FROM r"""
)
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are runs: some have an open field, some no approval, some one that has run out."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    now = F.lit("2026-01-02").cast("date")
    until = F.when(k % 3 == 0, "2026-01-01").otherwise("2026-02-01").cast("date")
    approvals = p.filter(k % 7 != 0).select("p_partkey", F.lit("2025-12-01").cast("date").alias("approved_at"), until.alias("expires_at"))
    return gates.run_gate(p.select("p_partkey"), p.filter("p_size % 2 = 0").select("p_partkey"), approvals, "p_partkey", now).withColumn("reasons", F.array_join("reasons", ","))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS workload, CASE WHEN o_orderkey % 3 = 0 THEN 'cloud' WHEN o_orderkey % 5 = 0 THEN 'local' END AS wanted, CASE WHEN o_orderpriority = '1-URGENT' THEN 'cloud' WHEN o_orderpriority != '5-LOW' THEN 'local' END AS t, o_totalprice > 200000 AS costly FROM orders),
    w AS (SELECT *, CASE WHEN t IS NULL THEN 'unknown_workload' WHEN wanted IS NOT NULL AND costly THEN 'over_budget' ELSE '' END AS reasons FROM r)
    SELECT o_orderkey, CASE WHEN reasons = '' THEN coalesce(wanted, t) END AS routed, CASE WHEN reasons != '' THEN 'denied' WHEN wanted IS NOT NULL AND wanted != t THEN 'override' ELSE 'default' END AS status, reasons FROM w"""
)
def routed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for a provider; an override that the policy denies is refused, one that only waits for its device is not."""
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("workload"), F.when(k % 3 == 0, "cloud").when(k % 5 == 0, "local").alias("wanted"), "o_totalprice")
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    routes = spark.createDataFrame([(w, "cloud" if w == "1-URGENT" else "local") for w in kinds], "workload string, provider string")
    denials = policy.reasons({"over_budget": F.col("o_totalprice") > 200000, "no_attestation": F.lit(True)})
    return gates.overridden(requests, routes, denials).select("o_orderkey", "routed", "status", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH e AS (SELECT l_orderkey AS run, l_partkey % 2 AS step, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS attempt, l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_returnflag != 'N'),
    t AS (SELECT *, (list(CASE WHEN q > 25 THEN 'halve_batch' END) OVER (PARTITION BY run, step ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l FROM e),
    u AS (SELECT *, coalesce(list_filter(l, lambda x: x IS NOT NULL), []) AS tried FROM t)
    SELECT run, step, attempt::INTEGER AS attempt, 'failure-' || left(sha256(run || '|' || step || '|' || attempt), 12) AS failure_id, CASE WHEN f = 'R' THEN 'out_of_memory' ELSE 'tool_error' END AS failure_class, CASE WHEN f = 'R' THEN 'high' ELSE 'medium' END AS severity,
           f = 'R' AS retryable, array_to_string(tried, ',') AS attempted_repairs, greatest(2 - len(tried), 0)::INTEGER AS remaining_budget,
           CASE WHEN f != 'R' THEN 'escalate' WHEN 2 - len(tried) <= 0 THEN 'escalate' WHEN q > 25 THEN 'refine' ELSE 'retry' END AS recommended_action FROM u"""
)
def step_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts of an order's two steps, with the repairs tried before, what is left of the budget, and what to do."""
    from pyspark.sql import Window

    step = (F.col("l_partkey") % 2).alias("step")
    order = Window.partitionBy("l_orderkey", F.col("l_partkey") % 2).orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    memory = F.col("l_returnflag") == "R"
    events = table(spark, sf_dir, "lineitem").filter("l_returnflag != 'N'").select(
        F.col("l_orderkey").alias("run"), step, F.row_number().over(order).alias("attempt"), F.lit("train").alias("skill"), F.when(memory, "out_of_memory").otherwise("tool_error").alias("failure_class"),
        F.when(memory, "high").otherwise("medium").alias("severity"), memory.alias("retryable"), F.lit("log").alias("observed"), F.array(F.lit("batch")).alias("causes"),
        F.when(F.col("l_quantity") > 25, "halve_batch").alias("repair"), F.lit(2).alias("budget"), F.array(F.lit("a")).alias("artifacts"),
    )
    action = policy.recovery(F.col("severity"), F.col("retryable"), F.col("failure_class"), F.lit("escalate"), F.col("remaining_budget"), F.col("repair").isNotNull())
    found = gates.failure_record(events, ["run", "step", "attempt"], action)
    return found.select("run", "step", "attempt", "failure_id", "failure_class", "severity", "retryable", F.array_join("attempted_repairs", ",").alias("attempted_repairs"), "remaining_budget", "recommended_action")


@query(
    """WITH s AS (SELECT l_orderkey AS run, string_agg('| s' || l_partkey || ' | train | ' || n || ' | ' || f || ' |', chr(10) ORDER BY l_partkey, 's' || l_partkey) AS steps, count(*) AS k FROM (SELECT l_orderkey, l_partkey, count(*) AS n, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT l_orderkey AS run, string_agg('- s' || l_partkey || ': retry after failure-' || l_partkey || ', repair {}', chr(10) ORDER BY l_partkey, 's' || l_partkey) AS recoveries FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
    SELECT o_orderkey AS run, '# Run ' || o_orderkey || chr(10) || chr(10) || '- Status: ' || CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed or incomplete' END || chr(10) || '- Seed: ' || o_custkey || chr(10) || '- Workflow: ' || o_orderpriority || chr(10) || '- Campaign: unknown' || chr(10)
        || '- Events: ' || k || ', artifacts: ' || k || chr(10) || chr(10) || '## Steps' || chr(10) || chr(10) || '| Step | Skill | Attempts | Status |' || chr(10) || '|-|-|-|-|' || chr(10) || steps || chr(10) || chr(10) || '## Failures and recovery' || chr(10) || chr(10)
        || coalesce(recoveries, '- none') || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '- none' ELSE '| Claim | Value | Units | Status | Backed by |' || chr(10) || '|-|-|-|-|-|' || chr(10) || '| c1 | 0.5 | eV | '
        || CASE WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'proposed (not verified)' END || ' | a, b |' END AS text FROM orders JOIN s ON s.run = o_orderkey LEFT JOIN r ON r.run = o_orderkey"""
)
def full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order: status, hashes, steps, recoveries and claims."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    steps = l.groupBy(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("place")).agg(F.count("*").alias("attempts"), F.max("l_returnflag").alias("status"))
    steps = steps.withColumn("step", F.concat(F.lit("s"), F.col("place").cast("string"))).withColumn("skill", F.lit("train"))
    failed = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("place")).distinct()
    name = F.col("place").cast("string")
    recoveries = failed.select("run", "place", F.concat(F.lit("s"), name).alias("step"), F.lit("retry").alias("decision"), F.concat(F.lit("failure-"), name).alias("failure_id"), F.lit("{}").alias("repair"))
    claims = o.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("run"), F.lit("c1").alias("claim"), F.lit("0.5").alias("value"), F.lit("eV").alias("units"), F.when(F.col("o_orderkey") % 3 == 0, "verified").otherwise("proposed").alias("status"), F.array(F.lit("a"), F.lit("b")).alias("artifacts"))
    counts = steps.groupBy("run").agg(F.count("*").alias("n_events"))
    runs = o.select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("completed"), F.col("o_custkey").alias("seed"), F.col("o_orderpriority").alias("workflow_sha256"), F.lit(None).cast("string").alias("campaign_sha256"))
    return gates.run_report(runs.join(counts, "run").withColumn("n_artifacts", F.col("n_events")), steps, recoveries, claims)


@query()
def split_by_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items dealt by whole orders to partitions of a tenth, a tenth and a half; what each got. Tests hold the invariants, as the choice among sizes isn't put in SQL."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")  # noqa: E741
    n = l.count()
    made = split.assign_by_sizes(l, "l_orderkey", {"test": n // 10, "validation": n // 10, "pool": n // 2}, "initial", 7)
    return made.groupBy("partition").agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_groups"), F.sum("l_orderkey").alias("key_sum"))
