"""Clearance before a run, and the small decisions of a loop; the tables' columns stand for their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import scalars
from veinwork.operators import clearance, governance, policy
from veinwork.plans.registry import query
from veinwork.sources.tables import table


@query(
    """WITH f AS (SELECT DISTINCT url AS path FROM pages), a AS (SELECT DISTINCT url AS path FROM pages WHERE page_id % 10 != 3 UNION SELECT 'missing/' || item_id FROM benchmark)
    SELECT path, 'unexpected' AS problem FROM f ANTI JOIN a USING (path) UNION ALL SELECT path, 'missing' FROM a ANTI JOIN f USING (path)
    UNION ALL SELECT path, 'forbidden_path' FROM f WHERE contains(lower(path), '/fr/')"""
)
def transport_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth page isn't listed, some listed files don't exist, French ones are forbidden."""
    files = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("missing/"), F.col("item_id").cast("string")).alias("path"))
    return clearance.transport_problems(files, files.filter("page_id % 10 != 3").select("path").unionByName(gone), "path", ["/FR/"])


@query(
    """SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN TIMESTAMP '1996-01-15' < o_orderdate THEN 'not_yet_valid' END, CASE WHEN TIMESTAMP '1996-01-15' > o_orderdate + INTERVAL 300 DAY THEN 'expired' END,
    CASE WHEN o_orderkey % 40 = 1 THEN 'changed:status' END, CASE WHEN o_custkey % 50 = 0 THEN 'changed:price' END) AS problems FROM orders) WHERE problems != ''"""
)
def approval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an approval of 300 days; some live records changed since."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    live = (F.when(F.col("o_orderkey") % 40 == 1, "?").otherwise(status), F.when(F.col("o_custkey") % 50 == 0, price + 1).otherwise(price))
    why = clearance.approval_problems(F.lit("1996-01-15").cast("timestamp"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 300 DAY"), {"status": (status, live[0]), "price": (price, live[1])})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(why, ",").alias("problems")).filter("problems != ''")


@query(
    """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 5 = 0 THEN p_brand END, 'unidentified-storage') AS storage FROM part WHERE p_size % 2 = 0"""
)
def surviving_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", (size % 2 == 0).alias("active"), F.when(size % 3 == 0, F.col("p_name")).alias("volume"), F.when(size % 5 == 0, F.col("p_brand")).alias("store"))
    return clearance.surviving_storage(p, "p_partkey", "active", ["volume", "store"])


@query("SELECT p_partkey, '/pins/1' AS path FROM part UNION ALL SELECT p_partkey, '/sub/rev' FROM part WHERE p_size % 2 = 0")
def pending_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registration with a pending place in a list, and in half of them one in an object."""
    rev = F.when(F.col("p_size") % 2 == 0, "TBD").otherwise("r1")
    text = F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "pins": ["ok", "TBD"], "sub": {"rev": "'), rev, F.lit('"}}'))
    return clearance.pending_fields(table(spark, sf_dir, "part").select("p_partkey", text.alias("doc")), "doc", "p_partkey")


@query(
    """SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 != 0 THEN 'frozen' END, CASE WHEN p_size % 3 = 0 THEN 'hidden' END) AS flags FROM part) WHERE flags != ''"""
)
def fixture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flag is set for odd sizes, the other is missing for every third."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 != 0).alias("frozen"), F.when(F.col("p_size") % 3 != 0, False).alias("hidden"))
    return p.select("p_partkey", F.array_join(clearance.unattested(["frozen", "hidden"]), ",").alias("flags")).filter("flags != ''")


@query("SELECT p_partkey, p_size % 3 != 0 AND p_size % 7 != 0 AS aggregate_only FROM part")
def aggregate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 3 == 0, "record_mae").when(size % 7 == 0, "mae::a").otherwise("mae_records")
    return table(spark, sf_dir, "part").select("p_partkey", clearance.aggregate_only(F.create_map(F.lit("rmse"), F.lit(1.0), name, F.lit(2.0))).alias("aggregate_only"))


@query(
    """SELECT o_orderkey, 'price' AS constraint_id, o_totalprice AS observed, 2e5 AS "limit", o_totalprice <= 2e5 AS passed FROM orders
    UNION ALL SELECT o_orderkey, 'customer', o_custkey::DOUBLE, 1e2, o_custkey <= 100 FROM orders"""
)
def constraint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clearance.constraint_rows(table(spark, sf_dir, "orders"), "o_orderkey", {"price": (F.col("o_totalprice"), 200_000), "customer": (F.col("o_custkey"), 100)})


@query(
    """SELECT * FROM (SELECT w.p_partkey AS artifact_id, concat_ws(',', CASE WHEN r.p_partkey IS NULL THEN 'unregistered' END, CASE WHEN r.p_partkey IS NOT NULL AND w.p_size % 6 = 0 THEN 'kind' END,
    CASE WHEN r.p_size > 45 THEN 'changed' END, CASE WHEN r.p_size % 8 = 0 THEN 'outside' END) AS problems FROM part w LEFT JOIN (SELECT * FROM part WHERE p_partkey % 50 != 7) r ON w.p_partkey = r.p_partkey) WHERE problems != ''"""
)
def registered_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").withColumn("artifact_id", F.col("p_partkey"))
    wanted = p.select("artifact_id", F.when(size % 6 == 0, "other").otherwise(F.col("p_type")).alias("kind"))
    path = F.concat(F.when(size % 8 == 0, "/tmp/").otherwise("run/"), F.col("p_name"))
    registry = p.filter("p_partkey % 50 != 7").select("artifact_id", F.col("p_type").alias("kind"), path.alias("path"), F.col("p_brand").alias("stored_sha"), F.when(size > 45, "x").otherwise(F.col("p_brand")).alias("actual_sha"))
    return clearance.artifact_problems(wanted, registry, "run/").withColumn("problems", F.array_join("problems", ","))


@query("""SELECT event_id, '{"outer": {"api-key": "[REDACTED]", "n": [{"Token": "[REDACTED]"}, 3]}, "props": ' || props || '}' AS clean FROM events""")
def hidden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a secret's name at two depths, one of them in a list."""
    text = F.concat(F.lit('{"outer": {"api-key": 1, "n": [{"Token": 2}, 3]}, "props": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", clearance.hidden_values(text).alias("clean"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'blocked' WHEN user_id % 7 >= 5 THEN 'complete' WHEN value <= 50 THEN 'partial' ELSE 'continue' END AS status FROM events")
def stopping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("event_type") == "error", "escalate").otherwise("accept")
    return table(spark, sf_dir, "events").select("event_id", policy.stopping(decision, F.col("user_id") % 7, 5, F.col("value") - 50).alias("status"))


@query("SELECT p_partkey, p_size % 4 != 0 AS sound FROM part")
def cost_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth card's total is one too high."""
    hourly, minutes = F.col("p_retailprice"), F.col("p_size")
    total = hourly * minutes / 60 + (minutes % 4 == 0).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", policy.cost_card(hourly, minutes, total).alias("sound"))


@query("SELECT p_partkey, p_size % 5 != 0 AND p_size % 4 <= 2 AS allowed FROM part")
def tier_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = list(governance.TIER_OF_CLASS.values())
    tier = F.when(F.col("p_size") % 5 == 0, "unheard_of").otherwise(F.element_at(F.array(*map(F.lit, tiers)), (F.col("p_size") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", policy.tier_allowed(tier, "replicated", tiers).alias("allowed"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk FROM part")
def lock_in_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", policy.lock_in_risk(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("risk"))


@query("SELECT p_partkey, round_even(least(greatest(p_size * 0.5e0, 2), 20), 0) AS moved FROM part")
def bounded_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", policy.bounded_move(F.col("p_size"), 0.5, 2.0, 20.0, integer=True).alias("moved"))


@query("SELECT p_partkey, least(greatest(p_retailprice * CASE p_size % 4 WHEN 0 THEN 2e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END, 500), 1500) AS proposed FROM part")
def review_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    note = F.when(size == 0, "Please increase it").when(size == 1, "reduce the rate").when(size == 2, "increase or reduce").otherwise("fine as is")
    return table(spark, sf_dir, "part").select("p_partkey", policy.review_direction(note, F.col("p_retailprice"), 500.0, 1500.0).alias("proposed"))


@query("SELECT o_orderkey, epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate) > 1000 * 3600000000 AS stale FROM orders")
def stale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_stale(F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate"), 1000).alias("stale"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'l4' WHEN 1 THEN 'a100' ELSE 'unknown' END AS device FROM part")
def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    name = F.concat(F.lit("  NVIDIA   "), F.when(size == 0, "L4").when(size == 1, "A100").otherwise("Z9"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(scalars.normalised_name(name, {"nvidia l4": "l4", "nvidia a100": "a100"}), F.lit("unknown")).alias("device"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'auth' WHEN 'view' THEN 'rate_limited' WHEN 'click' THEN 'timeout' ELSE 'tool_error' END AS failure_class FROM events")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "signup", "HTTP 401").when(kind == "view", "Rate limit 429").when(kind == "click", "Timed OUT").otherwise("boom")
    return table(spark, sf_dir, "events").select("event_id", scalars.classified(message, [("401|403", "auth"), ("429|rate limit", "rate_limited"), ("timed out", "timeout")], "tool_error").alias("failure_class"))


@query("WITH t AS (SELECT *, CASE WHEN p_size % 9 = 0 THEN 'x' ELSE sha256(p_partkey || '|' || p_name) END AS seal FROM part) SELECT p_partkey, seal = sha256(p_partkey || '|' || p_name) AS sealed FROM t")
def sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seal = F.when(F.col("p_size") % 9 == 0, "x").otherwise(scalars.content_hash("p_partkey", "p_name"))
    return table(spark, sf_dir, "part").withColumn("seal", seal).select("p_partkey", scalars.sealed("seal", "p_partkey", "p_name").alias("sealed"))


@query("SELECT o_orderkey, o_custkey % 2 = 1 AND o_orderkey % 3 != 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS constraint_failed FROM orders")
def prior_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.when(F.col("o_custkey") % 2 == 1, "reject").otherwise("accept")
    return table(spark, sf_dir, "orders").select("o_orderkey", governance.prior_outcome(decision, k % 3 != 0, k % 5 != 0, k % 7 != 0, k % 11 != 0).alias("constraint_failed"))


@query("SELECT p_partkey, round(2e0 * p_size * p_retailprice + 1, 4) AS volume FROM part")
def cell_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: (x if not isinstance(x, int) else F.lit(x)).cast("double")
    cell = F.array(*(F.array(*map(d, row)) for row in ((F.col("p_size"), 1, 0), (0, 2, 1), (1, 0, F.col("p_retailprice")))))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.determinant3(cell), 4).alias("volume"))
