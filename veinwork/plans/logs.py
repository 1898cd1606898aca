"""Event-log audits. Events of a user stand for the steps of a run, conversation turns for a lineage chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import events, policy
from veinwork.plans.registry import query
from veinwork.sources.tables import table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    """WITH p AS (SELECT event_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS e, count(*) AS d, min(event_id) AS a, max(event_id) AS z FROM p)
    SELECT e AS n_events, e - d AS repeated, greatest(z + 1, e) - d AS missing, e = d AND greatest(z + 1, e) = d AND a = 0 AS dense FROM s"""
)
def event_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.density(_log(spark, sf_dir), "event_id")


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS attempts,
    CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS status,
    count(*) FILTER (WHERE event_type = 'view') > 1 AS resumed, min(event_id) AS first_event, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1"""
)
def step_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.step_fold(_log(spark, sf_dir), "user_id", "event_id", "event_type", "view", "purchase", "error")


# Which event may follow which.
TRANSITIONS = {"signup": ("view", "click", "error"), "view": ("view", "click", "purchase"), "click": ("view", "click", "purchase", "error"), "purchase": ("view", "signup"), "error": ("view", "error", "signup")}
PAIRS = [(a, b) for a, bs in TRANSITIONS.items() for b in bs]
VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)


@query(
    f"""WITH t AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, event_type AS to_state FROM events)
    SELECT * FROM t WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {VALUES})"""
)
def transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame(PAIRS, "from_state string, to_state string")
    return events.transition_audit(_log(spark, sf_dir), "user_id", "event_id", "event_type", allowed)


@query(
    """WITH b AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS z FROM events GROUP BY 1)
    SELECT e.user_id, count(*) FILTER (WHERE z IS NULL OR event_id > z) AS streak FROM events e JOIN b USING (user_id) GROUP BY 1"""
)
def trailing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.trailing_streak(_log(spark, sf_dir), "user_id", "event_id", F.col("event_type") != "error")


@query(
    """SELECT * FROM (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'signup') AS first_seq, min(event_id) FILTER (WHERE event_type = 'purchase') AS then_seq
    FROM events GROUP BY 1) WHERE then_seq IS NOT NULL AND (first_seq IS NULL OR first_seq > then_seq)"""
)
def event_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.order_check(_log(spark, sf_dir), "user_id", "event_id", "event_type", "signup", "purchase")


@query(
    """SELECT * FROM (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE event_type = 'view') AS n_view,
    count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM events GROUP BY 1, 2)
    WHERE n_view != 1 OR n_click != 1 OR n_purchase != 1"""
)
def exactly_once_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return events.exactly_once(log, ["user_id", "hour"], "event_type", ["view", "click", "purchase"])


@query(
    """SELECT event_id, CASE WHEN value > 80 THEN 'abort' WHEN event_type NOT IN ('view', 'click') AND event_type != 'error' AND event_id % 2 = 0 THEN 'pivot'
    WHEN event_type NOT IN ('view', 'click') THEN 'escalate' WHEN event_id % 3 <= 0 THEN 'escalate' WHEN event_type = 'click' THEN 'refine' ELSE 'retry' END AS decision FROM events"""
)
def recovery_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(F.col("value") > 80, "critical").otherwise("minor")
    failure = F.when(kind == "error", "validation_error").otherwise("tool_error")
    recommended = F.when(F.col("event_id") % 2 == 0, "pivot").otherwise("escalate")
    decided = policy.recovery(severity, kind.isin("view", "click"), failure, recommended, F.col("event_id") % 3, kind == "click")
    return _log(spark, sf_dir).select("event_id", decided.alias("decision"))


@query(
    """WITH p AS (SELECT event_id AS matched_id, ts AS matched_at, user_id FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, e.ts, CASE WHEN e.ts - matched_at <= INTERVAL 240 HOUR THEN matched_id ELSE -1 END AS matched_id
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.matched_at"""
)
def preflight_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for jobs, signups for preflight records: the newest one before the job that isn't stale."""
    log = _log(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    jobs = log.filter("event_type = 'purchase'").drop("event_type")
    found = events.latest_before(jobs, log.filter("event_type = 'signup'"), ["user_id"], "ts", "ts", "event_id", within_hours=240)
    return found.select("event_id", "user_id", "ts", F.coalesce("matched_id", F.lit(-1)).alias("matched_id"))


@query(
    """SELECT user_id, event_type, arg_min(CASE WHEN value > 20 THEN 'approved' ELSE 'rejected' END, event_id) AS verdict,
    min(event_id) AS decided_by, count(*) AS n_rows FROM events GROUP BY 1, 2"""
)
def approval_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _log(spark, sf_dir).withColumn("v", F.when(F.col("value") > 20, "approved").otherwise("rejected"))
    return events.first_match(verdicts, ["user_id", "event_type"], "event_id", "v")


@query(
    """WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 - CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 1 ELSE 0 END END AS parent FROM conversations),
    u AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
    SELECT conv_id, turn FROM u WHERE b IS DISTINCT FROM parent"""
)
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every fifth conversation the third turn names a wrong parent."""
    identifier = F.col("conv_id") * 1000 + F.col("turn")
    wrong = ((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2)).cast("int")
    parent = F.when(F.col("turn") > 0, identifier - 1 - wrong)
    return events.chain_breaks(table(spark, sf_dir, "conversations"), "conv_id", "turn", parent, identifier)


@query(
    """SELECT c.conv_id, r.role FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('system'), ('user'), ('assistant')) r(role)
    WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r.role)"""
)
def chain_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([("system",), ("user",), ("assistant",)], "role string")
    return events.missing_kinds(table(spark, sf_dir, "conversations"), "conv_id", "role", required)


@query(
    """WITH h AS (SELECT user_id, event_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) // 50 AS k FROM events),
    f AS (SELECT user_id, arg_min(stage, event_id) AS fs, arg_min(k, event_id) AS fk FROM h GROUP BY 1)
    SELECT user_id, event_id, concat_ws(',', CASE WHEN stage IS DISTINCT FROM fs THEN 'stage' END, CASE WHEN k IS DISTINCT FROM fk THEN 'k' END) AS changed
    FROM h JOIN f USING (user_id) WHERE stage IS DISTINCT FROM fs OR k IS DISTINCT FROM fk"""
)
def config_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.get_json_object("props", "$.k").cast("long") / 50)
    h = _log(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("stage"), k.alias("k"))
    return events.config_changes(h, "user_id", "event_id", ["stage", "k"]).withColumn("changed", F.array_join("changed", ","))


@query(
    """WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
        UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 7) FROM nation WHERE n_nationkey + 7 < 25),
    n AS (SELECT 'R' || r_regionkey AS node, r_regionkey AS position FROM region UNION ALL SELECT 'N' || n_nationkey, 100 + n_nationkey FROM nation),
    d AS (SELECT node, 0 AS depth FROM n UNION SELECT child, depth + 1 FROM d JOIN e ON node = parent)
    SELECT node, max(depth) AS depth, any_value(position)::BIGINT AS position FROM d JOIN n USING (node) GROUP BY 1"""
)
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions feed their nations, and each nation the one seven numbers on; sort by depth, then position."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    n = F.col("n_nationkey")
    edges = nation.select(name("R", F.col("n_regionkey")).alias("parent"), name("N", n).alias("child")).unionByName(nation.filter(n + 7 < 25).select(name("N", n).alias("parent"), name("N", n + 7).alias("child")))
    nodes = region.select(name("R", F.col("r_regionkey")).alias("node"), F.col("r_regionkey").cast("long").alias("position")).unionByName(nation.select(name("N", n).alias("node"), (n + 100).cast("long").alias("position")))
    return events.topological_depths(edges, nodes)
