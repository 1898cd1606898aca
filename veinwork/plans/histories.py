"""Hash-chained ledgers, canonical documents and references at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import clearance, ledger, trees
from veinwork.plans.registry import query
from veinwork.plans.selecting import REQUESTS, _requests
from veinwork.sources.tables import table

BALANCED = f"""{REQUESTS.replace("WITH l AS", "l AS", 1)}, b AS (
        SELECT campaign, round, requested, charged, sum(charged) OVER w::BIGINT AS spent, (70 - sum(charged) OVER w)::BIGINT AS remaining,
               row_number() OVER w - 1 AS position FROM c WINDOW w AS (PARTITION BY campaign ORDER BY round)),
    q AS (SELECT campaign, round, sha256(concat_ws('|', campaign, round, 'data', 'split', array_to_string(list_sort(list(record_id)), ','))) AS request_id FROM r GROUP BY 1, 2),
    e AS (SELECT b.*, request_id, concat_ws('|', b.round, request_id, charged, spent, remaining) AS content FROM b JOIN q ON b.campaign = q.campaign AND b.round = q.round),
    chain AS (
        SELECT campaign, position, repeat('0', 64) AS prior_sha256, sha256(repeat('0', 64) || '|0|' || content) AS sha256 FROM e WHERE position = 0
        UNION ALL SELECT e.campaign, e.position, x.sha256, sha256(x.sha256 || '|' || e.position || '|' || content) FROM chain x JOIN e ON e.campaign = x.campaign AND e.position = x.position + 1)
"""
CONTENT = ["round", "request_id", "charged", "spent", "remaining"]


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label ledger of every campaign, an entry for each round, chained."""
    asked = _requests(spark, sf_dir)
    charges = ledger.balance(ledger.charge(asked), 70).drop("over_round", "refused")
    identity = ledger.requests_by_identity(asked.distinct(), F.lit("data"), F.lit("split")).select("campaign", "round", "request_id")
    return ledger.chained(charges.join(identity, ["campaign", "round"]), "campaign", "round", CONTENT)


@query(f"WITH RECURSIVE {BALANCED} SELECT e.campaign, e.round, e.position::BIGINT AS position, request_id, spent, remaining, prior_sha256, sha256 FROM e JOIN chain ON e.campaign = chain.campaign AND e.position = chain.position")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each campaign's label ledger, every entry bound to the one before by its hash."""
    return _chain(spark, sf_dir).select("campaign", "round", "position", "request_id", "spent", "remaining", "prior_sha256", "sha256")


@query(
    f"""WITH RECURSIVE {BALANCED}, n AS (SELECT campaign, max(position) AS z FROM e GROUP BY 1)
    SELECT campaign::BIGINT AS campaign, position::BIGINT AS position, problem FROM (
        SELECT 0 AS campaign, 2 AS position, 'content' AS problem UNION ALL SELECT 1, 3, 'gap' UNION ALL SELECT 2, 1, 'content' UNION ALL SELECT 2, 2, 'content' UNION ALL SELECT 2, 1, 'link'
        UNION ALL SELECT 2, 2, 'link' UNION ALL SELECT 2, 3, 'link' UNION ALL SELECT 3, 1, 'repeated' UNION ALL SELECT 3, z, 'head' FROM n WHERE campaign = 3)"""
)
def ledger_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with an entry changed (campaign 0), dropped (1) and two swapped (2), one repeated and the end cut off (3): what the audit finds."""
    chain = _chain(spark, sf_dir)
    at = lambda campaign, *positions: (F.col("campaign") == campaign) & F.col("position").isin(*positions)
    heads = ledger.chain_heads(chain, "campaign")
    last = F.col("position") == F.col("length") - 1
    broken = chain.join(heads.select("campaign", "length"), "campaign").filter(~(at(1, 2) | (F.col("campaign") == 3) & last)).drop("length")
    broken = broken.withColumn("charged", F.when(at(0, 2), F.col("charged") + 1).otherwise(F.col("charged")))
    broken = broken.withColumn("position", F.when(at(2, 1, 2), 3 - F.col("position")).otherwise(F.col("position")))
    broken = broken.unionByName(broken.filter(at(3, 1)))
    return ledger.chain_problems(broken, "campaign", CONTENT, heads)


def _props(order: str) -> Column:
    """One event as a JSON document; the same content is written in two ways."""
    value, user = F.round(F.col("value"), 2).cast("decimal(20,2)").cast("string"), F.col("user_id").cast("string")
    tags = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "list": [1, {"z": null, "a": true}]}'))
    if order == "sorted":
        return F.concat(F.lit('{"props": '), "props", F.lit(', "tags": '), tags, F.lit(', "user": '), user, F.lit(', "value": '), value, F.lit("}"))
    tags = F.concat(F.lit('{"list" :[1.0,{"a":true , "z":null}],"type":"'), "event_type", F.lit('"}'))
    return F.concat(F.lit('{"value":'), value, F.lit('0 , "tags": '), tags, F.lit(', "user": '), user, F.lit('.00, "props":'), "props", F.lit("}"))


@query(
    """WITH t AS (SELECT event_id, '{"props":' || replace(props, ' ', '') || ',"tags":{"list":[1,{"a":true,"z":null}],"type":"' || event_type || '"},"user":' || user_id || ',"value":'
          || regexp_replace(regexp_replace(round(value, 2)::DECIMAL(20,2)::VARCHAR, '0+$', ''), '[.]$', '') || '}' AS j FROM events)
    SELECT event_id, sha256(j) AS sha256, true AS alike FROM t"""
)
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of every event's document, and whether the same content with other key order, spaces and forms of numbers hashes alike."""
    a, b = trees.canonical_hash(_props("sorted")), trees.canonical_hash(_props("other"))
    return table(spark, sf_dir, "events").select("event_id", a.alias("sha256"), a.eqNullSafe(b).alias("alike"))


NESTED = '{"in": {"first": "$steps.load.rows", "list": ["$steps.fit.loss.mean", {"deep": ["$steps.load"]}, 7]}, "name": "'


def _parameters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts are steps with parameters at several depths, some of which refer to outputs that aren't there."""
    extra = F.when(F.col("p_size") % 5 == 0, "$steps.load.columns").when(F.col("p_size") % 7 == 0, "$steps.score.all").otherwise("$steps.fit.kind")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(NESTED), "p_brand", F.lit('", "x": "'), extra, F.lit('"}')).alias("doc"))
    regions = table(spark, sf_dir, "region").agg(F.count("*").cast("string").alias("n"))
    outputs = [("load", "rows", F.concat(F.lit('{"n": '), "n", F.lit(', "a": []}'))), ("fit", "loss.mean", F.lit("0.50")), ("fit", "kind", F.lit('"linear"'))]
    return rows, regions.select(F.explode(F.array(*(F.struct(F.lit(s).alias("step_id"), F.lit(f).alias("field"), v.alias("value")) for s, f, v in outputs))).alias("o")).select("o.*")


@query(
    """SELECT p_partkey, '{"in":{"first":{"a":[],"n":' || (SELECT count(*) FROM region) || '},"list":[0.5,{"deep":["$steps.load"]},7]},"name":"' || p_brand || '","x":"'
    || CASE WHEN p_size % 5 = 0 THEN '$steps.load.columns' WHEN p_size % 7 = 0 THEN '$steps.score.all' ELSE 'linear' END || '"}' AS text FROM part"""
)
def nested_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a step's output replaced, at any depth of a document."""
    rows, outputs = _parameters(spark, sf_dir)
    return trees.resolved(rows, "doc", "p_partkey", outputs)[0]


@query(
    """SELECT p_partkey, '/in/list/1/deep/0' AS path, '$steps.load' AS reference, 'malformed' AS problem FROM part
    UNION ALL SELECT p_partkey, '/x', '$steps.load.columns', 'no_field' FROM part WHERE p_size % 5 = 0
    UNION ALL SELECT p_partkey, '/x', '$steps.score.all', 'incomplete_step' FROM part WHERE p_size % 5 != 0 AND p_size % 7 = 0"""
)
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references that name no output, with the reason."""
    rows, outputs = _parameters(spark, sf_dir)
    return trees.resolved(rows, "doc", "p_partkey", outputs)[1]


@query("""SELECT event_id, '{"outer":{"api-key":"[REDACTED]","n":[{"Token":"[REDACTED]"},3]},"props":' || replace(props, ' ', '') || '}' AS text FROM events""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values under keys with a secret's name, whole objects too, replaced without leaving the JVM."""
    text = F.concat(F.lit('{"outer": {"api-key": {"a": [1]}, "n": [{"Token": 2}, 3]}, "props": '), "props", F.lit("}"))
    return trees.redacted(table(spark, sf_dir, "events").select("event_id", text.alias("doc")), "doc", "event_id", clearance.SECRET_KEYS)


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 30 = 1 THEN 'unknown' ELSE concat_ws(',', CASE WHEN o_custkey % 11 = 0 THEN 'dataset' END, CASE WHEN o_custkey % 13 = 0 THEN 'budget' END) END) AS broken
    FROM orders WHERE o_orderkey % 30 = 1 OR o_custkey % 11 = 0 OR o_custkey % 13 = 0"""
)
def contract_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of runs that name another dataset or budget than their contract, or have none."""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    contract = o.filter("o_orderkey % 30 != 1").select("o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("budget"))
    states = o.select("o_orderkey", F.when(c % 11 == 0, "other").otherwise(F.col("o_orderpriority")).alias("dataset"), F.when(c % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("budget"))
    return ledger.contract_breaks(states, contract, "o_orderkey", ["dataset", "budget"]).withColumn("broken", F.array_join("broken", ","))


@query(
    f"""{REQUESTS}, s AS (SELECT campaign, sum(charged)::BIGINT AS charged_total FROM c GROUP BY 1), m AS (SELECT campaign, max(charged) AS most FROM c GROUP BY 1)
    SELECT campaign, concat_ws(',', CASE WHEN campaign = 1 THEN 'total' END, CASE WHEN campaign = 2 THEN 'revealed' END, CASE WHEN campaign = 3 THEN 'rounds' END, CASE WHEN most > 15 THEN 'over_round' END) AS broken
    FROM s JOIN m USING (campaign) WHERE campaign IN (1, 2, 3) OR most > 15"""
)
def ledger_inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers whose remainder, number of revealed records or rounds don't fit their charge, one fault in each of three campaigns."""
    rounds = ledger.charge(_requests(spark, sf_dir)).select("campaign", "round", "charged", F.lit(15).cast("long").alias("budget"))
    total, k = F.sum("charged"), F.col("campaign")
    book = rounds.groupBy("campaign").agg(total.alias("charged_total")).withColumn("total_budget", F.lit(70))
    book = book.withColumn("remaining", 70 - F.col("charged_total") + (k == 1).cast("int")).withColumn("n_revealed", F.col("charged_total") - (k == 2).cast("int"))
    rounds = rounds.unionByName(rounds.filter("campaign = 3").groupBy("campaign").agg(F.lit(99).cast("bigint").alias("round"), F.lit(1).cast("bigint").alias("charged"), F.lit(15).cast("bigint").alias("budget")))
    return ledger.ledger_inconsistencies(book, rounds).withColumn("broken", F.array_join("broken", ","))
