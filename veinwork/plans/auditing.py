"""Policies, claims, redaction, exports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import scalars
from veinwork.operators import audit, policy
from veinwork.plans.registry import query
from veinwork.sources import exports
from veinwork.sources.tables import table


@query(
    """SELECT o_orderkey, CASE WHEN NOT o_custkey % 17 != 0 THEN 'reject' WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'refine' WHEN o_orderstatus = 'P' THEN 'escalate'
    WHEN (CASE WHEN o_totalprice = 0 THEN 0 ELSE (o_totalprice - o_totalprice * (0.9e0 + (o_custkey % 10) / 1e2)) / abs(o_totalprice) END) >= 0.055e0 AND o_totalprice <= 399999.995 THEN 'accept' ELSE 'reject' END AS decision FROM orders"""
)
def acceptance_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    candidate = price * (0.9 + (cust % 10) / 100)
    decided = policy.acceptance(cust % 17 != 0, F.col("o_orderstatus") == "P", cust % 2 == 0, price, candidate, 0.055, {"price": (price, F.lit(399999.995))})
    return table(spark, sf_dir, "orders").select("o_orderkey", decided.alias("decision"))


# Ranges of a mutation policy, by part type.
POLICY = [("ECONOMY", "numeric", 5.0, 40.0), ("STANDARD", "numeric", 1.0, 30.0), ("PROMO", "owner_gated", None, None), ("LARGE", "numeric", 10.0, 50.0)]


@query(
    f"""WITH p(name, class, low, high) AS (VALUES {", ".join(f"('{n}', '{c}', {'NULL' if a is None else a}, {'NULL' if b is None else b})" for n, c, a, b in POLICY)}),
    m AS (SELECT p_brand AS proposal, p_type AS name, p_size AS value FROM part),
    v AS (SELECT proposal, CASE WHEN coalesce(class, 'immutable') = 'immutable' THEN 'immutable:' || m.name WHEN class = 'owner_gated' THEN 'owner_gated:' || m.name
          WHEN NOT coalesce(value BETWEEN low AND high, false) THEN 'out_of_range:' || m.name END AS x FROM m LEFT JOIN p ON m.name = p.name),
    g AS (SELECT proposal, count(*) AS n_changes, list_sort(list_distinct(list(x) FILTER (WHERE x IS NOT NULL))) AS l FROM v GROUP BY 1)
    SELECT proposal, n_changes, concat_ws(',', nullif(array_to_string(coalesce(l, []), ','), ''), CASE WHEN n_changes > 80 THEN 'too_many_changes' END) AS violations,
           len(coalesce(l, [])) = 0 AND n_changes <= 80 AS legal FROM g"""
)
def mutation_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a proposal, each of its parts a change."""
    mutations = table(spark, sf_dir, "part").select(F.col("p_brand").alias("proposal"), F.col("p_type").alias("name"), F.col("p_size").alias("value"))
    rules = spark.createDataFrame(POLICY, "name string, class string, low double, high double")
    return policy.mutation_legality(mutations, rules, 80).withColumn("violations", F.array_join("violations", ","))


@query(
    """SELECT o_orderkey, r AS reasons, r = '' AS allowed FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'over_budget' END,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'priority' END, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'stale' END) AS r FROM orders)"""
)
def policy_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = policy.reasons({"over_budget": F.col("o_totalprice") > 300000, "priority": F.col("o_orderpriority") == "1-URGENT", "stale": F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("allowed"))


AUDITED = """
    WITH a AS (SELECT p_partkey AS artifact_id, p_type AS kind, p_brand AS stored, CASE WHEN p_size > 45 THEN 'x' ELSE p_brand END AS actual FROM part WHERE p_partkey % 50 != 7),
    r AS (SELECT o_orderkey AS claim_id, l_partkey AS artifact_id FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey),
    g AS (SELECT claim_id, count(*) FILTER (WHERE r.artifact_id IS NOT NULL) AS n_refs, count(*) FILTER (WHERE r.artifact_id IS NOT NULL AND kind IS NULL) AS unregistered,
          count(*) FILTER (WHERE stored != actual) AS corrupted, count(*) FILTER (WHERE kind IN ('PROMO')) AS forbidden FROM r LEFT JOIN a ON r.artifact_id = a.artifact_id GROUP BY 1),
    c AS (SELECT *, CASE WHEN n_refs = 0 THEN 'no_evidence' WHEN unregistered > 0 THEN 'unregistered' WHEN corrupted > 0 THEN 'corrupted' WHEN forbidden > 0 THEN 'forbidden_kind' ELSE 'backed' END AS category FROM g),
    s AS (SELECT *, CASE WHEN category = 'backed' THEN 'verified' ELSE 'rejected' END AS status FROM c)
"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_partkey % 50 != 7")
    artifacts = parts.select(F.col("p_partkey").alias("artifact_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("stored_sha"), F.when(F.col("p_size") > 45, "x").otherwise(F.col("p_brand")).alias("actual_sha"))
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set("l_partkey").alias("refs"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id")).join(refs, "claim_id", "left")
    return audit.claim_audit(claims, artifacts, ["PROMO"])


@query(f"{AUDITED} SELECT claim_id, n_refs, unregistered, corrupted, forbidden, category, status FROM s")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are claims, their parts the evidence; some parts are unregistered, corrupted or of a forbidden kind."""
    return _audited(spark, sf_dir)


@query(f"{AUDITED} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY 2")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.claim_counts(_audited(spark, sf_dir), ["category", "status"])


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' HF_TOKENS: x' || doc_id || '; my-secret=abc,d Authorization: Bearer credential sk-0123456789abcdef' || doc_id || ' ya29.abcdefghijklmnop ghp_0123456789abcdefXY ghx_0123456789abcdefXY',
    '([a-z0-9_-]*(?:token|secret|password|passwd|api[_-]?key|bearer|authorization|credential)s?)(\s*[=:]\s*)(\S+)', '\1\2[REDACTED]', 'gi'), '\bgh[opsu]_[A-Za-z0-9]{16,}\b', '[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]{16,}\b', '[REDACTED]', 'g'), '\bya29\.[A-Za-z0-9_-]{16,}\b', '[REDACTED]', 'g')) AS redacted_sha256 FROM documents"""
)
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with one secret of each form planted at its end."""
    i = F.col("doc_id").cast("string")
    planted = F.concat("text", F.lit(" HF_TOKENS: x"), i, F.lit("; my-secret=abc,d Authorization: Bearer credential sk-0123456789abcdef"), i, F.lit(" ya29.abcdefghijklmnop ghp_0123456789abcdefXY ghx_0123456789abcdefXY"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalars.redacted(planted), 256).alias("redacted_sha256"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_number FROM documents)
    SELECT doc_id, line_number::INTEGER AS line_number, sha256(line) AS line_sha256 FROM l WHERE regexp_matches(line, 'AKIA[A-Z0-9]{16}|token = ') AND NOT regexp_matches(line, 'example-only')"""
)
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.secret_lines(table(spark, sf_dir, "documents"), "doc_id", "text", ["AKIA[A-Z0-9]{16}", "token = "], ["example-only"])


@query("SELECT p_name AS member, count(DISTINCT p_type) AS n_sets, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS sets FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def pairwise_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "part").select("p_type", F.col("p_name").alias("member"))
    return policy.pairwise_overlap(sets, "p_type", "member").withColumn("sets", F.array_join("sets", ","))


@query(
    """WITH a AS (SELECT l_orderkey, count(*) AS n_atoms, string_agg(printf('%s %.10f %.10f %.10f %.10f %.10f %.10f', l_returnflag, l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax, l_quantity / 7, 0e0),
        chr(10) ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax) AS t FROM lineitem GROUP BY 1)
    SELECT o_orderkey, n_atoms, sha256(printf('%d', n_atoms) || chr(10) || printf('REF_energy=%.10f Properties=species:S:1:pos:R:3:REF_forces:R:3', o_totalprice) || chr(10) || t) AS frame_sha256
    FROM orders JOIN a ON o_orderkey = l_orderkey"""
)
def xyz_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    place = F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    atoms = l.select(F.col("l_orderkey").alias("o_orderkey"), place.alias("place"), F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("fx"), (F.col("l_quantity") / 7).alias("fy"), F.lit(0.0).alias("fz"))
    frames = exports.xyz_lines(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("energy")), atoms, "o_orderkey")
    return frames.select("o_orderkey", "n_atoms", F.sha2("text", 256).alias("frame_sha256"))


@query(
    """WITH e AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS s FROM documents WHERE doc_id % 10 != 3),
    a AS (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 4 THEN 'changed' ELSE sha256(coalesce(text, '')) END AS s FROM documents WHERE doc_id % 10 != 5)
    SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
    FROM e FULL JOIN a ON e.path = a.path WHERE a.path IS NULL OR e.path IS NULL OR e.s != a.s"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests of the documents, each with files that the other lacks, and some changed ones."""
    sha = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    actual = sha.filter("doc_id % 10 != 5").withColumn("sha", F.when(F.col("doc_id") % 10 == 4, "changed").otherwise(F.col("sha")))
    return audit.manifest_diff(sha.filter("doc_id % 10 != 3"), actual, "doc_id", "sha")


@query("SELECT p_name, count(DISTINCT p_brand) AS n_contents FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def artifact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.conflicting_artifacts(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query(
    """WITH g AS (SELECT event_type, count(*) AS n, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
    SELECT min(a) AS first_at, max(z) AS last_at, sum(n)::BIGINT AS n_events, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type FROM g"""
)
def provenance_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exports.provenance(table(spark, sf_dir, "events").withColumnRenamed("ts", "at"))
    listed = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return got.withColumn("by_type", F.array_join(listed, ","))


@query(
    """WITH k AS (SELECT o_orderkey, list_sort(list(l_returnflag)) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    g AS (SELECT len(s)::INTEGER AS length, array_to_string(s, ',') AS symbols, count(*) AS n_frames, min(o_orderkey) AS first_key FROM k GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY length, symbols)::INTEGER AS group_number FROM g"""
)
def symbol_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_returnflag")).alias("s"))
    return exports.symbol_groups(k.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey", "s")
