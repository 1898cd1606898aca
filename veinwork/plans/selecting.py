"""Selection under a budget, and the label ledger. Embeddings stand for descriptors and ensemble predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import ledger, selection
from veinwork.plans.registry import query
from veinwork.sources.tables import table, written

BUDGET, SEED = 10, 55


@query(
    f"""WITH t AS (SELECT vec_id, sha256('{SEED}~' || vec_id) AS order_key FROM embeddings ORDER BY order_key, vec_id LIMIT 20)
    SELECT vec_id, order_key, row_number() OVER (ORDER BY order_key, vec_id) - 1 AS rank FROM t"""
)
def random_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.random_select(table(spark, sf_dir, "embeddings"), "vec_id", 20, SEED)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members that see the vector scaled; one gives NaN for some candidates."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("candidate_id"), F.posexplode("embedding").alias("pos", "x"))
    scaled = v.select("candidate_id", F.floor(F.col("pos") / 4).cast("int").alias("atom"), (F.col("pos") % 4).alias("k"), F.col("x").cast("double").alias("x"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m"))
    nan = (F.col("m") == 2) & (F.col("candidate_id") % 97 == 0)
    value = F.when(nan, F.lit(float("nan"))).otherwise(F.col("x") * F.element_at(F.array(F.lit(1.0), F.lit(1.2), F.lit(0.8)), F.col("m") + 1))
    return scaled.select(F.concat(F.lit("m"), "m").alias("member_id"), "candidate_id", "atom", "k", value.alias("value"))


SCORES = """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    m AS (SELECT vec_id, pos // 4 AS atom, pos % 4 AS k, x * f AS v FROM e, (SELECT unnest([1e0, 1.2e0, 0.8e0]) AS f) WHERE vec_id % 97 != 0),
    s AS (SELECT vec_id, atom, k, stddev_pop(v) AS s FROM m GROUP BY 1, 2, 3),
    n AS (SELECT vec_id, atom, sqrt(sum(s * s)) AS norm FROM s GROUP BY 1, 2),
    d AS (SELECT vec_id, avg(norm) AS mean_d, max(norm) AS max_d FROM n GROUP BY 1)
"""


@query(
    f"""{SCORES} SELECT e.vec_id AS candidate_id, round(mean_d, 6) AS mean_disagreement, round(max_d, 6) AS max_disagreement,
    d.vec_id IS NULL AS invalid, CASE WHEN d.vec_id IS NULL THEN 'm2' ELSE '' END AS invalid_members
    FROM embeddings e LEFT JOIN d USING (vec_id)"""
)
def ensemble_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection.disagreement(_members(spark, sf_dir))
    clean = lambda c: F.when(~F.col("invalid"), F.round(c, 6)).alias(c)
    return d.select("candidate_id", clean("mean_disagreement"), clean("max_disagreement"), "invalid", F.array_join("invalid_members", ",").alias("invalid_members"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _picks(source: str, budget: int) -> str:
    """Farthest points by a recursive query: each level lowers every row's distance by the last pick."""
    return f"""
    RECURSIVE base AS ({source}),
    c AS (SELECT list(m ORDER BY pos) AS mean FROM (
        SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM base) GROUP BY pos)),
    f AS (
        SELECT 0 AS rank, vec_id, v, d, first_value(vec_id) OVER w AS pick, first_value(v) OVER w AS pv, first_value(d) OVER w AS pd
        FROM (SELECT vec_id, v, list_distance(v, mean) AS d FROM base, c) WINDOW w AS (ORDER BY round(d, 12) DESC, vec_id)
        UNION ALL
        SELECT rank, vec_id, v, d, first_value(vec_id) OVER w, first_value(v) OVER w, first_value(d) OVER w
        FROM (SELECT rank + 1 AS rank, vec_id, v, CASE WHEN rank = 0 THEN list_distance(v, pv) ELSE least(d, list_distance(v, pv)) END AS d
              FROM f WHERE vec_id != pick AND rank + 1 < {budget})
        WINDOW w AS (ORDER BY round(d, 12) DESC, vec_id)),
    picks AS (SELECT rank, pick AS vec_id, any_value(pd) AS distance, any_value(pv) AS v FROM f GROUP BY 1, 2)"""


ALL = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"WITH {_picks(ALL, BUDGET)} SELECT vec_id, rank, round(distance, 6) AS distance FROM picks")
def diversity_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.farthest_points(_vectors(spark, sf_dir), "vec_id", "embedding", BUDGET).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {_picks(ALL, BUDGET)} SELECT count(*) AS n_pairs, round(avg(list_distance(a.v, b.v)), 6) AS mean_distance
    FROM picks a JOIN picks b ON a.vec_id < b.vec_id"""
)
def mean_pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    chosen = selection.farthest_points(vectors, "vec_id", "embedding", BUDGET).select("vec_id")
    picked = vectors.join(F.broadcast(chosen), "vec_id", "left_semi")  # as many rows as the budget
    return selection.mean_pairwise_distance(picked, "vec_id", "embedding").withColumn("mean_distance", F.round("mean_distance", 6))


GATED = f"""
    SELECT e.vec_id, embedding::DOUBLE[] AS v FROM embeddings e JOIN d USING (vec_id)
    ORDER BY round(mean_d, 12) DESC, e.vec_id LIMIT (SELECT greatest({BUDGET}, ceil(count(*) * 0.2e0))::BIGINT FROM d)"""


@query(f"WITH RECURSIVE {SCORES.strip()[5:]}, {_picks(GATED, BUDGET).strip()[10:]} SELECT vec_id, rank, round(distance, 6) AS distance FROM picks")
def decision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = selection.disagreement(_members(spark, sf_dir)).withColumnRenamed("candidate_id", "vec_id").select("vec_id", "mean_disagreement", "invalid")
    scored = written(_vectors(spark, sf_dir).join(scores, "vec_id"), "gate")
    return selection.decision_gate(scored, "vec_id", "mean_disagreement", "invalid", "embedding", BUDGET, 0.2).withColumn("distance", F.round("distance", 6))


TERMS = "License version idiot password token rights"


@query(
    f"""WITH q AS (SELECT DISTINCT lower(t) AS t FROM (SELECT unnest(string_split('{TERMS}', ' ')) AS t) WHERE length(t) > 2),
    s AS (SELECT doc_id, count(*) AS score FROM documents, q WHERE contains(lower(text), t) GROUP BY 1)
    SELECT doc_id, score::INTEGER AS score FROM s ORDER BY score DESC, doc_id LIMIT 50"""
)
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keyword_relevance(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), TERMS, 50)


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 1 THEN 's' WHEN vec_id % 70 = 2 THEN 'n' WHEN vec_id % 20 = 3 THEN 'd' END AS kind, embedding FROM embeddings),
    d AS (SELECT min(vec_id) AS k, count(*) AS n FROM e WHERE kind IS NULL GROUP BY embedding UNION ALL SELECT min(vec_id), count(*) FROM e WHERE kind = 'd')
    SELECT 'dimension' AS problem, vec_id::VARCHAR AS key FROM e WHERE kind = 's' UNION ALL SELECT 'not_finite', vec_id::VARCHAR FROM e WHERE kind = 'n' UNION ALL SELECT 'duplicate', k::VARCHAR FROM d WHERE n > 1"""
)
def descriptor_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some vectors are cut short, hold a NaN or are all ones."""
    k, v = F.col("vec_id"), F.col("embedding")
    nan = F.array_append(F.slice(v, 1, F.size(v) - 1), F.lit(float("nan")).cast("float"))
    planted = F.when(k % 50 == 1, F.slice(v, 1, F.size(v) - 1)).when(k % 70 == 2, nan).when(k % 20 == 3, F.transform(v, lambda x: F.lit(1.0).cast("float"))).otherwise(v)
    return selection.descriptor_problems(table(spark, sf_dir, "embeddings").select("vec_id", planted.alias("embedding")), "vec_id", "embedding")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document is asked for in one round, every seventh again in the next."""
    l = table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("campaign"), (F.floor(F.col("doc_id") / 10) % 6).alias("round"), F.col("doc_id").alias("record_id"))  # noqa: E741
    return l.unionByName(l.filter("record_id % 7 = 0").withColumn("round", F.col("round") + 1))


REQUESTS = """
    WITH l AS (SELECT doc_id % 4 AS campaign, doc_id // 10 % 6 AS round, doc_id AS record_id FROM labels),
    r AS (SELECT DISTINCT * FROM (SELECT * FROM l UNION ALL SELECT campaign, round + 1, record_id FROM l WHERE record_id % 7 = 0)),
    f AS (SELECT campaign, round, count(*) AS charged FROM (SELECT campaign, record_id, min(round) AS round FROM r GROUP BY 1, 2) GROUP BY 1, 2),
    c AS (SELECT r.campaign, r.round, count(*) AS requested, coalesce(any_value(charged), 0) AS charged
          FROM r LEFT JOIN f USING (campaign, round) GROUP BY 1, 2)
"""


@query(
    f"""{REQUESTS} SELECT campaign, round, requested, charged, charged > 15 AS over_round, sum(charged) OVER w::BIGINT AS spent,
    (70 - sum(charged) OVER w)::BIGINT AS remaining, 70 - sum(charged) OVER w < 0 AS refused
    FROM c WINDOW w AS (PARTITION BY campaign ORDER BY round)"""
)
def reveal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.balance(ledger.charge(_requests(spark, sf_dir), 15), 70)


@query(f"{REQUESTS} SELECT campaign, round, record_id, 'not_in_pool' AS reason FROM r WHERE record_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def reveal_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("record_id"))
    return ledger.rejections(_requests(spark, sf_dir), pool)


@query(
    f"""{REQUESTS} SELECT campaign, round FROM r GROUP BY 1, 2 HAVING count(*) FILTER (WHERE record_id % 11 = 0) > 0
    AND count(*) FILTER (WHERE record_id % 11 != 0) > 0"""
)
def reveal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rounds asked for again without some of their records."""
    asked = _requests(spark, sf_dir)
    return ledger.conflicts(asked, asked.filter("record_id % 11 != 0"))


@query(
    """WITH t AS (SELECT doc_id AS record_id, 'initial' AS origin FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'revealed' FROM labels WHERE quality = 1)
    SELECT record_id, min(origin) AS origin, count(DISTINCT origin) AS n_origins FROM t GROUP BY 1"""
)
def training_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial = table(spark, sf_dir, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("record_id"))
    return ledger.training_set(initial, table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("record_id")))


@query(
    """WITH s AS (SELECT conv_id % 20 AS campaign, conv_id, count(*) AS n FROM conversations GROUP BY 1, 2),
    m AS (SELECT campaign, max(n) AS history_length FROM s GROUP BY 1)
    SELECT m.campaign, history_length, count(*) = 1 AS unique_head FROM m JOIN s ON m.campaign = s.campaign AND n = history_length GROUP BY 1, 2"""
)
def campaign_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 20).alias("campaign"), "conv_id").agg(F.count("*").alias("n"))
    return ledger.heads(states, "campaign", "n")
