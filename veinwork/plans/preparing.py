"""Qualification, splits and label-hiding views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import scalars
from veinwork.operators import qualify, split, views
from veinwork.plans.registry import query
from veinwork.sources.tables import table

SEED = 55


@query(
    """WITH t AS (SELECT * FROM lineitem) SELECT * FROM (
    SELECT 'quantity_finite' AS check_name, count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity)) AS violations,
           count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity)) = 0 AS passed FROM t
    UNION ALL SELECT 'quantity_range', count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50), count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50) = 0 FROM t
    UNION ALL SELECT 'price_window', count(*) FILTER (WHERE l_extendedprice / l_quantity NOT BETWEEN 900 AND 2000), count(*) FILTER (WHERE l_extendedprice / l_quantity NOT BETWEEN 900 AND 2000) = 0 FROM t
    UNION ALL SELECT 'discount_bound', count(*) FILTER (WHERE l_discount > 0.09), count(*) FILTER (WHERE l_discount > 0.09) = 0 FROM t
    UNION ALL SELECT 'flag_known', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) = 0 FROM t)"""
)
def qualify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return qualify.report(
        table(spark, sf_dir, "lineitem"),
        {
            "quantity_finite": ~scalars.is_finite("l_quantity"),
            "quantity_range": ~F.col("l_quantity").between(1, 50),
            "price_window": ~price.between(900, 2000),
            "discount_bound": F.col("l_discount") > 0.09,
            "flag_known": ~F.col("l_returnflag").isin("A", "N", "R"),
        },
    )


@query("SELECT lang AS family, count(*) AS n, count(DISTINCT source) AS n_distinct FROM documents GROUP BY 1")
def family_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualify.histogram(table(spark, sf_dir, "documents").select(F.col("lang").alias("family"), "source"), "family", "source")


NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT sha256(coalesce(text, '')) AS e, sha256({NORMAL}) AS k FROM documents),
    x AS (SELECT sum(n - 1) AS exact FROM (SELECT e, count(*) AS n FROM t GROUP BY 1)),
    y AS (SELECT sum(n - 1) AS near FROM (SELECT k, count(*) AS n FROM t GROUP BY 1))
    SELECT exact::BIGINT AS exact_duplicates, (near - exact)::BIGINT AS near_duplicates FROM x, y"""
)
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    near = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return qualify.duplicates(table(spark, sf_dir, "documents"), F.sha2(text, 256), F.sha2(near, 256))


@query(
    """WITH t AS (SELECT array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') AS e,
    array_to_string(list_transform(embedding[1:2], lambda x: printf('%.1f', round(x::DOUBLE, 1) + 0.0)), ',') AS k FROM embeddings),
    x AS (SELECT sum(n - 1) AS exact FROM (SELECT k, e, count(*) AS n FROM t GROUP BY 1, 2)),
    y AS (SELECT sum(n - 1) AS near FROM (SELECT k, count(*) AS n FROM t GROUP BY 1))
    SELECT exact::BIGINT AS exact_duplicates, (near - exact)::BIGINT AS near_duplicates FROM x, y"""
)
def vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.sha2(F.array_join(F.transform("embedding", lambda x: scalars.fixed(x)), ","), 256)
    return qualify.duplicates(table(spark, sf_dir, "embeddings"), exact, qualify.rounded_key(F.slice("embedding", 1, 2), 1))


@query(
    r"""WITH t AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS group_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS num, url FROM pages)
    SELECT page_id, group_id, group_id || '_block' || (CAST(num AS INTEGER) // 10) AS split_unit_id, split_part(url, '?', 1) AS origin FROM t WHERE num != ''"""
)
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for snapshots: the language is the group, ten numbered pages are a block."""
    p = table(spark, sf_dir, "pages")
    pattern = "/([a-z]{2})/([0-9]+)"
    t = p.select("page_id", F.regexp_extract("url", pattern, 1).alias("group_id"), F.regexp_extract("url", pattern, 2).alias("num"), F.substring_index("url", "?", 1).alias("origin"))
    block = scalars.frame_block(F.col("num"), 10)
    return t.filter("num != ''").select("page_id", "group_id", F.concat("group_id", F.lit("_block"), block).alias("split_unit_id"), "origin")


@query("SELECT doc_id, source, lang, sha256(doc_id || '|' || coalesce(source, '~') || '|' || coalesce(lang, '~') || '|' || coalesce(text, '~')) AS content_sha256 FROM documents")
def lineage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", scalars.content_hash("doc_id", "source", "lang", "text").alias("content_sha256"))


def _grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("group_id"))


@query()
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by a subset choice over group counts; tests hold it against a re-derivation."""
    rows = _grouped_documents(spark, sf_dir)
    n = rows.count()
    return split.assign(rows, "group_id", {"initial": n // 10, "test": n // 5, "validation": n // 10}, "pool", SEED)


HASHED = f"""
    WITH s AS (SELECT doc_id, concat_ws('/', source, lang) AS group_id FROM documents),
    t AS (SELECT *, CAST('0x' || substr(sha256('{SEED}~' || group_id), 1, 8) AS BIGINT) % 100 AS slot FROM s),
    p AS (SELECT doc_id, group_id, CASE WHEN slot < 10 THEN 'initial' WHEN slot < 30 THEN 'test' WHEN slot < 40 THEN 'validation' ELSE 'pool' END AS partition FROM t)
"""
SHARES = (("initial", 10), ("test", 20), ("validation", 10), ("pool", 60))


@query(f"{HASHED} SELECT partition, count(*) AS n_records, count(DISTINCT doc_id) AS n_distinct, count(DISTINCT group_id) AS n_groups FROM p GROUP BY 1")
def split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.summary(split.hash_split(_grouped_documents(spark, sf_dir), F.col("group_id"), SHARES, SEED), "doc_id", "group_id")


@query(
    f"""{HASHED}, q AS (SELECT doc_id, group_id, CASE WHEN doc_id % 50 = 7 THEN 'moved' ELSE partition END AS partition FROM p UNION ALL SELECT doc_id, group_id, partition FROM p WHERE doc_id % 60 = 11),
    torn AS (SELECT group_id FROM q GROUP BY 1 HAVING count(DISTINCT partition) > 1)
    SELECT 'group_torn' AS problem, group_id AS key FROM torn
    UNION ALL SELECT 'record_repeated', CAST(doc_id AS VARCHAR) FROM q GROUP BY doc_id HAVING count(*) > 1"""
)
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty for a sound split; here a fiftieth of the rows are moved and some are listed twice."""
    sound = split.hash_split(_grouped_documents(spark, sf_dir), F.col("group_id"), SHARES, SEED)
    moved = sound.withColumn("partition", F.when(F.col("doc_id") % 50 == 7, "moved").otherwise(F.col("partition")))
    return split.violations(moved.unionByName(sound.filter("doc_id % 60 = 11")), "doc_id", "group_id")


@query(f"SELECT source, lang, count(*) AS n, sha256('{SEED}~' || source || '~' || lang) AS order_key FROM documents GROUP BY source, lang")
def hash_split_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("order_key", split.seeded_order("source", "lang", seed=SEED))


@query("SELECT 'missing' AS problem, doc_id AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def split_against_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.against(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def acquisition_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "labels").filter("quality = 1")
    return views.acquisition_view(table(spark, sf_dir, "documents"), pool, "doc_id", ["lang", "source", "n_chars"])


@query(
    """SELECT event_id, list_sort(list_filter(list_transform(json_keys(props), lambda k: lower(k)), lambda k: k IN ('k', 'label'))) AS found
    FROM events WHERE len(list_filter(list_transform(json_keys(props), lambda k: lower(k)), lambda k: k IN ('k', 'label'))) > 0"""
)
def hidden_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.json_key_scan(table(spark, sf_dir, "events"), "props", "event_id", ["k", "label"])


@query("SELECT event_id, 'k' AS key, '/k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.variant_keys(table(spark, sf_dir, "events"), "props", "event_id")


@query(
    """WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')
    SELECT 'left' AS side, doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
    UNION ALL SELECT 'right', doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)"""
)
def membership_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualify.drift(table(spark, sf_dir, "labels").select("doc_id").distinct(), table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").distinct(), ["doc_id"])
