"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm import html_text, language_model, licenses, packing, pii, ranked_search, secrets, toxicity
from veinwork.llm.common import table
from veinwork.llm.decontaminate import find_contamination
from veinwork.llm.exact_dedup import exact_dedup
from veinwork.llm.near_dedup import near_components
from veinwork.llm.spans import counted, listed
from veinwork.llm.spelling import spelling_groups
from veinwork.llm.vector_dedup import vector_components


def byte_bpe() -> str:
    """The place of the public byte-level vocabulary; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, each document followed by id 0."""
    return packing.pack_pieces(table(spark, sf_dir, "documents"), byte_bpe())


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 7 is not 2 and scores them all."""
    held_out = crc32_of_id() % 7 == 2
    scored = language_model.score(table(spark, sf_dir, "documents"), train_on=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that covers four fifths or more of a license template."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, Jaccard similarity of 0.8 or more."""
    return near_components(table(spark, sf_dir, "documents"), k=2, threshold=0.8)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts unchanged; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels whose crc32(doc_id) mod 5 is not 0 and scores every document by its text."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc32_of_id() % 5 != 0))
    return toxicity.score(docs, model).select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item of which tiles cover half or more."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: the fixed kinds, and runs that look random to models trained on the words of the same table."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    return found.select(
        "doc_id",
        *(counted(s, k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        F.sha2(listed(s, secrets.BASE_KINDS), 256).alias("base_sha256"),
        listed(s).alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text, with the score that words nearby leave each span, and how many of them score a half or more."""
    found = pii.scan_pii(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    return found.select(
        "doc_id",
        *(counted(s, k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(listed(s, pii.BASE_KINDS), 256).alias("base_sha256"),
        listed(s).alias("spans"),
        F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
        F.size(F.filter(s, lambda x: x["score"] >= pii.LEAST)).cast("long").alias("n_likely"),
    )


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels with a cosine of 0.98 or more."""
    return vector_components(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five code points or more that occur three times or more, with their near words; one run in 97 is thinned."""
    return spelling_groups(table(spark, sf_dir, "documents"), least=5, fewest=3, times=2, every=97)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_language_model, op3_licenses, op4_near_dedup, op5_exact_dedup, op6_toxicity, op7_decontaminate, op8_html_text, op9_secrets, op10_pii, op11_vector_dedup, op12_ranked_search, op13_spelling_variants)
}

ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op12_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        sizes AS (SELECT doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM words) GROUP BY ALL),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, docs),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // whole.terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 50
    """,
}
