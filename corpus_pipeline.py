"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm import toxicity
from veinwork.llm.common import materialise, table
from veinwork.llm.decontaminate import find_contamination
from veinwork.llm.exact_dedup import exact_dedup
from veinwork.llm.near_dedup import near_components
from veinwork.llm.packing import pack_pieces
from veinwork.llm.queries import byte_bpe


def _free(docs: DataFrame, base: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{base}{i}") not in taken)


def _text_sha(docs: DataFrame) -> tuple[DataFrame, str]:
    """With the hash of the text, which tells rows apart also where an id is null or repeated, and that column's name."""
    name = _free(docs, "_text_sha")
    return docs.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256)), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, scores below a half."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays; a row repeated with its id stays once."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256")).distinct()
    marked, sha = _text_sha(docs)
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_id"]) & (marked[sha] == kept["_sha256"]), "left_semi")
    return found.dropDuplicates(["doc_id", sha]).drop(sha)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more stays."""
    kept = near_components(docs, k=5, threshold=0.8).filter("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go."""
    marked, sha = _text_sha(docs)
    found = find_contamination(marked, table(spark, sf_dir, "benchmark"), id_col=sha).select(sha).distinct()
    return marked.join(found, sha, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 ids."""
    return pack_pieces(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokenizer can't be put in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
