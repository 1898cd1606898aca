"""Audits that list violations: claims against artifacts, manifests, lineage against what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim_audit(claims: DataFrame, artifacts: DataFrame, forbidden_kinds: Sequence[str]) -> DataFrame:
    """claims: claim_id, refs (array). artifacts: artifact_id, kind, stored_sha, actual_sha.

    Per claim: status, category (the first problem of no_evidence, unregistered, corrupted, forbidden_kind) and
    how many references have each. References are joined one by one, so a claim may have any number.
    """
    refs = claims.select("claim_id", F.explode_outer("refs").alias("artifact_id"))
    joined = refs.join(artifacts, "artifact_id", "left")
    has = F.col("artifact_id").isNotNull()
    per = joined.groupBy("claim_id").agg(
        F.count_if(has).alias("n_refs"),
        F.count_if(has & F.col("kind").isNull()).alias("unregistered"),
        F.count_if(F.col("stored_sha") != F.col("actual_sha")).alias("corrupted"),
        F.count_if(F.col("kind").isin(*forbidden_kinds)).alias("forbidden"),
    )
    category = F.when(F.col("n_refs") == 0, "no_evidence").when(F.col("unregistered") > 0, "unregistered").when(F.col("corrupted") > 0, "corrupted").when(F.col("forbidden") > 0, "forbidden_kind").otherwise("backed")
    return per.withColumn("category", category).withColumn("status", F.when(category == "backed", "verified").otherwise("rejected"))


def claim_counts(audited: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension, in one pass over the claims."""
    stacked = audited.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x"))
    return stacked.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n")).select("dimension", "value", "n")


def manifest_diff(expected: DataFrame, actual: DataFrame, path: str, sha: str) -> DataFrame:
    """Paths that only one manifest has, or whose hashes differ."""
    e = expected.select(F.col(path).alias("path"), F.col(sha).alias("e_sha"))
    a = actual.select(F.col(path).alias("path"), F.col(sha).alias("a_sha"))
    problem = F.when(F.col("a_sha").isNull(), "missing").when(F.col("e_sha").isNull(), "unexpected").when(F.col("e_sha") != F.col("a_sha"), "changed")
    return e.join(a, "path", "full_outer").select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def conflicting_artifacts(registrations: DataFrame, identifier: str, sha: str) -> DataFrame:
    """Ids registered with more than one content; identical repeats are fine."""
    return registrations.groupBy(identifier).agg(F.count_distinct(sha).alias("n_contents")).filter("n_contents > 1")


def violations(*checks: tuple[str, DataFrame, Column]) -> DataFrame:
    """All violation rows of several audits in one table: check, location. Empty means passed."""
    out = None
    for name, found, location in checks:
        rows = found.select(F.lit(name).alias("check_name"), location.cast("string").alias("location"))
        out = rows if out is None else out.unionByName(rows)
    return out


def lock_diff(wanted: DataFrame, installed: DataFrame, line: str) -> DataFrame:
    """Lines name==version of two requirement lists that disagree; a +local part of a version is ignored."""

    def parsed(df: DataFrame, version: str) -> DataFrame:
        parts = F.split(F.trim(line), "==")
        return df.select(F.lower(parts[0]).alias("name"), F.substring_index(F.get(parts, 1), "+", 1).alias(version))

    both = parsed(wanted, "wanted").join(parsed(installed, "installed"), "name", "full_outer")
    return both.filter(~F.col("wanted").eqNullSafe(F.col("installed")))


def secret_lines(rows: DataFrame, key: str, text: str, patterns: Sequence[str], allowed: Sequence[str] = ()) -> DataFrame:
    """Lines of a text that match a pattern and no allowed one, numbered from 1."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    hit, fine = F.lit(False), F.lit(False)
    for p in patterns:
        hit = hit | F.col("line").rlike(p)
    for p in allowed:
        fine = fine | F.col("line").rlike(p)
    return lines.filter(hit & ~fine).select(key, (F.col("at") + 1).alias("line_number"), F.sha2("line", 256).alias("line_sha256"))
