"""What must hold before a run may start or its results may leave: inputs, approvals, flags, pins, limits."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.policy import reasons
from veinwork.operators.views import variant_keys

# Parts of key names whose values are hidden.
SECRET_KEYS = ("token", "secret", "password", "credential", "api_key")


def transport_problems(files: DataFrame, allowed: DataFrame, path: str, markers: Sequence[str]) -> DataFrame:
    """Paths that are not on the list, listed paths that are not there, and paths with a forbidden part in any case."""
    there, listed = files.select(path).distinct(), allowed.select(path).distinct()
    problem = lambda df, name: df.select(path, F.lit(name).alias("problem"))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.lower(path), F.lit(m.lower()))
    unexpected, missing = there.join(listed, path, "left_anti"), listed.join(there, path, "left_anti")
    return problem(unexpected, "unexpected").unionByName(problem(missing, "missing")).unionByName(problem(there.filter(hit), "forbidden_path"))


def approval_problems(now: Column, approved_at: Column, expires_at: Column, pairs: Mapping[str, tuple[Column, Column]]) -> Column:
    """Why an approval doesn't cover a request: its time, then each field whose approved and live values differ."""
    changed = {f"changed:{name}": ~a.eqNullSafe(b) for name, (a, b) in pairs.items()}
    return reasons({"not_yet_valid": now < approved_at, "expired": now > expires_at, **changed})


def surviving_storage(records: DataFrame, key: str, active: str, names: Sequence[str]) -> DataFrame:
    """Storage that is still active, by the first of its names that is known."""
    return records.filter(F.coalesce(F.col(active), F.lit(False))).select(key, F.coalesce(*names, F.lit("unidentified-storage")).alias("storage"))


def pending_fields(rows: DataFrame, json_column: str, key: str, sentinel: str = "TBD", depth: int | None = None) -> DataFrame:
    """Paths of a JSON text, down to a depth if one is given, at which the sentinel stands, in objects and lists."""
    return variant_keys(rows, json_column, key, depth, elements=True).filter(F.col("value") == sentinel).select(key, "path")


def unattested(flags: Sequence[str]) -> Column:
    """The flags that aren't literally false: a missing one counts."""
    return reasons({f: ~F.col(f).eqNullSafe(F.lit(False)) for f in flags})


def aggregate_only(metrics: Column) -> Column:
    """Whether no key of a map of metrics names a single record."""
    return ~F.exists(F.map_keys(metrics), lambda k: k.startswith("record_") | k.contains("::"))


def constraint_rows(rows: DataFrame, key: str, limits: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row per constraint: observed, limit, passed; a missing observation fails."""
    one = lambda name, o, limit: F.struct(F.lit(name).alias("constraint_id"), o.cast("double").alias("observed"), F.lit(float(limit)).alias("limit"))
    long = rows.select(key, F.explode(F.array(*(one(n, o, limit) for n, (o, limit) in limits.items()))).alias("x")).select(key, "x.*")
    return long.withColumn("passed", F.coalesce(F.col("observed") <= F.col("limit"), F.lit(False)))


def inside_folder(path: Column, folder: str) -> Column:
    """Whether a path, its . and .. steps resolved, lies below a folder; a path that climbs above its own start does not."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def walk(state, step):
        up = step == ".."
        at = F.when(up, F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0)))).otherwise(F.array_append(state["at"], step))
        return F.struct(at.alias("at"), (state["ok"] & (~up | (F.size(state["at"]) > 0))).alias("ok"))

    resolved = F.aggregate(steps, start, walk)
    clean = "/".join(x for x in folder.split("/") if x not in ("", "."))
    below = F.startswith(F.concat(F.array_join(resolved["at"], "/"), F.lit("/")), F.lit(f"{clean}/"))
    return resolved["ok"] & below & (F.startswith(path, F.lit("/")) == F.lit(folder.startswith("/")))


def artifact_problems(wanted: DataFrame, registry: DataFrame, folder: str) -> DataFrame:
    """wanted: artifact_id, kind. registry: artifact_id, kind, path, stored_sha, actual_sha. Per wanted artifact what is wrong with it."""
    found = registry.select("artifact_id", F.col("kind").alias("registered_kind"), "path", "stored_sha", "actual_sha")
    joined = wanted.join(found, "artifact_id", "left")
    there = F.col("registered_kind").isNotNull()
    wrong = reasons({
        "unregistered": ~there,
        "kind": there & (F.col("kind") != F.col("registered_kind")),
        "changed": there & ~F.col("stored_sha").eqNullSafe(F.col("actual_sha")),
        "outside": there & ~F.coalesce(inside_folder(F.col("path"), folder), F.lit(False)),
    })
    return joined.select("artifact_id", wrong.alias("problems")).filter(F.size("problems") > 0)


def hidden_values(column: Column | str, markers: Sequence[str] = SECRET_KEYS, mark: str = "[REDACTED]") -> Column:
    """A JSON text with the value under every key that has a marker replaced, at any depth; other text gives null.

    Depth is not bounded, so the walk is Python's, a batch of texts at a time.
    """
    words = tuple(markers)

    def walk(value):
        if isinstance(value, dict):
            return {k: mark if any(w in k.casefold().replace("-", "_") for w in words) else walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else value

    def one(text):
        try:
            return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(column)
