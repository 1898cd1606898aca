"""Label-hiding projections, and scans for keys that must not be there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field names that hold labels, and parts of names that look like one.
HIDDEN_KEYS = ("energy_ev", "forces_ev_per_a", "virial_stress_kbar", "energy", "forces", "stress", "labels")
LABEL_PARTS = ("energy", "force", "stress", "virial", "label", "target", "truth", "oracle")


def acquisition_view(rows: DataFrame, pool: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns of the pool's rows: the others are never read."""
    guard_columns(allowed)
    return rows.select(key, *(c for c in allowed if c != key)).join(pool.select(key), key, "left_semi")


def guard_columns(columns: Sequence[str]) -> None:
    """Refuses column names that look like labels."""
    bad = [c for c in columns if any(p in c.lower() for p in LABEL_PARTS)]
    if bad:
        raise ValueError(f"label-like columns: {bad}")


def hidden_fields(schema: T.DataType, hidden: Sequence[str] = HIDDEN_KEYS, path: str = "") -> list[str]:
    """Dotted paths of hidden field names at any depth of a schema."""
    if isinstance(schema, T.StructType):
        return [q for f in schema.fields for p in [f"{path}.{f.name}".strip(".")] for q in ([p] if f.name.lower() in hidden else []) + hidden_fields(f.dataType, hidden, p)]
    if isinstance(schema, T.ArrayType):
        return hidden_fields(schema.elementType, hidden, f"{path}[]")
    if isinstance(schema, T.MapType):
        return hidden_fields(schema.valueType, hidden, f"{path}{{}}")
    return []


_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'


def json_depth(json_column: str) -> Column:
    """How deep the objects and lists of a JSON text are nested; null if it can't be parsed."""
    brackets = F.regexp_replace(F.regexp_replace(json_column, _STRING, ""), r"[^{}\[\]]", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, start, lambda a, x: F.struct((a.now + x).alias("now"), F.greatest(a.most, a.now + x).alias("most")), lambda a: a.most)
    return F.when(F.try_parse_json(json_column).isNotNull(), deepest)


def json_key_scan(rows: DataFrame, json_column: str, key: str, hidden: Sequence[str]) -> DataFrame:
    """Rows whose JSON object or list has a hidden key at any depth, whatever its case, with the keys found; other text has none."""
    # Strings are read one after another, so a quote or colon within one is never taken for a key's.
    strings = F.regexp_extract_all(json_column, F.lit(_STRING + r"(?:\s*:)?"), F.lit(0))
    quoted = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.regexp_replace(s, r"\s*:$", ""))
    is_json = F.json_object_keys(json_column).isNotNull() | F.json_array_length(json_column).isNotNull()
    keys = F.when(is_json, F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>"))
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(keys, F.lower), lambda k: k.isin(*hidden))))
    return rows.select(key, found.alias("found")).filter(F.size("found") > 0)


def variant_keys(rows: DataFrame, json_column: str, key: str, depth: int | None = None, elements: bool = False) -> DataFrame:
    """Every key of a JSON text, down to a depth if one is given, with its path and the value there as text; with elements also
    every place of a list, whose key is null.

    Each level is one variant_explode over the level above, which is written, so a level costs what it holds and none is made twice.
    """
    from veinwork.sources.tables import written

    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("id"), F.to_json(F.try_parse_json(json_column)).alias("j"), F.lit("").alias("path")).filter("j IS NOT NULL")
    out, k = None, 0
    while depth is None or k < depth:
        opened = level.filter(F.col("j").rlike(r"^[\[{][^\]}]")).select("id", "path", F.parse_json("j").alias("v"))
        opened = opened.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.concat("path", F.lit("/"), F.coalesce("key", F.col("pos").cast("string")))
        level = written(opened.select("id", F.col("key"), step.alias("path"), F.expr("try_variant_get(value, '$', 'string')").alias("value"), F.to_json("value").alias("j")), "keys")
        found = (level if elements else level.filter("key IS NOT NULL")).select(F.col("id").alias(key), "key", "path", "value")
        out, k = found if out is None else out.unionByName(found), k + 1
        if depth is None and level.isEmpty():
            return out
    return out


def finite_rows(rows: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows whose arrays hold finite numbers only."""
    from veinwork.functions.scalars import all_finite

    for a in arrays:
        rows = rows.filter(all_finite(a))
    return rows


def allowed_species(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return rows.filter(F.size(F.array_except(F.array_distinct(column), F.array(*map(F.lit, allowed)))) == 0)
