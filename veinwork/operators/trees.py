"""JSON documents as trees: one canonical text, values replaced within a row, and, for documents of any depth, nodes level by level and the text built again from the bottom."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.sources.tables import written

_TOKENS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
#: Objects and lists within each other that a row's own expression opens; deeper documents go through tables of nodes.
LEVELS = 8
#: Stands for what is deeper; no JSON text holds it unescaped.
_DEEPER = "\x00"
_STEP = r"^\$steps\.([^.]*)(?:\.(.*))?$"


def canonical(json_column: Column | str) -> Column:
    """One text for all JSON texts of equal content: keys sorted at every depth, no white space, strings with the fewest escapes, numbers in one form.

    A number is its plain decimal without trailing zeros where 38 digits with 18 decimals hold it, otherwise the shortest text of its double; -0 is 0.
    Null for a text that is no JSON or repeats a key in an object.
    """
    return _one_form(F.to_json(F.try_parse_json(json_column)))


def canonical_hash(json_column: Column | str) -> Column:
    return F.sha2(canonical(json_column), 256)


def record_hash(*columns: str) -> Column:
    """The hash of the canonical text of an object that holds the columns under their names, nested ones too: the order in which they are named plays no part."""
    return F.sha2(_one_form(F.to_json(F.to_variant_object(F.struct(*columns)))), 256)


def _one_form(text: Column) -> Column:
    """Numbers that were doubles (with an exponent, or .0) as decimals."""

    def number(t: Column) -> Column:
        exact = t.try_cast("decimal(38,18)")
        plain = F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1").cast("string")
        plain = F.regexp_replace(plain, r"\.$", "")
        whole = exact.isNotNull() & (exact.cast("double") == t.cast("double"))
        return F.when(t.rlike(r"^-?[0-9]") & t.rlike("[.eE]"), F.when(whole, F.when(plain == "-0", "0").otherwise(plain)).otherwise(t)).otherwise(F.when(t == "-0", "0").otherwise(t))

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.when(text.rlike(r"[0-9]E|\.0|-0"), F.array_join(F.transform(tokens, number), "")).otherwise(text)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def nodes(rows: DataFrame, json_column: str, key: str, closed: Column | None = None) -> list[DataFrame]:
    """The nodes of the JSON texts, a written table for each depth from the root on: id, path (a JSON pointer), parent, name, place, text, open.

    name is null in lists; place orders a parent's children (an object's by key). An open node is an object or list with
    children, which the next table holds; any other has its canonical text. closed: nodes, by name, that are not opened. Each level is
    one variant_explode over the level above, so the work follows the number of nodes. Texts that are no JSON have no nodes.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("place"), canonical(json_column).alias("text")).filter("text IS NOT NULL")
    shut = F.lit(False) if closed is None else F.coalesce(closed, F.lit(False))
    tables = []
    while True:
        here = written(level.withColumn("open", F.col("text").rlike(r"^[\[{][^\]}]") & ~shut), "tree")
        tables.append(here)
        inner = here.filter("open")
        if inner.isEmpty():
            return tables
        opened = inner.select("id", "path", F.parse_json("text").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.regexp_replace(F.regexp_replace(F.coalesce("key", F.col("pos").cast("string")), "~", "~0"), "/", "~1")
        level = opened.select("id", F.concat_ws("/", "path", step).alias("path"), F.col("path").alias("parent"), F.col("key").alias("name"), F.col("pos").alias("place"), _one_form(F.to_json("value")).alias("text"))


def rebuilt(levels: Sequence[DataFrame], key: str) -> DataFrame:
    """The texts (key, text) of nodes' levels, each parent from its children's texts, from the bottom up."""
    below = None
    for level in reversed(levels):
        here = level
        if below is not None:
            inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
            made = below.withColumn("piece", F.concat(F.when(F.col("name").isNotNull(), F.concat(_quoted(F.col("name")), F.lit(":"))).otherwise(""), "text"))
            made = made.groupBy("id", F.col("parent").alias("path")).agg(F.array_join(inside, ",").alias("inside"), F.max(F.col("name").isNotNull()).alias("named"))
            made = made.select("id", "path", F.when(F.col("named"), F.concat(F.lit("{"), "inside", F.lit("}"))).otherwise(F.concat(F.lit("["), "inside", F.lit("]"))).alias("made"))
            here = level.join(made, ["id", "path"], "left").withColumn("text", F.when(F.col("open"), F.col("made")).otherwise(F.col("text"))).drop("made")
        below = here
    return below.select(F.col("id").alias(key), "text")


def _children(v: Column) -> Column:
    """An object's or list's values with their names (null in lists); null for a value of another kind."""
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), listed)


def _opened(v: Column, inside: Callable[[Column], Column], other: Column) -> Column:
    """inside(children) where there are any, and other where not; the children are worked out once."""
    return F.transform(F.array(_children(v)), lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, inside(c)).otherwise(other))[0]


def _rewritten(v: Column, hide: Callable[[Column], Column] | None, leaf: Callable[[Column], Column] | None, levels: int) -> Column:
    """A variant's text with other texts in it, where they aren't null: hide(name) for a value under a name, leaf(value) for one without children."""
    own = F.to_json(v) if leaf is None else F.coalesce(leaf(v), F.to_json(v))

    def piece(c: Column) -> Column:
        inner = _rewritten(c["value"], hide, leaf, levels - 1)
        inner = inner if hide is None else F.coalesce(hide(c["key"]), inner)
        return F.concat(F.when(c["key"].isNotNull(), F.concat(_quoted(c["key"]), F.lit(":"))).otherwise(""), inner)

    def inside(children: Column) -> Column:
        if not levels:
            return F.lit(_DEEPER)
        named = children[0]["key"].isNotNull()
        return F.concat(F.when(named, "{").otherwise("["), F.array_join(F.transform(children, piece), ","), F.when(named, "}").otherwise("]"))

    return _opened(v, inside, own)


def _said(v: Column) -> Column:
    """The reference that a value without children is."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.startswith(text, F.lit("$steps.")), text)


def _references(v: Column, path: Column, levels: int) -> Column:
    """path and said of the references in a variant; null where it is deeper than levels."""
    said = _said(v)
    none = F.array().cast("array<struct<path:string,said:string>>")

    def inside(children: Column) -> Column:
        if not levels:
            return F.lit(None).cast("array<struct<path:string,said:string>>")
        step = lambda c, i: F.replace(F.replace(F.coalesce(c["key"], i.cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        return F.flatten(F.transform(children, lambda c, i: _references(c["value"], F.concat(path, F.lit("/"), step(c, i)), levels - 1)))

    return _opened(v, inside, F.when(said.isNotNull(), F.array(F.struct(path.alias("path"), said.alias("said")))).otherwise(none))


def redacted(rows: DataFrame, json_column: str, key: str, markers: Sequence[str], mark: str = "[REDACTED]") -> DataFrame:
    """key and text: the value under every key that has a marker (in any case, - as _) replaced at any depth; rows whose text is no JSON are left out.

    A row's text is made within the row, without a shuffle; only documents deeper than LEVELS go through tables of nodes.
    """
    hide = lambda name: F.when(_marked(name, markers), _quoted(F.lit(mark)))
    parsed = rows.select(key, F.col(json_column).alias("doc"), F.try_parse_json(json_column).alias("v")).filter("v IS NOT NULL")
    made = parsed.select(key, "doc", _one_form(_rewritten(F.col("v"), hide, None, LEVELS)).alias("text"))
    deeper = F.contains("text", F.lit(_DEEPER))
    made = written(made.select(key, F.when(~deeper, F.col("text")).alias("text"), F.when(deeper, F.col("doc")).alias("doc")), "redacted")
    shallow, deep = made.filter("text IS NOT NULL").select(key, "text"), made.filter("text IS NULL").select(key, "doc")
    return shallow if deep.isEmpty() else shallow.unionByName(_redacted_nodes(deep, "doc", key, markers, mark))


def _marked(name: Column, markers: Sequence[str]) -> Column:
    """One expression for all markers, as it is worked out for every name; - stands for _, so a marker with - is in no name."""
    found = "|".join("[_-]".join(rf"\Q{part}\E" for part in m.split("_")) for m in markers if "-" not in m)
    return F.lower(name).rlike(found) if found else F.lit(False)


def _redacted_nodes(rows: DataFrame, json_column: str, key: str, markers: Sequence[str], mark: str) -> DataFrame:
    hidden = _marked(F.col("name"), markers)
    levels = nodes(rows, json_column, key, hidden)
    hide = F.when(F.coalesce(hidden, F.lit(False)), _quoted(F.lit(mark))).otherwise(F.col("text"))
    return rebuilt([level.withColumn("text", hide) for level in levels], key)


def resolved(rows: DataFrame, json_column: str, key: str, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (key, text) with each string $steps.<step>.<field>, at any depth, replaced by that output; and what can't be: (key, path, reference, problem).

    outputs: step_id, field, value (JSON). A reference is malformed without a field, incomplete_step where the step has no outputs, and
    no_field where it has no such one; it stays as it is. A field's name may hold dots.
    A row's references are read within the row and joined with the outputs, and their answers go back to the row; only documents deeper than LEVELS go through tables of nodes.
    """
    parsed = rows.select(F.col(key).alias("id"), F.col(json_column).alias("doc"), F.try_parse_json(json_column).alias("v")).filter("v IS NOT NULL")
    base = written(parsed.select(F.monotonically_increasing_id().alias("row"), "id", "doc", _references(F.col("v"), F.lit(""), LEVELS).alias("refs")), "references")
    shallow, deep = base.filter("refs IS NOT NULL"), base.filter("refs IS NULL")
    joined = _answered(shallow.select("row", "id", F.explode("refs").alias("ref")).select("row", "id", "ref.path", "ref.said"), outputs)
    answers = joined.filter("output IS NOT NULL").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("said", "output"))).alias("answers"))
    text = _rewritten(F.parse_json("doc"), None, lambda v: F.try_element_at("answers", _said(v)), LEVELS)
    texts = shallow.join(answers, "row", "left").select(F.col("id").alias(key), _one_form(text).alias("text"))
    problems = _problems(joined, key)
    if deep.isEmpty():
        return texts, problems
    more, bad = _resolved_nodes(deep.select(F.col("id").alias(key), "doc"), "doc", key, outputs)
    return texts.unionByName(more), problems.unionByName(bad)


def _answered(parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """parts(said) with step_id, field, the output if there is one, and known_step if the step has any."""
    known = outputs.groupBy("step_id", "field").agg(F.max(canonical("value")).alias("output"))
    steps = outputs.select(F.col("step_id").alias("known_step")).distinct()
    parts = parts.withColumn("step_id", F.regexp_extract("said", _STEP, 1)).withColumn("field", F.regexp_extract("said", _STEP, 2))
    return parts.join(known, ["step_id", "field"], "left").join(steps, F.col("step_id") == F.col("known_step"), "left")


def _problems(joined: DataFrame, key: str) -> DataFrame:
    why = F.when(F.col("field") == "", "malformed").when(F.col("known_step").isNull(), "incomplete_step").when(F.col("output").isNull(), "no_field")
    return joined.filter(F.col("said").isNotNull() & why.isNotNull()).select(F.col("id").alias(key), "path", F.col("said").alias("reference"), why.alias("problem"))


def _resolved_nodes(rows: DataFrame, json_column: str, key: str, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    levels = nodes(rows, json_column, key)
    found, problems = [], None
    for level in levels:
        said = F.when(F.startswith("text", F.lit('"$steps.')), F.try_variant_get(F.try_parse_json("text"), "$", "string"))
        joined = _answered(level.withColumn("said", said), outputs)
        found.append(joined.withColumn("text", F.when(F.col("said").isNotNull(), F.coalesce("output", "text")).otherwise(F.col("text"))).select(*level.columns))
        bad = _problems(joined, key)
        problems = bad if problems is None else problems.unionByName(bad)
    return rebuilt(found, key), problems
