"""Spans in a text: what the secret and personal-data scans share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, by_batch, id_type, keyed_text

Span = tuple[str, int, int, float]
SPANS_DDL = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan_spans(docs: DataFrame, find: Callable[[str], list[Span]], id_col: str, text_col: str) -> DataFrame:
    """id and spans (kind, start, end, score; code points, end exclusive) of each row, in the order find gives."""
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    schema = pa.schema([("id", id_type(rows)), ("spans", _SPANS)])

    def columns(ids: list, texts: list) -> dict[str, list]:
        return {"id": ids, "spans": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in texts]}

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(by_batch(columns, schema), f"id {kind}, spans {SPANS_DDL}").withColumnRenamed("id", id_col)


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """The spans (of these kinds) as kind:start:end, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark.format(kind)]
            at = end
    return "".join(out) + text[at:]
