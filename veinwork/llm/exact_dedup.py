"""Exact duplicates by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, id_type, keyed_text, materialise

#: Bytes of the text that lead the sort key. The splitters that Spark samples hold these, a hash of
#: the whole text and the identifier, so what it gathers on the driver is bounded however long texts are.
LEAD = 128


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned by sampled splitters over the first LEAD bytes of the normalised text; texts that begin
    with the same LEAD bytes are ordered by a hash of the whole and then by the identifier, so that neither a common
    beginning nor a text that a third of all rows share stays in one partition. Within a partition
    an external sort by these keys and the whole text puts equal texts side by side, and each is compared whole with its
    neighbour. Only the groups at a partition's ends can go on in the next one: each gives one record with its text (two for
    a partition at most), which are compared whole with each other, and their totals are joined back by place.

    keep: "min" or "max", which identifier of a group stays. normalise: applied to the text before comparing.
    A null text counts as empty; an empty table gives no rows; a null identifier never stays while its group
    has another; rows that repeat an identifier are counted each, and each is kept if its identifier stays.
    Other columns of docs are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    if normalise is not None:
        rows = rows.withColumn("text", normalise(F.col("text")))
    rows = rows.select(F.substring(F.col("text").cast("binary"), 1, LEAD).alias("lead"), F.xxhash64("text").alias("hash"), "id", "text")
    placed = rows.repartitionByRange("lead", "hash", "id").sortWithinPartitions("lead", "hash", "text", "id")
    kind, ddl = id_type(rows), rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", kind), ("sha", pa.string()), ("keep_here", kind), ("size_here", pa.int64()), ("edge", pa.int64()), ("edge_text", pa.string())])
    compared = materialise(placed.mapInArrow(_neighbours(schema, keep), f"`id` {ddl}, sha string, keep_here {ddl}, size_here bigint, edge bigint, edge_text string"), "exact-dedup")
    best = F.max if keep == "max" else F.min
    ends = compared.filter("edge_text IS NOT NULL").groupBy("edge_text").agg(best("keep_here").alias("keep_all"), F.sum("size_here").alias("size_all"), F.collect_list("edge").alias("edges"))
    whole = ends.select(F.explode("edges").alias("edge"), "keep_all", "size_all")
    joined = compared.filter("edge_text IS NULL").select("id", "sha", "keep_here", "size_here", "edge").join(F.broadcast(whole), "edge", "left")
    keep_id = F.when(F.col("size_all").isNotNull(), F.col("keep_all")).otherwise(F.col("keep_here"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("size_all", "size_here").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _neighbours(schema: pa.Schema, keep: str) -> Callable:
    """Compares each text of a sorted partition with the one before it; a group's identifiers wait for its end.

    Groups at the partition's ends have a number of their own (edge), and one more row that holds their text.
    """
    choose = max if keep == "max" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        waiting: list[tuple[str, list]] = []  # the groups of the current key: more than one only if hashes collide
        edges = TaskContext.get().partitionId() << 32
        key = text = first = None

        def close(edge: bool) -> None:
            nonlocal edges
            for t, ids in waiting:
                stays = choose((i for i in ids if i is not None), default=None)
                edges += edge
                n, number = len(ids), edges if edge else None
                out["id"] += ids
                out["sha"] += [hashlib.sha256(t.encode()).hexdigest()] * n
                out["keep_here"] += [stays] * n
                out["size_here"] += [n] * n
                out["edge"] += [number] * n
                out["edge_text"] += [None] * n
                if edge:
                    for name, value in zip(schema.names, (None, None, stays, n, number, t), strict=True):
                        out[name].append(value)
            waiting.clear()

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for column in out.values():
                column.clear()
            return made

        for b in batches:
            for *here, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if here != key:
                    close(edge=key == first)
                    key, text = here, None
                    first = first or key
                if t != text:
                    waiting.append((t, []))
                    text = t
                waiting[-1][1].append(i)
            if len(out["id"]) >= 10_000:
                yield full()
        close(edge=True)
        yield full()

    return run
