"""Objects of one large JSON array, found by byte ranges in parallel and decoded only where they are asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A string that is open at the start of a piece, up to its end; a token that matters: a string, a string that the piece leaves open, a bracket.
_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\]]', re.DOTALL)


@dataclass(frozen=True)
class Place:
    """Where the scan of a range begins: in a string or not, how deep, how many objects of the array came before, and whether it is in the array."""

    quoted: bool
    depth: int
    before: int = 0
    inside: bool = False


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """block (where the byte range begins in the file), text: the pieces between closing braces, in the order of the file within a block; a piece belongs to the
    block that it begins in, whatever its length."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))


def _steps(text: str, quoted: bool) -> Iterator[tuple[int, str]]:
    """(place, bracket) of the piece's brackets outside strings, and last (-1, "open" or "") for whether it ends in a string."""
    at = 0
    if quoted:
        m = _REST.match(text)
        if not m:
            yield -1, "open"
            return
        at = m.end()
    for m in _TOKEN.finditer(text, at):
        if m[0][0] != '"':
            yield m.start(), m[0]
        elif not m[1]:
            yield -1, "open"
            return
    yield -1, ""


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    """block, the file's size and the piece with its brace."""
    for b in batches:
        for block, text, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            yield block, size, text + "}"


def _summaries(pieces: DataFrame, key: str | None) -> list:
    """For each block and each way to begin it (in a string or not): how it ends, by how much the depth changes, the bytes it has, and where the array may begin.

    A block doesn't know what came before it, so it is summed up as a function of that.
    """
    begin = re.compile(rf'"{re.escape(key)}"\s*:\s*\[') if key is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], list] = {}
        for block, size, text in _blocks(batches):
            for quoted in (False, True):
                s = found.setdefault((block, quoted), [quoted, 0, 0, 0, {}, size])  # state, depth, lowest, bytes, {depth: [place, lowest after it]}
                starts = {m.end() - 1 for m in begin.finditer(text)} if begin else ()
                for place, token in _steps(text, s[0]):
                    if place < 0:
                        s[0] = token == "open"
                    elif token in "{[":
                        if (place in starts if begin else token == "[") and s[1] not in s[4]:
                            s[4][s[1]] = [s[3] + len(text[:place].encode()), s[1] + 1]
                        s[1] += 1
                    else:
                        s[1] -= 1
                        s[2] = min(s[2], s[1])
                        for c in s[4].values():
                            c[1] = min(c[1], s[1])
                s[3] += len(text.encode())
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.int64()]
        rows = [(block, quoted, *s[:4], list(s[4]), [c[0] for c in s[4].values()], [c[1] for c in s[4].values()], s[5]) for (block, quoted), s in found.items()]
        names = ["block", "quoted", "ends_quoted", "change", "low", "bytes", "depths", "places", "lows", "size"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    ddl = "block long, quoted boolean, ends_quoted boolean, change long, low long, bytes long, depths array<long>, places array<long>, lows array<long>, size long"
    return pieces.mapInArrow(run, ddl).collect()


def _composed(rows: list, key: str | None) -> tuple[dict[int, Place], int, int, bool]:
    """Where each block really begins, by running through the blocks' summaries; the array's block and place in it; whether the file ends with a brace."""
    by = {(r.block, r.quoted): r for r in rows}
    level = 1 + (key is not None)
    at, places, start, total = Place(False, 0), {}, None, 0
    for block in sorted({r.block for r in rows}):
        own = by[block, at.quoted]
        low, inside, places[block] = own.low, at.inside, at
        if start is None:
            for d, p, after in zip(own.depths, own.places, own.lows, strict=True):
                if at.depth + d == level - 1:
                    start, low, inside = (block, p), after, True
        total += own.bytes
        at = Place(own.ends_quoted, at.depth + own.change, 0, inside and at.depth + low >= level)
    if start is None:
        raise ValueError(f"no array under the key {key!r}" if key is not None else "the document is no array")
    if at.inside:
        raise ValueError("the array is not closed")
    return places, *start, total == rows[0].size


def _objects(batches: Iterator[pa.RecordBatch], places: dict[int, Place], level: int, first: int, place: int, braced: bool) -> Iterator[tuple[int, int, str, bool, bool]]:
    """block, ordinal, text, whether it begins in this block and whether it ends here: the objects of the array, one row for each block that holds some of one.

    places: the blocks' beginnings, with the number of objects begun before. What lies outside the array is passed over; anything
    in it that is no object fails.
    """
    block = None
    quoted = inside = done = begun = False
    depth = ordinal = seen = size = 0
    held: list[str] = []

    def gap(text: str) -> None:
        if text.strip(" \t\r\n,"):
            raise ValueError(f"item {ordinal} is no object: {text.strip(' ,')[:40]!r}")

    for at, length, text in _blocks(batches):
        if at != block:
            if held:
                yield block, ordinal - 1, "".join(held), begun, False
            p = places[at]
            block, quoted, depth, ordinal, seen, inside, done, begun, held, size = at, p.quoted, p.depth, p.before, 0, p.inside, False, False, [], length
        if not braced and at + seen + len(text.encode()) > size:  # the brace that the file doesn't have
            text = text[:-1]
        begin = 0  # of what is not yet given out
        array_at = place - seen if at == first and not inside and not done else -1
        for where, token in _steps(text, quoted):
            if where < 0:
                quoted = token == "open"
            elif token in "{[":
                if array_at >= 0 and not inside and not done and len(text[:where].encode()) == array_at:
                    inside, begin = True, where + 1
                elif inside and depth == level:
                    gap(text[begin:where])
                    if token == "[":
                        raise ValueError(f"item {ordinal} is no object")
                    ordinal, begin, begun = ordinal + 1, where, True
                depth += 1
            else:
                depth -= 1
                if inside and depth == level:
                    yield block, ordinal - 1, "".join(held) + text[begin : where + 1], begun, True
                    held, begin = [], where + 1
                elif inside and depth == level - 1:
                    gap(text[begin:where])
                    inside, done = False, True
        if inside and depth > level:
            held.append(text[begin:])
        elif inside:
            gap(text[begin:])
        seen += len(text.encode())
    if held:
        yield block, ordinal - 1, "".join(held), begun, False


def array_objects(spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """ordinal (from 0) and text of the objects of the JSON array in one file, those whose ordinal is in wanted(ordinal), or all.

    key: the root object's key that holds the array (without braces, quotes or escapes); None if the root is the array. The file is read in
    byte ranges: a first pass sums each range up as a function of the state before it, the driver composes those summaries (one for each range) to
    where each range really begins, a second pass counts objects, and a third cuts them out. An object that spans ranges is put together
    from its parts. No text is decoded here; those that aren't wanted are given up undecoded. Fails where the array is missing or not closed, an
    item is no object, or an ordinal is beyond the last.
    """
    if key is not None and re.search(r'[{}"\\]', key):
        raise ValueError("the key may not hold braces, quotes or backslashes")
    pieces = _pieces(spark, path)
    rows = _summaries(pieces, key)
    if not rows:
        raise ValueError("the file is empty")
    places, first, place, braced = _composed(rows, key)
    level = 1 + (key is not None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for block, _, _, begun, _ in _objects(batches, places, level, first, place, braced):
            found[block] = found.get(block, 0) + begun
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["block", "begun"])

    counts = {r.block: r.begun for r in pieces.mapInArrow(count, "block long, begun long").collect()}
    total, known = 0, {}
    for b, p in sorted(places.items()):
        known[b] = replace(p, before=total)
        total += counts.get(b, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        objects = ((b, o, t, begun and ended) for b, o, t, begun, ended in _objects(batches, known, level, first, place, braced))
        while out := list(islice(objects, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "ordinal", "text", "whole"])

    parts = pieces.mapInArrow(cut, "block long, ordinal long, text string, whole boolean")
    if wanted is not None:
        if not wanted.filter((F.col("ordinal") >= total) | (F.col("ordinal") < 0)).isEmpty():
            raise ValueError(f"an ordinal is beyond the array's {total} objects")
        parts = parts.join(wanted.select("ordinal").distinct(), "ordinal", "left_semi")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    return parts.filter("whole").select("ordinal", "text").unionByName(parts.filter("NOT whole").groupBy("ordinal").agg(F.array_join(in_order, "").alias("text")))


def without_field(text: Column, field: str) -> Column:
    """A JSON object's text without a field that holds null or a flat list and doesn't come first, before anything is decoded; fails unless there is exactly one."""
    pattern = rf',\s*"{re.escape(field)}"\s*:\s*(?:null|\[[^\[\]]*\])'
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, "")).otherwise(F.raise_error(F.lit(f"not exactly one field {field}")).cast("string"))
