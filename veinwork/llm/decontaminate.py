"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, id_type, keyed_text, materialise

#: Shortest match in tokens, and the share of an item's tokens that tiles must cover for a document to be contaminated.
SHORTEST, COVERAGE = 5, 0.5
#: Bits of the filter that tasks hold: its size is fixed, a large benchmark only makes it pass more.
FILTER_BITS = 1 << 23
#: A window that so many items share is asked for last; windows of a text that are compared at a time.
HOT, STEP = 8, 1 << 16
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_HASHES_REMEMBERED = 500_000


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > _HASHES_REMEMBERED:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of the text's tokens: runs of letters and digits, lower-cased."""
        found = _TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def running_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of width tokens, modulo 2^64, by running sums over powers of the base."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers = np.cumprod(np.full(len(tokens), _BASE, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((tokens | np.uint64(1)) * powers)])
    h = (sums[width:] - sums[:n]) * np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))
    return h ^ (h >> np.uint64(29))


def _seeds(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows, different for windows of different widths."""
    return running_hashes(tokens, width) ^ np.uint64(width * 0x5851F42D4C957F2D & (1 << 64) - 1)


def greedy_tiles(text: np.ndarray, item: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, length): again and again the longest match of unmarked tokens
    is marked in both; of equally long ones the first in the text, then in the item. Ends when none is left of
    shortest tokens or more. Windows of the search length are found by their running hashes, and the match that
    is chosen is compared token by token; the search length starts at the longest run that can match and halves
    down to shortest.
    """
    free_t, free_i = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    width = max(shortest, min(len(text), len(item)))
    while True:
        best = _longest(text, item, free_t, free_i, width)
        if best:
            length, a, b = best
            tiles.append((a, b, length))
            free_t[a : a + length] = False
            free_i[b : b + length] = False
        elif width == shortest:
            return tiles
        else:
            width = max(shortest, width // 2)


def _longest(text: np.ndarray, item: np.ndarray, free_t: np.ndarray, free_i: np.ndarray, width: int) -> tuple[int, int, int] | None:
    """The longest match (length, place in the text, place in the item) of width or more unmarked tokens, the first of equally long ones.

    The text's windows are taken STEP at a time, and an item's length more, as no match is longer than the item:
    memory stays bounded where a long text and an item repeat the same few tokens.
    """
    at_t, at_i = _open_windows(free_t, width), _open_windows(free_i, width)
    if not len(at_t) or not len(at_i):
        return None
    ht, hi = running_hashes(text, width)[at_t], running_hashes(item, width)[at_i]
    order = np.argsort(hi, kind="stable")
    hi, at_i = hi[order], at_i[order]
    hit = np.isin(ht, hi)
    ht, at_t = ht[hit], at_t[hit]
    best: tuple[int, int, int] | None = None
    for start in range(0, len(at_t), STEP):
        stop = np.searchsorted(at_t, at_t[min(start + STEP, len(at_t)) - 1] + len(item), side="right")
        first = max(0, start - 1)
        low, high = np.searchsorted(hi, ht[first:stop]), np.searchsorted(hi, ht[first:stop], side="right")
        n = high - low
        a = np.repeat(at_t[first:stop], n)
        b = at_i[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        same = text[a] == item[b]
        for j in range(1, width):
            same &= text[a + j] == item[b + j]
        a, b = a[same], b[same]
        if not len(a):
            continue
        o = np.lexsort((a, b - a))
        a, b = a[o], b[o]
        begins = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])
        runs = np.flatnonzero(begins)
        length = np.diff(np.concatenate([runs, [len(a)]])) + width - 1
        a, b = a[runs], b[runs]
        own = (a >= at_t[start]) & (a <= at_t[min(start + STEP, len(at_t)) - 1])
        if own.any():
            k = np.lexsort((b[own], a[own], -length[own]))[0]
            found = (int(length[own][k]), int(a[own][k]), int(b[own][k]))
            if best is None or found[0] > best[0]:
                best = found
    return best


def _open_windows(free: np.ndarray, width: int) -> np.ndarray:
    """Where windows of width unmarked tokens begin."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[width:] - sums[:-width] == width) if len(free) >= width else np.empty(0, dtype=np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _BASE >> np.uint64(40)) % np.uint64(FILTER_BITS)


def _items(benchmark: DataFrame, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """row, item, width of its windows, tokens, and its windows' hashes with the number of places that each has; written."""
    rows = keyed_text(benchmark, id_col, text_col)
    seed = pa.list_(pa.struct([("seed", pa.int64()), ("places", pa.int32())]))
    schema = pa.schema([("item_row", pa.int64()), ("item", id_type(rows)), ("width", pa.int32()), ("item_tokens", pa.list_(pa.int64())), ("seeds", seed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = _Tokens(), TaskContext.get().partitionId() << 40
        for b in batches:
            got = [tokens.of(t) for t in b.column(1).to_pylist()]
            widths = [min(shortest, len(t)) for t in got]
            counted = [np.unique(_seeds(t, w), return_counts=True) if w else ((), ()) for t, w in zip(got, widths, strict=True)]
            seeds = [[{"seed": int(np.uint64(h).astype(np.int64)), "places": int(n)} for h, n in zip(*c, strict=True)] for c in counted]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(got)), pa.int64()), b.column(0), pa.array(widths, pa.int32()), pa.array([x.view(np.int64) for x in got], schema[3].type), pa.array(seeds, seed)], schema=schema)
            row += len(got)

    kind = rows.schema["id"].dataType.simpleString()
    return materialise(rows.mapInArrow(run, f"item_row bigint, item {kind}, width int, item_tokens array<bigint>, seeds array<struct<seed:bigint,places:int>>"), "tiling-items")


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of all seeds, in a table of fixed size; words of it are put together in Spark."""
    seeds = items.select(F.explode("seeds.seed").alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            on[_bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
        packed = np.packbits(on).view(">i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at].astype(np.int64))], names=["at", "word"])

    packed = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in seeds.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        packed[r.at] = r.word
    return np.unpackbits(packed.astype(">i8").view(np.uint8)).astype(bool)


def _passages(rows: DataFrame, on: np.ndarray, widths: list[int]) -> DataFrame:
    """For each document with windows that the filter passes: their hashes, and the tokens that they cover; written.

    Only those tokens can be part of a tile. Runs that don't touch are parted by a token that matches nothing.
    """
    kind = rows.schema["id"].dataType.simpleString()
    packed = np.packbits(on)
    schema = pa.schema([("row", pa.int64()), ("id", id_type(rows)), ("passage", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = _Tokens(), np.unpackbits(packed).astype(bool)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = tokens.of(t)
                hits, seeds = [], []
                for w in widths:
                    h = _seeds(got, w)
                    hit = np.flatnonzero(bits[_bits(h)]) if len(h) else h
                    if len(hit):
                        hits.append((hit[:, None] + np.arange(w)).ravel())
                        seeds.append(h[hit])
                if hits:
                    covered = np.unique(np.concatenate(hits)).astype(np.int64)
                    cut = np.flatnonzero(np.diff(covered) > 1) + 1
                    passage = np.insert(got[covered], cut, np.arange(len(cut), dtype=np.uint64))
                    row += 1
                    out.append((row, i, passage.view(np.int64), np.insert(covered, cut, -1).astype(np.int32), np.unique(np.concatenate(seeds)).view(np.int64)))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return materialise(rows.mapInArrow(run, f"row bigint, id {kind}, passage array<bigint>, places array<int>, seeds array<bigint>"), "tiling-passages")


def _asked(items: DataFrame, coverage: float) -> DataFrame:
    """item_row, seed, places, spare, need: the windows that documents are joined by.

    Tiles that cover the share coverage of an item hold coverage * tokens / width of its window places at least,
    as a tile of n tokens holds n - width + 1 of them, one for each width tokens or more; that number is need.
    Windows that HOT or more items share are left out of the join, most frequent first, while they have fewer
    than need places in the item: a document that reaches the coverage must share another window too. spare is the
    number of places left out, which the document is taken to share.
    """
    seeds = items.select("item_row", F.ceil(F.lit(coverage) * F.size("item_tokens") / F.col("width") - 1e-9).cast("long").alias("need"), F.explode("seeds").alias("s")).select("item_row", "need", "s.seed", "s.places")
    common = seeds.groupBy("seed").agg(F.count("*").alias("items")).filter(F.col("items") >= HOT)
    marked = seeds.join(common, "seed", "left")
    upto = Window.partitionBy("item_row").orderBy(F.desc_nulls_last("items"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    left_out = F.col("items").isNotNull() & (F.sum("places").over(upto) < F.col("need"))
    whole = Window.partitionBy("item_row")
    return marked.withColumn("out", left_out).withColumn("spare", F.sum(F.when(F.col("out"), F.col("places")).otherwise(0)).over(whole)).filter(~F.col("out")).select("item_row", "seed", "places", "spare", "need")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per contaminated pair: id, item id, item_tokens, matched_tokens, coverage, n_tiles, longest_tile, starts.

    Windows of shortest tokens that a document shares with an item are joined by hash; pairs that share enough
    places of them to reach the coverage are tiled greedily, longest matches first, so passages in another order or
    with words in between are found too. starts are the tiles' places in the document, in tokens.
    The whole text of every document is searched; a filter of fixed size keeps the rest of it from being moved.

    An item of fewer than shortest tokens is one window by itself. Null or empty texts and items match nothing;
    repeated rows give their pairs each; an empty table on either side gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    items = _items(benchmark, shortest, item_id_col, item_text_col)
    widths = sorted(r.width for r in items.filter("width > 0").select("width").distinct().collect())
    passages = _passages(rows, _filter(items), widths)
    shared = passages.select("row", F.explode("seeds").alias("seed")).join(_asked(items, coverage), "seed")
    shared = shared.groupBy("row", "item_row").agg(F.sum("places").alias("shared"), F.first("spare").alias("spare"), F.first("need").alias("need"))
    pairs = shared.filter(F.col("shared") + F.col("spare") >= F.col("need")).select("row", "item_row")
    pairs = pairs.join(items.select("item_row", "item", "width", "item_tokens"), "item_row")
    whole = pairs.join(passages.select("row", "id", "passage", "places"), "row").select("id", "item", "width", "item_tokens", "passage", "places")
    id_kind, item_kind = (whole.schema[c].dataType.simpleString() for c in ("id", "item"))
    schema = pa.schema([("id", id_type(whole)), ("item", id_type(whole, "item")), ("item_tokens", pa.int64()), ("matched_tokens", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64()), ("starts", pa.list_(pa.int32()))])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, item, width, want, passage, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tiles = greedy_tiles(np.array(passage, dtype=np.int64).view(np.uint64), np.array(want, dtype=np.int64).view(np.uint64), width)
                matched = sum(n for _, _, n in tiles)
                if tiles and matched >= coverage * len(want):
                    out.append((i, item, len(want), matched, matched / len(want), len(tiles), tiles[0][2], sorted(places[a] for a, _, _ in tiles)))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = whole.mapInArrow(tile, f"id {id_kind}, item {item_kind}, item_tokens bigint, matched_tokens bigint, coverage double, n_tiles bigint, longest_tile bigint, starts array<int>")
    return found.withColumnsRenamed({"id": id_col, "item": item_id_col})
