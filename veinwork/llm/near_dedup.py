"""Near duplicates over word shingles: min-max hashing, banding, and exact confirmation on full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veinwork.llm.common import bounded_batches, discard, keyed_text, materialise
from veinwork.llm.components import components

#: A permutation gives two signature values, its minimum and its maximum. 32 bands of 5 values miss a pair at a
#: similarity of 0.8 with a probability of 3e-6, one at 0.85 with 2e-8.
PERMUTATIONS, ROWS, BANDS = 80, 5, 32
#: A pair goes on to its full sets if its signatures agree in at least threshold - SLACK: 5 standard errors.
SLACK = 0.16
#: Members of a bucket or cluster in a block, and the bytes of their sets; a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
#: Clusters of up to so many members are one block.
SMALL = 128
_WORDS_REMEMBERED = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles: A-Z lower-cased, words parted by ASCII white space.

    Fewer than k words make one shingle of them all; no words, an empty set.
    """
    words = text.encode().lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = h[:n].copy()
    for j in range(1, width):
        out = _mix(out) * _ODD + h[j : j + n]
    return np.unique(_mix(out + np.uint64(width)))


def signatures(sets: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """For each non-empty set, PERMUTATIONS minima and as many maxima, 16 mixed bits of each."""
    r = np.random.default_rng(seed)
    factors = r.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = r.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype="<u2")
    if not sets:
        return out
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    for j in range(PERMUTATIONS):
        v = flat * factors[j] + shifts[j]
        out[:, 2 * j] = (_mix(np.minimum.reduceat(v, starts)) & np.uint64(0xFFFF)).astype("<u2")
        out[:, 2 * j + 1] = (_mix(np.maximum.reduceat(v, starts)) & np.uint64(0xFFFF)).astype("<u2")
    return out


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    """id, n (size of the set), set_key (hash of the whole set), sig; written, as several steps read it."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            sets = [shingle_set(t, k, hashes) for t in b.column(1).to_pylist()]
            sigs = iter(signatures([s for s in sets if len(s)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([next(sigs).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                schema=schema,
            )

    return materialise(rows.mapInArrow(sketch, "id bigint, n bigint, set_key binary, sig binary"), "near-sketches")


def in_blocks(members: DataFrame, blocks: Column, part: str = "all") -> DataFrame:
    """Each member once for every pair of blocks (lo, hi) of its group that holds its own block.

    A group of one block is one task's work; a larger one is dealt into blocks, and every pair of them becomes
    a group of its own, so no task holds more than two blocks however large a group is. part: "first" gives only
    the pairs of a block with itself and with block 0, which is three rows for each member on average; "rest" gives the others.
    """
    spread = members.withColumn("blocks", blocks.cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every, first = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own") == 0
    if part == "first":
        every = F.when(first, every).otherwise(F.array(F.lit(0), F.col("own")))
    elif part == "rest":
        every = F.when(~first, F.array_except(every, F.array(F.lit(0), F.col("own"))))
    other = F.explode(every).alias("other")
    return spread.select("*", other).select(*members.columns, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _block_count(members: Column, shingles: Column) -> Column:
    """Blocks of a cluster: of at most BLOCK members and, on average, BLOCK_BYTES, and about as many as the square
    root of its members, so a large cluster spreads over many tasks and is copied no more often than that."""
    spread = F.when(members > SMALL, F.ceil(F.sqrt(members))).otherwise(1)
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles * 8 / BLOCK_BYTES), spread).cast("int")


def _grouped(fn: Callable[[dict[str, list]], list[tuple[int, int]]], key: list[str], columns: list[str]) -> Callable:
    """A mapInArrow function over partitions sorted by key: gives fn one group's columns at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, {c: [] for c in columns}, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            values = {c: b.column(c).to_pylist() for c in columns}
            first = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != at:
                    for c in columns:
                        held[c] += values[c][first:i]
                    if i == len(keys):
                        break
                    if len(held[columns[0]]) > 1:
                        out += fn(held)
                    at, held, first = keys[i], {c: [] for c in columns}, i
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if len(held[columns[0]]) > 1:
            out += fn(held)
        yield _pairs(out)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Union:
    """Components of a group's members; root is the same for members of one component."""

    def __init__(self, root: np.ndarray):
        self.root = root.copy()
        self.members: dict[int, list[int]] = {}
        for i, r in enumerate(root.tolist()):
            self.members.setdefault(r, []).append(i)

    def join(self, i: int, j: int) -> None:
        """The smaller component takes the larger one's root, so a member changes its root a logarithmic number of times."""
        a, b = sorted((int(self.root[i]), int(self.root[j])), key=lambda r: -len(self.members[r]))
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved

    def stars(self, names: np.ndarray) -> list[tuple[int, int]]:
        """Each member with the smallest name of its component."""
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, names)
        return [(int(x), int(y)) for x, y in zip(names, least[self.root], strict=True) if x != y]


def _by_size(g: dict[str, list], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by set size; for each place in it, where the sets begin that are too large for it; the blocks."""
    n = np.array(g["n"])
    order = np.argsort(n, kind="stable")
    n = n[order]
    return order, np.searchsorted(n, np.floor(n / threshold + 1e-9), side="right"), np.array(g["own"])[order]


def _likely(threshold: float) -> Callable[[dict[str, list]], list[tuple[int, int]]]:
    """Stars of the members whose signatures are alike enough."""

    def fn(g: dict[str, list]) -> list[tuple[int, int]]:
        order, ends, own = _by_size(g, threshold)
        sig = np.frombuffer(b"".join(g["sig"]), dtype="<u2").reshape(len(order), -1)[order]
        union, split = _Union(np.arange(len(order))), own.min() != own.max()
        for i in range(len(order)):
            c = np.arange(i + 1, ends[i])
            c = c[(union.root[c] != union.root[i]) & ((own[c] != own[i]) | (not split))]
            for j in c[(sig[c] == sig[i]).mean(axis=1) >= threshold - SLACK] if len(c) else ():
                if union.root[i] != union.root[j]:
                    union.join(i, j)
        return union.stars(np.array(g["rep"])[order])

    return fn


def _linked(threshold: float) -> Callable[[dict[str, list]], list[tuple[int, int]]]:
    """Stars of the members whose full sets are similar enough; what is one component already teaches nothing."""

    def fn(g: dict[str, list]) -> list[tuple[int, int]]:
        order, ends, own = _by_size(g, threshold)
        names = np.array(g["rep"])[order]
        sets = [np.frombuffer(g["members"][o], dtype="<u8") for o in order]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        _, first, known = np.unique(np.array(g["component"])[order], return_index=True, return_inverse=True)
        union, split = _Union(first[known]), own.min() != own.max()
        mine = np.zeros(int(numbers.max()) + 1, dtype=np.int32)
        for i in range(len(order)):
            c = slice(i + 1, ends[i])
            open_ = (union.root[c] != union.root[i]) & ((own[c] != own[i]) | (not split))
            if not open_.any():
                continue
            mine[numbers[starts[i] : starts[i + 1]]] = 1
            both = np.add.reduceat(mine[numbers[starts[i + 1] : starts[ends[i]]]], starts[c] - starts[i + 1])
            mine[numbers[starts[i] : starts[i + 1]]] = 0
            for j in i + 1 + np.flatnonzero(open_ & (both + 1e-9 >= threshold * (sizes[i] + sizes[c] - both))):
                if union.root[i] != union.root[j]:
                    union.join(i, j)
        return union.stars(names)

    return fn


def _pairs_of_blocks(members: DataFrame, key: list[str], columns: list[str], fn: Callable) -> DataFrame:
    placed = members.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)
    return placed.mapInArrow(_grouped(fn, key, columns), "a bigint, b bigint")


def _alike(classes: DataFrame, threshold: float) -> DataFrame:
    """Stars (a, b) of the classes that share a band and whose signatures are alike enough; written.

    A bucket of up to BLOCK classes is one task's work. In a larger one each block is compared with itself and with the
    first block, which puts a large group of copies in one component. What such a bucket then still holds of several
    components shares a band by a common passage more than by being alike: its members are dealt again by pairs of bands,
    as two texts with a similarity of 0.8 share another band with a probability of 1 - 4e-6, and only pairs of bands
    that several components share are compared.
    """
    columns, key = ["rep", "n", "sig", "own"], ["bucket", "lo", "hi"]
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    placed = classes.select("rep", F.explode(band).alias("bucket"))
    shared = materialise(placed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "near-buckets")
    sized = placed.join(shared, "bucket")
    whole = classes.select("rep", "n", "sig")
    blocks = F.ceil(F.col("members") / BLOCK)
    likely = _pairs_of_blocks(in_blocks(sized.filter(F.col("members") <= BLOCK).join(whole, "rep"), blocks), key, columns, _likely(threshold))
    large = sized.filter(F.col("members") > BLOCK)
    if shared.filter(F.col("members") > BLOCK).isEmpty():
        found = materialise(likely, "near-alike")
    else:
        met = materialise(likely.unionByName(_pairs_of_blocks(in_blocks(large.join(whole, "rep"), blocks, "first"), key, columns, _likely(threshold))), "near-alike")
        part = components(met, "near-part").withColumnRenamed("node", "rep")
        both = large.join(classes, "rep").select("rep", F.col("bucket").alias("x"), F.explode(band).alias("y")).filter("x != y")
        both = both.select("rep", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("bucket")).distinct()
        both = both.join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ = both.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket", "members")
        rest = both.select("rep", "bucket").join(open_, "bucket").join(whole, "rep")
        found = materialise(met.unionByName(_pairs_of_blocks(in_blocks(rest, blocks), key, columns, _likely(threshold))), "near-alike")
        discard(met)
    discard(shared)
    return found


def near_components(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Ids are unique, of any type that can be ordered.

    Documents with equal sets are one class, and only classes go on. A class's signature is cut into bands;
    classes that share a band are compared by set size and whole signature (_alike), never as a list of pairs: a task
    gives back stars of what it finds alike. The clusters that these stars make are confirmed on
    the full sets: first each block within itself and with its cluster's first block, then, where several
    components are left, every other pair of blocks. Within a component nothing is compared again, so a large
    group of copies costs its size times the number of blocks at most. No bucket, cluster or list is capped.

    A null or empty text has an empty set and stands alone; fewer than k words are one shingle; an empty table
    gives no rows; rows with a null id are left out of links but returned, each for itself with a null component.
    Rows that repeat an id count as that one document and are all kept or dropped with it.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    if isinstance(rows.schema["id"].dataType, IntegralType):
        found = _components(rows.withColumn("id", F.col("id").cast("long")), k, threshold)
    else:  # numbered for the work, named again after it
        numbers = materialise(rows.filter("id IS NOT NULL").select(F.col("id").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "near-ids")
        numbered = rows.join(numbers, rows["id"] == numbers["name"], "left").select(numbers["id"].alias("id"), "text")
        named = _components(numbered, k, threshold).join(numbers, "id", "left")
        least = named.groupBy("component_id").agg(F.min("name").alias("least"))
        found = named.join(least, "component_id", "left").select(F.col("name").alias("id"), "n_shingles", F.col("least").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """id, n_shingles, component_id (the smallest id) of rows(id bigint, text)."""
    sketches = _sketches(rows, k)
    classes = materialise(sketches.filter("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    likely = _alike(classes, threshold)
    clusters = components(likely, "near-likely").withColumnsRenamed({"node": "rep", "component": "cluster"}).join(classes.select("rep", "n"), "rep")
    sizes = clusters.groupBy("cluster").agg(_block_count(F.count("*"), F.sum("n")).alias("n_blocks"))
    full = materialise(_with_sets(clusters.join(sizes, "cluster"), rows, k), "near-sets")

    columns, key = ["rep", "n", "own", "members", "component"], ["cluster", "lo", "hi"]
    first = in_blocks(full.withColumn("component", F.col("rep")), F.col("n_blocks"), "first")
    links = materialise(_pairs_of_blocks(first, key, columns, _linked(threshold)), "near-links")
    if not full.filter("n_blocks > 2").isEmpty():
        part = components(links, "near-part").withColumnRenamed("node", "rep")
        known = full.join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ = known.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("cluster")
        rest = in_blocks(known.join(open_, "cluster"), F.col("n_blocks"), "rest")
        links = materialise(links.unionByName(_pairs_of_blocks(rest, key, columns, _linked(threshold))), "near-links")
    discard(full, likely)
    found = components(links, "near-components").withColumnRenamed("node", "rep")

    by_class = classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    alone = sketches.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    others = sketches.filter("n > 0 AND id IS NOT NULL").join(by_class, "set_key").select("id", "n", "component_id")
    return others.unionByName(alone).withColumnRenamed("n", "n_shingles")


def _with_sets(members: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The members with the full set of their text; only their texts are read again."""
    texts = rows.join(members, rows["id"] == members["rep"]).select("rep", "n", "cluster", "n_blocks", "text")
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("cluster", pa.int64()), ("n_blocks", pa.int32()), ("members", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            made = [shingle_set(t, k, hashes).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(made, pa.binary())], schema=schema)

    return texts.mapInArrow(sets, "rep bigint, n bigint, cluster bigint, n_blocks int, members binary")
