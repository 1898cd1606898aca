"""Ranked lexical search over inverted treaps: documents in search order, impacts in heap order, pruned by summed maxima."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, discard, id_type, keyed_text, materialise

#: Documents in a shard and postings in it, whichever is reached first; items that search a shard together; intervals opened at a time.
SHARD, SHARD_POSTINGS, ITEMS, OPENED = 16_384, 1 << 21, 512, 512
#: Bits of the filter that tasks hold: its size is fixed, more items only make it pass more terms.
FILTER_BITS = 1 << 23
#: An impact is SCALE * tf div (1000 * tf + 20 * m), with m = 50 + 50 * n * N div L.
SCALE = 1_000_000_000
_REMEMBERED = 500_000
#: A-Z to lower case; every other ASCII character that is neither letter nor digit parts terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters from U+0080 on; A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split()


def _bit(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) % FILTER_BITS


class _Wanted(dict):
    """Whether a term passes the filter."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) > _REMEMBERED:
            self.clear()
        self[term] = found = bool(self.bits[(h := _bit(term)) >> 3] >> (h & 7) & 1)
        return found


def _item_terms(items: DataFrame) -> DataFrame:
    """item, item_row (numbers the rows) and term, once for each distinct term of rows(id, text); written."""
    schema = pa.schema([("item", id_type(items)), ("item_row", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows, terms = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sorted(set(terms_of(t)))
                ids += [i] * len(own)
                rows += [row] * len(own)
                terms += own
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, rows, terms), schema, strict=True)], schema=schema)

    return materialise(items.mapInArrow(run, f"item {items.schema['id'].dataType.simpleString()}, item_row long, term binary"), "rank-items")


def _filter(terms: DataFrame) -> np.ndarray:
    """The bits of all terms: the distinct bits come back in FILTER_BITS / 4096 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            seen.update(map(_bit, b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["bit"])

    bits = np.zeros(FILTER_BITS, dtype=np.uint8)
    found = terms.select("term").mapInArrow(run, "bit int").distinct().groupBy((F.col("bit") / 4096).cast("int").alias("part")).agg(F.collect_list("bit").alias("bits"))
    for r in found.toLocalIterator():
        bits[r.bits] = 1
    return np.packbits(bits, bitorder="little")


def _frequencies(docs: DataFrame, wanted) -> DataFrame:
    """id, n (terms with repeats), and the asked-for terms with their occurrences, of every document; written."""
    schema = pa.schema([("id", id_type(docs)), ("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wanted(wanted.value)
        for b in batches:
            n, terms, tfs = [], [], []
            for t in b.column(1).to_pylist():
                found = terms_of(t)
                n.append(len(found))
                own = {w: c for w, c in Counter(found).items() if known[w]}
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip((n, terms, tfs), list(schema)[1:], strict=True))], schema=schema)

    return materialise(docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, terms array<binary>, tfs array<long>"), "rank-tfs")


def treap(impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Children (left, right; -1 for none) and root of the treap whose search order is the array's and whose heap order is that of impacts.

    Among equal impacts a hash of the place decides, so a list of equal impacts is no chain.
    """
    n = len(impacts)
    left, right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort(((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), impacts))] = np.arange(n)
    l, r, path = left.tolist(), right.tolist(), []
    for i, own in enumerate(rank.tolist()):
        last = -1
        while path and path[-1][1] < own:
            last = path.pop()[0]
        l[i] = last
        if path:
            r[path[-1][0]] = i
        path.append((i, own))
    left[:], right[:] = l, r
    return left, right, path[0][0] if path else -1


def _treaps(tfs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each shard and term: its treap; and one without a term that lists the shard's documents in the order of their ids. Written."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("ids", pa.list_(id_type(tfs))), *((c, pa.binary()) for c in ("place", "impact", "left", "right")), ("root", pa.int32())])

    def index(shard: int, docs: list[tuple]) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0]))
        postings: dict[bytes, tuple[list[int], list[int]]] = {}
        for place, (_, n, terms, tf) in enumerate(docs):
            m = 20 * (50 + 50 * n * n_docs // n_terms)
            for term, f in zip(terms, tf, strict=True):
                p, q = postings.setdefault(term, ([], []))
                p.append(place)
                q.append(SCALE * f // (1000 * f + m))
        rows: list[list] = [[shard], [None], [[d[0] for d in docs]], [None], [None], [None], [None], [None]]
        for term, (p, q) in postings.items():
            left, right, root = treap(np.array(q))
            made = (shard, term, None, np.array(p, dtype="<i4").tobytes(), np.array(q, dtype="<i4").tobytes(), left.astype("<i4").tobytes(), right.astype("<i4").tobytes(), root)
            for column, value in zip(rows, made, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[2]:
                    held.append(row)
                    size += len(row[2])
                if len(held) >= SHARD or size >= SHARD_POSTINGS:
                    yield index(shard, held)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield index(shard, held)

    return materialise(tfs.mapInArrow(run, f"shard long, term binary, ids array<{tfs.schema['id'].dataType.simpleString()}>, place binary, impact binary, left binary, right binary, root int"), "rank-treaps")


class Treaps:
    """The treaps of a shard, with all nodes in common arrays; node 0 stands for none."""

    def __init__(self, found: list[tuple[bytes, bytes, bytes, bytes, int]]):
        parts = [tuple(np.frombuffer(x, dtype="<i4") for x in f[:4]) for f in found]
        starts = np.cumsum([1] + [len(p[0]) for p in parts])
        self.roots = np.array([s + f[4] for s, f in zip(starts, found, strict=False)], dtype=np.int32)
        none = np.zeros(1, dtype=np.int32)
        self.place = np.concatenate([none, *(p[0] for p in parts)])
        self.impact = np.concatenate([none, *(p[1] for p in parts)]).astype(np.int64)
        self.left, self.right = (np.concatenate([none, *(np.where(p[side] < 0, 0, p[side] + s).astype(np.int32) for p, s in zip(parts, starts, strict=False))]) for side in (2, 3))

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each treap (row) and interval (column), the topmost node below the given one whose document is in [low, high)."""
        flat = nodes.reshape(-1).copy()
        low, high = (np.broadcast_to(x, nodes.shape).reshape(-1) for x in (low, high))
        open_ = np.flatnonzero(flat)
        while len(open_):
            now = flat[open_]
            p = self.place[now]
            up, down = p < low[open_], p >= high[open_]
            moved = up | down
            open_, now = open_[moved], now[moved]
            now = np.where(up[moved], self.right[now], self.left[now])
            flat[open_] = now
            open_ = open_[now > 0]
        return flat.reshape(nodes.shape)

    def search(self, terms: np.ndarray, weights: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of a shard of that size, best first, equal scores in the order of places.

        All treaps of the terms are gone through at the same time. An interval of documents has in each of them a topmost node, whose impact
        is the largest of the interval; their weighted sum bounds every score in it. The intervals with the largest
        bounds are opened first: at the document of the node that weighs most, into what lies before it, the document
        itself, whose bound is its score, and what lies after it. An interval that can't enter the k best is dropped with
        all subtrees below it.
        """
        w = weights[:, None]
        nodes, low, high = self.roots[terms][:, None], np.zeros(1, dtype=np.int64), np.full(1, size, dtype=np.int64)
        bound = (self.impact[nodes] * w).sum(axis=0)
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while len(bound):
            if len(bound) > OPENED:
                first = np.argpartition(-bound, OPENED)
                now, later = first[:OPENED], first[OPENED:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            own, a, z = nodes[:, now], low[now], high[now]
            top = (self.impact[own] * w).argmax(axis=0)
            at = self.place[own[top, np.arange(len(now))]].astype(np.int64)
            new_low, new_high = np.concatenate([a, at, at + 1]), np.concatenate([at, at + 1, z])
            some = new_low < new_high
            new_low, new_high = new_low[some], new_high[some]
            new = self.within(np.concatenate([own, own, own], axis=1)[:, some], new_low, new_high)
            new_bound = (self.impact[new] * w).sum(axis=0)
            single = new_high - new_low == 1
            places, scores = np.concatenate([places, new_low[single]]), np.concatenate([scores, new_bound[single]])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
            nodes = np.concatenate([nodes[:, later], new[:, ~single]], axis=1)
            low, high, bound = np.concatenate([low[later], new_low[~single]]), np.concatenate([high[later], new_high[~single]]), np.concatenate([bound[later], new_bound[~single]])
            keep = bound > 0
            if len(scores) == k:
                keep &= (bound > scores[-1]) | (bound == scores[-1]) & (low < places[-1])
            nodes, low, high, bound = nodes[:, keep], low[keep], high[keep], bound[keep]
        return places[scores > 0], scores[scores > 0]


def _searched(ids: pa.DataType, k: int):
    """One shard and one block of items: each item's k best documents there."""
    schema = pa.schema([("item_row", pa.int64()), ("doc", ids), ("score", pa.int64())])

    def fn(unit: pa.Table) -> pa.Table:
        rows = unit.select(["term", "ids", "place", "impact", "left", "right", "root", "asked"]).to_pylist()
        names = next(r["ids"] for r in rows if r["term"] is None)
        rows = [r for r in rows if r["term"] is not None]
        treaps = Treaps([(r["place"], r["impact"], r["left"], r["right"], r["root"]) for r in rows])
        asked: dict[int, tuple[list[int], list[int]]] = {}
        for i, r in enumerate(rows):
            for x in r["asked"]:
                terms, weights = asked.setdefault(x["item_row"], ([], []))
                terms.append(i)
                weights.append(x["w"])
        out: tuple[list, list, list] = ([], [], [])
        for item, (terms, weights) in asked.items():
            places, scores = treaps.search(np.array(terms), np.array(weights, dtype=np.int64), len(names), k)
            out[0].extend([item] * len(places))
            out[1].extend(names[p] for p in places.tolist())
            out[2].extend(scores.tolist())
        return pa.table([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return fn


def weight(documents: int, df: Column) -> Column:
    """floor(1000 * ln((2N + 2) / (2df + 1)))."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * df + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's k documents with the highest scores above 0: item, rank, id, score; equal scores by ascending id.

    A document's score sums weight * impact over the item's distinct terms (weight and SCALE state both), in 64-bit integers.
    Documents are counted where they lie; a filter of fixed size keeps the terms that no item asks for from going on. Each
    task cuts its documents into shards and builds a treap for each of a shard's terms; a shard's treaps meet once with every block of ITEMS
    items, by the terms that they ask for, and are searched together (Treaps.search). Of a shard, k rows for each item
    go on to the last ranking, so one frequent term or hot source is as many tasks as it has shards.

    Null or empty texts have no terms: such documents are counted nowhere and never found, such items find none. A document with a null id
    is ranked like others, after those with equal scores. Rows that repeat an id are documents, or items, of their own: a repeated
    item's documents come out for each of its rows. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed_text(docs, id_col, text_col)
    item_terms = _item_terms(keyed_text(items, item_col, item_text_col))
    wanted = spark.sparkContext.broadcast(_filter(item_terms))
    tfs = _frequencies(rows, wanted)
    total = tfs.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    treaps = _treaps(tfs, total.docs, total.terms or 1)
    df = tfs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = materialise(item_terms.join(df, "term").withColumn("w", weight(total.docs, F.col("df"))).filter("w > 0"), "rank-weights")
    blocks = 1 + known.select("item_row").distinct().count() // ITEMS
    asked = known.groupBy("term", F.pmod(F.xxhash64("item_row"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item_row", "w")).alias("asked"))
    columns = ["block", "shard", "term", "ids", "place", "impact", "left", "right", "root", "asked"]
    lists = treaps.filter("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(None).cast(asked.schema["asked"].dataType))
    units = treaps.filter("term IS NOT NULL").join(asked, "term").select(*columns).unionByName(lists.select(*columns))
    ids = id_type(rows)
    best = units.groupBy("block", "shard").applyInArrow(_searched(ids, k), f"item_row long, doc {rows.schema['id'].dataType.simpleString()}, score long")
    place = F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    top = materialise(best.withColumn("rank", place).filter(F.col("rank") <= k), "rank-top")
    names = item_terms.select("item", "item_row").distinct()
    found = top.join(names, "item_row").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
    discard(treaps, tfs, known)
    return found
