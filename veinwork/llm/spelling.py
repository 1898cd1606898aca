"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.blocks import in_units
from veinwork.llm.common import bounded_batches, discard, growing, keyed_text, materialise

#: Code points of a gram; numbers that grams are hashed to (their frequencies are one array of this size in every task).
Q, GRAMS = 4, 1 << 18
#: One edit changes Q grams at most and moves the others by one place, so of its L + Q - 1 grams a word shares all but Q with a word
#: near to it, and one of its Q + 1 rarest (one more, as the other may be a code point shorter).
RAREST = Q + 1
#: Words in a block of a unit.
BLOCK = 2048
_REMEMBERED = 300_000
#: Letters of ASCII, A-Z lower-cased, and U+00C0 to U+00FF, a byte each; everything else parts runs.
_LETTERS = bytes(b if b >= 0xC0 or chr(b).isalpha() and b < 0x80 else 0x20 for b in bytes(range(256)).lower())
#: Stands before and after a word in its grams; no run holds it.
_PAD = "\x00" * (Q - 1)


def runs_of(text: str) -> list[bytes]:
    """Runs of letters of ASCII and of U+00C0 to U+00FF, A-Z lower-cased, in Latin-1: a code point is a byte."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def thinned(run: bytes, start: int, every: int) -> bytes:
    """The run, or, where the crc32 of <name>:<run> in UTF-8 divides by every, the run without its code point crc32 % length. start: the crc32 of <name>:."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run[: (at := h % len(run))] + run[at + 1 :] if h % every == 0 else run


def word_counts(docs: DataFrame, least: int, fewest: int, every: int = 0) -> DataFrame:
    """word and n of the words of at least `least` code points that occur at least `fewest` times in rows(id, text); written.

    Tasks count first. every: thins one run in so many (see thinned) by the id of its document, a null id as an empty one; 0 leaves all as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def made() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in seen.items() if n and len(w) >= least]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = runs_of(t)
                seen.update(runs)
                start, changed = zlib.crc32(f"{'' if i is None else i}:".encode()), {}
                for w in set(runs) if every else ():
                    if (other := thinned(w, start, every)) != w:
                        changed[w] = other
                for w in runs if changed else ():
                    if w in changed:
                        seen[w] -= 1
                        seen[changed[w]] += 1
                if len(seen) > _REMEMBERED:
                    yield made()
        yield made()

    counted = docs.select(F.col("id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest), "spell-words")


def grams_of(word: str) -> list[int]:
    """The numbers of the word's grams, place by place: L + Q - 1 of them."""
    padded = _PAD + word + _PAD
    return [xxhash.xxh32_intdigest(padded[i : i + Q]) % GRAMS for i in range(len(word) + Q - 1)]


def within_one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many words each gram number occurs in: GRAMS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAMS, dtype=np.int64)
        for b in batches:
            for w in b.column(0).to_pylist():
                n[list(set(grams_of(w)))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["gram", "n"])

    counts = np.zeros(GRAMS, dtype=np.int64)
    found = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    parts = found.groupBy((F.col("gram") / 4096).cast("int")).agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n"))
    for r in parts.toLocalIterator():
        counts[r.gram] = r.n
    return counts


def _routed(words: DataFrame, order) -> DataFrame:
    """Each word for each of its rarest grams: once under its own length, at home, and once as the longer one of the length before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("gram", "size", "home", "rarest")}
            rows = []
            for i, w in enumerate(b.column(0).to_pylist()):
                rarest = list(dict.fromkeys(sorted(grams_of(w), key=lambda g: rank[g])[:RAREST]))
                for g in rarest:
                    for home in (True, False):
                        rows.append(i)
                        out["gram"].append(g)
                        out["size"].append(len(w) - (not home))
                        out["home"].append(home)
                        out["rarest"].append(rarest)
            types = {"gram": pa.int32(), "size": pa.int32(), "home": pa.bool_(), "rarest": pa.list_(pa.int32())}
            columns = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns.columns, *(pa.array(out[c], t) for c, t in types.items())], names=["word", "n", *types])

    return words.select("word", "n").mapInArrow(run, "word string, n long, gram int, size int, home boolean, rarest array<int>")


def merged(lists: list[list[int]], least: int) -> list[int]:
    """The numbers that stand in at least `least` of the ascending lists.

    All but two of so many lists, the longest, are set aside: a number must stand twice in the others, which are merged by a
    heap, and is then looked up in those.
    """
    lists = sorted(lists, key=len)
    aside = lists[len(lists) - least + 2 :] if least > 2 else []
    out = []
    for number, times in groupby(heapq.merge(*lists[: len(lists) - len(aside)])):
        n = sum(1 for _ in times)
        if n + len(aside) >= least:
            for x in aside:
                at = bisect_left(x, number)
                n += at < len(x) and x[at] == number
            if n >= least:
                out.append(number)
    return out


def _near(gram: int, rows: list[tuple]) -> dict[str, list]:
    """One unit's rows(word, n, home, rarest, target, asking): for each word how many near words it has there, the largest n of those and the smallest
    word that has it. A pair counts in the unit of its first common rarest gram.
    """
    size = next((len(r[0]) for r in rows if r[4]), 0)
    postings: list[dict[str, list[int]]] = [{} for _ in range(size + Q - 1)]
    targets: list[tuple] = []
    found: dict[str, list] = {}

    def insert(row: tuple) -> None:
        padded = _PAD + row[0] + _PAD
        for place, index in enumerate(postings):
            index.setdefault(padded[place : place + Q], []).append(len(targets))
        targets.append(row)

    def note(word: str, other: str, n: int) -> None:
        own = found.setdefault(word, [0, n, other])
        own[0] += 1
        if n > own[1] or n == own[1] and other < own[2]:
            own[1:] = n, other

    def ask(word: str, n: int, home: bool, rarest: list[int], target: bool) -> None:
        # A word of the same length has its grams in the same places, one that is a code point shorter has them there or one place before.
        padded, lists, misses = _PAD + word + _PAD, [], 0
        for place in range(len(word) + Q - 1):
            g, before = padded[place : place + Q], len(lists)
            if place < len(postings) and g in (index := postings[place]):
                lists.append(index[g])
            if not home and place and g in (index := postings[place - 1]):
                lists.append(index[g])
            misses += len(lists) == before
            if misses > Q:
                return
        for i in merged(lists, len(word) - 1):
            other, m, _, theirs, *_ = targets[i]
            if (not home or target or word < other) and gram == next((g for g in rarest if g in theirs), None) and within_one_edit(word, other):
                note(word, other, m)
                note(other, word, n)

    for row in rows:  # what is only looked for
        if row[4] and not row[5]:
            insert(row)
    for row in rows:  # what does both asks those before it
        if row[2] and row[5]:
            ask(*row[:5])
            if row[4]:
                insert(row)
    for row in rows:
        if not row[2]:
            ask(*row[:5])
    return found


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All units of a partition that is sorted by them, one at a time."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []
    for key, unit in groupby(rows, key=lambda r: r[:4]):
        out += ((w, *x) for w, x in _near(key[0], [r[4:] for r in unit]).items())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    columns = zip(*out, strict=True) if out else ((),) * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (the near word of largest n, of equal ones the smallest), best_n, for the words(word, n) that have a near one.

    Words are distinct and not null. Each word goes to the units of its RAREST rarest grams, where two words near to each other must meet, by length;
    in a unit an index of (gram, place) lists is merged for each word under the limits of place and length, and what shares enough grams is
    compared. Units of any size are dealt in blocks. Only counts and the best word leave a task, never pairs.
    """
    order = np.argsort(_gram_counts(words), kind="stable")
    rank = np.empty(GRAMS, dtype=np.int32)
    rank[order] = np.arange(GRAMS, dtype=np.int32)
    routed = _routed(words, words.sparkSession.sparkContext.broadcast(rank))
    units = in_units(routed, ["gram", "size"], "word", F.col("home"), BLOCK)
    key = ["gram", "size", "t", "q"]
    placed = units.select(*key, "word", "n", "home", "rarest", "target", "asking").repartition(*key).sortWithinPartitions(*key)
    met = placed.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of words(word, form): each step doubles how far a word has followed its forms. Forms make no circle."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialise(now.join(growing(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        discard(now)
        now = then.select("word", "root")
        now.written_to = then.written_to
        if then.filter("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least: int = 5, fewest: int = 3, times: float = 2, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `least` code points (3 or more) that occurs at least `fewest` times.

    A word's form is its near word (one inserted, deleted or replaced code point) of largest n, of equal ones the smallest in the order of code points, if that
    occurs at least `times` (above 1) as often as the word, else null. Its root is where its forms end, itself if it has none.
    every: see word_counts. A null text has no words; an empty table gives no rows.
    """
    if least < 3 or times <= 1:
        raise ValueError("words have at least 3 code points, and a form occurs more often than its word")
    bounded_batches(docs.sparkSession)
    words = word_counts(keyed_text(docs, id_col, text_col), least, fewest, every)
    near = materialise(near_words(words), "spell-near")
    joined = words.join(growing(near), "word", "left").withColumn("formed", F.coalesce(F.col("best_n") >= F.col("n") * times, F.lit(False)))
    formed = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("best")).alias("form"), F.when(F.col("formed"), F.col("best_n")).alias("form_n")), "spell-forms")
    roots = _roots(formed.filter("form IS NOT NULL"))
    discard(words, near)
    return formed.join(growing(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
