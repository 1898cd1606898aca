"""Spelling variants against all pairs of words, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veinwork.llm import queries, spelling
from veinwork.llm.blocks import in_units

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs, every):
    """The words of all texts, one code point taken from one run in `every`."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode()) & 0xFFFFFFFF
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return n


def edits(word, letters):
    """All that one edit makes of a word."""
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def plain(docs, least, fewest, times, every):
    """The operator's rows by making every edit of every word."""
    n = {w: c for w, c in counts(docs, every).items() if len(w) >= least and c >= fewest}
    letters = sorted({c for w in n for c in w})
    near = {w: {e for e in edits(w, letters) if e in n} - {w} for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_all_edits(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    want = plain(docs, 5, 3, 2, 97)
    assert any(r[1] for r in want)
    assert found(queries.op13_spelling_variants(spark, f"/root/testdata/{sf}")) == want


def test_alike_words_in_blocks_match_all_edits(spark, monkeypatch):
    """Words of two letters, so that every unit is hot and grams repeat, in blocks of 8; forms in long chains."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(3, 9))) for _ in range(250)})
    docs = [(i, " ".join([w] * r.choice([1, 2, 3, 4, 6, 9, 20, 41, 90, 200]))) for i, w in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(spelling.spelling_groups(df, least=3, fewest=2, times=1.5)) == plain(docs, 3, 2, 1.5, 0)


def test_chain_of_forms(spark):
    """Each word's form is the next one; all end in the last."""
    words = ["a" * i + "b" * (12 - i) for i in range(12)]
    df = spark.createDataFrame([(i, " ".join([w] * 2**i)) for i, w in enumerate(words)], "doc_id long, text string")
    assert {r.root for r in spelling.spelling_groups(df, fewest=1).collect()} == {words[-1]}


def test_one_edit():
    r = random.Random(7)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(2))
        assert spelling.within_one_edit(a, b) == (a != b and b in set(edits(a, "ab")))


def test_merge_matches_counting():
    r = random.Random(9)
    for _ in range(500):
        lists = [sorted(r.sample(range(40), r.randint(1, 20))) for _ in range(r.randint(1, 12))]
        least = r.randint(1, 8)
        n = Counter(x for y in lists for x in y)
        assert spelling.merged(lists, least) == sorted(x for x, c in n.items() if c >= least)


def test_edge_cases(spark):
    """Nulls, empty and long texts, repeated rows, no words, capitals outside ASCII, clashing names, an empty table, wrong bounds."""
    long = " ".join(["parallel", "paralel", "\u00c9cole", "\u00e9cole"] * 5000) + " " + "x" * 50_000
    docs = [(1, None), (2, ""), (3, "12 34 !?"), (4, long), (4, long), (None, "Parallel parallels"), (5, "PARALLELS parallels d\u00e9j\u00e0vu d\u00e9j\u00e0vu d\u00e9javu \u0161koda \u65e5\u672c"), (6, "y" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "word", "n", "gram", "size", "home", "rarest", "form", "root", "t", "q")})
    for every in (0, 2, 97):
        assert found(spelling.spelling_groups(df, fewest=1, every=every)) == plain(docs, 5, 1, 2, every)
    assert spelling.spelling_groups(df.limit(0)).count() == 0
    assert spelling.spelling_groups(df.filter("doc_id < 4")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, least=2)


def test_tables_that_grow_are_not_broadcast(spark):
    """Words compressed to less than Spark's limit once filled the driver's memory as a broadcast."""
    df = spark.createDataFrame([(1, "parallel paralel " * 5)], "doc_id long, text string")
    groups = spelling.spelling_groups(df, fewest=1)
    units = in_units(spark.range(20).selectExpr("id % 3 AS g", "id"), ["g"], "id", F.lit(True), 4)
    for found in (groups, units):
        assert found.count() and found.collect()
        assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
