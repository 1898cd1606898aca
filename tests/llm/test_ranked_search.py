"""Ranked search against SQL and against plain scoring; its treaps and its edge cases."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.llm import queries, ranked_search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, id, score) by scoring every document for every item."""
    counted = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for x, f in df.items()}
    out = []
    for item, text in items:
        asked, found = set(terms(text)), []
        for i, t in counted:
            m = 50 + 50 * len(t) * n_docs // n_terms
            score = sum(w[x] * (1000000000 * f // (1000 * f + 20 * m)) for x in asked if (f := t.count(x)))
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_ranked_search"]).fetchall()
    got = queries.op12_ranked_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == sorted(want, key=str)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_small_shards_match_plain_scoring(spark, monkeypatch, k):
    """Copies with equal scores, terms in every document, several shards and blocks of items, few intervals at a time."""
    for name, value in (("SHARD", 16), ("ITEMS", 3), ("OPENED", 4)):
        monkeypatch.setattr(ranked_search, name, value)
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    p = 1 / np.arange(1, 41)
    docs = [(i, " ".join(random.choice(words, random.integers(1, 60), p=p / p.sum()))) for i in range(150)]
    docs += [(200 + i, docs[i % 3][1]) for i in range(60)]
    items = [(f"q{i}", " ".join(random.choice(words, 8))) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ranked_search.search(df, spark.createDataFrame(items, "item_id string, text string"), k=k)
    assert found(got) == plain(docs, items, k)


def test_treaps_keep_both_orders():
    random = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        impacts = random.integers(0, 5, n)
        left, right, root = ranked_search.treap(impacts)
        seen, depth = [], 0

        def walk(i, d):
            nonlocal depth
            if i >= 0:
                depth = max(depth, d)
                assert all(impacts[c] <= impacts[i] for c in (left[i], right[i]) if c >= 0)
                walk(left[i], d + 1)
                seen.append(i)
                walk(right[i], d + 1)

        walk(root, 1)
        assert seen == list(range(n)) and depth <= 12 * math.log2(n + 1)


def test_search_opens_a_part_of_the_documents(monkeypatch):
    """Where few documents can enter the k best, the subtrees of the others are never opened."""
    n = 20_000
    impacts = np.full(n, 10)
    impacts[::1000] = np.arange(20) + 100
    built = ranked_search.Treaps([(np.arange(n, dtype="<i4").tobytes(), impacts.astype("<i4").tobytes(), *(x.tobytes() for x in ranked_search.treap(impacts)[:2]), ranked_search.treap(impacts)[2])] * 2)
    asked = []
    within = ranked_search.Treaps.within
    monkeypatch.setattr(ranked_search.Treaps, "within", lambda self, nodes, low, high: asked.append(nodes.shape[1]) or within(self, nodes, low, high))
    places, scores = built.search(np.array([0, 1]), np.array([1, 2]), n, 10)
    assert places.tolist() == [i * 1000 for i in range(19, 9, -1)] and scores.tolist() == [3 * (100 + i) for i in range(19, 9, -1)]
    assert sum(asked) < 200


def test_edge_cases(spark):
    """Null and empty texts, ids that are null, repeated or text, ties, long texts, empty tables, clashing columns."""
    long = " ".join(f"w{i % 5000} rare{i % 7}" for i in range(60_000))
    docs = [(1, "Alpha beta-GAMMA"), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, "\u00c4pfel \u65e5\u672c\u8a9e alpha"), (None, "alpha beta gamma"), (6, long), (7, "\x00\t!?")]
    items = [(1, "ALPHA gamma"), (2, None), (3, ""), (4, "\u00c4PFEL \u65e5\u672c\u8a9e"), (4, "rare3 w77"), (None, "beta"), (5, "unheard"), (6, "!?")]
    clashing = ("id", "term", "terms", "n", "tfs", "shard", "rank", "score", "item", "item_row", "w", "df", "asked", "block")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in clashing})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in clashing})
    assert found(ranked_search.search(d, q)) == plain(docs, items, 50)
    assert ranked_search.search(d.limit(0), q).count() == 0
    assert ranked_search.search(d, q.limit(0)).count() == 0
    named = ranked_search.search(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), q)
    assert found(named.filter("item_id = 1").select("doc_id"))[:1] == [("d1",)]
