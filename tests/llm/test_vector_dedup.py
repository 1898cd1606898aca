"""Vector near-dedup against all pairs, and its edge cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.llm import queries, vector_dedup


def all_pairs(rows, threshold=0.98):
    """(n_links, component) of each row(id, vector, label) by comparing all pairs in doubles."""
    good, links, parent = {}, {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (name, v, label) in enumerate(rows):
        if name is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append(i)
    for members in good.values():
        x = np.array([rows[i][1] for i in members], dtype=float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x**2).sum(axis=1))[:, None]
        for a, b in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_all_pairs(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    got = queries.op11_vector_dedup(spark, f"/root/testdata/{sf}")
    assert found(got) == all_pairs(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_many_lists_and_blocks_lose_no_link(spark, monkeypatch):
    """Chains and balls of near vectors across lists, a hot group of copies and a hot group of different near vectors, in blocks of 64."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "LISTS", 1.5)
    random = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = random.normal(size=16)
        rows.append((len(rows), v.tolist(), i % 2))
        for step in range(i % 4):  # a chain of small turns, most of them in one coordinate only
            v = v + np.where(np.arange(16) == step, 0.17 * np.linalg.norm(v), 0)
            rows.append((len(rows), v.tolist(), i % 2))
    hot = random.normal(size=16)
    rows += [(len(rows) + i, (hot * (1 + i % 3)).tolist(), 1) for i in range(300)]
    rows += [(len(rows) + i, (hot[::-1] + random.normal(size=16) * 0.1).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert found(vector_dedup.vector_components(df, fitted=400)) == all_pairs(rows)


def test_edge_cases(spark):
    """Bad vectors link with nothing; copies, scaled copies, other lengths and labels; ids that are null, repeated or text; clashing names."""
    v = [0.5, 1.0, -2.0]
    rows = [(1, v, 1), (2, v, 1), (2, [x * 7 for x in v], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 0.0], 1)]
    rows += [(10, [1.0, float("inf"), 0.0], 1), (11, [*v, 0.0], 1), (None, v, 1), (12, [-x for x in v], 1), (13, [1e30 * x for x in v], 1), (14, [1e-30 * x for x in v], 1), (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "vec", "key", "number", "own", "t", "q", "target", "a", "b", "links", "l", "k", "component", "list", "vector", "width")})
    assert found(vector_dedup.vector_components(df)) == all_pairs(rows)
    assert vector_dedup.vector_components(df.limit(0)).count() == 0
    assert found(vector_dedup.vector_components(df.filter("vec_id IN (5, 6)"))) == [(5, 0, 5), (6, 0, 6)]
    named = vector_dedup.vector_components(df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")).withColumn("label", F.col("label").cast("string")))
    assert {r.vec_id: r.component_id for r in named.collect()}["v2"] == "v1"
    with pytest.raises(ValueError):
        vector_dedup.vector_components(df, threshold=0)
