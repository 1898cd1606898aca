import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.operators import metrics, ranks

ATOMS = "record_id long, dx double, dy double, dz double"
STRUCTURES = "record_id long, group_id string, energy_target double, energy_predicted double"


def golden(spark):
    structures = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "a", 0.0, 2.0)], STRUCTURES)
    atoms = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], ATOMS)
    return structures, atoms


def test_golden_overall(spark):
    r = metrics.overall_metrics(*golden(spark), 1.5).first()
    assert (r.n_structures, r.n_atoms) == (2, 2)
    assert r.energy_mae == pytest.approx(1.5)
    assert r.force_mae == pytest.approx(0.5)
    assert r.force_rmse == pytest.approx((5 / 6) ** 0.5)
    assert r.force_p95 == pytest.approx(1.95)
    assert r.high_error_fraction == pytest.approx(0.5)


def test_small_groups_are_suppressed(spark):
    structures = spark.createDataFrame([(i, "bulk", 0.0, float(i)) for i in (1, 2, 3)] + [(4, "solo", 0.0, 99.0)], STRUCTURES)
    atoms = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(1, 5)], ATOMS)
    rows = metrics.grouped_metrics(structures, atoms, 1.0).collect()
    assert [(r.group_id, r.n_structures, r.energy_mae) for r in rows] == [("bulk", 3, 2.0)]
    assert tuple(metrics.suppressed(structures, atoms).first()) == (1, 1)


def test_order_and_partitions_change_nothing(spark):
    s, a = golden(spark)
    assert metrics.overall_metrics(s.repartition(3), a.repartition(4), 1.5).first() == metrics.overall_metrics(s, a, 1.5).first()


@pytest.mark.parametrize("n", [1, 2, 7, 500])
@pytest.mark.parametrize("large", [0, 40])
def test_percentiles(spark, n, large, monkeypatch):
    """Overall and by group, whether a group is one aggregate or ranges of several partitions; many values are equal."""
    monkeypatch.setattr(ranks, "LARGE", large)
    r = random.Random(n)
    rows = [(i % 3 // 2, r.choice([r.random(), 0.5, float(r.randint(0, 3))])) for i in range(n)]
    df = spark.createDataFrame([*rows, (0, None)], "g int, x double")
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = ranks.percentiles(df, [], "x", shares).first()
    assert list(got) == pytest.approx([float(np.percentile([v for _, v in rows], q * 100)) for q in shares.values()])
    for x in ranks.percentiles(df, ["g"], "x", shares).collect():
        assert list(x)[1:] == pytest.approx([float(np.percentile([v for g, v in rows if g == x.g], q * 100)) for q in shares.values()])


def test_numbers_and_tops_span_partitions(spark):
    r = random.Random(6)
    rows = [(i, r.randint(0, 4), r.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g int, s int").repartition(7)
    places = {x.k: x.place for x in ranks.numbered(df, ["g"], ["s", "k"]).collect()}
    for g in range(5):
        assert [places[k] for s, k in sorted((s, k) for k, h, s in rows if h == g)] == list(range(sum(h == g for _, h, _ in rows)))
    for k in (0, 1, 100, 300, 400):
        want = {i for i, _, s in sorted(rows, key=lambda x: (-x[2], x[0]))[:k]}
        got = {x.k for x in ranks.top(df, F.col("s"), "k", k).collect()}
        assert got == want


def test_empty_inputs(spark):
    s, a = (df.limit(0) for df in golden(spark))
    assert ranks.percentiles(a, [], "dx", {"p": 0.95}).first().p is None
    assert metrics.grouped_metrics(s, a, 1.0).count() == 0
    assert metrics.overall_metrics(s, a, 1.0).first().n_structures == 0


def test_coverage_names_the_side(spark):
    p, t = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert {tuple(r) for r in metrics.coverage(p, t, "k").collect()} == {(1, "unknown"), (3, "missing")}


def test_rerun_delta(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k long, v double")
    assert tuple(metrics.rerun_delta(a, a).first()) == (0.0, 0)
    assert tuple(metrics.rerun_delta(a, a.limit(1)).first()) == (1.0, 1)


def test_large_groups_are_not_sorted_by_ranges(spark, monkeypatch):
    """A group above LARGE gets its exact percentiles from bounds and counts; rows aren't shuffled by value."""
    monkeypatch.setattr(ranks, "LARGE", 100)
    monkeypatch.setattr(ranks, "_ranked", None)
    got = ranks.percentiles(spark.range(10_001).selectExpr("cast(id % 5000 AS double) AS x"), [], "x", {"half": 0.5, "most": 0.95}).first()
    want = np.percentile(np.arange(10_001) % 5000, [50, 95])
    assert abs(got.half - want[0]) < 1e-9 and abs(got.most - want[1]) < 1e-9
