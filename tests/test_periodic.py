"""Near pairs in cells of any shape against all images of all pairs."""

import itertools
import math

import numpy as np

from veinwork.operators import periodic


def plain(positions, cell, pbc, least):
    """(i, j, shift) -> distance of every pair of images within least; as many cells away as the thinnest direction asks for."""
    inverse = np.linalg.inv(cell)
    heights = 1 / np.linalg.norm(inverse, axis=0)
    f = positions @ inverse
    f = np.where(pbc, f - np.floor(f), f)
    reach = [range(-n, n + 1) if p else range(1) for n, p in zip((math.ceil(least / h) + 1 for h in heights), pbc)]
    out = {}
    for s in itertools.product(*reach):
        for i in range(len(f)):
            for j in range(i, len(f)):
                if i < j or s > (0, 0, 0):
                    d = float(np.linalg.norm((f[j] + s - f[i]) @ cell))
                    if d < least:
                        out[i, j, s] = d
    return out


def test_random_cells_match_all_images(spark):
    """500 cells, some skewed strongly, some thinner than the distance, some open on a side."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(500):
        cell = r.normal(size=(3, 3)) * r.choice([1.0, 3.0, 8.0]) + np.diag(r.uniform(0.5, 4, 3))
        if k % 5 == 0:
            cell[1] = cell[0] * r.integers(1, 4) + r.normal(size=3) * 0.8
        while 1 / np.linalg.norm(np.linalg.inv(cell), axis=0).max() < 0.2:
            cell = cell + np.diag(r.uniform(0.5, 1, 3))
        pbc = [bool(x) for x in (r.random(3) < 0.8)]
        positions = r.uniform(-6, 6, size=(r.integers(1, 7), 3))
        rows.append((k, positions.tolist(), cell.tolist(), pbc))
        want |= {(k, *x): d for x, d in plain(positions, cell, np.array(pbc), 1.1).items()}
    df = spark.createDataFrame(rows, "k int, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>")
    found = periodic.close_pairs(*periodic.atoms_of(df, "k"), "k", 1.1).collect()
    got = {(x.k, x.i, x.j, tuple(x.shift)): x.distance for x in found}
    assert len(got) == len(found) and len(got) > 500
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_a_skewed_cell_with_a_pair_near_by_an_image(spark):
    cell = [[10.0, 0.0, 0.0], [9.0, 3.0, 0.0], [0.0, 0.0, 10.0]]
    rows = [(1, [[0.1, 0.1, 5.0], [0.9, 2.9, 5.0]], cell), (2, [[0.0, 0.0, 0.0]], cell), (3, [[0.0, 0.0, 0.0]], [[0.4, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]), (4, [[0.0] * 3] * 2, [[0.0] * 3] * 3)]
    df = spark.createDataFrame(rows, "k int, positions array<array<double>>, cell array<array<double>>")
    got = {x.k: (x.n_pairs, round(x.nearest, 6)) for x in periodic.too_close(df, "k", 2.0).collect()}
    assert got[1] == (1, round(math.hypot(1.8, 0.2), 6)) and got[3] == (4, 0.4) and 2 not in got and 4 not in got


def test_pairs_are_joined_on_bins(spark):
    """A structure of 20,000 atoms on a line: the join is on the bin, and its pairs are a few for each atom."""
    atoms = spark.range(20_000).selectExpr("cast(id div 1000000 + 1 AS int) AS k", "cast(id AS int) AS atom", "array(id * 0.4D, 0D, 0D) AS position")
    cells = spark.createDataFrame([(1, [[8000.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]], [True] * 3)], "k int, cell array<array<double>>, pbc array<boolean>")
    found = periodic.close_pairs(atoms, cells, "k", 0.5)
    assert found.count() == 20_000  # each with the next, the last with the first
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_images_are_not_shuffled(spark):
    """Pairs at several blocks' distance of their cell's edges are found, and an atom of a small cell is sent once and not once for each bin around it."""
    atoms = spark.range(200).selectExpr("1 AS k", "cast(id AS int) AS atom", "array(id * 0.4D, id % 7 * 4D, 0D) AS position")
    cells = spark.createDataFrame([(1, [[80.0, 0.0, 0.0], [0.0, 28.0, 0.0], [0.0, 0.0, 6.0]], [True] * 3)], "k int, cell array<array<double>>, pbc array<boolean>")
    positions = np.array([[i * 0.4, i % 7 * 4.0, 0.0] for i in range(200)])
    want = plain(positions, np.diag([80.0, 28.0, 6.0]), np.array([True] * 3), 4.5)
    got = {(x.i, x.j, tuple(x.shift)): x.distance for x in periodic.close_pairs(atoms, cells, "k", 4.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)
    small = spark.createDataFrame([(1, [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]], [True] * 3)], "k int, cell array<array<double>>, pbc array<boolean>")
    plan = periodic.close_pairs(atoms, small, "k", 2.5)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan()
    assert "Generate" in text.toString()
    before = text.toString().split("+- == Initial Plan ==")[0]
    assert before.index("Generate explode(CASE WHEN") < before.index("Join")  # the shifts are made above the join
