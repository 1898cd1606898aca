"""Geometry of a structure inside its row: arrays and higher-order functions, no exploded pairs and no shuffle.

A structure is symbols array<string>, positions array<array<double>>, cell array<array<double>>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.scalars import determinant3, euclid, norm


def strict_zip(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Pairs of two arrays; null unless they are equally long (arrays_zip alone would pad)."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1]))))


def shape_problems(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose arrays don't have the shapes n x 3 and 3 x 3, with what is wrong; null arrays are wrong too."""
    n = F.size("symbols")
    rules = {
        "no_atoms": F.coalesce(n < 1, F.lit(True)),
        "positions": ~F.coalesce((F.size("positions") == n) & F.forall("positions", lambda p: F.size(p) == 3), F.lit(False)),
        "cell": ~F.coalesce((F.size("cell") == 3) & F.forall("cell", lambda p: F.size(p) == 3), F.lit(False)),
    }
    wrong = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return rows.select(key, wrong.alias("problems")).filter(F.size("problems") > 0)


def nearest_distances(positions: Column) -> Column:
    """For each atom the distance to the nearest other one; 0 for a lone atom."""
    others = lambda p, i: F.transform(positions, lambda q, j: F.when(j != i, euclid(p, q)))
    return F.transform(positions, lambda p, i: F.coalesce(F.array_min(others(p, i)), F.lit(0.0)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def nearest_periodic(positions: Column, cell: Column) -> Column:
    """As nearest_distances under the minimum-image rule of an orthorhombic cell."""
    fold = lambda d, k: d - cell[k][k] * F.rint(d / cell[k][k])
    apart = lambda p, q: F.sqrt(sum((fold(p[k] - q[k], k) * fold(p[k] - q[k], k) for k in range(3)), F.lit(0.0)))
    others = lambda p, i: F.filter(F.transform(positions, lambda q, j: F.when(j != i, apart(p, q))), lambda d: d.isNotNull())
    return F.transform(positions, lambda p, i: F.coalesce(F.array_min(others(p, i)), F.lit(float("inf"))))


def too_close(rows: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Structures with two atoms nearer than least; a lone atom has no pair."""
    return rows.select(key, F.array_min(nearest_periodic(F.col("positions"), F.col("cell"))).alias("nearest")).filter(F.col("nearest") < least)


def orthorhombic(cell: Column, within: float = 1e-8) -> Column:
    off = F.flatten(F.transform(cell, lambda row, i: F.filter(F.transform(row, lambda x, j: F.when(i != j, F.abs(x))), lambda x: x.isNotNull())))
    return F.forall(off, lambda x: x <= within)


def composition(symbols: Column) -> Column:
    """Symbol=count in symbol order."""
    kinds = F.array_sort(F.array_distinct(symbols))
    return F.array_join(F.transform(kinds, lambda s: F.concat_ws("=", s, F.size(F.filter(symbols, lambda x: x == s)))), ",")


def cluster_key(digits: int = 1) -> Column:
    """A hash of coarse, order-free geometry: composition, volume per atom, nearest distances' mean and deviation, cell lengths.

    Labels and ids are no part of it. Bins are rounded half away from zero in fixed text.
    """
    n = F.size("symbols")
    sum_of = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda s, x: s + of(x))
    both = lambda near, mean: F.concat_ws("|", text(mean), text(F.sqrt(sum_of(near, lambda x: (x - mean) * (x - mean)) / n)))
    text = lambda x: F.format_string(f"%.{digits}f", F.round(x, digits))
    spread = once(nearest_distances(F.col("positions")), lambda near: once(sum_of(near, lambda x: x) / n, lambda mean: both(near, mean)))
    lengths = F.array_join(F.transform(F.array_sort(F.transform("cell", norm)), text), ",")
    parts = F.concat_ws("|", composition(F.col("symbols")), n, text(F.abs(determinant3(F.col("cell"))) / n), spread, lengths)
    return F.concat(F.lit("geometry-"), F.substring(F.sha2(parts, 256), 1, 20))


def lattice(spark, a: float, repeats: tuple[int, int, int], copies: int, largest: float, seed: int) -> DataFrame:
    """copies of a face-centred cubic block, each atom moved by seeded noise whose size rises from 0 to largest.

    place numbers the atoms of a copy. The noise is a function of seed, copy, atom and axis alone, so any
    partitioning gives the same structures.
    """
    nx, ny, nz = repeats
    base = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
    per = len(base) * nx * ny * nz
    atoms = spark.range(copies * per).select(F.floor(F.col("id") / per).alias("copy"), (F.col("id") % per).alias("place"))
    cell = F.floor(F.col("place") / 4)
    offset = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in base)), (F.col("place") % 4 + 1).cast("int"))
    corner = (F.floor(cell / (ny * nz)), F.floor(cell / nz) % ny, cell % nz)
    unit = lambda k, n: (F.conv(F.substring(F.sha2(F.concat_ws("~", F.lit(str(seed)), "copy", "place", F.lit(str(k)), F.lit(str(n))), 256), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    normal = lambda k: F.sqrt(-2 * F.ln(unit(k, 0))) * F.cos(2 * F.pi() * unit(k, 1))
    size = F.lit(largest) * F.col("copy") / max(1, copies - 1)
    return atoms.select("copy", "place", *(((corner[k] + offset[k]) * a + normal(k) * size).alias(axis) for k, axis in enumerate("xyz")))


def pair_energy(positions: Column, epsilon: float, sigma: float) -> Column:
    """Lennard-Jones energy over all pairs of a structure's atoms, each once."""
    r6 = lambda d: F.pow(F.lit(sigma) / d, 6.0)
    per_atom = F.transform(positions, lambda p, i: F.aggregate(F.transform(positions, lambda q, j: F.when(j > i, 4 * epsilon * (r6(euclid(p, q)) * r6(euclid(p, q)) - r6(euclid(p, q)))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(per_atom, F.lit(0.0), lambda s, x: s + x)
