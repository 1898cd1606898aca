"""Near pairs of atoms in periodic cells of any shape and size, found through a grid of bins and not among all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a block, a side: the atoms of a block and of the bins around it are compared with each other.
BLOCK = 4


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def atoms_of(structures: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tables of atoms (key, atom, position) and cells (key, cell, pbc) of structures with positions, cell and, if it is there, pbc."""
    pbc = F.col("pbc") if "pbc" in structures.columns else F.array(*[F.lit(True)] * 3)
    return structures.select(key, F.posexplode("positions").alias("atom", "position")), structures.select(key, "cell", pbc.alias("pbc"))


def close_pairs(atoms: DataFrame, cells: DataFrame, key: str, least: float) -> DataFrame:
    """key, i, j, shift, distance: every pair of atoms, or of an atom and an image, nearer than least; j stands in the cell that lies shift cells away.

    The images of a lattice that can be that near are those of the bins around an atom's own: a bin is least wide or wider between the lattice planes, in
    a cell of any shape, and a cell that is thinner than that is looked at as many cells away as its thickness asks for. An atom goes to each block
    of BLOCK bins a side that the bins around it lie in, which is its own alone in a small cell, and is joined there with the block's atoms on (key, block):
    a structure of any size spreads over tasks. The shifts that bring a pair into bins side by side are made from the joined pair, so no image is shuffled.
    A pair comes out once for each of its images (i < j, or i = j and a positive shift). Cells without a volume have no pairs.
    """
    row = [[F.col("cell")[i][k].cast("double") for k in range(3)] for i in range(3)]
    area = [_cross(row[1], row[2]), _cross(row[2], row[0]), _cross(row[0], row[1])]
    volume = _dot(row[0], area[0])
    height = [F.abs(volume) / F.sqrt(_dot(a, a)) for a in area]
    bins = [F.greatest(F.lit(1), F.floor(h / least).cast("int")) for h in height]
    reach = [F.when(n == 1, F.ceil(F.lit(least) / h).cast("int")).otherwise(1) for n, h in zip(bins, height, strict=True)]
    shaped = cells.filter(volume != 0).select(
        key, "cell", F.col("pbc").alias("_pbc"), F.array(*bins).alias("_n"),
        F.array(*(F.when(F.col("pbc")[k] | (bins[k] > 1), reach[k]).otherwise(1) for k in range(3))).alias("_reach"),
        F.array(*(F.array(*(area[k][j] / volume for j in range(3))) for k in range(3))).alias("_inverse"),
    )
    joined = atoms.join(shaped, key)
    position = [F.col("position")[k].cast("double") for k in range(3)]
    fraction = [_dot(position, [F.col("_inverse")[k][j] for j in range(3)]) for k in range(3)]
    inside = [f - F.floor(f) for f in fraction]
    inside = [F.when(~F.col("_pbc")[k], fraction[k]).when(inside[k] >= 1, 0.0).otherwise(inside[k]) for k in range(3)]
    placed = joined.select(key, "atom", "cell", "_pbc", "_n", "_reach", *(inside[k].alias(f"_u{k}") for k in range(3)))
    binned = placed.select("*", *(F.floor(F.col(f"_u{k}") * F.col("_n")[k]).cast("long").alias(f"_b{k}") for k in range(3)))

    block = lambda b: F.floor(b / BLOCK).cast("long")
    around = binned
    for k in range(3):
        b, n, reach = F.col(f"_b{k}"), F.col("_n")[k], F.col("_reach")[k]
        near = F.sequence(b - reach, b + reach)
        blocks = F.array_distinct(F.when(F.col("_pbc")[k], F.transform(near, lambda x: block(F.pmod(x, n)))).otherwise(F.transform(near, block)))  # noqa: B023
        around = around.withColumn(f"_t{k}", F.explode(F.when(F.col("_pbc")[k] & (n <= BLOCK), F.array(F.lit(0).cast("long"))).otherwise(blocks)))
    asking = around.select(F.col(key).alias("_key"), F.col("atom").alias("i"), "cell", "_pbc", "_n", "_reach", *(f"_t{k}" for k in range(3)), *(F.col(f"_b{k}").alias(f"_a{k}") for k in range(3)), *(F.col(f"_u{k}").alias(f"_v{k}") for k in range(3)))
    there = binned.select(key, F.col("atom").alias("j"), *(block(F.col(f"_b{k}")).alias(f"_block{k}") for k in range(3)), *(f"_b{k}" for k in range(3)), *(f"_u{k}" for k in range(3)))
    met = asking["_key"] == there[key]
    for k in range(3):
        met = met & (asking[f"_t{k}"] == there[f"_block{k}"])
    pairs = asking.join(there, met & (F.col("i") <= F.col("j")))
    for k in range(3):  # shifts s with bin a - reach <= b + s * n <= a + reach
        a, b, n, reach = F.col(f"_a{k}"), F.col(f"_b{k}"), F.col("_n")[k], F.col("_reach")[k]
        low, high = -F.floor((b + reach - a) / n), F.floor((a + reach - b) / n)
        none = F.array().cast("array<int>")
        periodic = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(none)
        still = F.when(F.abs(a - b) <= reach, F.array(F.lit(0))).otherwise(none)
        pairs = pairs.withColumn(f"_s{k}", F.explode(F.when(F.col("_pbc")[k], periodic).otherwise(still)))
    shift = F.array(*(F.col(f"_s{k}") for k in range(3)))
    pairs = pairs.filter((F.col("i") < F.col("j")) | (shift > F.array(*[F.lit(0)] * 3)))
    between = [F.col(f"_u{k}") + F.col(f"_s{k}") - F.col(f"_v{k}") for k in range(3)]
    apart = [_dot(between, [F.col("cell")[k][j].cast("double") for k in range(3)]) for j in range(3)]
    return pairs.select(key, "i", "j", shift.alias("shift"), F.sqrt(_dot(apart, apart)).alias("distance")).filter(F.col("distance") < least)


def too_close(structures: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Structures with two atoms nearer than least, images counted: how many such pairs there are and the smallest distance."""
    found = close_pairs(*atoms_of(structures, key), key, least)
    return found.groupBy(key).agg(F.count("*").alias("n_pairs"), F.min("distance").alias("nearest"))
