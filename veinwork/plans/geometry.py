"""Geometry: an order's line items are the atoms of a structure, in the order of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import periodic, structures
from veinwork.plans.registry import query
from veinwork.sources import exports
from veinwork.sources.tables import table


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: an atom is one row of a group of a few, so the list stays small."""
    atom = F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(atom)).alias("a"))
    positions = F.transform("a", lambda x: F.array(x["l_quantity"], x["l_discount"] * 100, x["l_tax"] * 100))
    cell = F.array(*(F.array(*(F.lit(60.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    return grouped.select("l_orderkey", F.transform("a", lambda x: x["l_returnflag"]).alias("symbols"), positions.alias("positions"), cell.alias("cell"))


ATOMS = """
    WITH a AS (SELECT l_orderkey, l_returnflag AS s, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_tax) AS i FROM lineitem),
    n AS (SELECT l_orderkey, count(*) AS n_atoms FROM a GROUP BY 1),
    d AS (SELECT p.l_orderkey, p.i, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS d
          FROM a p JOIN a q ON p.l_orderkey = q.l_orderkey AND p.i != q.i GROUP BY 1, 2)
"""


@query(
    f"""{ATOMS} SELECT n.l_orderkey, n_atoms::INTEGER AS n_atoms, round(coalesce(min(d), 0), 6) AS nearest, round(coalesce(avg(d), 0), 6) AS mean_nearest
    FROM n LEFT JOIN d USING (l_orderkey) GROUP BY 1, 2"""
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir).select("l_orderkey", F.size("symbols").alias("n_atoms"), structures.nearest_distances(F.col("positions")).alias("d"))
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("n_atoms")
    return s.select("l_orderkey", "n_atoms", F.round(F.array_min("d"), 6).alias("nearest"), F.round(mean, 6).alias("mean_nearest"))


@query(
    """WITH a AS (SELECT l_orderkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_tax) AS i FROM lineitem),
    d AS (SELECT p.l_orderkey, min(sqrt((p.x - q.x - 60 * round((p.x - q.x) / 60)) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS nearest
          FROM a p JOIN a q ON p.l_orderkey = q.l_orderkey AND p.i != q.i GROUP BY 1)
    SELECT l_orderkey, round(nearest, 6) AS nearest FROM d WHERE nearest < 3.4567"""
)
def too_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.too_close(_structures(spark, sf_dir), "l_orderkey", 3.4567).withColumn("nearest", F.round("nearest", 6))


@query(
    """SELECT l_orderkey, string_agg(s || '=' || c, ',' ORDER BY s) AS composition FROM (SELECT l_orderkey, l_returnflag AS s, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structures(spark, sf_dir).select("l_orderkey", structures.composition(F.col("symbols")).alias("composition"))


@query()
def geometry_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many structures share a coarse geometry; tests hold the key against a re-derivation."""
    return _structures(spark, sf_dir).select(structures.cluster_key().alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


@query(
    """WITH i AS (SELECT unnest(range(160)) AS id), p AS (SELECT id // 32 AS copy, id % 32 AS place FROM i),
    q AS (SELECT copy, place, place // 4 AS c, place % 4 AS b FROM p),
    g AS (SELECT copy, place, ax, [c // 4, c // 2 % 2, c % 2][ax + 1] AS corner,
          [[0e0, 0e0, 0e0], [0e0, 0.5e0, 0.5e0], [0.5e0, 0e0, 0.5e0], [0.5e0, 0.5e0, 0e0]][b + 1][ax + 1] AS off,
          (CAST('0x' || substr(sha256('7~' || copy || '~' || place || '~' || ax || '~0'), 1, 12) AS BIGINT) + 1) / 281474976710657e0 AS u,
          (CAST('0x' || substr(sha256('7~' || copy || '~' || place || '~' || ax || '~1'), 1, 12) AS BIGINT) + 1) / 281474976710657e0 AS v
          FROM q, (SELECT unnest([0, 1, 2]) AS ax)),
    r AS (SELECT copy, place, ax, round((corner + off) * 3.6e0 + sqrt(-2 * ln(u)) * cos(2 * pi() * v) * 0.1e0 * copy / 4, 6) AS w FROM g)
    SELECT copy, place, max(w) FILTER (WHERE ax = 0) AS x, max(w) FILTER (WHERE ax = 1) AS y, max(w) FILTER (WHERE ax = 2) AS z FROM r GROUP BY 1, 2"""
)
def lattice_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = structures.lattice(spark, 3.6, (2, 2, 2), 5, 0.1, 7)
    return points.withColumns({c: F.round(c, 6) for c in "xyz"})


@query(
    """WITH a AS (SELECT l_orderkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_tax) AS i FROM lineitem),
    p AS (SELECT p.l_orderkey, (2.5e0 / sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) ** 6 AS r FROM a p JOIN a q ON p.l_orderkey = q.l_orderkey AND p.i < q.i
          WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) > 0),
    bad AS (SELECT DISTINCT p.l_orderkey FROM a p JOIN a q ON p.l_orderkey = q.l_orderkey AND p.i < q.i WHERE p.x = q.x AND p.y = q.y AND p.z = q.z)
    SELECT n.l_orderkey, round(coalesce(sum(0.4e0 * (r * r - r)), 0), 4) + 0e0 AS energy FROM (SELECT DISTINCT l_orderkey FROM lineitem) n LEFT JOIN p USING (l_orderkey)
    WHERE n.l_orderkey NOT IN (SELECT l_orderkey FROM bad) GROUP BY 1 HAVING abs(coalesce(sum(0.4e0 * (r * r - r)), 0)) < 1e6"""
)
def pair_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures without coinciding atoms and with an energy that isn't absurd."""
    s = _structures(spark, sf_dir).filter((F.size("positions") == 1) | (F.array_min(structures.nearest_distances(F.col("positions"))) > 0))
    e = s.select("l_orderkey", structures.pair_energy(F.col("positions"), 0.1, 2.5).alias("energy")).filter(F.abs("energy") < 1e6)
    return e.withColumn("energy", F.round("energy", 4) + 0.0)


@query("SELECT p_partkey, sha256(printf('&SYSTEM' || chr(10) || '  nat = %d' || chr(10) || '  ntyp = %d' || chr(10) || '  ecutwfc = %.4f' || chr(10) || '  ecutrho = %.4f' || chr(10) || '/', p_size, p_size % 3 + 1, p_retailprice, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 8 ELSE p_retailprice * 4 END)) AS deck_sha256 FROM part")
def plane_wave_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rho = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 8)
    rows = p.select("p_partkey", F.col("p_size").alias("nat"), (F.col("p_size") % 3 + 1).alias("ntyp"), F.col("p_retailprice").alias("ecutwfc"), rho.alias("ecutrho"))
    return exports.pw_input(rows, "p_partkey").select("p_partkey", F.sha2("text", 256).alias("deck_sha256"))


@query("SELECT l_returnflag AS symbol, row_number() OVER (ORDER BY l_returnflag)::INTEGER AS number FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def species_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.species_numbers(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol")), "symbol")


@query(
    """WITH a AS (SELECT l_orderkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_tax) AS i FROM lineitem),
    f AS (SELECT l_orderkey, i, z / 7 AS w, (y - z / 7) / 8 AS v, (x - 3 * ((y - z / 7) / 8) - 2 * (z / 7)) / 9 AS u FROM a),
    g AS (SELECT l_orderkey, i, u - floor(u) AS u, v - floor(v) AS v, w - floor(w) AS w FROM f),
    s AS (SELECT unnest([-1, 0, 1]) AS s),
    d AS (SELECT p.l_orderkey, q.u - p.u + a.s AS u, q.v - p.v + b.s AS v, q.w - p.w + c.s AS w FROM g p JOIN g q ON p.l_orderkey = q.l_orderkey AND p.i < q.i, s a, s b, s c),
    e AS (SELECT l_orderkey, sqrt((9 * u + 3 * v + 2 * w) ** 2 + (8 * v + w) ** 2 + (7 * w) ** 2) AS distance FROM d)
    SELECT l_orderkey, count(*) AS n_pairs, round(min(distance), 6) AS nearest FROM e WHERE distance < 2.3456 GROUP BY 1"""
)
def close_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same atoms in a small skewed cell: pairs that are near by an image."""
    cell = F.array(*(F.array(*map(F.lit, r)) for r in ((9.0, 0.0, 0.0), (3.0, 8.0, 0.0), (2.0, 1.0, 7.0))))
    found = periodic.too_close(_structures(spark, sf_dir).withColumn("cell", cell), "l_orderkey", 2.3456)
    return found.withColumn("nearest", F.round("nearest", 6))
