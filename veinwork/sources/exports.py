"""Text exports: structures with labels, data files, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.operators.ranks import numbered


def xyz_lines(structures: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """key, n_atoms, text: one extended-XYZ frame per structure, fixed decimals, atoms in their order.

    structures: key, energy. atoms: key, place, symbol, x, y, z, fx, fy, fz. A structure's atoms are one row of text.
    """
    line = F.format_string("%s %.10f %.10f %.10f %.10f %.10f %.10f", "symbol", *(F.col(c).cast("double") for c in ("x", "y", "z", "fx", "fy", "fz")))
    frames = atoms.groupBy(key).agg(F.count("*").alias("n_atoms"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    joined = structures.join(frames, key)
    head = F.format_string("%d\nREF_energy=%.10f Properties=species:S:1:pos:R:3:REF_forces:R:3", F.col("n_atoms"), F.col("energy").cast("double"))
    return joined.select(key, "n_atoms", F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def write_text(frames: DataFrame, path: str) -> None:
    frames.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def species_numbers(atoms: DataFrame, symbol: str) -> DataFrame:
    """symbol and its 1-based number in sorted order; a small table of elements."""
    from pyspark.sql import Window

    return atoms.select(symbol).distinct().withColumn("number", F.row_number().over(Window.orderBy(symbol)))


def symbol_groups(structures: DataFrame, key: str, symbols: str) -> DataFrame:
    """Frames with the same symbols in the same order: group number by (length, symbols), number of frames, smallest key."""
    text = F.array_join(symbols, ",")
    groups = structures.groupBy(F.size(symbols).alias("length"), text.alias("symbols")).agg(F.count("*").alias("n_frames"), F.min(key).alias("first_key"))
    return numbered(groups, [], ["length", "symbols"]).withColumn("group_number", (F.col("place") + 1).cast("int")).drop("place")


def write_manifest(artifacts: DataFrame, path: str) -> None:
    """Sorted and without times, so that equal runs give equal bytes."""
    artifacts.orderBy("artifact_id").coalesce(1).write.mode("overwrite").json(path)


def provenance(log: DataFrame) -> DataFrame:
    """One row: first and last time, number of events, counts by type as a map in order."""
    counts = log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return counts.agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n_events"), F.map_from_entries(entries).alias("by_type"))


def pw_input(rows: DataFrame, key: str) -> DataFrame:
    """A plane-wave input deck per row: ecutrho is four times ecutwfc where it isn't given."""
    rho = F.coalesce(F.col("ecutrho"), F.col("ecutwfc") * 4)
    return rows.select(key, F.format_string("&SYSTEM\n  nat = %d\n  ntyp = %d\n  ecutwfc = %.4f\n  ecutrho = %.4f\n/", F.col("nat"), F.col("ntyp"), F.col("ecutwfc").cast("double"), rho.cast("double")).alias("text"))


def xyz_frames(structures: DataFrame, key: str) -> DataFrame:
    """key and text: extended-XYZ frames with Lattice, pbc and the structure's id, ten decimals. structures: symbols, positions, forces, cell, pbc, energy as
    arrays of one row; a frame whose arrays differ in length is null."""
    number = lambda x: F.format_string("%.10f", x.cast("double"))
    joined = lambda xs: F.array_join(F.transform(xs, number), " ")
    atoms = F.transform(F.arrays_zip("symbols", "positions", "forces"), lambda a: F.concat_ws(" ", a["symbols"], joined(a["positions"]), joined(a["forces"])))
    head = F.concat(
        F.lit('Lattice="'), joined(F.flatten("cell")), F.lit('" Properties=species:S:1:pos:R:3:REF_forces:R:3 REF_energy='), number(F.col("energy")),
        F.lit(' pbc="'), F.array_join(F.transform("pbc", lambda p: F.when(p, "T").otherwise("F")), " "), F.lit('" config_id='), F.col(key).cast("string"),
    )
    sound = (F.size("symbols") == F.size("positions")) & (F.size("symbols") == F.size("forces"))
    return structures.select(key, F.when(sound, F.concat_ws("\n", F.size("symbols").cast("string"), head, F.array_join(atoms, "\n"))).alias("text"))


def data_file(structures: DataFrame, masses: DataFrame, key: str) -> DataFrame:
    """key and text: a molecular-dynamics data file for each structure with a cell along the axes: counts, bounds, masses and atoms, species numbered in the order of their
    symbols within the structure. masses: symbol, mass; null for a structure with a symbol that it lacks."""
    known = masses.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "mass"))).alias("_masses"))  # an element each
    kinds = F.array_sort(F.array_distinct("symbols"))
    rows = structures.join(F.broadcast(known)).withColumn("_kinds", kinds)
    bound = lambda k, axis: F.format_string(f"0.0 %.10f {axis}lo {axis}hi", F.col("cell")[k][k].cast("double"))
    mass = F.transform("_kinds", lambda s, i: F.format_string("%d %.6f  # %s", i + 1, F.col("_masses")[s].cast("double"), s))
    atom = F.transform(F.arrays_zip("symbols", "positions"), lambda a, i: F.concat_ws(" ", (i + 1).cast("string"), F.array_position(F.col("_kinds"), a["symbols"]).cast("string"), F.array_join(F.transform(a["positions"], lambda x: F.format_string("%.10f", x.cast("double"))), " ")))
    text = F.concat_ws(
        "\n", F.format_string("%d atoms", F.size("symbols")), F.format_string("%d atom types", F.size("_kinds")), F.lit(""), bound(0, "x"), bound(1, "y"), bound(2, "z"),
        F.lit("\nMasses\n"), F.array_join(mass, "\n"), F.lit("\nAtoms  # atomic\n"), F.array_join(atom, "\n"),
    )
    return rows.select(key, F.when(F.forall("_kinds", lambda s: F.col("_masses")[s].isNotNull()), text).alias("text"))
