"""A writer of stacked arrays: frames with the same symbols become files of arrays, which are there only once all are."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from veinwork.sources.digests import located
from veinwork.sources.exports import symbol_groups

#: Frames in a file, at most.
FRAMES = 4096


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class StackedWriter(DataSourceWriter):
    """A task writes the files of its frames below a staging folder and tells their names; the driver moves that folder to its place."""

    def __init__(self, path: str, frames: int):
        self.path, self.frames, self.staging = path.rstrip("/"), frames, f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files: list[dict] = []
        held: list[Row] = []
        own = uuid.uuid4().hex[:12]  # a task that is run again writes other names, and only those it commits are listed

        def flush() -> None:
            if not held:
                return
            symbols = list(held[0].symbols)
            names = sorted(set(symbols))
            arrays = {
                "keys": np.array([str(r.key) for r in held]),
                "types": np.array([names.index(s) for s in symbols]),
                "cells": np.array([r.cell for r in held], dtype=float),
                "coords": np.array([r.positions for r in held], dtype=float),
                "energies": np.array([r.energy for r in held], dtype=float),
                "forces": np.array([r.forces for r in held], dtype=float),
            }
            body = io.BytesIO()
            np.savez(body, **arrays)
            name = f"system-{held[0].system:05d}/set-{own}-{len(files):05d}.npz"
            system, root = located(self.staging)
            system.create_dir(f"{root}/{name.split('/')[0]}", recursive=True)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(body.getvalue())
            files.append({"file": name, "symbols": names, "n_atoms": len(symbols), "n_frames": len(held), "sha256": hashlib.sha256(body.getvalue()).hexdigest()})
            held.clear()

        for row in iterator:
            if held and (row.system != held[0].system or row.part != held[0].part or len(held) == self.frames):
                flush()
            held.append(row)
        flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.staging)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        system.create_dir(root, recursive=True)
        listed = {f["file"] for f in files}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):  # what failed attempts have left
            if info.is_file and info.path.split(f"{root.rsplit('/', 1)[-1]}/", 1)[-1] not in listed:
                system.delete_file(info.path)
        with system.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"units": {"energy": "eV", "forces": "eV/angstrom", "length": "angstrom"}, "files": files}, sort_keys=True).encode())
        system.move(root, located(self.path)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.staging)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class StackedArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stacked_arrays"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        system, place = located(path)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{path} is there already")
        return StackedWriter(path, int(self.options.get("frames", FRAMES)))


def write_stacked(structures: DataFrame, key: str, path: str, frames: int = FRAMES) -> None:
    """Structures (key, symbols, positions, cell, energy, forces) as arrays: a folder for each sequence of symbols, numbered by (length, symbols), and in it files
    of up to `frames` frames in the order of their keys, with a manifest of all.

    A sequence of symbols with very many frames is dealt to as many tasks as it has files. Fails, leaving nothing, if a task fails or the path exists.
    """
    spark: SparkSession = structures.sparkSession
    spark.dataSource.register(StackedArrays)
    text = F.array_join("symbols", ",")
    groups = symbol_groups(structures, key, "symbols").select(F.col("symbols").alias("_text"), (F.col("group_number") - 1).alias("system"), F.ceil(F.col("n_frames") / frames).alias("_files"))
    joined = structures.join(groups, text == F.col("_text"))
    placed = joined.withColumn("part", F.pmod(F.xxhash64(key), F.col("_files"))).repartition("system", "part").sortWithinPartitions("system", "part", key)
    placed.select("system", "part", F.col(key).alias("key"), "symbols", "positions", "cell", "energy", "forces").write.format("stacked_arrays").option("path", path).option("frames", frames).mode("append").save()


def read_stacked(path: str) -> tuple[dict, list[dict[str, np.ndarray]]]:
    """The manifest and the arrays of each of its files, for checks of an export; each file's hash is compared."""
    system, root = located(path)
    manifest = json.loads(system.open_input_stream(f"{root}/manifest.json").read())
    out = []
    for f in manifest["files"]:
        body = system.open_input_stream(f"{root}/{f['file']}").read()
        if hashlib.sha256(body).hexdigest() != f["sha256"]:
            raise ValueError(f"{f['file']} was changed")
        out.append(dict(np.load(io.BytesIO(body))))
    return manifest, out
