"""Digests of files of any size, and of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task holds of a file.
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it of a path as Spark writes it: a URI whose characters aren't escaped, or a local path."""
    scheme, colon, rest = path.partition(":")
    uri = f"{scheme}:{quote(rest)}" if colon and scheme.isalnum() else f"file://{quote(path)}"
    return fs.FileSystem.from_uri(uri)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, size_bytes and sha256 of every file below a folder. Only names and sizes are listed by Spark; a task reads a file in chunks through
    the file system of its path (local, hdfs, s3, gs), so a file may be larger than any memory. Files are dealt by a hash of their path. Empty files are left out, as Spark lists none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                system, place = located(path)
                sha = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while chunk := stream.read(CHUNK):
                        sha.update(chunk)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["path", "size_bytes", "sha256"])

    return listed.repartition("path").mapInArrow(digest, "path string, size_bytes long, sha256 string")


def table_digest(df: DataFrame) -> str:
    """A text for the content of a table, whatever the order of its rows: their number, and the sum of the first 60 bits of each row's hash.

    Columns count by name and type; a repeated row counts as often as it is there.
    """
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)"))).first()
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    return hashlib.sha256(f"{schema}|{n}|{total}".encode()).hexdigest()
