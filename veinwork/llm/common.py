"""What the text operators share: reading tables, written intermediate tables, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts can be long, so a batch must not hold Spark's default of 10,000 of them.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset, read whole by Spark's own reader (any store that Spark can open)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master may fall back on a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        found = tempfile.mkdtemp(prefix="veinwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table read back.

    It cuts the lineage, so what follows survives the loss of an executor without doing the work again,
    and rows that a task has numbered keep their numbers. The files go when the application ends, or by discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veinwork/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote, once everything that reads them has been written itself."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def growing(df: DataFrame) -> DataFrame:
    """df for a join of tables that both grow with the input: merged, never broadcast. Spark goes by the bytes of the compressed files or
    shuffle blocks, and rows of a few MB there can take hundreds in the driver, which builds what is broadcast."""
    return df.hint("merge")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, the null text as an empty one; other columns can't clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_batch(
    fn: Callable[[list, list], dict[str, list]], schema: pa.Schema, setup: Callable[[], None] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from fn(ids, texts) -> columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for b in batches:
            out = fn(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def id_type(df: DataFrame, col: str = "id") -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)
