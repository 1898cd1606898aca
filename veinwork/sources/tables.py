"""Tables of a dataset folder, JSON and JSONL documents, file manifests, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("sequence", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("step_id", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("timestamp", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir, read back: iterations keep a short lineage that survives lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        root = tempfile.mkdtemp(prefix="veinwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/veinwork/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or document of records; one that doesn't fit the schema fails the load."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSONL events, with the timestamp as one."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path).withColumn("at", F.to_timestamp("timestamp"))


def append_events(log: DataFrame | None, new: DataFrame, path: str) -> None:
    """Appends events (with a column order) as JSONL; sequences go on from the log's last.

    Events of one append are one run's few new ones, so one task may number them.
    """
    from pyspark.sql import Window

    last = -1 if log is None else (log.agg(F.max("sequence")).first()[0] if not log.isEmpty() else -1)
    numbered = new.withColumn("sequence", F.row_number().over(Window.orderBy("order")) + F.lit(last).cast("long"))
    numbered.drop("order").coalesce(1).write.mode("append").json(path)


def normalised_records(raw: DataFrame, species_path: str = "structure.sites") -> DataFrame:
    """Raw structures with sites flattened: symbols, positions; a site with an occupancy other than 1 fails the load."""
    sites = F.col(species_path)
    whole = F.forall(sites, lambda s: (F.size(s["species"]) == 1) & (s["species"][0]["occu"] == 1))
    checked = F.when(whole, sites).otherwise(F.raise_error(F.lit("a site is not wholly one element")).cast(raw.select(sites).schema[0].dataType))
    return raw.withColumn("_sites", checked).withColumn("symbols", F.transform("_sites", lambda s: s["species"][0]["element"])).withColumn("positions", F.transform("_sites", lambda s: s["xyz"])).drop("_sites")


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, size_bytes and sha256 of every file below a folder."""
    from veinwork.sources.digests import file_digests

    return file_digests(spark, folder)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose canonical text isn't cached; cached bodies that are no JSON count as misses."""
    keyed = requests.withColumn("cache_key", F.sha2("request", 256))
    usable = cache.filter(F.try_parse_json("body").isNotNull()).select("cache_key")
    return keyed.join(usable, "cache_key", "left_anti")


def parameters(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """A configuration document as a small table of name and text."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "name string, value string")
