"""Live counterparts of the event-log operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veinwork.sources.transactions import Transaction

#: The state store that typed state and its expiry need; set it before a query with them starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows; later than late counts no more."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def deduplicated(events: DataFrame, at: str, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def transition_violations(events: DataFrame, entity: str, sequence: str, state: str, allowed: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Illegal transitions as they arrive: the state held for an entity is its last one. Within a trigger events go by sequence."""
    table = {k: frozenset(v) for k, v in allowed.items()}

    def audit(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values(sequence)
        out = []
        for n, to in zip(rows[sequence], rows[state], strict=True):
            if now is not None and to not in table.get(now, frozenset()):
                out.append((str(key[0]), int(n), now, to))
            now = to
        held.update((now,))
        yield pd.DataFrame(out, columns=["entity", "sequence", "from_state", "to_state"])

    return events.select(entity, sequence, state).groupBy(entity).applyInPandasWithState(audit, "entity string, sequence long, from_state string, to_state string", "state string", "append", GroupStateTimeout.NoTimeout)


def exactly_once_sink(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each batch with its number to write; a batch that comes again has the same number."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Transitions(StatefulProcessor):
    """Typed state for each entity: its last state and sequence, which expire."""

    def __init__(self, allowed: Mapping[str, tuple[str, ...]], expiry_ms: int | None):
        self.allowed, self.expiry = {k: frozenset(v) for k, v in allowed.items()}, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string, sequence long", self.expiry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pairs = sorted((n, to) for frame in rows for n, to in zip(frame["sequence"].tolist(), frame["to_state"].tolist(), strict=True))
        now, at = self.last.get() if self.last.exists() else (None, -1)
        out = []
        for n, to in pairs:
            if n <= at:  # late or repeated: the state has gone on
                out.append((str(key[0]), int(n), now, to, "late"))
                continue
            if now is not None and to not in self.allowed.get(now, frozenset()):
                out.append((str(key[0]), int(n), now, to, "illegal"))
            now, at = to, int(n)
        self.last.update((now, at))
        yield pd.DataFrame(out, columns=["entity", "sequence", "from_state", "to_state", "problem"])

    def close(self) -> None:
        pass


def live_transitions(events: DataFrame, entity: str, sequence: str, state: str, allowed: Mapping[str, tuple[str, ...]], expiry_ms: int | None = None) -> DataFrame:
    """entity, sequence, from_state, to_state, problem as events arrive: illegal transitions, and events that come no later than one already seen.

    An entity's state is its last state and sequence, typed, in the state store (STATE_STORE); it expires expiry_ms after its last event (never, if None), after which the
    entity begins anew. Of an entity's events of one trigger two columns are held and sorted.
    """
    rows = events.select(F.col(entity).alias("entity"), F.col(sequence).cast("long").alias("sequence"), F.col(state).alias("to_state"))
    schema = "entity string, sequence long, from_state string, to_state string, problem string"
    return rows.groupBy("entity").transformWithStateInPandas(_Transitions(allowed, expiry_ms), outputStructType=schema, outputMode="Append", timeMode="None" if expiry_ms is None else "ProcessingTime")


class BatchStore:
    """A sink whose batches are there once and whole: each is a transaction of its own, and its manifest is the receipt that it is finished."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark, self.path, self.query = spark, path.rstrip("/"), query

    def _batch(self, number: int) -> Transaction:
        return Transaction(self.spark, self.path, f"batch-{number:010d}", {"query": self.query, "batch": str(number)})

    def __call__(self, batch: DataFrame, number: int) -> bool:
        """Writes the batch; False if it is finished already: a batch that comes again, by a restart or otherwise, writes nothing."""
        return self._batch(number).commit({"rows": lambda: batch})

    def finished(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/manifest.json")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(int(x.getPath().getParent().getName().removeprefix("batch-")) for x in found)

    def read(self) -> DataFrame | None:
        """The rows of the finished batches; None before there is one."""
        numbers = self.finished()
        return self.spark.read.parquet(*(f"{self.path}/batch-{n:010d}/rows" for n in numbers)) if numbers else None

    def start(self, events: DataFrame, checkpoint: str):
        return events.writeStream.foreachBatch(lambda batch, number: self(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
