"""Several tables as one transaction: written beside each other, and there for readers only from the moment that their manifest is."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from veinwork.sources.digests import table_digest


class Conflict(Exception):
    """The transaction exists with other pins, or what it wrote is not what its manifest says."""


class Transaction:
    """Tables below folder/name. pins: what the transaction is bound to (campaign, round, request, hashes of its inputs)."""

    def __init__(self, spark: SparkSession, folder: str, name: str, pins: Mapping[str, str]):
        self.spark, self.root, self.pins = spark, f"{folder.rstrip('/')}/{name}", dict(sorted(pins.items()))

    def commit(self, tables: Mapping[str, Callable[[], DataFrame]]) -> bool:
        """Writes the tables and publishes the manifest; False if the same transaction was published before, which is then verified and not written again.

        Each table is computed, written and digested, and a note with its digest follows. A run that was cut between tables goes on
        with those that have no note, after checking those that have one; a table without a note is written anew. The manifest names all digests and
        comes last, by a rename that fails if one is there: of two runs one wins, and no reader sees a part.
        """
        known = self._read("manifest.json")
        if known is not None:
            self._same(known)
            if sorted(known["tables"]) != sorted(tables):
                raise Conflict(f"published with the tables {sorted(known['tables'])}")
            self.verify()
            return False
        digests = {}
        for name, make in tables.items():
            note = self._read(f"{name}.note.json")
            if note is not None:
                self._same(note)
                if note["digest"] != table_digest(self._table(name)):
                    raise Conflict(f"the staged table {name} is not what its note says")
            else:
                make().write.mode("overwrite").parquet(f"{self.root}/{name}")
                note = {"pins": self.pins, "digest": table_digest(self._table(name))}
                self._publish(f"{name}.note.json", note)
            digests[name] = note["digest"]
        self._publish("manifest.json", {"pins": self.pins, "tables": digests})
        return True

    def verify(self) -> None:
        """Raises unless the transaction was published and every table still has the content that its manifest names."""
        known = self._read("manifest.json")
        if known is None:
            raise Conflict("not published")
        for name, digest in known["tables"].items():
            if table_digest(self._table(name)) != digest:
                raise Conflict(f"the table {name} was changed")

    def table(self, name: str) -> DataFrame:
        """A table of a published transaction."""
        known = self._read("manifest.json")
        if known is None:
            raise Conflict("not published")
        self._same(known)
        return self._table(name)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _same(self, known: dict) -> None:
        other = sorted(k for k in {*known["pins"], *self.pins} if known["pins"].get(k) != self.pins.get(k))
        if other:
            raise Conflict(f"begun with other pins: {', '.join(other)}")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _read(self, name: str) -> dict | None:
        files = self._files()
        if not files.exists(self._path(name)):
            return None
        return json.loads("".join(r.value for r in self.spark.read.option("wholetext", "true").text(f"{self.root}/{name}").collect()))

    def _publish(self, name: str, content: dict) -> None:
        files, draft = self._files(), self._path(f"_{name}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if files.exists(self._path(name)) or not files.rename(draft, self._path(name)):
            raise Conflict(f"{name} was published by another run")
