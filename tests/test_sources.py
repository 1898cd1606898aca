"""Digests of large files, transactions of several tables, stacked arrays."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinwork.sources import digests, stacked, tables, transactions


def test_digests_of_large_files(spark, tmp_path):
    """A file beyond 2 GB (sparse), an empty one and a small one below a folder."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "deep" / "small é.bin").write_bytes(b"abc" * 700_000)
    size = (1 << 31) + 12_345
    with open(tmp_path / "in" / "large", "wb") as f:
        f.truncate(size)
    got = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in tables.file_manifest(spark, str(tmp_path / "in")).collect()}
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(12_345))
    os.truncate(tmp_path / "in" / "large", 0)
    assert got["large"] == (size, zeros.hexdigest())
    assert "empty" not in got
    assert next(v for k, v in got.items() if "small" in k) == (2_100_000, hashlib.sha256(b"abc" * 700_000).hexdigest())


def test_table_digest(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("x"), F.when(F.col("id") % 3 == 0, 1.5).alias("y"))
    assert digests.table_digest(df) == digests.table_digest(df.repartition(7).select("y", "x", "id"))
    others = [df.filter("id > 0"), df.withColumn("x", F.when(F.col("id") == 5, "z").otherwise(F.col("x"))), df.unionByName(df.filter("id = 3")), df.withColumn("id", F.col("id").cast("int")), df.limit(0)]
    assert len({digests.table_digest(d) for d in [df, *others]}) == 6


def test_transaction_goes_on_where_it_was_cut(spark, tmp_path):
    """Six tables of a reveal; the run is cut before the fourth. The charge is computed once, a repeat writes nothing, other pins are refused."""
    pins = {"campaign": "c", "round": "r1", "request": "abc", "dataset": "d1"}
    made = []

    def table(name, fail=False):
        def make():
            if fail:
                raise RuntimeError("cut")
            made.append(name)
            return spark.range(5).withColumn("name", F.lit(name))

        return make

    names = ["request", "decision", "labels", "ledger", "lineage", "state"]
    first = transactions.Transaction(spark, str(tmp_path), "c-r1", pins)
    with pytest.raises(RuntimeError):
        first.commit({n: table(n, n == "ledger") for n in names})
    with pytest.raises(transactions.Conflict, match="not published"):
        first.table("request")
    assert made == names[:3]
    again = transactions.Transaction(spark, str(tmp_path), "c-r1", pins)
    assert again.commit({n: table(n) for n in names}) and made == names
    assert not transactions.Transaction(spark, str(tmp_path), "c-r1", pins).commit({n: table(n) for n in names}) and made == names
    assert again.table("ledger").count() == 5
    for other in ({"dataset": "d2"}, {"request": "abd"}):
        with pytest.raises(transactions.Conflict, match=next(iter(other))):
            transactions.Transaction(spark, str(tmp_path), "c-r1", pins | other).commit({n: table(n) for n in names})
    with pytest.raises(transactions.Conflict, match="tables"):
        again.commit({"request": table("request")})
    spark.range(6).withColumn("name", F.lit("ledger")).write.mode("overwrite").parquet(f"{tmp_path}/c-r1/ledger")
    with pytest.raises(transactions.Conflict, match="ledger was changed"):
        again.verify()


def test_a_changed_stage_is_refused(spark, tmp_path):
    t = transactions.Transaction(spark, str(tmp_path), "t", {"a": "1"})

    def cut():
        raise RuntimeError("cut")

    with pytest.raises(RuntimeError):
        t.commit({"x": lambda: spark.range(3), "y": cut})
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t/x")
    with pytest.raises(transactions.Conflict, match="staged table x"):
        t.commit({"x": lambda: spark.range(3), "y": lambda: spark.range(1)})


def frames(n):
    r = np.random.default_rng(1)
    kinds = [["H", "O", "H"], ["O"], ["Cu", "Cu"], ["H", "H", "O"]]
    for i in range(n):
        s = kinds[0 if i % 3 else i % 4]  # one of them is hot
        yield (i, s, r.normal(size=(len(s), 3)).tolist(), (np.eye(3) * 9).tolist(), float(i), r.normal(size=(len(s), 3)).tolist())


SCHEMA = "k long, symbols array<string>, positions array<array<double>>, cell array<array<double>>, energy double, forces array<array<double>>"


def test_stacked_arrays(spark, tmp_path):
    rows = list(frames(300))
    path = str(tmp_path / "out")
    stacked.write_stacked(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", path, frames=32)
    manifest, arrays = stacked.read_stacked(path)
    order = [["O"], ["Cu", "Cu"], ["H", "H", "O"], ["H", "O", "H"]]
    back = {}
    for f, a in zip(manifest["files"], arrays):
        symbols = [f["symbols"][t] for t in a["types"]]
        assert f["file"].startswith(f"system-{order.index(symbols):05d}/") and f["n_frames"] == len(a["keys"]) <= 32
        assert [int(k) for k in a["keys"]] == sorted(int(k) for k in a["keys"])
        for j, k in enumerate(a["keys"]):
            back[int(k)] = (int(k), symbols, a["coords"][j].tolist(), a["cells"][j].tolist(), float(a["energies"][j]), a["forces"][j].tolist())
    assert back == {r[0]: r for r in rows}
    with pytest.raises(Exception, match="there already"):
        stacked.write_stacked(spark.createDataFrame(rows, SCHEMA), "k", path)


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    rows = list(frames(40))
    rows[17] = (*rows[17][:2], [[0.0, 0.0, 0.0], [1.0]], *rows[17][3:])  # a ragged frame
    with pytest.raises(Exception):
        stacked.write_stacked(spark.createDataFrame(rows, SCHEMA).repartition(4), "k", str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
