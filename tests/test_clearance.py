import json

from pyspark.sql import functions as F

from veinwork.operators import clearance


def test_transport_is_a_set_equality(spark):
    files = spark.createDataFrame([("a.json",), ("a.json",), ("x/.ENV",)], "path string")
    allowed = spark.createDataFrame([("a.json",), ("b.json",)], "path string")
    got = {tuple(r) for r in clearance.transport_problems(files, allowed, "path", [".env"]).collect()}
    assert got == {("x/.ENV", "unexpected"), ("b.json", "missing"), ("x/.ENV", "forbidden_path")}
    assert clearance.transport_problems(files, files, "path", []).count() == 0
    assert clearance.transport_problems(files.limit(0), allowed.limit(0), "path", ["x"]).count() == 0


def test_approval_fails_closed(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    one = spark.range(1)
    why = lambda now, pairs: one.select(clearance.approval_problems(t(now), t("2024-01-02"), t("2024-01-04"), pairs).alias("w")).first().w
    assert why("2024-01-03", {"gpu": (F.lit("l4"), F.lit("l4"))}) == []
    assert why("2024-01-01", {"gpu": (F.lit("l4"), F.lit(None))}) == ["not_yet_valid", "changed:gpu"]
    assert why("2024-01-05", {}) == ["expired"]
    assert why(None, {}) == ["not_yet_valid", "expired"]


def test_pending_flags_and_aggregates(spark):
    rows = spark.createDataFrame([(1, '{"a": "TBD", "b": [{"c": ["TBD"]}], "d": "not TBD"}'), (2, "{}"), (3, "no json"), (4, None)], "k long, j string")
    assert {tuple(r) for r in clearance.pending_fields(rows, "j", "k").collect()} == {(1, "/a"), (1, "/b/0/c/0")}
    flags = spark.createDataFrame([(False, False), (None, True)], "a boolean, b boolean")
    assert [r.f for r in flags.select(clearance.unattested(["a", "b"]).alias("f")).collect()] == [[], ["a", "b"]]
    maps = spark.createDataFrame([({"mae": 1.0},), ({"a::b": 1.0},), ({"record_1": 1.0},), ({},)], "m map<string,double>")
    assert [r.ok for r in maps.select(clearance.aggregate_only(F.col("m")).alias("ok")).collect()] == [True, False, False, True]


def test_constraints_and_artifacts(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double")
    assert {(r.k, r.passed) for r in clearance.constraint_rows(rows, "k", {"v": (F.col("v"), 5)}).collect()} == {(1, True), (2, False)}
    wanted = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m"), ("d", "m")], "artifact_id string, kind string")
    registry = spark.createDataFrame([("a", "m", "run/a", "1", "1"), ("b", "p", "run/b", "1", None), ("c", "m", "/tmp/c", "1", "1")], "artifact_id string, kind string, path string, stored_sha string, actual_sha string")
    got = {r.artifact_id: r.problems for r in clearance.artifact_problems(wanted, registry, "run/").collect()}
    assert got == {"b": ["kind", "changed"], "c": ["outside"], "d": ["unregistered"]}
    storage = spark.createDataFrame([(1, True, None), (2, False, "v"), (3, None, "v"), (4, True, "v")], "k long, on boolean, name string")
    assert {tuple(r) for r in clearance.surviving_storage(storage, "k", "on", ["name"]).collect()} == {(1, "unidentified-storage"), (4, "v")}


def test_hidden_values_at_any_depth(spark):
    deep = {"x": 1}
    for _ in range(40):
        deep = {"n": [deep]}
    cases = ['{"API-Key": {"a": 1}, "ok": "é"}', json.dumps(deep), "[1, 2]", "no json", None, ""]
    got = [r.c for r in spark.createDataFrame([(c,) for c in cases], "j string").coalesce(1).select(clearance.hidden_values("j").alias("c")).collect()]
    assert got == ['{"API-Key": "[REDACTED]", "ok": "é"}', json.dumps(deep), "[1, 2]", None, None, None]
