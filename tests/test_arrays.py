"""The reader of one large JSON array against Python's json, in many byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veinwork.sources import arrays


def record(r, i):
    odd = ["}", "{", "]}", '"', "\\", '\\"}', "é}日", "\n", "[{", ",", ":", '"records": [']
    value = lambda d: r.choice([i, None, "".join(r.choices([*odd, "plain "], k=r.randint(0, 6))), [value(d + 1) for _ in range(r.randint(0, 3))] if d < 3 else 1, {r.choice(odd): value(d + 1), "records": []} if d < 3 else True])
    return {"i": i, "text": "x" * r.choice([0, 3, 200]), "v": [value(0) for _ in range(3)]}


@pytest.fixture(scope="module")
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "1"), spark.conf.set("spark.sql.files.minPartitionNum", "1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("size", [97, 1_000, 5_000, 1 << 20])
@pytest.mark.parametrize("form", ["root", "key"])
def test_objects_of_any_ranges(spark, tmp_path, small_ranges, size, form):
    r = random.Random(size)
    records = [record(r, i) for i in range(60)]
    indent = r.choice([None, 1])
    document = records if form == "root" else {"meta": {"records": [1], "x": '"records": ['}, "records": records, "after": [{"records": [2]}, {"deep": [[{}]]}]}
    text = json.dumps(document, indent=indent, ensure_ascii=False) + r.choice(["", "\n"])
    path = tmp_path / "a.json"
    path.write_text(text)
    small_ranges(size)
    key = None if form == "root" else "records"
    got = {x.ordinal: json.loads(x.text) for x in arrays.array_objects(spark, str(path), key=key).collect()}
    assert got == dict(enumerate(records))
    wanted = spark.createDataFrame([(i,) for i in (0, 7, 59, 7)], "ordinal long")
    some = {x.ordinal: json.loads(x.text) for x in arrays.array_objects(spark, str(path), wanted, key).collect()}
    assert some == {i: records[i] for i in (0, 7, 59)}
    ranges = arrays._pieces(spark, str(path)).select("block").distinct().count()
    assert ranges >= min(8, len(text.encode()) // (size + 2000))


def test_bad_arrays_fail(spark, tmp_path):
    def read(text, key=None, wanted=None):
        path = tmp_path / f"{abs(hash((text, key)))}.json"
        path.write_text(text)
        return [x.text for x in arrays.array_objects(spark, str(path), wanted, key).orderBy("ordinal").collect()]

    assert read("[]") == [] and read('{"a": [ ]}', "a") == [] and read(' [ {} , {"b":[{}]} ] ') == ["{}", '{"b":[{}]}']
    for text, key in (('{"a": 1}', "a"), ('{"b": {"a": []}}', "a"), ('{"a": []}', None), ('[{"a": 1}', None), ('[{"a": 1', None), ("", None), ('{"a": [{}', "a")):
        with pytest.raises(ValueError):
            read(text, key)
    for text in ("[1, {}]", "[[1]]", '[{}, "x"]', "[{} null]"):
        with pytest.raises(Exception, match="is no object"):
            read(text)
    with pytest.raises(ValueError, match="beyond"):
        read("[{}]", None, spark.createDataFrame([(1,)], "ordinal long"))
    with pytest.raises(ValueError):
        read('{"a}": []}', "a}")


def test_field_is_removed_before_decoding(spark):
    rows = spark.createDataFrame([('{"a": 1, "s" : [1, 2.5], "b": "x"}',), ('{"a": 1,"s":null}',)], "j string")
    assert [r.j for r in rows.select(arrays.without_field(F.col("j"), "s").alias("j")).collect()] == ['{"a": 1, "b": "x"}', '{"a": 1}']
    for bad in ('{"a": 1}', '{"a": 1, "s": [1], "s": [2]}'):
        with pytest.raises(Exception, match="not exactly one"):
            spark.createDataFrame([(bad,)], "j string").select(arrays.without_field(F.col("j"), "s")).collect()
