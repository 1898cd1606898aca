"""JSON trees against Python's own json, and against SQL."""

import hashlib
import json
import random

import pytest

from veinwork.operators import trees


def shuffled(value, r):
    """The same content with keys in another order and white space."""
    if isinstance(value, dict):
        items = list(value.items())
        r.shuffle(items)
        return "{ " + " , ".join(f"{json.dumps(k, ensure_ascii=r.random() < 0.5)} :{shuffled(v, r)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",\n".join(shuffled(v, r) for v in value) + " ]"
    return json.dumps(value, ensure_ascii=r.random() < 0.5)


def made(r, depth=0):
    kind = r.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {r.choice(["a", "b", "é", "a/b", "~x", 'q"', "Api-Key", "token_1"]) + str(i): made(r, depth + 1) for i in range(r.randrange(4))}
    if kind == 6:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return [None, True, r.randint(-50, 50), r.choice([0.5, -1.25, 1000.125]), r.choice(["x", "", 'say "hi"\n', "ünï", "$steps.s1.a.b", "$steps.s1.c", "$steps.s1", "$steps.s9.z"])][kind]


def text_of(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture(scope="module")
def documents():
    r = random.Random(2)
    return [{"root": made(r), "more": made(r)} for _ in range(60)] + [[], {}, [[]], {"a": {}}, "x", 3, None]


def test_canonical_text(spark, documents):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, shuffled(d, r), shuffled(d, r)) for i, d in enumerate(documents)], "k long, a string, b string")
    for row in rows.select("k", trees.canonical("a").alias("a"), trees.canonical("b").alias("b"), trees.canonical_hash("a").alias("h")).collect():
        assert row.a == row.b == text_of(documents[row.k]) and row.h == hashlib.sha256(row.a.encode()).hexdigest()
    same = ["[1000, 0.001, 12, 0, 1.5]", "[1e3, 1e-3, 12.0, -0, 15e-1]", "[1000.000, 1.0E-3, 1.2e1, -0.0, 1.50]", "[10e2,0.0010,0.12e2,0e0,1.5]"]
    got = spark.createDataFrame([(x,) for x in same], "j string").select(trees.canonical("j").alias("c")).distinct().collect()
    assert [r.c for r in got] == ["[1000,0.001,12,0,1.5]"]
    odd = spark.createDataFrame([("1e300",), ('"1e3 -0 2.0"',), ("no",), ('{"a":1,"a":2}',), (None,), ("10000000000.0",), ("1e10",)], "j string").select(trees.canonical("j").alias("c")).collect()
    assert [r.c for r in odd] == ["1.0E300", '"1e3 -0 2.0"', None, None, None, "10000000000", "10000000000"]


def test_record_hash_ignores_the_order_of_columns(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0], "x", {"k": 2})], "b int, a array<double>, c string, d map<string,int>")
    x, y = rows.select(trees.record_hash("a", "b", "c", "d").alias("x"), trees.record_hash("d", "c", "b", "a").alias("y")).first()
    assert x == y == hashlib.sha256(b'{"a":[0.5,1],"b":1,"c":"x","d":{"k":2}}').hexdigest()


def test_trees_are_built_again(spark, documents):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)] + [(99, "no json"), (98, None)], "k long, j string")
    got = {r.k: r.text for r in trees.rebuilt(trees.nodes(rows, "j", "k"), "k").collect()}
    assert got == {i: text_of(d) for i, d in enumerate(documents)}


def test_redaction_at_any_depth(spark, documents):
    markers = ("token", "api_key")

    def hide(v):
        if isinstance(v, dict):
            return {k: "[REDACTED]" if any(m in k.lower().replace("-", "_") for m in markers) else hide(x) for k, x in v.items()}
        return [hide(x) for x in v] if isinstance(v, list) else v

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "k long, j string")
    got = {r.k: r.text for r in trees.redacted(rows, "j", "k", markers).collect()}
    assert got == {i: text_of(hide(d)) for i, d in enumerate(documents)} and any("REDACTED" in t for t in got.values())


def test_references_at_any_depth(spark, documents):
    outputs = {("s1", "a.b"): {"z": [1, {"y": 2}]}, ("s1", "d"): "text"}
    problems = []

    def resolve(v, i, path):
        if isinstance(v, str) and v.startswith("$steps."):
            step, _, field = v[7:].partition(".")
            if (step, field) in outputs:
                return outputs[step, field]
            problems.append((i, path, v, "malformed" if not field else "no_field" if step == "s1" else "incomplete_step"))
            return v
        if isinstance(v, dict):
            return {k: resolve(x, i, f"{path}/{k.replace('~', '~0').replace('/', '~1')}") for k, x in v.items()}
        return [resolve(x, i, f"{path}/{p}") for p, x in enumerate(v)] if isinstance(v, list) else v

    want = {i: text_of(resolve(d, i, "")) for i, d in enumerate(documents)}
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "k long, j string")
    out = spark.createDataFrame([(s, f, json.dumps(v)) for (s, f), v in outputs.items()], "step_id string, field string, value string")
    text, bad = trees.resolved(rows, "j", "k", out)
    assert {r.k: r.text for r in text.collect()} == want
    assert sorted(tuple(r) for r in bad.collect()) == sorted(problems) and {p[3] for p in problems} == {"malformed", "no_field", "incomplete_step"}


def test_work_within_a_row(spark, monkeypatch):
    """Documents that a row's expression can hold make no tables of nodes; deeper ones do, with the same result, and rows of one key are apart."""
    asked = []
    nodes = trees.nodes
    monkeypatch.setattr(trees, "nodes", lambda *args: asked.append(1) or nodes(*args))

    def at(depth, value):
        for i in range(depth):
            value = [value, i] if i % 2 else {"k]": value, "[": "x"}
        return value

    out = spark.createDataFrame([("s", "f", '{"y":[1]}')], "step_id string, field string, value string")
    for depths, used in (((1, 3, trees.LEVELS - 2), False), ((2, trees.LEVELS + 3), True)):
        asked.clear()
        rows = spark.createDataFrame([(7 if used is False else d, json.dumps(at(d, {"Api-Key": {"a": 1}, "my_token": 2, "r": "$steps.s.f", "z": "$steps.s.g"}))) for d in depths], "k long, j string")
        got = [r.text for r in trees.redacted(rows, "j", "k", ("api_key", "token")).collect()]
        assert sorted(got) == sorted(text_of(at(d, {"Api-Key": "[REDACTED]", "my_token": "[REDACTED]", "r": "$steps.s.f", "z": "$steps.s.g"})) for d in depths) and bool(asked) == used
        asked.clear()
        text, bad = trees.resolved(rows, "j", "k", out)
        assert sorted(r.text for r in text.collect()) == sorted(text_of(at(d, {"Api-Key": {"a": 1}, "my_token": 2, "r": {"y": [1]}, "z": "$steps.s.g"})) for d in depths) and bool(asked) == used
        assert [(r.reference, r.problem) for r in bad.collect()] == [("$steps.s.g", "no_field")] * len(depths)
