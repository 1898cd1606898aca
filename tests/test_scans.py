"""Composed folds against a sequential fold, one entity over ten ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veinwork.operators import events, ranks, scans


@pytest.fixture(scope="module", autouse=True)
def ten_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefixes_of_one_entity(spark):
    r = random.Random(1)
    rows = [("a" if i % 50 else "b", i, r.choice([None, r.randint(-9, 9)])) for i in range(2000)]
    at = ranks.placed(spark.createDataFrame(rows, "e string, s int, v int"), ["e", "s"])
    assert at.filter("e = 'a'").select("part").distinct().count() >= 9
    for inclusive in (False, True):
        for kind, fold in (("sum", lambda a, x: (a or 0) + x), ("min", lambda a, x: x if a is None else min(a, x)), ("max", lambda a, x: x if a is None else max(a, x)), ("last", lambda a, x: x)):
            want, held = {}, {}
            for e, s, v in rows:
                if not inclusive:
                    want[e, s] = held.get(e)
                if v is not None:
                    held[e] = fold(held.get(e), v)
                if inclusive:
                    want[e, s] = held.get(e)
            got = scans.prefix(at, ["e"], ["s"], kind, F.col("v"), "x", inclusive).collect()
            assert {(x.e, x.s): x.x for x in got} == want and len(got) == len(rows)


def test_transitions_and_chains_equal_the_simple_form(spark):
    r = random.Random(2)
    log = spark.createDataFrame([(r.choice("xxxxxy"), i, r.choice("abc")) for i in range(1500)], "e string, s int, k string")
    allowed = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_state string, to_state string")
    a, b = (sorted(map(tuple, f(log, "e", "s", "k", allowed).collect())) for f in (events.transition_audit, scans.transition_audit))
    assert a == b and a
    c, d = (sorted(map(tuple, f(log, "e", "s", F.when(F.col("s") % 40 > 0, F.col("s") - 1), F.col("s")).collect())) for f in (events.chain_breaks, scans.chain_breaks))
    assert c == d and c


@pytest.mark.parametrize("patience", [1, 3, 40, 5000])
def test_early_stopping_equals_the_loop(spark, patience):
    r = random.Random(patience)
    rows = []
    for run in range(4):
        value = 10.0
        for step in range(600 if run else 1):
            value += r.uniform(-0.1, 0.099)
            rows.append((run, step, r.choice([value] * 8 + [math.nan, math.inf, None]) if run < 3 else math.nan))
    want = {}
    for run in range(4):
        best, best_step, wait, n = math.inf, None, 0, 0
        for _, step, v in (x for x in rows if x[0] == run):
            n += 1
            if v is not None and v < best:
                best, best_step, wait = v, step, 0
            else:
                wait += 1
            if wait >= patience:
                break
        want[run] = (n, wait >= patience, None if best == math.inf else best, best_step, wait)
    got = scans.early_stopping(spark.createDataFrame(rows, "run int, step int, value double"), "run", "step", "value", patience)
    assert {x.run: (x.n_steps, x.stopped_early, x.best, x.best_step, x.patience_count) for x in got.collect()} == want
