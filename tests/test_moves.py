"""The next mutation against a plain loop over random states."""

import random

from veinwork.operators import moves

ROTATION = ("learning_rate", "gradient_clip", "batch_size", "energy_weight")
RANGES = {"learning_rate": (0.1, 8.0, False), "gradient_clip": (1.0, 16.0, False), "batch_size": (1, 9, True), "energy_weight": (1.0, 4.0, False)}


def plain(decision, failed, prior, down, config):
    def move(key, factor):
        low, high, whole = RANGES[key]
        if config.get(key) is None:
            return None
        new = min(high, max(low, config[key] * factor))
        new = float(round(new)) if whole else float(new)
        return (key, config[key], new) if new != config[key] else None

    prior = prior or "learning_rate"
    if decision is None:
        tries, why = [("learning_rate", 0.2)], "first_move"
    elif decision in ("refine", "escalate"):
        tries, why = [("learning_rate", 0.5), ("gradient_clip", 2.0)], "no_stability_repair"
    elif decision == "reject" and failed:
        tries, why = [("batch_size", 0.5)], "no_resource_repair"
    elif decision == "reject":
        at = ROTATION.index(prior) if prior in ROTATION else -1
        order = [ROTATION[(at + j) % len(ROTATION)] for j in range(1, len(ROTATION) + 1)]
        tries, why = [(k, 0.5) for k in order if k != prior], "no_key_moves"
    elif decision == "accept":
        tries, why = ([(prior, 0.5 if down else 2.0)] if prior in RANGES else []) + [(k, 0.5) for k in ROTATION if k != prior], "no_key_moves"
    else:
        return None, "unknown_decision"
    found = next((m for k, f in tries if (m := move(k, f))), None)
    return found, None if found else why


def test_moves_follow_the_decision(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        config = {k: r.choice([None, 0.1, 1.0, 2.0, 3.0, 5.0, 7.0, 8.0, 9.0, 16.0]) for k in RANGES}
        config["batch_size"] = r.choice([None, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0])
        rows.append((i, r.choice([None, "refine", "escalate", "reject", "reject", "accept", "accept", "pause"]), r.random() < 0.3, r.choice([None, "cutoff", *ROTATION]), r.random() < 0.5, config))
    df = spark.createDataFrame(rows, "i int, decision string, constraint_failed boolean, mutated_key string, was_decrease boolean, config map<string,double>")
    got = {x.i: (tuple(x.move) if x.move else None, x.blocked) for x in moves.next_mutation(df, ROTATION, RANGES).collect()}
    want = {i: plain(*row) for i, *row in rows}
    assert got == want
    assert {b for _, b in got.values()} == {None, "first_move", "no_stability_repair", "no_resource_repair", "no_key_moves", "unknown_decision"}
    assert any(m and m[0] == "gradient_clip" and rows[i][1] == "refine" for i, (m, _) in got.items())
