"""Words of batches as arrays against the plain form, and the sums over classes against all of their exponentials."""

import numpy as np
import pyarrow as pa
import pytest

from veinwork.llm import language_model as lm
from veinwork.llm.words import Words


def test_words_hashes_and_tails_are_those_of_single_words():
    r = np.random.default_rng(4)
    odd = ["", " ", "\n\t a  B\x0b\x0c\r", "ÀÉ x é", "a" * 31 + " " + "b" * 32 + " " + "C" * 70 + " \x00 \x1c\x85", "　x ïB"]
    texts = odd + [" ".join(r.integers(33, 127, n, dtype=np.uint8).tobytes().decode() for n in range(1, 80)), *odd]
    for given in (pa.array(texts), pa.array(["x", *texts, "y"], pa.large_string()).slice(1, len(texts)), pa.array([""]), pa.array(["a"])):
        found, plain = Words.of(given, lm.END), [lm.words_of(t) for t in given.to_pylist()]
        words = [found.data[i : i + n].tobytes() for i, n in zip(found.start, found.size, strict=True)]
        assert [words[i] for i in found.at] == [w for t in plain for w in t] and found.tokens.tolist() == [len(t) for t in plain]
        got = zip(words, found.hashes().tolist(), found.by_ends(lm.tail_of, 8).tolist(), strict=True)
        assert all((h, t) == (lm._hash(w), lm.tail_of(w)) for w, h, t in got if w)


@pytest.mark.parametrize("size", [0.3, 2.0, 30.0])
def test_sums_over_classes_are_those_of_all_exponentials(size):
    """Small vectors take a factor for each place, the largest ones the exponentials of pairs."""
    r, n, places = np.random.default_rng(6), 130, 200
    scorer = lm.Scorer.__new__(lm.Scorer)
    scorer.p = {"R": r.normal(0, size, (places, lm.WIDTH)).astype(np.float32), "Q": r.normal(0, size, (n, lm.WIDTH + 1)).astype(np.float32), "mix": r.normal(0, 0.3, (2, lm.WIDTH)).astype(np.float32)}
    a, b = r.integers(0, places, 5000), r.integers(0, places, 5000)
    q = np.ones((5000, lm.WIDTH + 1), dtype=np.float32)
    q[:, :-1] = scorer.p["R"][a] * scorer.p["mix"][0] + scorer.p["R"][b] * scorer.p["mix"][1]
    logits = q.astype(float) @ scorer.p["Q"].T.astype(float)
    most = logits.max(axis=1)
    assert scorer._totals(a, b, q) == pytest.approx(most + np.log(np.exp(logits - most[:, None]).sum(axis=1)), rel=1e-4, abs=1e-4)


def test_row_sums():
    r = np.random.default_rng(7)
    for at in (r.integers(0, 40, 300), np.arange(9), np.zeros(5, dtype=int), np.array([3, 3, 1])):
        rows = r.normal(0, 1, (len(at), 3))
        sums, _, places, times = lm._row_sums(at.astype(np.uint16), rows, len(at))
        assert places.tolist() == sorted(set(at.tolist())) and times.tolist() == [int((at == p).sum()) for p in places]
        assert sums == pytest.approx(np.array([rows[at == p].sum(axis=0) for p in places]))
