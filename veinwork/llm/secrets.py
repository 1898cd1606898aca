"""Secrets: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.spans import Span, scan_spans

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are taken whole, so asking for the length in the pattern drops exactly the runs that are too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters in a random string, at least.
LEAST = 16
#: Symbols of the models: letters of either case, digits, everything else as one.
ALPHABET = string.ascii_letters + string.digits
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1

# Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "get set read write open close file path name user index count value list map key item node data type size "
    "line text page table row column query result error log level message event stream buffer cache config option "
    "default current next previous parent child root start end begin finish first last min max sum total average "
    "time date day month year hour minute second version build release test check valid is has to from with for by "
    "create update delete insert select find search filter sort group join merge split parse format convert encode "
    "decode load save store fetch send receive request response client server host port address session process thread "
    "task job worker queue pool lock manager handler factory provider service controller model view component module "
    "package class function method object instance string number integer float boolean array dict tuple http www com org"
).split()


class MarkovPair:
    """Two second-order models over characters, smoothed by first-order ones; score is the mean log-likelihood ratio of
    a character after the two before it."""

    def __init__(self, labelled: Iterable[tuple[str, int]], smoothing: float = 0.5, trust: float = 4.0):
        one, two = np.full((2, SIZE, SIZE), smoothing), np.zeros((2, SIZE * SIZE, SIZE))
        for text, label in labelled:
            c = _codes(text)
            np.add.at(one[int(label)], (c[:-1], c[1:]), 1)
            np.add.at(two[int(label)], (c[:-2] * SIZE + c[1:-1], c[2:]), 1)
        lower = np.tile(one / one.sum(axis=2, keepdims=True), (1, SIZE, 1))
        logs = np.log((two + trust * lower) / (two.sum(axis=2, keepdims=True) + trust))
        self.ratio = (logs[1] - logs[0]).astype(np.float32)

    def score(self, text: str) -> float:
        c = _codes(text)
        return float(self.ratio[c[:-2] * SIZE + c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8) & 127]


def corpus_words(docs: DataFrame, text_col: str = "text", max_rows: int = 20_000, most: int = 20_000) -> list[str]:
    """Words of 2 to 24 ASCII letters that occur at least twice in a sample of about max_rows rows, the most frequent
    first, at most as many as asked for: a bounded sample that ordinary identifiers are made of."""
    n = docs.count()
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).sample(min(1.0, max_rows / max(1, n)), seed=7)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(_PLAIN.findall(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


_PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_=-])")


def _patterned(r: random.Random) -> str:
    """One character again and again, a small number filled with zeros, or ascending digits."""
    kind, length = r.randrange(4), r.randint(LEAST, 48)
    if kind < 2:
        return r.choice(("-=_+/", string.ascii_letters + string.digits)[kind]) * length
    if kind == 2:
        return str(r.randint(0, 999)).zfill(length)
    return (string.digits * 6)[(at := r.randrange(10)) : at + length]


def labelled_samples(words: Iterable[str] = (), n: int = 12_000, seed: int = 7) -> list[tuple[str, int]]:
    """n labelled strings by rule: 1 for random ones over usual key alphabets, 0 for ordinary ones. One in sixteen of those is a
    ruler, a counter or a row of one character; of the others half are made of the words given, half of the fixed ones, in
    the styles of programs, paths and headlines."""
    r = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", "0123456789abcdef", "0123456789ABCDEF", string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.digits)
    given = list(words)
    styles = ("_".join, "-".join, lambda w: w[0] + "".join(x.title() for x in w[1:]), "/".join, "".join, lambda w: "_".join(w).upper(), lambda w: "".join(w).upper(), lambda w: "".join(w).title())
    out = []
    for i in range(n // 2):
        out.append(("".join(r.choices(kinds[i % len(kinds)], k=r.randint(LEAST, 48))), 1))
        if i % 16 == 0:
            out.append((_patterned(r), 0))
            continue
        source = given if given and i % 2 else IDENTIFIER_WORDS
        made = styles[(i // 2) % len(styles)](r.choices(source, k=r.randint(1 if source is given else 2, 6)))
        out.append((made + (str(r.randint(0, 2030)) if r.random() < 0.4 else ""), 0))
    return out


def fit(labelled: Iterable[tuple[str, int]] | None = None, holdout_every: int = 5, alarm: float = 10.0) -> tuple[MarkovPair, float, float]:
    """The models, the threshold that parts the held-out samples best, and their accuracy there. alarm: how many
    missed random strings a false alarm weighs, as ordinary strings are the most by far."""
    rows = list(labelled) if labelled is not None else labelled_samples()
    model = MarkovPair(x for i, x in enumerate(rows) if i % holdout_every)
    held = sorted((model.score(t), y) for i, (t, y) in enumerate(rows) if i % holdout_every == 0)
    cost = alarm * sum(1 - y for _, y in held)  # all above the threshold
    least, at, right = cost, -np.inf, sum(y for _, y in held)
    best = right
    for k, (s, y) in enumerate(held):
        cost += y - alarm * (1 - y)
        right += 1 - 2 * y
        if cost < least:
            least, best, at = cost, right, (s + held[k + 1][0]) / 2 if k + 1 < len(held) else s
    return model, float(at), best / max(1, len(held))


class SecretFinder:
    """Base spans by fixed patterns, and runs of LEAST or more key characters that look random to the models."""

    def __init__(self, model: MarkovPair, threshold: float):
        self.model, self.threshold = model, threshold

    def __call__(self, text: str) -> list[Span]:
        found: list[Span] = []
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text)]
        found += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
        reach, base, at = 0, sorted((a, b) for _, a, b, _ in found), 0
        for a, b in (m.span() for m in _LONG_RUN.finditer(text)):
            while at < len(base) and base[at][0] <= a:  # both are sorted: one pointer
                reach, at = max(reach, base[at][1]), at + 1
            if reach < b and (s := self.model.score(text[a:b])) > self.threshold:
                found.append(("random", a, b, s))
        return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


_LONG_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")


def scan_secrets(docs: DataFrame, labelled: Iterable[tuple[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """id and spans(kind, start, end, score) of each row, found in the whole text.

    labelled: strings with 1 for random and 0 for an identifier, a bounded sample; by default made by rule, of the
    words of about max_rows rows (corpus_words). The models are a table of 63 x 63 x 63 numbers, so what goes to the
    executors doesn't grow with the input. Every run of LEAST or more key characters is scored, and of those that look random the ones stay that no
    base span holds. Random digits differ least from ordinary numbers: about a quarter of 16 to 23 of them is missed (24 are a base span).
    A null text counts as empty and has no spans; each row is scanned by itself, so repeated rows, ties and
    empty tables need nothing special. Other columns are ignored.
    """
    model, threshold, _ = fit(labelled if labelled is not None else labelled_samples(corpus_words(docs, text_col, max_rows)))
    return scan_spans(docs, SecretFinder(model, threshold), id_col, text_col)
