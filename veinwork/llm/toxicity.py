"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactual sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, discard, keyed_text, materialise

#: Defaults of fit's bounds: labelled rows that it uses (the first by a hash of their id), features that it keeps, terms that
#: it may learn to swap and frequent words that tell their contexts.
MAX_ROWS, MAX_FEATURES, TERMS, NEIGHBOURS = 20_000, 6_000, 200, 200
#: Terms occur in such a share of the rows, lean to a label by fewer standard errors, and stand in contexts at least so alike.
RARE, COMMON, EVEN, ALIKE = 0.005, 0.5, 1.5, 0.2
PREFIXES = range(3, 9)
_WORDS_REMEMBERED = 500_000
_WORD = re.compile(r"[^\W\d_]+")

# Terms for groups of people, by kind and language. Swapped within a row, they must not move a score.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "american"), ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "citizen", "foreigner"), ("immigrants", "refugees", "citizens", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre", "niña", "niño"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)
_SWAP = {w: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, w in enumerate(row)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> tuple[str, ...]:
    """The word itself, and its beginnings with a mark that parts them from words."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if n <= len(word)))


def doc_features(words: Iterable[str]) -> set[str]:
    return {f for w in set(words) for f in features_of(w)}


def swapped(words: list[str], swap: dict[str, str] = _SWAP) -> list[str] | None:
    """The words with each term replaced by its partner; None without such terms."""
    out = [swap.get(w, w) for w in words]
    return out if out != words else None


class Classifier:
    """sigmoid(bias + sum of the weights of the features that occur). swap: the terms that were exchanged in training,
    twins: how many training rows have one."""

    def __init__(self, weights: dict[str, float], bias: float, swap: dict[str, str] | None = None, twins: int = 0):
        self.weights, self.bias, self.swap, self.twins = weights, bias, _SWAP if swap is None else swap, twins
        self._known: dict[str, tuple[str, ...]] = {}

    def logit(self, words: Iterable[str]) -> float:
        if len(self._known) > _WORDS_REMEMBERED:
            self._known.clear()
        hit: set[str] = set()
        for w in set(words):
            got = self._known.get(w)
            if got is None:
                got = self._known[w] = tuple(f for f in features_of(w) if f in self.weights)
            hit.update(got)
        return self.bias + sum(self.weights[f] for f in sorted(hit))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -35, 35))))

    def change(self, text: str) -> float | None:
        """How far the swap of its terms moves the text's logit; None without terms."""
        words = words_of(text)
        twin = swapped(words, self.swap)
        return None if twin is None else abs(self.logit(twin) - self.logit(words))


def even_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, limit: int = TERMS) -> tuple[list[str], list[str]]:
    """Words that lean to neither label, the most frequent first: candidates for a swap; and the words that tell contexts."""
    rows = toxic + clean
    words = sorted(((a + b, f) for f, (a, b) in counts.items() if not f.endswith("*")), key=lambda x: (-x[0], x[1]))
    found = []
    for n, f in words:
        odds, error = _odds(*counts[f], toxic, clean)
        if max(4, RARE * rows) <= n <= COMMON * rows and abs(odds) < EVEN * error:
            found.append(f)
    return found[:limit], [f for _, f in words[:NEIGHBOURS]]


def partners(terms: list[str], near: np.ndarray) -> dict[str, str]:
    """Pairs of terms in like contexts, each term in one pair at most, the most alike first. near: for each term how often
    each context word stands beside it, on either side."""
    if len(terms) < 2 or not near.sum():
        return {}
    expected = near.sum(axis=1, keepdims=True) * near.sum(axis=0, keepdims=True) / near.sum()
    told = np.maximum(0, np.log((near + 1e-9) / (expected + 1e-9)))
    told /= np.linalg.norm(told, axis=1, keepdims=True) + 1e-12
    alike = np.triu(np.round(told @ told.T, 9), 1)
    out: dict[str, str] = {}
    for i, j in sorted(zip(*np.nonzero(alike >= ALIKE), strict=True), key=lambda x: (-alike[x], x)):
        a, b = terms[i], terms[j]
        if a not in out and b not in out:
            out[a], out[b] = b, a
    return out


def _odds(a: float, b: float, toxic: int, clean: int) -> tuple[float, float]:
    """Smoothed log odds of a feature that a toxic and b clean rows have, and their standard error."""
    odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
    return odds, np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (clean - b + 0.5))


def select_features(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, limit: int = MAX_FEATURES, least: int = 4) -> list[str]:
    """Features that speak clearly for or against: smoothed log odds of 2.5 standard errors or more, strongest first."""
    scored = []
    for f, a, b in counts:
        if a + b >= least:
            odds, error = _odds(a, b, toxic, clean)
            if abs(odds) >= 2.5 * error:
                scored.append((-abs(odds / error), f))
    return [f for _, f in sorted(scored)[:limit]]


def _joined(lists: Sequence[Sequence[int]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(x, dtype=np.int64) for x in lists)])


def fit_weights(rows: Sequence[Sequence[int]], labels: np.ndarray, pairs: Sequence[tuple[int, Sequence[int]]], n_features: int, l2: float = 0.3, counterfactual: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss + l2 / rows * |w|^2 + counterfactual * mean squared change of the logit under a swap; Adam, full batches.

    rows: feature numbers of each document; pairs: (row, feature numbers after the swap).
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat = _joined(rows)
    twin_at = np.repeat(np.arange(len(pairs)), [len(p[1]) for p in pairs])
    twin_feat = _joined([p[1] for p in pairs])
    source = np.array([p[0] for p in pairs], dtype=np.int64)
    w, b = np.zeros(n_features), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v, mb, vb, rate = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0, 0.1
    for t in range(1, steps + 1):
        z = np.bincount(at, w[feat], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / len(rows)
        pull = np.zeros(len(rows))
        grad = 2 * l2 / len(rows) * w
        if len(pairs):
            change = 2 * counterfactual * (z[source] - b - np.bincount(twin_at, w[twin_feat], len(pairs))) / len(pairs)
            np.add.at(pull, source, change)
            grad = grad - np.bincount(twin_feat, change[twin_at], n_features)
        grad = grad + np.bincount(feat, (g + pull)[at], n_features)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * rate
        w = w - fix * m / (np.sqrt(v) + 1e-9)
        b -= fix * mb / (np.sqrt(vb) + 1e-9)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, max_terms: int = TERMS, counterfactual: float = 1.0) -> Classifier:
    """Learns from max_rows labelled rows at most; features are counted and looked up in tasks, so only their
    counts, and for each row the few features that were kept (max_features), come to the driver.

    In each row that has terms for groups (IDENTITY_TERMS) or learned terms, all of them are swapped, and the change of the row's logit is
    penalised. Learned are max_terms words at most that lean to neither label, in pairs that stand among like neighbours: what a
    text happens to be about must not move its score. Such words are features too, so that there is something to hold down.

    Rows without a text or label are not used; of rows that repeat an id the smallest text is. With no labelled rows, or labels of one kind, the classifier
    gives every text the share of toxic rows (a half if there are none).
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # Only the parts of the hashes that hold the first max_rows are sorted, as counted: ids that are repeated often lie together.
    parts = sorted(chosen.groupBy((place / (1 << 16)).cast("int").alias("part")).count().collect())
    ends = np.searchsorted(np.cumsum([r["count"] for r in parts]), max_rows)
    chosen = chosen.filter(place < (parts[ends].part + 1 << 16 if ends < len(parts) else 1 << 30))
    chosen = chosen.orderBy(place, "id", "label").limit(max_rows)
    texts = keyed_text(docs.filter(F.col(text_col).isNotNull()), id_col, text_col)
    if texts.schema["id"].dataType != chosen.schema["id"].dataType:  # ids of two types are compared as text
        texts, chosen = (x.withColumn("id", F.col("id").cast("string")) for x in (texts, chosen))
    rows = materialise(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text"), "tox-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        total = Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y > 0)].update(doc_features(words_of(t)))
                total[int(y > 0)] += 1
        names = list(seen[0].keys() | seen[1].keys())
        columns = [["", *names], [total[1], *(seen[1][f] for f in names)], [total[0], *(seen[0][f] for f in names)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialise(counts.withColumn("n", F.col("toxic") + F.col("clean")).filter("feature = '' OR n >= 4"), "tox-counts")
    whole = counts.filter("feature = ''").first()
    toxic, clean = (whole.toxic, whole.clean) if whole else (0, 0)
    if not toxic or not clean:
        share = np.clip(toxic / (toxic + clean) if toxic + clean else 0.5, 0.01, 0.99)
        return Classifier({}, float(np.log(share / (1 - share))))
    found = _leading(counts.filter("feature != ''"), toxic, clean, max_features, max_terms)
    terms, context = even_terms(found, toxic, clean, max_terms)
    pairs = partners(terms, _near(rows, terms, context))
    swap = {**_SWAP, **pairs}
    names = select_features(((f, *ab) for f, ab in found.items()), toxic, clean, max_features)
    names += sorted({*pairs, *(w for w in _SWAP if w in found)} - {*names})
    number = {f: i for i, f in enumerate(names)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, twins = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                twin = swapped(words, swap)
                own.append(sorted(number[f] for f in doc_features(words) if f in number))
                twins.append(None if twin is None else sorted(number[f] for f in doc_features(twin) if f in number))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, kind), pa.array(twins, kind)], names=["label", "own", "twin"])

    # As Arrow columns, 4 bytes a feature: as Python lists the same rows take many times the driver's memory.
    got = rows.mapInArrow(look_up, "label int, own array<int>, twin array<int>").toArrow().combine_chunks()
    lists = [[x.values.to_numpy() if x.is_valid else None for x in got.column(c)] for c in ("own", "twin")]
    twins = [(i, x) for i, x in enumerate(lists[1]) if x is not None]
    discard(rows, counts)
    weights, bias = fit_weights(lists[0], (got.column("label").to_numpy() > 0).astype(float), twins, len(names), counterfactual=counterfactual)
    return Classifier(dict(zip(names, weights.tolist(), strict=True)), bias, swap, len(twins))


def _leading(counts: DataFrame, toxic: int, clean: int, max_features: int, max_terms: int) -> dict[str, tuple[int, int]]:
    """Of all features counted, those that select_features and even_terms choose from: the max_features strongest, the max_terms most frequent words
    that lean to neither label, the NEIGHBOURS most frequent words, and the words of IDENTITY_TERMS."""
    a, b, rows = F.col("toxic"), F.col("clean"), toxic + clean
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (clean - b + 0.5))
    scored = counts.withColumn("z", F.abs(odds) / error)
    words, often = scored.filter(~F.col("feature").endswith("*")), (F.desc("n"), "feature")
    lists = (
        scored.filter(F.col("z") > 2.5 - 1e-9).orderBy(F.desc("z"), "feature").limit(max_features),
        words.filter((F.col("n") >= RARE * rows) & (F.col("n") <= COMMON * rows) & (F.col("z") < EVEN + 1e-9)).orderBy(*often).limit(max_terms),
        words.orderBy(*often).limit(NEIGHBOURS),
        words.filter(F.col("feature").isin(*_SWAP)),
    )
    return {r.feature: (r.toxic, r.clean) for found in lists for r in found.collect()}


def _near(rows: DataFrame, terms: list[str], context: list[str]) -> np.ndarray:
    """How often each context word stands right before (first half of the columns) and right after each term."""
    place, column = {t: i for i, t in enumerate(terms)}, {c: i for i, c in enumerate(context)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                words = words_of(t)
                for x, y in zip(words, words[1:], strict=False):
                    if y in place and x in column:
                        seen[place[y], column[x]] += 1
                    if x in place and y in column:
                        seen[place[x], len(context) + column[y]] += 1
        found = [(*k, n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["term", "side", "n"])

    out = np.zeros((len(terms), 2 * len(context)))
    for r in rows.mapInArrow(count, "term bigint, side bigint, n bigint").groupBy("term", "side").agg(F.sum("n").alias("n")).collect():
        out[r.term, r.side] = r.n
    return out


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row, from the whole text alone. Null and empty texts get the score of no features;
    repeated rows get equal scores; an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores below the threshold; nothing is shuffled. A null text counts as empty.
    A classifier that learned no feature (without labels, or with labels of one kind) tells no text from another and rejects none."""
    if not model.weights:
        return docs
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t or "") < threshold for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
