"""A log-bilinear language model over word classes, trained by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, keyed_text, materialise
from veinwork.llm.words import Words

#: Most frequent words, each a class of its own; the finest tail classes of all other words, by their last two bytes;
#: words whose counts the tasks hold at least (the counts of all others are joined); sizes of the vectors and batches.
OWN, TAIL_HASHES, HELD, WIDTH, BATCH = 64, 4096, 50_000, 24, 2048
#: Noise classes that a batch shares; noise words of the same class for each word; tokens and tokens for each vector
#: that a task learns between two averagings; one in so many documents tells when to stop.
NOISE, INNER, SHARD, SHARD_X, ASIDE = 48, 3, 1 << 20, 128, 64
#: Words with vectors for each cube root of tokens; tail classes for each square root of those words.
MEMBERS, TAILS = 32, 2.0
#: A corpus of fewer tokens is gone through again until so many have been learned, or a pass gains less than GAIN, in log10 a token.
LEARN, GAIN = 1 << 24, 0.005
RATE = 0.12
_REMEMBERED = 300_000
#: The end of a text, as a word that no text can hold.
END = b"\n"


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, parted by ASCII white space, and the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def tail_of(word: bytes) -> int:
    """By the last two bytes, and within those by the first."""
    return xxhash.xxh32_intdigest(word[-2:]) % (TAIL_HASHES // 8) * 8 + xxhash.xxh32_intdigest(word[:1]) % 8


def tail_classes(tokens: np.ndarray, tails: int) -> np.ndarray:
    """The class of each tail hash: neighbours in order, so words that end alike, in classes of about as many tokens."""
    weight = tokens + 1e-9
    return OWN + np.minimum(((np.cumsum(weight) - weight / 2) / weight.sum() * tails).astype(np.int64), tails - 1)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def word_counts(rows: DataFrame) -> DataFrame:
    """hash, tail and count of every word of all rows(text): tasks count first, the sums are written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, ...]] = []

        def summed() -> tuple[np.ndarray, ...]:
            words, tails, counts = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(words)
            first = np.flatnonzero(np.diff(words[order], prepend=words[order[0]] - 1))
            return words[order][first], tails[order][first], np.add.reduceat(counts[order], first)

        for b in batches:
            if not b.num_rows:
                continue
            found = Words.of(b.column(0), END)
            seen.append((found.hashes(), found.by_ends(tail_of, 8), np.bincount(found.at, minlength=len(found.size))))
            if sum(len(x) for x, _, _ in seen) > 4 * _REMEMBERED:
                seen = [summed()]
                if len(seen[0][0]) > _REMEMBERED:
                    yield _counted(*seen.pop())
        if seen:
            yield _counted(*summed())

    return materialise(rows.select("text").mapInArrow(count, "hash bigint, tail int, count bigint").groupBy("hash").agg(F.first("tail").alias("tail"), F.sum("count").alias("count")), "lm-counts")


def _counted(words: np.ndarray, tails: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Without the empty part that white space may have left, which no text counts."""
    met = counts > 0
    return pa.RecordBatch.from_arrays([pa.array(words[met], pa.int64()), pa.array(tails[met], pa.int32()), pa.array(counts[met], pa.int64())], names=["hash", "tail", "count"])


def members_of(tokens: int) -> int:
    """How many words of the tail classes have vectors of their own: grows with the corpus, slowly enough that a task can hold them all."""
    return int(MEMBERS * np.cbrt(tokens))


def tails_of(tokens: int) -> int:
    """Tail classes, a power of two that divides TAIL_HASHES: about as many as members in a class."""
    return int(np.clip(2 ** np.ceil(np.log2(1 + TAILS * np.sqrt(members_of(tokens)))), 32, TAIL_HASHES))


@dataclass
class Vocabulary:
    """What tasks know about words: the most frequent ones, and sums for each class.

    A word's place is its class, or that of the tail class after the last plus m if it is member m of a tail class. A tail class's own place
    stands for those of its words that are no members.
    """

    held: dict[int, tuple[int, int]]  # hash -> place, count
    tokens: int
    types: int
    tail_class: np.ndarray  # of each tail hash
    classes: np.ndarray  # tokens of each class
    spread: np.ndarray  # log10 of tokens + types + 1 of a class's words that are no members; 0 for a word of its own
    member_class: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    member_count: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        """Reads one row for each tail class and the most frequent words: HELD rows at most, or as many as have vectors.

        Which counts are frequent enough is read off a histogram of them, so no task sends more than is held.
        """
        per_tail = {r.tail: (r.tokens, r.types) for r in counts.groupBy("tail").agg(F.sum("count").alias("tokens"), F.count("*").alias("types")).collect()}
        tokens, types = (sum(x[i] for x in per_tail.values()) for i in (0, 1))
        tails, most = tails_of(tokens), max(HELD, 2 * (OWN + members_of(tokens)))
        step = (F.log2("count") * 16).cast("int")
        sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least = next((s + 1 for (s, _), total in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if total > most), 0)
        top = sorted(counts.filter((step >= least) | (F.col("hash") == _hash(END))).collect(), key=lambda r: (-r["count"], r.hash))
        classes, kinds, own = np.zeros(OWN + tails), np.zeros(OWN + tails), top[:OWN]
        left = np.zeros((2, TAIL_HASHES))
        for t, found in per_tail.items():
            left[:, t] = found
        for i, r in enumerate(own):
            classes[i] = r["count"]
            left[:, r.tail] -= r["count"], 1
        tail_class = tail_classes(left[0], tails)
        classes += np.bincount(tail_class, left[0], OWN + tails)
        kinds += np.bincount(tail_class, left[1], OWN + tails)
        members = top[OWN : OWN + members_of(tokens)]
        held = {r.hash: (i if i < OWN else tails + i if i < OWN + len(members) else int(tail_class[r.tail]), r["count"]) for i, r in enumerate(top)}
        member_class = np.array([tail_class[r.tail] for r in members], dtype=np.int64)
        member_count = np.array([r["count"] for r in members], dtype=float)
        others = classes - np.bincount(member_class, member_count, OWN + tails)
        spread = np.log10(others + kinds - np.bincount(member_class, minlength=OWN + tails) + 1)
        spread[:OWN] = 0
        return cls(held, tokens, types, tail_class, classes, spread, member_class, member_count)

    @property
    def top(self) -> np.ndarray:
        """The class of each place."""
        return np.concatenate([np.arange(len(self.classes)), self.member_class])

    @property
    def inner(self) -> np.ndarray:
        """The tokens of each place, half a one more."""
        others = self.classes - np.bincount(self.member_class, self.member_count, len(self.classes))
        return np.concatenate([others, self.member_count]) + 0.5

    @property
    def noise(self) -> np.ndarray:
        p = self.classes + 0.5
        return p / p.sum()

    @property
    def narrow(self) -> str:
        """The type that places are written in."""
        return "<u2" if len(self.classes) + len(self.member_class) <= 1 << 16 else "<u4"


class Codes:
    """Numbers of the held words, in the vocabulary's order."""

    def __init__(self, vocabulary: Vocabulary):
        hashes = np.array(list(vocabulary.held), dtype=np.int64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.tail_class = vocabulary.tail_class
        self.held_places = np.array([c for c, _ in vocabulary.held.values()], dtype=np.int32)

    def __getitem__(self, word: bytes) -> int:
        return int(self.numbers(np.array([_hash(word)]))[0])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of words by their hashes; -1 for one that isn't held."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def classes(self) -> np.ndarray:
        """The places of the held words."""
        return self.held_places

    def places(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """The place of each word: of one that isn't held, that of its tail class."""
        return np.where(numbers >= 0, self.held_places[numbers], self.tail_class[words.by_ends(tail_of, 8)]).astype(np.int32)


@dataclass
class Parameters:
    """For q = near * R[a] + far * R[b], with a the place of the word before and b of the one before that: a class
    scores (q, 1) . Q[class], a place within its class (q, 1) . S[place]. mix holds near and far."""

    R: np.ndarray
    S: np.ndarray
    Q: np.ndarray
    mix: np.ndarray

    NAMES = ("R", "S", "Q", "mix")

    @classmethod
    def start(cls, noise: np.ndarray, shares: np.ndarray, seed: int = 3) -> Parameters:
        """shares: of the places in their classes."""
        r = np.random.default_rng(seed)
        classes, places = r.normal(0, 0.3, (len(noise), WIDTH)), r.normal(0, 0.1, (len(shares), WIDTH))
        return cls(r.normal(0, 0.3, (len(shares), WIDTH)), np.column_stack([places, np.log(shares)]), np.column_stack([classes, np.log(noise)]), np.vstack([np.full(WIDTH, 0.5), np.full(WIDTH, 0.2)]))

    def changed(self, change) -> Parameters:
        """change(name, table) for each table."""
        return Parameters(*(change(n, getattr(self, n)) for n in self.NAMES))


class Inner:
    """The places of each class, and the share that each has of its class's tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.top = vocabulary.top
        n = len(vocabulary.classes)
        self.slots = np.argsort(self.top, kind="stable")
        self.first = np.searchsorted(self.top[self.slots], np.arange(n + 1))
        self.at = np.empty(len(self.top), dtype=np.int64)  # of each place within its class
        self.at[self.slots] = np.arange(len(self.top)) - self.first[self.top[self.slots]]
        self.size = np.diff(self.first)
        tokens = vocabulary.inner
        self.share = tokens / np.bincount(self.top, tokens, n)[self.top]


@dataclass
class Learned:
    """Parameters, and for each row of a table the sum of squares that AdaGrad divides by."""

    now: Parameters
    squares: Parameters

    @classmethod
    def start(cls, parameters: Parameters) -> Learned:
        return cls(parameters.changed(lambda _, x: x.astype(np.float32)), parameters.changed(lambda _, x: np.full(len(x), 1e-2, dtype=np.float32)))

    def blocks(self, weights: Parameters) -> Iterator[tuple[int, bytes, bytes]]:
        """Number, rows (parameters and squares) and the rows' weights, BLOCK rows at a time."""
        k = 0
        for n in Parameters.NAMES:
            rows, w = np.column_stack([getattr(self.now, n), getattr(self.squares, n)]).astype(np.float32), getattr(weights, n).astype(np.float32)
            for i in range(0, len(rows), BLOCK):
                yield k, rows[i : i + BLOCK].tobytes(), w[i : i + BLOCK].tobytes()
                k += 1

    def filled(self, blocks: list[bytes]) -> Learned:
        """The same tables with the values of blocks in their order."""
        now, squares, k = {}, {}, 0
        for n in Parameters.NAMES:
            size, width = getattr(self.now, n).shape
            count = -(-size // BLOCK)
            rows = np.frombuffer(b"".join(blocks[k : k + count]), dtype=np.float32).reshape(size, width + 1)
            now[n], squares[n], k = rows[:, :-1].copy(), rows[:, -1].copy(), k + count
        return Learned(Parameters(**now), Parameters(**squares))


BLOCK = 1024


class Trainer:
    """Noise-contrastive estimation by AdaGrad with a step size for each row, BATCH tokens at a time, drawn from
    texts that stand together. Classes are told from NOISE classes that a batch shares, the words of a tail class from
    INNER other words that the batch has of it, as its tokens are drawn from the corpus like the noise should be."""

    def __init__(self, start: Learned, noise: np.ndarray, inner: Inner, seed: int):
        self.p = {n: getattr(start.now, n).astype(np.float32) for n in Parameters.NAMES}
        self.g = {n: getattr(start.squares, n).astype(np.float32) for n in Parameters.NAMES}
        self.seen = {n: np.full(len(v), 1e-6) for n, v in self.p.items()}
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.top, self.log_inner = inner.top, np.log(inner.share * INNER).astype(np.float32)
        self.up_to = np.cumsum(noise)[:-1]
        self.random = np.random.default_rng(seed)
        self.key = np.uint16 if len(self.top) <= 1 << 16 else np.int64

    def learn_texts(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        mixed = self.random.permutation(len(place))
        a, b, place = a[mixed], b[mixed], place[mixed]
        for i in range(0, len(place), BATCH):
            self.learn(a[i : i + BATCH], b[i : i + BATCH], place[i : i + BATCH])

    def learn(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        p, n, w = self.p, len(place), self.top[place]
        order = np.argsort(w.astype(self.key), kind="stable")
        a, b, place, w = a[order], b[order], place[order], w[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        size = np.diff(np.concatenate([first, [n]]))
        false = np.searchsorted(self.up_to, self.random.random(NOISE))
        ra, rb = p["R"][a], p["R"][b]
        q = np.ones((n, WIDTH + 1), dtype=np.float32)
        q[:, :-1] = ra * p["mix"][0] + rb * p["mix"][1]
        target, wrong = np.repeat(p["Q"][w[first]], size, axis=0), p["Q"][false]
        up = _sigmoid(self.log_noise[w] - np.einsum("ij,ij->i", q, target))
        against = -wrong
        against[:, -1] += self.log_noise[false]
        down = q @ against.T
        np.minimum(down, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        target *= up[:, None]
        target += down @ wrong
        pull = target[:, :-1]
        tail = int(np.searchsorted(w, OWN))
        if tail < n:
            k = int(np.searchsorted(first, tail))
            pull[tail:] += self._learn_inner(q[tail:], place[tail:], first[k:] - tail, size[k:], n)
        gq = np.zeros_like(p["Q"])
        gq[w[first]] = np.add.reduceat(up[:, None] * q, first)
        np.add.at(gq, false, down.T @ q)
        both = np.empty((2 * n, WIDTH), dtype=np.float32)
        np.multiply(pull, p["mix"][0], out=both[:n])
        np.multiply(pull, p["mix"][1], out=both[n:])
        self._step("mix", np.vstack([np.einsum("ij,ij->j", pull, ra), np.einsum("ij,ij->j", pull, rb)]), n, slice(None), n)
        self._step("R", *_row_sums(np.concatenate([a, b]).astype(self.key), both, n))
        self._step("Q", gq, n, slice(None), n)

    def _learn_inner(self, q: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """The pull on q. Tokens stand by class; first and size are those of the classes."""
        start, many = np.repeat(first, size), np.repeat(size, size)
        at, s = np.arange(len(place)) - start, self.p["S"][place]
        several = (many > 1).astype(np.float32)  # a word alone in its class has no noise here
        log_share = self.log_inner[place]
        up = _sigmoid(log_share - np.einsum("ij,ij->i", q, s)) * several
        pull, rows = up[:, None] * s, up[:, None] * q
        for u in self.random.random((INNER, len(first))):
            shift = np.repeat(1 + (u * np.maximum(size - 1, 1)).astype(np.int64), size)
            other = start + (at + shift) % many
            wrong = s[other]
            down = -_sigmoid(np.einsum("ij,ij->i", q, wrong) - log_share[other]) * several
            wrong *= down[:, None]
            pull += wrong
            back = start + (at - shift) % many
            rows += (down[:, None] * q)[back]
        self._step("S", *_row_sums(place.astype(self.key), rows, n))
        return pull[:, :-1]

    def _step(self, name: str, grad: np.ndarray, n: int, rows: np.ndarray | slice, times: np.ndarray | int) -> None:
        grad = grad * np.float32(64 / n)
        self.seen[name][rows] += times
        self.g[name][rows] += np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        self.p[name][rows] += grad * (np.float32(RATE) / np.sqrt(self.g[name][rows]))[:, None]

    def state(self) -> Iterator[tuple[int, bytes, bytes]]:
        return Learned(Parameters(**self.p), Parameters(**self.g)).blocks(Parameters(**self.seen))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _row_sums(at: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Sums of rows that belong to the same place, n, the places, and how often each occurs."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    size = np.diff(np.concatenate([first, [len(at)]]))
    # Most places occur once or twice: only the others are worth a reduceat, whose time goes by the number of places.
    sums = rows[order[first]]
    twice = np.flatnonzero(size > 1)
    sums[twice] += rows[order[first[twice] + 1]]
    often = twice[size[twice] > 2]
    if len(often):
        left = size[often] - 2
        start = np.cumsum(left) - left
        rest = np.arange(start[-1] + left[-1]) + np.repeat(first[often] + 2 - start, left)
        sums[often] += np.add.reduceat(rows[order[rest]], start)
    return sums, n, at[first].astype(np.int64), size


def contexts(codes: list[np.ndarray], classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of the word before, of the one before that, and of each word; before a text stand two ends."""
    pad = np.array([end, end], dtype=np.int32)
    whole = np.concatenate([x for c in codes for x in (pad, classes[c])])
    keep = np.ones(len(whole), dtype=bool)
    starts = np.cumsum([0] + [len(c) + 2 for c in codes[:-1]])
    keep[starts] = keep[starts + 1] = False
    at = np.flatnonzero(keep)
    return whole[at - 1], whole[at - 2], whole[at]


def _encoded(rows: DataFrame, vocabulary: Vocabulary, shards: int, wide: int) -> DataFrame:
    """slice, shard and places of each text of rows(id, text); the slice after the last is set aside.

    Texts are dealt by a hash of their row, so shards don't depend on how the table is partitioned.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        for b in batches:
            if b.num_rows:
                words = Words.of(b.column(1), END)
                places = codes.places(words, codes.numbers(words.hashes())).astype(vocabulary.narrow)[words.at]
                got = np.split(places, np.cumsum(words.tokens)[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in got], pa.binary())], names=["dealt", "places"])

    hashed = rows.select(F.xxhash64("id", "text").alias("dealt"), "text")
    codes = hashed.mapInArrow(encode, "dealt bigint, places binary")
    last = -(-shards // wide)
    aside = F.pmod("dealt", F.lit(ASIDE)) == 0
    drawn = F.pmod(F.xxhash64("dealt"), F.lit(shards)).cast("int")
    few = F.pmod(F.xxhash64("dealt"), F.lit(-(-shards // ASIDE))).cast("int")
    dealt = codes.withColumn("shard", F.when(aside, shards + few).otherwise(drawn))
    dealt = dealt.withColumn("slice", F.when(aside, last).otherwise((F.col("shard") / wide).cast("int")))
    return materialise(dealt.repartition("shard").sortWithinPartitions("slice", "shard", "dealt"), "lm-places", "slice")


def _batches_of(batches: Iterator[pa.RecordBatch], narrow: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """shard and places of texts that stand together."""
    for b in batches:
        shard = b.column(0).to_numpy(zero_copy_only=False)
        places = [np.frombuffer(x, dtype=narrow).astype(np.int32) for x in b.column(1).to_pylist()]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j > i:
                yield int(shard[i]), places[i:j]


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = 1) -> Parameters:
    """Passes over all texts, rounds of them at least; a small corpus is gone through again until LEARN tokens are learned or
    a pass gains less than GAIN on the texts set aside; those are then learned too.

    A pass goes through slices. The shards of a slice, SHARD tokens each or SHARD_X for each vector, are learned side by side from the same
    start; their rows, weighted by how often each shard met them, are averaged and start the next slice. There are as many slices as
    the cube root of the shards: updates one after another grow with the corpus, whatever its partitions are, and
    what is averaged grows no faster than the corpus.
    """
    noise, inner = vocabulary.noise, Inner(vocabulary)
    now = Learned.start(Parameters.start(noise, inner.share))
    if not vocabulary.tokens:
        return now.now
    shards = -(-vocabulary.tokens // max(SHARD, SHARD_X * len(inner.top)))
    slices = int(np.ceil(np.cbrt(shards)))
    wide = -(-shards // slices)
    slices = -(-shards // wide)
    texts = _encoded(rows, vocabulary, shards, wide)
    aside = texts.filter(F.col("slice") == slices).select("shard", "places")
    before, done = -np.inf, 0
    while True:
        for k in range(slices):
            now = _round(texts.filter(F.col("slice") == k).select("shard", "places"), vocabulary, now, done * slices + k)
        done += 1
        if done >= rounds and done * vocabulary.tokens >= LEARN:
            break
        gained = _mean_score(aside, vocabulary, now.now)
        if done >= rounds and (gained is None or gained < before + GAIN):
            break
        before = -np.inf if gained is None else gained
    return _round(aside, vocabulary, now, done * slices).now


def _mean_score(rows: DataFrame, vocabulary: Vocabulary, p: Parameters) -> float | None:
    end = vocabulary.held[_hash(END)][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, places = Scorer(vocabulary, p), np.arange(len(p.R))
        for _, got in _batches_of(batches, vocabulary.narrow):
            scores = scorer.classes(*contexts(got, places, end))
            yield pa.RecordBatch.from_arrays([pa.array([float(scores.sum())]), pa.array([len(scores)], pa.int64())], names=["total", "n"])

    r = rows.mapInArrow(run, "total double, n bigint").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    return r.total / r.n if r.n else None


def _round(rows: DataFrame, vocabulary: Vocabulary, start: Learned, r: int) -> Learned:
    end, noise = vocabulary.held[_hash(END)][0], vocabulary.noise

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, places = Inner(vocabulary), np.arange(len(start.now.R))

        def state_of(trainer: Trainer) -> pa.RecordBatch:
            at, values, weights = zip(*trainer.state(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.binary()), pa.array(weights, pa.binary())], names=["at", "part", "weights"])

        trainer, last = None, None
        for shard, got in _batches_of(batches, vocabulary.narrow):
            if shard != last:
                if trainer:
                    yield state_of(trainer)
                trainer, last = Trainer(start, noise, inner, r * 1_000_003 + shard), shard
            trainer.learn_texts(*contexts(got, places, end))
        if trainer:
            yield state_of(trainer)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = np.frombuffer(weights, dtype=np.float32).astype(np.float64)
                sums[at] = sums.get(at, 0) + np.frombuffer(part, dtype=np.float32).reshape(len(w), -1) * w[:, None]
                total[at] = total.get(at, 0) + w
        means = [(x / total[at][:, None]).astype(np.float32).tobytes() for at, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], names=["at", "part"])

    parts = rows.mapInArrow(learn, "at bigint, part binary, weights binary").repartition("at").mapInArrow(add, "at bigint, part binary").collect()
    if not parts:
        return start
    rows.sparkSession._jvm.System.gc()  # lets Spark delete the shuffles of earlier rounds
    return start.filled([x.part for x in sorted(parts, key=lambda x: x.at)])


class Scorer:
    """log10 probabilities of places, normalised over all classes and over the places of a class."""

    def __init__(self, vocabulary: Vocabulary, p: Parameters):
        self.p = {n: getattr(p, n).astype(np.float32) for n in Parameters.NAMES}
        self.inner = Inner(vocabulary)
        self.spread = np.concatenate([vocabulary.spread, np.zeros(len(vocabulary.member_class))])

    def classes(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(place) - log10 of the size of what shares it; a word that is no member still needs log10(count + 1)."""
        r, mix = self.p["R"], self.p["mix"]
        pairs, which = np.unique(a.astype(np.int64) * len(r) + b, return_inverse=True)
        order = np.argsort(self.inner.top[w].astype(np.uint16 if len(self.p["Q"]) <= 1 << 16 else np.int64), kind="stable")
        w, which = w[order], which[order]
        top = self.inner.top[w]
        q = np.ones((len(pairs), WIDTH + 1), dtype=np.float32)
        np.multiply(r[pairs // len(r)], mix[0], out=q[:, :-1])
        q[:, :-1] += r[pairs % len(r)] * mix[1]
        small = not len(q) or _reach(q, self.p["S"]) < 80
        total = self._totals(pairs // len(r), pairs % len(r), q)
        found = np.empty(len(w), dtype=np.float32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]])
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            c = top[first]
            members = self.inner.slots[self.inner.first[c] : self.inner.first[c + 1]]
            s = np.ascontiguousarray(self.p["S"][members].T)
            step = max(_ROWS, _ROWS * _CLASSES // len(members))
            for i in range(first, end, step):
                j = min(i + step, end)
                mine = q[which[i:j]]
                found[i:j] = mine @ self.p["Q"][c]
                if len(members) > 1:
                    logits = mine @ s
                    found[i:j] += logits[np.arange(j - i), self.inner.at[w[i:j]]]
                    found[i:j] -= _log_sums(logits, small)
        out = np.empty(len(w))
        out[order] = (found - total[which]) / np.log(10) - self.spread[w]
        return out

    def _totals(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all classes of exp(q . Q) for each pair of places.

        exp(near * R[a] . Q + far * R[b] . Q) is a product of one factor for each place, so exponentials are taken for the places that
        occur and not for their pairs, some classes at a time. Where the factors of a place that stands earlier reach too far apart for that, they are taken for the pairs.
        """
        total = np.zeros(len(a), dtype=np.float32)
        classes, r, mix = np.ascontiguousarray(self.p["Q"].T), self.p["R"], self.p["mix"]
        (x, at), (y, earlier) = _numbered(a, len(r)), _numbered(b, len(r))
        near, far = np.ones((len(x), WIDTH + 1), dtype=np.float32), np.zeros((len(y), WIDTH + 1), dtype=np.float32)
        near[:, :-1], far[:, :-1] = r[x] * mix[0], r[y] * mix[1]
        if not len(a) or _reach(far, self.p["Q"], False) >= 30:
            for i in range(0, len(q), _ROWS):
                total[i : i + _ROWS] = _log_sums(q[i : i + _ROWS] @ classes, False)
            return total
        blocks = [np.ascontiguousarray(classes[:, k : k + _TOGETHER]) for k in range(0, classes.shape[1], _TOGETHER)]
        most = np.max([(near @ c).max(axis=1) for c in blocks], axis=0)
        for c in blocks:
            one, other = near @ c, far @ c
            one -= most[:, None]
            np.exp(one, out=one)
            np.exp(other, out=other)
            for i in range(0, len(a), _PAIRS):
                total[i : i + _PAIRS] += np.einsum("ij,ij->i", one[at[i : i + _PAIRS]], other[earlier[i : i + _PAIRS]])
        return np.log(total, out=total) + most[at]


def _numbered(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, and the number of each among them."""
    met = np.zeros(n, dtype=bool)
    met[places] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[places]


def _reach(q: np.ndarray, rows: np.ndarray, whole: bool = True) -> float:
    """A bound of |q . row|; the last column of q holds 1, or, without whole, 0."""
    lengths = (float(np.sqrt(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]).max())) for x in (q, rows))
    return float(np.prod(list(lengths))) + (float(np.abs(rows[:, -1]).max()) if whole else 0.0)


#: Rows of a piece of work, so that its logits stay in the processor's cache.
_ROWS, _CLASSES = 256, 256
#: Classes whose factors stand side by side, and pairs of places that are worked on together.
_TOGETHER, _PAIRS = 64, 1024


def _log_sums(logits: np.ndarray, small: bool) -> np.ndarray:
    """Changes logits. Where their exponentials may leave the range, the largest is taken off first."""
    most = 0 if small else logits.max(axis=1)
    if not small:
        logits -= most[:, None]
    np.exp(logits, out=logits)
    return most + np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype))


def score(docs: DataFrame, train_on: Column, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    train_on: which rows are learned from; a null there counts as false. base_score is the log10 probability
    by add-one counts. In the model a word's probability is that of its class, given the two words before, times
    that of itself within the class, given them too. The words of a class without vectors share one place in it by
    (count + 1) / (tokens + types + 1 of these words), so one unknown word of each class has a share too, and
    all probabilities add up to 1. The number of words with vectors grows with the corpus (members_of). Counts cover all training texts: the most frequent words' are held by the
    tasks, all others' are joined by the word's 64-bit hash, after a task has summed its own.

    A null or empty text is its end alone. Without training texts every word is unknown and the classes are even.
    Every row is scored by itself, whatever its id is: rows with one id and different texts, or without an id, keep
    their own scores, and equal rows come back as often as they are there. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    marked = docs.withColumn("_train", F.coalesce(train_on, F.lit(False)))
    rows = keyed_text(marked, id_col, text_col)
    training = keyed_text(marked.filter("_train"), id_col, text_col)
    counts = word_counts(training)
    vocabulary = Vocabulary.of(counts)
    vocabulary.held.setdefault(_hash(END), (0, 0))
    scorer = Scorer(vocabulary, train(training, vocabulary, rounds))
    end = vocabulary.held[_hash(END)][0]
    held_counts = np.array([c for _, c in vocabulary.held.values()], dtype=np.int64)
    kind = rows.schema["id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what this task knows, dealt at random, and one for each of its words whose count it must ask for."""
        codes, spread = Codes(vocabulary), np.random.default_rng(1)
        for b in batches:
            if not b.num_rows:
                continue
            words = Words.of(b.column(1), END)
            hashes, n, at = words.hashes(), words.tokens, words.at
            numbers = codes.numbers(hashes)
            held = numbers >= 0
            counted = np.where(held, held_counts[numbers], 0)
            first = np.cumsum(n) - n
            before, earlier, places = contexts(np.split(at, first[1:]), codes.places(words, numbers), end)
            model = np.add.reduceat(scorer.classes(before, earlier, places).astype(float), first)
            log = np.log10(counted + 1)[at]
            model += np.add.reduceat(np.where((places >= OWN) & (places < len(vocabulary.classes)), log, 0.0), first)
            seen = np.add.reduceat((counted > 0)[at].astype(np.int64), first)
            asked = ~held[at]
            pair, times = np.unique(np.repeat(np.arange(len(n)), n)[asked] * np.int64(1 << 32) + at[asked], return_counts=True)
            asks = len(pair)
            who = np.concatenate([np.arange(len(n)), pair >> 32])
            key = np.array([_hash(t.encode()) for t in b.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(who)),
                    pa.array(key[who]),
                    pa.array(np.concatenate([spread.integers(-(1 << 63), 1 << 63, len(n)), hashes[pair & 0xFFFFFFFF]])),
                    pa.array(np.concatenate([np.zeros(len(n), dtype=np.int32), times.astype(np.int32)])),
                    pa.array(np.concatenate([n, np.zeros(asks, dtype=np.int64)])),
                    pa.array(np.concatenate([seen, np.zeros(asks, dtype=np.int64)])),
                    pa.array(np.concatenate([np.add.reduceat(log, first), np.zeros(asks)])),
                    pa.array(np.concatenate([model, np.zeros(asks)])),
                ],
                names=["id", "key", "hash", "asked", "n_tokens", "n_known", "log", "score"],
            )

    split = rows.mapInArrow(parts, f"id {kind}, key bigint, hash bigint, asked int, n_tokens bigint, n_known bigint, log double, score double")
    rare = counts.select("hash", "count")
    met = split.join(rare, "hash", "left").withColumn("found", F.when(F.col("asked") > 0, F.coalesce("count", F.lit(0))).otherwise(F.lit(0)))
    more = F.col("asked") * F.log10(F.col("found") + 1)
    # Rows with the same id and text are one group here: its sums hold each of their parts so many times, and they part again after it.
    times = F.sum(F.when(F.col("asked") == 0, 1).otherwise(0))
    summed = met.groupBy("id", "key").agg(
        times.alias("times"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("found") > 0, F.col("asked")).otherwise(0)).alias("n_known"),
        F.sum(F.col("log") + more).alias("log"),
        F.sum(F.col("score") + more).alias("score"),
    )
    each = summed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    per_token = float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    whole = {c: (F.col(c) / F.col("times")).cast("long") for c in ("n_tokens", "n_known")}
    return each.select(
        F.col("id").alias(id_col),
        *(v.alias(c) for c, v in whole.items()),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        ((F.col("log") - F.col("n_tokens") * per_token) / F.col("times")).alias("base_score"),
        (F.col("score") / F.col("times")).alias("score"),
    )
