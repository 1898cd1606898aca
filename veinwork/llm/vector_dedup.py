"""Near duplicates among vectors: product quantisation over inverted lists, table-lookup distances, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veinwork.llm.blocks import in_units
from veinwork.llm.common import bounded_batches, discard, id_type, materialise
from veinwork.llm.components import components

#: Vectors that the lists and codes are fitted on, about; dimensions of a subspace; codes of a subspace; passes of k-means.
FITTED, SUBSPACE, CODES, PASSES = 16_384, 8, 64, 8
#: Lists for each square root of the number of different vectors, and members of a list in a block.
LISTS, BLOCK = 0.5, 4096
#: Vectors that ask at a time; what rounding may add to a distance.
STEP, ROUNDING = 128, 1e-4


@dataclass
class Quantiser:
    """Centroids of the inverted lists, and for each subspace the codewords of what a vector differs from its centroid by."""

    centroids: np.ndarray  # lists x width
    codewords: np.ndarray  # subspaces x codes x SUBSPACE

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 1) -> Quantiser:
        random = np.random.default_rng(seed)
        centroids = _k_means(sample, lists, random)
        rest = (sample - centroids[_nearest(sample, centroids)]).reshape(len(sample), -1, SUBSPACE)
        return cls(centroids, np.stack([_k_means(rest[:, m], CODES, random) for m in range(rest.shape[1])]))

    def lists(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each unit vector's own list, and the lists of higher number that can hold a vector within reach.

        A vector lies on its own centroid's side of the plane midway between two centroids. So one within reach of x can be in list j
        only if x is no further than reach from the plane between its own centroid and that of j: no other list has to be probed.
        """
        squares = (self.centroids**2).sum(axis=1)
        d = squares - 2 * x @ self.centroids.T
        own = d.argmin(axis=1)
        apart = np.sqrt(np.maximum(squares[own, None] - 2 * self.centroids[own] @ self.centroids.T + squares, 0))
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * (reach + ROUNDING) * apart + ROUNDING
        near &= np.arange(len(self.centroids)) > own[:, None]
        return own, [np.flatnonzero(row) for row in near]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of each vector in its list, and how far the coded vector lies from it."""
        rest = (x - self.centroids[own]).reshape(len(x), -1, SUBSPACE)
        codes = np.stack([_nearest(rest[:, m], words) for m, words in enumerate(self.codewords)], axis=1).astype(np.uint8)
        coded = np.stack([words[codes[:, m]] for m, words in enumerate(self.codewords)], axis=1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))

    def tables(self, x: np.ndarray, in_list: int) -> np.ndarray:
        """For each asking vector and subspace, the squared distance to each codeword of the list: rows x subspaces x codes."""
        rest = (x - self.centroids[in_list]).reshape(len(x), -1, 1, SUBSPACE)
        return ((rest - self.codewords[None]) ** 2).sum(axis=3).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Centres of the rows; an empty cluster keeps its centre."""
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(PASSES):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, i], k) for i in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _units(blobs: list[bytes], kind: str, width: int) -> np.ndarray:
    """Unit vectors in double precision, filled with zeros up to width."""
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype=kind)
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return out / np.sqrt((out**2).sum(axis=1))[:, None]


def _prepared(rows: DataFrame, kind: str) -> DataFrame:
    """id, label, key (hash of the vector) and vec (its bytes), both null for a vector that links with nothing."""
    schema = pa.schema([("id", id_type(rows)), ("label", id_type(rows, "label")), ("key", pa.binary()), ("vec", pa.binary()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for v, label in zip(b.column(2), b.column(1), strict=True):
                found = None
                if v.is_valid and label.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and x.any():
                        found = (x + 0.0).tobytes()  # one zero
                out.append(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v and xxhash.xxh128_digest(v) for v in out], pa.binary()), pa.array(out, pa.binary()), pa.array([v and len(v) // np.dtype(kind).itemsize for v in out], pa.int32())], schema=schema
            )

    names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {names['id']}, label {names['label']}, key binary, vec binary, width int")


def _placed(classes: DataFrame, quantiser, kind: str, reach: float) -> DataFrame:
    """The classes with their list, the further lists to probe, their codes and the error of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for b in batches:
            x = _units(b.column("vec").to_pylist(), kind, q.width)
            own, further = q.lists(x, reach)
            codes, error = q.encode(x, own)
            lists = [np.concatenate([[o], f]) for o, f in zip(own, further, strict=True)]
            made = [pa.array(own, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "own", "lists", "codes", "error"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{names}, own int, lists array<int>, codes binary, error float")


def _joined(roots: np.ndarray, these: np.ndarray) -> None:
    """All of these have one root from now on: that of the first."""
    met = np.unique(roots[these])
    if len(met) > 1:
        roots[np.isin(roots, met[1:])] = met[0]


def _links(quantiser, kind: str, threshold: float):
    """For one unit: each linked class with the smallest class it hangs together with there, and the vectors that it is linked with."""
    reach = float(np.sqrt(2 - 2 * threshold)) + ROUNDING

    def fn(unit: pa.Table) -> pa.Table:
        q = quantiser.value
        target, asks = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("target", "asking"))
        number, weight = unit.column("number").to_numpy(), unit.column("weight").to_numpy()
        in_list = unit.column("list")[0].as_py()
        x = _units(unit.column("vec").to_pylist(), kind, q.width)
        home = unit.column("own").to_numpy() == in_list
        t, a = np.flatnonzero(target), np.flatnonzero(asks)
        codes = np.frombuffer(b"".join(unit.column("codes").take(pa.array(t)).to_pylist()), dtype=np.uint8).reshape(len(t), -1)
        limit = (reach + unit.column("error").to_numpy()[t].astype(np.float32) + ROUNDING) ** 2
        nodes, place = np.unique(number, return_inverse=True)
        roots, met = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
        for first in range(0, len(a) if len(t) else 0, STEP):
            asking = a[first : first + STEP]
            table = q.tables(x[asking], in_list)
            distance = np.zeros((len(asking), len(t)), dtype=np.float32)
            for m in range(codes.shape[1]):
                distance += table[:, m, codes[:, m]]
            near = (distance <= limit) & (~home[asking, None] | (number[asking, None] < number[t]))
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(r):
                continue
            linked = near[np.ix_(r, c)] & (x[asking[r]] @ x[t[c]].T >= threshold)
            np.add.at(met, place[asking[r]], linked @ weight[t[c]])
            np.add.at(met, place[t[c]], weight[asking[r]] @ linked)
            for i in np.flatnonzero(linked.any(axis=1)):
                _joined(roots, np.concatenate([[place[asking[r[i]]]], place[t[c[linked[i]]]]]))
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, nodes)
        some = met > 0
        return pa.table({"a": nodes[some], "b": least[roots][some], "links": met[some]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    return fn


def vector_components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fitted: int = FITTED) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Vectors of one label with a cosine of threshold (above 0) or more are linked.

    Equal vectors of a label are one class with a weight, so a hot group of copies is one row. Lists and codes are fitted on about `fitted` classes
    (a documented bound, chosen by a hash); every class is indexed. A class is a member of its own list and visits those lists
    that can hold a vector within reach (Quantiser.lists), so the search loses no link. In a list, the distance to a member is read off
    the tables of the asking vector; what is further than the threshold's distance plus the member's own coding error can't
    be linked, and the rest is compared by exact cosine in doubles. Large lists are worked on in blocks, and a task gives back sums and
    stars, never pairs. n different vectors that are all linked still cost n * n / 2 comparisons, spread over tasks.

    A vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with nothing. Vectors
    of different lengths are compared as if the shorter one went on with zeros only if they are equal in length: they never link otherwise.
    Rows with a null id are left out of links but returned, with no links and a null component. Rows that repeat an id are vectors of
    their own. Ids are of any type that can be ordered. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kind = "<f8" if isinstance(rows.schema["vector"].dataType.elementType, DoubleType) else "<f4"
    prepared = _prepared(rows, kind)
    whole = prepared.filter("vec IS NOT NULL AND id IS NOT NULL")
    classes = materialise(
        whole.groupBy("label", "key").agg(F.first("vec").alias("vec"), F.first("width").alias("width"), F.count("*").alias("weight"), F.min("id").alias("least")).withColumn("number", F.monotonically_increasing_id()),
        "vec-classes",
    )
    size = classes.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    found = None
    if size.n:
        width = -(-size.width // SUBSPACE) * SUBSPACE
        share = min(1.0, fitted / size.n)
        sample = classes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else classes
        x = _units([r.vec for r in sample.select("vec").collect()], kind, width)
        x = x if len(x) else _units([r.vec for r in classes.select("vec").limit(1).collect()], kind, width)
        q = spark.sparkContext.broadcast(Quantiser.fit(x, int(np.clip(LISTS * np.sqrt(size.n), 1, max(1, len(x) // 4)))))
        placed = materialise(_placed(classes.drop("key", "least"), q, kind, float(np.sqrt(2 - 2 * threshold))), "vec-placed")
        members = placed.withColumn("list", F.explode("lists")).drop("lists")
        key = ["label", "width", "list"]
        units = in_units(members, key, "number", F.col("own") == F.col("list"), BLOCK)
        links = materialise(units.groupBy(*key, "t", "q").applyInArrow(_links(q, kind, threshold), "a long, b long, links long"), "vec-links")
        part = components(links.select("a", "b"), "vec-part").withColumnRenamed("node", "number")
        direct = links.groupBy(F.col("a").alias("number")).agg(F.sum("links").alias("links"))
        known = classes.select("label", "key", "number", "weight", "least").join(part, "number", "left").join(direct, "number", "left").withColumn("component", F.coalesce("component", "number"))
        named = materialise(known, "vec-known")
        names = named.groupBy("component").agg(F.min("least").alias("component_id"))
        found = named.join(names, "component").select(F.col("label").alias("l"), F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        discard(classes, placed, links)
    alone = prepared.select("id", "label", "key")
    if found is None:
        out = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        out = alone.join(found, (alone["label"] == found["l"]) & (alone["key"] == found["k"]) & alone["id"].isNotNull(), "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
