"""Packing documents into token sequences: concatenate and cut."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, id_type, keyed_text, materialise

#: Texts with anything else go to the tokenizers library whole: there, Unicode tables of two libraries could differ.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\u024f\u0391-\u03c9\u0410-\u044f\u2010-\u2026\u20ac]")
# Fixed value: the byte-level pre-tokenizer's pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: So long a word goes to the tokenizers library too, whose time doesn't grow with the square of its length.
LONG_WORD = 500


class Encoder:
    """Ids by a file of the tokenizers library, as its own call with its own defaults gives them.

    plain(text) is that call: an added token's string in a text is that token. Where the file is a byte-level BPE
    whose ids follow its merges, batch(texts) gives usual texts without such strings to an encoder of the tiktoken
    library that is built from the same file: the ids are equal and it takes a third of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = _same_bpe(spec)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [self.fast.encode_to_numpy(t, disallowed_special=()) if self._same(t) else np.array(self.plain(t), dtype=np.uint32) for t in texts]

    def _same(self, text: str) -> bool:
        return self.fast is not None and not any(a in text for a in self.added) and _usual(text)


def _usual(text: str) -> bool:
    if _UNUSUAL.search(text):
        return False
    if len(text) <= LONG_WORD:
        return True
    lengths = list(map(len, text.split()))
    return bool(lengths) and max(lengths) <= LONG_WORD and len(text) - sum(lengths) <= len(lengths) + LONG_WORD


def _same_bpe(spec: dict):
    """A tiktoken encoder with the same vocabulary; None if the file isn't a plain byte-level BPE."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("type") != "BPE":
        return None
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    ranks = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("from-file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass, written: id, part, start, n_tokens, ids (little-endian, 2 or 4 bytes each).

    part is the task that encoded the row and start the tokens before it there, both fixed by the write.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    schema = pa.schema([("id", id_type(rows)), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, start = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        wide = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.batch(b.column(1).to_pylist())]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), pa.array([x.astype(wide).tobytes() for x in ids], pa.binary())], schema=schema)

    kind = rows.schema["id"].dataType.simpleString()
    return materialise(rows.mapInArrow(encode, f"id {kind}, part int, start bigint, n_tokens bigint, ids binary"), "pack-tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds the global offset of each document: the tokens of all parts before its own, plus its start.

    The driver sums one total for each task of the first pass; their number is that of the input's splits.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = np.cumsum([0] + [r.n for r in totals]).tolist()
    bases = tokens.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, before, strict=False)], "part int, base bigint")
    return tokens.join(F.broadcast(bases), "part").withColumn("begin", F.col("base") + F.col("start"))


def _cut(located: DataFrame, width: int, with_ids: bool) -> DataFrame:
    """The second pass: each document's pieces, cut at the multiples of width."""
    kind = located.schema["id"].dataType.simpleString()
    fields = [("id", id_type(located)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    ddl = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, begin, n, raw in zip(*(b.column(c).to_pylist() for c in ("id", "begin", "n_tokens", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, width)
                    piece = ids[at : at + width - offset]
                    out.append((i, at, len(piece), zlib.crc32(piece.tobytes()), n, sequence, offset, *([piece.astype(np.int32)] if with_ids else [])))
                    at += len(piece)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return located.select("id", "begin", "n_tokens", "ids").mapInArrow(cut, ddl)


def pack_pieces(docs: DataFrame, tokenizer_path: str, width: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All documents, each followed by end_id, stand one behind the other and are cut every width tokens: only the
    last sequence is padded. Nothing is shuffled: the first pass writes the ids and counts them, the second
    cuts each document where its global offset says. Sequences that run over the end of a partition are the
    boundary records: pieces of two tasks with the same sequence_id.
    A null or empty text is the end_id alone; an empty table gives no rows; repeated rows are packed each.
    A very long text makes many pieces. Other columns are ignored.
    """
    return _cut(with_offsets(token_table(docs, tokenizer_path, end_id, id_col, text_col)), width, False).withColumnRenamed("id", id_col)


def pack_sequences(docs: DataFrame, tokenizer_path: str, width: int = 1024, end_id: int = 0, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens (without padding), input_ids.

    All are width long but the last one where its n_tokens are a power of two: that is left as it is, any other is padded with pad_id.
    Sequences that lie in one task are joined there; only the boundary records are shuffled, by sequence_id,
    and a group of them is one sequence long at most.
    """
    pieces = _cut(with_offsets(token_table(docs, tokenizer_path, end_id, id_col, text_col)), width, True)
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # sequence, offset, ids so far

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([np.concatenate(now[2])], schema[2].type)], schema=schema)

        for b in batches:
            for s, o, ids in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
                if now and (s != now[0] or o != now[1] + sum(map(len, now[2]))):
                    yield row()
                    now = []
                now = now or [s, o, []]
                now[2].append(np.array(ids, dtype=np.int32))
        if now:
            yield row()

    runs = pieces.select("sequence_id", "offset", "ids").mapInArrow(joined, "sequence_id bigint, offset bigint, ids array<int>")
    whole = runs.filter(F.size("ids") == width).select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("input_ids"))
    edges = runs.filter(F.size("ids") < width).groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    filled = F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), width - n)))
    padded = edges.select("sequence_id", n.cast("long").alias("n_tokens"), filled.alias("input_ids"))
    return whole.unionByName(padded)
