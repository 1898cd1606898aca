"""Words of whole batches of texts, as arrays: parted and lower-cased by Arrow, hashed a length at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass
class Words:
    """The different words of some texts, as bytes one after another, and the texts as places in them."""

    data: np.ndarray  # uint8, eight more at the end
    start: np.ndarray
    size: np.ndarray
    at: np.ndarray  # of each token of all texts
    tokens: np.ndarray  # of each text

    @classmethod
    def of(cls, texts: pa.Array, end: bytes) -> Words:
        """A-Z lower-cased, parted by ASCII white space, and end after each text; end is the last word, and no text can hold it."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = parts.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.large_binary())
        start = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
        held = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: start[-1]] if start[-1] else np.zeros(0, dtype=np.uint8)
        data = np.concatenate([held, np.frombuffer(end, dtype=np.uint8), np.zeros(8, dtype=np.uint8)])
        size = np.append(np.diff(start), len(end))
        codes = found.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        real = size[codes] > 0  # white space at the ends of a text leaves empty parts
        codes, text = codes[real], text[real]
        tokens = np.bincount(text, minlength=len(texts)) + 1
        at = np.full(len(codes) + len(texts), len(words), dtype=np.int64)
        at[np.arange(len(codes)) + text] = codes
        return cls(data, start, size, at, tokens)

    def hashes(self) -> np.ndarray:
        """xxh64 of each word, less 2 ** 63."""
        eight = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        four = np.ndarray((len(self.data) - 7,), dtype="<u4", buffer=self.data, strides=(1,))
        out = np.empty(len(self.size), dtype=np.uint64)
        order = np.argsort(self.size.astype(np.uint16) if len(self.size) and self.size.max() < 1 << 16 else self.size, kind="stable")
        sizes, first = np.unique(self.size[order], return_index=True)
        for size, which in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            at = self.start[which]
            if size >= 32:
                out[which] = [xxhash.xxh64_intdigest(self.data[i : i + size].tobytes()) for i in at.tolist()]
                continue
            h, i = np.full(len(at), _P5 + np.uint64(size)), 0
            for i in range(0, size - 7, 8):
                h = _turned(h ^ _turned(eight[at + i] * _P2, 31) * _P1, 27) * _P1 + _P4
            i = size // 8 * 8
            if size - i >= 4:
                h = _turned(h ^ four[at + i].astype(np.uint64) * _P1, 23) * _P2 + _P3
                i += 4
            for j in range(i, size):
                h = _turned(h ^ self.data[at + j].astype(np.uint64) * _P5, 11) * _P1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[which] = h ^ (h >> np.uint64(32))
        return (out ^ np.uint64(1 << 63)).view(np.int64)

    def by_ends(self, one: Callable[[bytes], int], few: int) -> np.ndarray:
        """one(word) of each word, for a one that goes by the last two bytes and the first: one(w) = last - last % few + first % few."""
        firsts, pairs, singles = _ends(one, few)
        last = np.where(self.size > 1, self.start + self.size - 2, 0)
        long = pairs[self.data[last].astype(np.int64) * 256 + self.data[last + 1]]
        first = self.data[self.start]
        return np.where(self.size > 1, long + firsts[first], singles[first])


@cache
def _ends(one: Callable[[bytes], int], few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the first byte adds, what the last two give, and what a word of one byte has."""
    singles = np.array([one(bytes([x])) for x in range(256)])
    pairs = np.array([one(bytes(x)) for x in np.ndindex(256, 256)])
    return singles % few, pairs - pairs % few, singles


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))
