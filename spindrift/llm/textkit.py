"""Vectorised words and hashes over batches of texts.

A word is a maximal run of ASCII letters and digits and non-ASCII characters, lower-cased.  Hashes of byte ranges
come from prefix sums of (random value of the byte) * base^position modulo 2^64, divided by base^start, and are then
scrambled; a range costs a few operations whatever its length.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix64

_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_POWERS = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U64(base))
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        up, self._down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_RANDOM[buf] * up[: len(buf)], out=self.sums[1:])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self._down[start]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, stop))

    def all_grams(self, k: int) -> np.ndarray:
        """Hash of each k bytes of the buffer."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """The words of a batch of texts: ``hash`` of each, its ``doc`` (index in the batch) and byte range."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.doc_start = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        inside = _WORD_BYTE[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.stop = edge[0::2], edge[1::2]
        self.ranges = RangeHash(self.buf)
        self.hash = self.ranges.of(self.start, self.stop)
        self.per_doc = np.diff(np.searchsorted(self.start, np.append(self.doc_start, len(self.buf))))
        self.doc = np.repeat(np.arange(len(texts)), self.per_doc)
        self.n_docs = len(texts)

    def prefix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of the first k bytes of each word that is longer."""
        keep = self.stop - self.start > k
        s = self.start[keep]
        return self.ranges.of(s, s + k), self.doc[keep]


def shingles(hashes: np.ndarray, doc: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of each k words in a row, in text order; a text of 1..k-1 words has one shingle, of all its words."""
    n = len(hashes)
    begin = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc >= k, per_doc - k + 1, np.minimum(per_doc, 1))
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(per_doc)), count)
    first = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    left = np.repeat(begin + per_doc, count) - first
    out = np.zeros(total, np.uint64)
    for j in range(k):
        word = hashes[np.minimum(first + j, n - 1)]
        out = np.where(left > j, mix64(out * U64(0x9E3779B97F4A7C15) + word + U64(j)), out)
    return out, own
