"""Packing documents into windows: best-fit decreasing over remaining capacities.

Each document's ids (with the end id) are first cut into full windows; what is left over is placed, longest
first, into the open window that it fills most tightly.  A segment tree over capacities 0..window tells which
remaining capacity, of those some open window has, is the least that suffices.  Each task packs its own
documents (some thousands of windows), so nothing is shuffled and no window mixes rows of two tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, text_slices
from .tokens import BYTE_FILE, encoder

WINDOW = 1024
END_ID = 0
HELD_BYTES = 24 << 20  # ids that a task holds back before it packs them


class CapacityTree:
    """Segment tree whose leaf c counts the open windows with c places left; inner nodes add up their leaves."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1 - 1).bit_length()
        self.size = self.size if self.size > window else self.size * 2
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, step: int) -> None:
        i = capacity + self.size
        while i:
            self.sums[i] += step
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need that is open, or -1."""
        sums, i = self.sums, need + self.size
        if sums[i]:
            return need
        while i > 1:  # up to the first right neighbour that holds something, then down to its least leaf
            if not i & 1 and sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if sums[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each item; every length is 1..window.  Ties keep the given order."""
    tree, open_at = CapacityTree(window), [[] for _ in range(window + 1)]
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    windows = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.tightest(n)
        if room < 0:
            room, number = window, windows
            windows += 1
        else:
            number = open_at[room].pop()
            tree.add(room, -1)
        place[i] = (number, window - room)
        if room > n:
            open_at[room - n].append(number)
            tree.add(room - n, 1)
    return place


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, file: str = BYTE_FILE) -> DataFrame:
    """Pieces of documents with their place: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    Null text counts as empty, which is one end id.  ``ids`` holds little-endian unsigned 32-bit ids.  Every id of
    a row lies in exactly one piece; a sequence's pieces leave no gap.  Rows that share an id are packed as rows
    of their own.  ``sequence_id`` is unique over the result, not consecutive.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(file), TaskContext.get().partitionId() << 36
        rest: list[tuple] = []
        held = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(_NAMES, zip(*rows))], names=_NAMES)

        def flush() -> list[tuple]:
            nonlocal number, rest, held
            place = best_fit_decreasing([r[2] for r in rest], window)
            out = [(*r, number + k, offset) for r, (k, offset) in zip(rest, place)]
            number += 1 + max((k for k, _ in place), default=-1)
            rest, held = [], 0
            return out

        for piece in text_slices(batches, 2 << 20):
            got, n = enc.encode(piece.column("text").to_pylist())
            raw = np.insert(got, np.cumsum(n), end_id).astype("<u4").tobytes()
            at, out = 0, []
            for doc, size in zip(piece.column("id").to_pylist(), (n + 1).tolist()):
                full = size // window * window
                for start in range(0, full, window):
                    out.append((doc, start, window, raw[at + 4 * start : at + 4 * (start + window)], size, number, 0))
                    number += 1
                if size > full:
                    rest.append((doc, full, size - full, raw[at + 4 * full : at + 4 * size], size))
                    held += 4 * (size - full) + 200
                at += 4 * size
            if held >= HELD_BYTES:
                out += flush()
            if out:
                yield batch(out)
        if rest:
            yield batch(flush())

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(pack), _PIECE)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The contract's columns, with a digest of each piece's ids."""
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into windows of 1024 ids."""
    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
