"""Exact removal of repeated 100-byte strings, over all documents, by suffix arrays.

A byte goes if a 100-byte string that covers it also starts earlier (in a smaller doc_id, or further left).

1. Routing.  In every 100-byte window, the 50-byte gram of least hash (the leftmost, if it recurs) is the window's
   anchor, so equal windows have equal anchors at equal places.  A run of windows with one anchor is a segment: some
   26 windows, each text has about one segment per 26 bytes.  Segments whose anchor recurs belong to the cell (128
   bytes of some text) in which their anchor is first met; neighbouring ones of one cell are joined to stretches.  So
   equal windows are in stretches of one cell, and a cell mostly holds copies.  Hashes only tell what is compared.
2. Comparison.  A cell's stretches are laid end to end, and their suffix array is built by linear grouping
   (``suffix_array``).  Windows that are equal stand next to each other in it; of these all but the first in order of
   documents are repeats.  A cell with more than ``LANE`` stretches gets several texts, copies side by side; what was
   found repeated throughout leaves, and what is left is compared again.  If most stretches of such a cell differ, they
   fall into segments again, compared anchor by anchor (its 50 bytes as one sign), and windows of very frequent anchors
   are first dealt out by the hash of the bytes that several of them share.
3. Order of work.  Each task compares its own segments first, so what a third of all documents hold sends one
   segment per task.  Then places of the others are dealt by anchor to find anchors that several tasks have; bytes
   of these alone are fetched and compared.  An anchor with more than ``HOT`` segments is compared in groups of so
   many; the windows that stay are dealt by their own hash, and those that meet another one are compared once more.

Every removal is decided on bytes: segments of one anchor hash but other anchor bytes are told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_signed, bounded_batches, drop_tables, mix64, ragged_arange, release_shuffles, released, stage_table
from .suffix_array import suffix_arrays
from .textkit import RangeHash

WINDOW = 100
GRAM = 50
SIDE = WINDOW - GRAM
HOT = 2048
SLICE_BYTES = 1 << 19  # texts hashed together
CELL_BITS = 7
STRETCH = 512
TASK_BYTES = 8 << 20  # a task compares and sends its segments in blocks of so many bytes of text
SETTLE_BYTES = 4 << 20  # stretches from other tasks that are compared together
LANE = 4  # stretches or segments of a suffix array
LANE_BATCH = 600_000  # symbols whose suffix arrays are built together
NO_ID = (1 << 63) - 1
KEY_BYTES = 6  # of a hash that tells what meets; beside its bucket, the rest would not tell more apart


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` entries in a row."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end -> of each segment: hash of its anchor, place of the anchor, first and last window."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    g = RangeHash(buf).all_grams(GRAM)
    m = _slide(g, SIDE + 1)
    valid = np.arange(n) + WINDOW <= np.repeat(np.cumsum(sizes), sizes)[:n]
    fresh = valid.copy()
    # the next window has another anchor if its least gram differs, or if this window began with its anchor
    fresh[1:] &= (m[1:] != m[:-1]) | (g[: n - 1] == m[:-1]) | ~valid[:-1]
    start = np.flatnonzero(fresh)
    change = np.append(np.flatnonzero(fresh | ~valid), n)
    stop = change[np.searchsorted(change, start, side="right")] - 1
    anchor, least = stop.copy(), m[start]
    todo = np.flatnonzero(g[anchor] != least)
    while len(todo):
        anchor[todo] += 1
        todo = todo[g[anchor[todo]] != least[todo]]
    return least, anchor, start, stop


def merge_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each document, in order."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    room = int(stop.max()) + 2
    reach = np.maximum.accumulate(number * room + stop)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = number[1:] * room + start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - number[last] * room


# --- comparison -----------------------------------------------------------------------------------------------------


def _heads(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, 4 * WINDOW + STRETCH, dtype=np.uint64) * U64(2) + U64(1)
_BYTES = np.random.default_rng(78).integers(1, 2**63, 256, dtype=np.uint64)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start, count) + ragged_arange(count)


def content_hash(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, which all have some; ranges are taken in runs of bounded length."""
    out = np.zeros(len(begin), np.uint64)
    ends = np.cumsum(size)
    for top in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
        a, b = np.searchsorted(ends, [top, top + (1 << 20)], side="right") if top + (1 << 20) < ends[-1] else (np.searchsorted(ends, top, side="right"), len(ends))
        if a < b:
            n = size[a:b]
            value = _BYTES[buf[_ranges(begin[a:b], n)]] * _MULTIPLIERS[ragged_arange(n) % len(_MULTIPLIERS)]
            out[a:b] = mix64(np.add.reduceat(value, np.cumsum(n) - n) + n.astype(np.uint64))
    return out


def same_anchor(buf: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys that also tell apart anchors of equal hash and other bytes."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    again = np.flatnonzero(k[1:] == k[:-1])
    for top in range(0, len(again), 50_000):
        i = again[top : top + 50_000]
        a, b = at[order[i]], at[order[i + 1]]
        if any((buf[a + j] != buf[b + j]).any() for j in range(GRAM)):
            anchors = [buf[x : x + GRAM].tobytes() for x in at.tolist()]
            number = {x: i for i, x in enumerate(sorted(set(anchors)))}
            return mix64(key ^ mix64(np.array([number[x] for x in anchors], np.uint64) + U64(1)))
    return key


def repeated_windows(buf: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """segments x offsets 0..50: does the window that starts so many bytes before the segment's anchor recur in a
    segment of equal ``key`` and smaller ``rank``?

    ``at``: place of the anchor in ``buf``.  A segment has the windows of offsets SIDE - right .. left.
    """
    found = np.zeros((len(at), SIDE + 1), bool)
    key = same_anchor(buf, at, key.astype(np.uint64))
    item = np.lexsort((rank, key))
    key, lo, hi = key[item], np.zeros(len(item), np.int64), np.full(len(item), SIDE)
    while len(item):
        a, b = np.maximum(lo, SIDE - right[item]), np.minimum(hi, left[item])
        size = np.diff(np.append(_heads(key), len(key)))
        per = np.repeat(size, size)
        keep = (per > 1) & (a <= b)
        if not keep.all():
            item, key, lo, hi = item[keep], key[keep], lo[keep], hi[keep]
            continue
        part, slow = np.zeros(len(item), np.int64), np.zeros(len(item), bool)
        big = np.flatnonzero(per > LANE)
        if len(big):
            # segments with equal bytes side by side, so that a text's segments mostly are copies
            bytes_ = content_hash(buf, at[item[big]] - b[big], GRAM + SIDE - a[big] + b[big])
            turn = np.lexsort((rank[item[big]], bytes_, key[big]))
            move = big[turn]
            item[big], lo[big], hi[big], a[big], b[big] = item[move], lo[move], hi[move], a[move], b[move]
            head = _heads(key[big])
            other = np.append(True, bytes_[turn][1:] != bytes_[turn][:-1])
            other[head] = True
            each = np.diff(np.append(head, len(big)))
            slow[big] = np.repeat(2 * np.add.reduceat(other.astype(np.int64), head) > each, each)
            # equal hashes of all bytes but few copies: the whole group is one text
            part[big] = np.where(slow[big] & (lo[big] == hi[big]), 0, ragged_arange(each) // LANE)
        halve = slow & (lo < hi)
        laid = np.flatnonzero(~halve)
        if len(laid):
            lane = np.cumsum(np.append(0, (key[laid][1:] != key[laid][:-1]) | (part[laid][1:] != part[laid][:-1])))
            _by_suffix_arrays(found, buf, at, item[laid], lane, a[laid], b[laid], rank)
        more = np.flatnonzero((per > LANE) & ~slow)
        sums = np.zeros((len(more), SIDE + 2), np.int16)
        np.cumsum(found[item[more]], axis=1, out=sums[:, 1:])
        i, laid_again = np.arange(len(more)), len(more)
        more = more[sums[i, b[more] + 1] - sums[i, a[more]] < (b - a + 1)[more]]
        if len(more) == laid_again and not halve.any():
            break  # copies always leave, so this only ends a construction that finds none
        pieces = [(item[more], key[more], lo[more], hi[more])]
        item, key, lo, hi = item[halve], key[halve], lo[halve], hi[halve]
        mid = (lo + hi) // 2
        for x, y in ((lo, mid), (mid + 1, hi)):
            # what all windows of the half share: x bytes before the anchor, and those after it up to SIDE - y
            fits = (left[item] >= x) & (right[item] >= SIDE - y)
            own, x, y = item[fits], x[fits], y[fits]
            if len(own):
                pieces.append((own, mix64(key[fits] + x.astype(np.uint64) + U64(7)) ^ content_hash(buf, at[own] - x, x + GRAM + SIDE - y), x, y))
        item, key, lo, hi = (np.concatenate(x) for x in zip(*pieces))
        turn = np.lexsort((rank[item], key))
        item, key, lo, hi = item[turn], key[turn], lo[turn], hi[turn]
    return found


def _by_suffix_arrays(found, buf, at, item, lane, a, b, rank) -> None:
    """One text per lane: each segment as its bytes before the anchor, a sign for the anchor, the bytes after it and a
    separator.  Windows are the suffixes that start before or at the anchor, by their first 51 symbols."""
    size = b + 1 + (SIDE - a) + 1
    lead = _heads(lane)
    lane_items = np.diff(np.append(lead, len(lane)))
    lane_symbols = np.add.reduceat(size, lead) + 1
    turn = np.argsort(lane_symbols, kind="stable")
    turn = turn[lane_items[turn] > 1]
    cuts = np.searchsorted(np.cumsum(lane_symbols[turn]), np.arange(LANE_BATCH, int(lane_symbols[turn].sum()) + LANE_BATCH, LANE_BATCH))
    for lanes in np.split(turn, np.unique(cuts[cuts < len(turn)])):
        if not len(lanes):
            continue
        pick = np.repeat(lead[lanes], lane_items[lanes]) + ragged_arange(lane_items[lanes])
        ends = np.cumsum(lane_items[lanes])
        n = size[pick]
        n[ends - 1] += 1  # the lane's final 0 goes with its last segment
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(pick)), n)
        j = np.arange(len(owner)) - begin[owner]
        before, after = b[pick], SIDE - a[pick]
        text = np.zeros(len(owner), np.int64)
        head, tail = j < before[owner], (j > before[owner]) & (j <= (before + after)[owner])
        place = at[item[pick]] - before
        text[head] = buf[place[owner[head]] + j[head]].astype(np.int64) + 2
        text[tail] = buf[place[owner[tail]] + j[tail] + GRAM - 1].astype(np.int64) + 2
        text[begin + before] = 258
        text[begin + before + 1 + after] = 1
        sa = suffix_arrays(text, lane_symbols[lanes])
        own = owner[sa]
        offset = before[own] - j[sa]
        window = (offset >= a[pick][own]) & (offset <= before[own])
        sa, offset, own = sa[window], offset[window], own[window]
        if not len(sa):
            continue
        which = np.repeat(np.arange(len(lanes)), lane_items[lanes])[own]
        segment = item[pick][own]
        again = _repeats(text, sa, which, SIDE + 1, rank[segment])
        found[segment[again], offset[again]] = True


def repeated_starts(buf: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Stretches of ``buf`` (their first window and number of windows) -> whether a window that starts at a place of
    ``buf`` recurs in a stretch of equal ``key`` and smaller ``rank``, or further left in its own."""
    found = np.zeros(len(buf), bool)
    item = np.lexsort((rank, key))
    apart = []
    while len(item):
        own = key[item]
        size = np.diff(np.append(_heads(own), len(own)))
        per = np.repeat(size, size)
        part, slow = np.zeros(len(item), np.int64), np.zeros(len(item), bool)
        big = np.flatnonzero(per > LANE)
        if len(big):
            x = item[big]
            bytes_ = content_hash(buf, begin[x], count[x] + WINDOW - 1)
            turn = np.lexsort((rank[x], bytes_, own[big]))
            item[big], bytes_ = x[turn], bytes_[turn]
            head = _heads(own[big])
            other = np.append(True, bytes_[1:] != bytes_[:-1])
            other[head] = True
            each = np.diff(np.append(head, len(big)))
            slow[big] = np.repeat(2 * np.add.reduceat(other.astype(np.int64), head) > each, each)
            part[big] = ragged_arange(each) // LANE
        apart.append(item[slow])
        laid = np.flatnonzero(~slow)
        if len(laid):
            lane = np.cumsum(np.append(0, (own[laid][1:] != own[laid][:-1]) | (part[laid][1:] != part[laid][:-1])))
            _by_whole_stretches(found, buf, begin[item[laid]], count[item[laid]], lane, rank[item[laid]])
        item = item[(per > LANE) & ~slow]
        if not len(item):
            break
        left = np.add.reduceat(found[_ranges(begin[item], count[item])], np.cumsum(count[item]) - count[item], dtype=np.int64) < count[item]
        if left.all():
            break  # copies always leave, so this only ends a construction that finds none
        item = item[left]
    apart = np.concatenate(apart) if apart else np.zeros(0, np.int64)
    if len(apart):
        size = count[apart] + WINDOW - 1
        there = np.repeat(begin[apart], size) + ragged_arange(size)
        h, anchor, start, stop = segments(buf[there], size)
        own = np.searchsorted(np.cumsum(size), anchor, side="right")
        i, start, stop = _spans_of(repeated_windows(buf[there], anchor, anchor - start, stop - anchor + SIDE, mix64(key[apart][own].astype(np.uint64)) ^ h, _rank(rank[apart][own], own, anchor)), anchor)
        found[there[_ranges(start, stop - WINDOW + 1 - start)]] = True
    return found


def _by_whole_stretches(found, buf, begin, count, lane, rank) -> None:
    """One text per lane, a separator after each stretch; its windows are the suffixes that start within ``count``."""
    size = count + WINDOW
    lead = _heads(lane)
    lane_items = np.diff(np.append(lead, len(lane)))
    lane_symbols = np.add.reduceat(size, lead) + 1
    turn = np.argsort(lane_symbols, kind="stable")
    cuts = np.searchsorted(np.cumsum(lane_symbols[turn]), np.arange(LANE_BATCH, int(lane_symbols.sum()) + LANE_BATCH, LANE_BATCH))
    for lanes in np.split(turn, np.unique(cuts[cuts < len(turn)])):
        if not len(lanes):
            continue
        pick = np.repeat(lead[lanes], lane_items[lanes]) + ragged_arange(lane_items[lanes])
        n = size[pick]
        n[np.cumsum(lane_items[lanes]) - 1] += 1  # the lane's final 0 goes with its last stretch
        first = np.cumsum(n) - n
        text = np.zeros(int(n.sum()), np.int64)
        inside = _ranges(first, size[pick] - 1)
        text[inside] = buf[_ranges(begin[pick], size[pick] - 1)].astype(np.int64) + 2
        text[first + size[pick] - 1] = 1
        owner = np.repeat(np.arange(len(pick)), n)
        sa = suffix_arrays(text, lane_symbols[lanes])
        own = owner[sa]
        sa_window = sa - first[own] < count[pick][own]
        sa, own = sa[sa_window], own[sa_window]
        which = np.repeat(np.arange(len(lanes)), lane_items[lanes])[own]
        order = rank[pick][own] << 32 | sa - first[own]
        again = _repeats(text, sa, which, WINDOW, order)
        found[begin[pick][own[again]] + (sa - first[own])[again]] = True


def _repeats(text: np.ndarray, sa: np.ndarray, lane: np.ndarray, width: int, order: np.ndarray) -> np.ndarray:
    """Neighbours in suffix order whose first ``width`` signs are equal: all but the one of least ``order``."""
    equal = np.flatnonzero(lane[1:] == lane[:-1])
    packed = text.copy()  # seven signs of nine bits
    for k in range(1, 7):
        packed[:-k] |= text[k:] << 9 * k
    for k in (*range(0, width - 7, 7), width - 7):
        equal = equal[packed[sa[equal] + k] == packed[sa[equal + 1] + k]]
    fresh = np.ones(len(sa), bool)
    fresh[equal + 1] = False
    head = np.flatnonzero(fresh)
    if not len(head):
        return head
    least = np.repeat(np.minimum.reduceat(order, head), np.diff(np.append(head, len(sa))))
    return np.flatnonzero(order > least)


def _spans_of(found: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Found windows as (segment, start, stop) of runs of neighbouring offsets."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).view(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return i, pos[i] - high, pos[i] - low + WINDOW


def stretches(row: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of row and place -> (first entry of each stretch, its windows): neighbours of one key, some
    ``STRETCH`` windows at most."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + count[:-1])
    head = np.flatnonzero(fresh)
    piece = (start - np.repeat(start[head], np.diff(np.append(head, len(row))))) // STRETCH
    fresh[1:] |= piece[1:] != piece[:-1]
    head = np.flatnonzero(fresh)
    return head, np.add.reduceat(count, head) if len(head) else head


# --- records --------------------------------------------------------------------------------------------------------

#: kind 0: a removed span of ``row`` from ``a`` to ``b``.  1: a segment to be compared: first window of row << 12 | number of
#: windows in ``a``, cell ``h``, ``part`` of its anchor's.  2: an anchor of cell ``h`` has more than HOT.  3: ``blob`` packs
#: places of a bucket.
_ROW = "bucket long, kind long, row long, a long, b long, h long, part long, blob binary"
_KEYS = ["bucket", "kind", "row", "a", "b", "h", "part", "blob"]


def _rows(n: int, **columns) -> pa.RecordBatch:
    kind = lambda k: pa.binary() if k == "blob" else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind(k)) if k in columns else pa.nulls(n, kind(k)) for k in _KEYS], names=_KEYS)


def _removed(row, start, stop, buckets: int) -> pa.RecordBatch:
    row, start, stop = merge_spans(row, start, stop)
    return _rows(len(row), bucket=as_signed(mix64(row.astype(np.uint64)) % U64(buckets)), kind=np.zeros(len(row), np.int64), row=row, a=start, b=stop)


def _bytes_of(x: np.ndarray) -> bytes:
    """Longs by place value: bytes that are much alike stand together."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(h: np.ndarray, doc: np.ndarray, row: np.ndarray, span: np.ndarray) -> bytes:
    order = np.lexsort((span, row))
    h, doc, row, span = h[order], doc[order], row[order], span[order]
    small = _bytes_of(np.diff(doc, prepend=0)) + _bytes_of(np.diff(row, prepend=0)) + _bytes_of(span)
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()
    return len(h).to_bytes(8, "little") + low + zstandard.ZstdCompressor(level=1).compress(small)


def _unpack(blob: bytes):
    n = int.from_bytes(blob[:8], "little")
    h = np.zeros((n, 8), np.uint8)
    h[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, KEY_BYTES * n, 8).reshape(n, KEY_BYTES)
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + KEY_BYTES * n :]), np.uint8).reshape(3, 8, n)
    doc, row, span = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in small)
    return h.view("<u8").ravel(), np.cumsum(doc), np.cumsum(row), span


def _packed(h: np.ndarray, doc: np.ndarray, row: np.ndarray, span: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One packed record per bucket; a bucket goes by ``h``."""
    bucket = as_signed(mix64(h) % U64(buckets))
    turn = np.argsort(bucket, kind="stable")
    at = np.append(_heads(bucket[turn]), len(h)) if len(h) else np.zeros(1, np.int64)
    blobs = [_pack(h[i], doc[i], row[i], span[i]) for i in (turn[a:b] for a, b in zip(at[:-1], at[1:]))]
    return _rows(len(blobs), bucket=bucket[turn][at[:-1]], kind=np.full(len(blobs), 3), blob=blobs)


def _rank(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((pos, row, doc))] = np.arange(len(doc))
    return rank


def _stage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [pack.compress(t.encode("utf-8", "replace")) if t else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "id")), pa.array(z, pa.binary()), batch.column("carried")], names=["row", "id", "z", "carried"])


def _cell(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(row.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + (start >> CELL_BITS).astype(np.uint64))


def _found_spans(found: np.ndarray, begin: np.ndarray, row: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Found windows of a buffer -> spans of rows.  ``begin``: places in ascending order that are ``pos`` of ``row``."""
    edge = np.diff(np.pad(found, 1).view(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(begin, start, side="right") - 1
    return _removed(row[own], pos[own] + start - begin[own], pos[own] + stop - 1 - begin[own] + WINDOW, buckets)


def _find_segments(buckets: int):
    """Compares a task's own segments; sends repeats, and packed places of the segments that hold other windows."""

    def send(raws: list[bytes], texts: list[tuple], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        buf = np.frombuffer(b"".join(raws), np.uint8)
        raws.clear()
        h, doc, row, start, count, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        size = np.diff(np.append(_heads(h[order]), len(h)))
        shared = np.sort(order[np.repeat(size, size) > 1])
        rest = np.ones(len(h), bool)
        if len(shared):
            rank = _rank(doc[shared], row[shared], start[shared])
            order = np.lexsort((rank, h[shared]))
            head = _heads(h[shared][order])
            cell = np.empty(len(shared), np.uint64)
            cell[order] = np.repeat(_cell(row[shared][order[head]], start[shared][order[head]]), np.diff(np.append(head, len(order))))
            head, windows = stretches(row[shared], start[shared], count[shared], cell)
            found = repeated_starts(buf, at[shared][head], windows, cell[head], rank[head])
            yield _found_spans(found, *(np.concatenate(x) for x in zip(*texts)), buckets)
            width = np.arange(SIDE + 1)
            inside = width < count[shared][:, None]
            open_ = inside & ~found[np.minimum(at[shared][:, None] + width, len(buf) - 1)]
            first, last = open_.argmax(axis=1), SIDE - open_[:, ::-1].argmax(axis=1)
            rest[shared] = open_.any(axis=1)
            start[shared] += first
            count[shared] = last - first + 1
        yield _packed(h[rest], doc[rest], row[rest], (start << 12 | count)[rest], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        raws, texts, held, total, waiting = [], [], [], 0, 0
        part: list[tuple[int, int, bytes]] = []

        def take() -> None:
            nonlocal total, waiting
            sizes = np.array([len(p[2]) for p in part], np.int64)
            raw = b"".join(p[2] for p in part)
            h, _, start, stop = segments(np.frombuffer(raw, np.uint8), sizes)
            begin = np.cumsum(sizes) - sizes
            own = np.searchsorted(begin, start, side="right") - 1
            ids, rows = (np.array([p[k] for p in part], np.int64) for k in (0, 1))
            held.append((h, ids[own], rows[own], start - begin[own], stop - start + 1, start + total))
            texts.append((begin + total, rows, np.zeros(len(rows), np.int64)))
            raws.append(raw)
            total += len(raw)
            waiting = 0
            part.clear()

        for batch in batches:
            for doc, row, z in zip(*(batch.column(k).to_pylist() for k in ("id", "row", "z"))):
                raw = unzip.decompress(z) if z else b""
                if len(raw) < WINDOW:
                    continue
                part.append((NO_ID if doc is None else doc, row, raw))
                waiting += len(raw)
                if waiting >= SLICE_BYTES:
                    take()
                if total >= TASK_BYTES:
                    yield from send(raws, texts, held)
                    raws, texts, held, total = [], [], [], 0
        if part:
            take()
        if held:
            yield from send(raws, texts, held)

    return run


class _Met:
    """Keys of one bucket that have come twice or more.  Holds one entry per key, however often it comes."""

    def __init__(self):
        self.once = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
        self.known, self.cell, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def take(self, places: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, row, span = (np.concatenate(x) for x in zip(self.once, *places))
        order = np.lexsort((span, row, doc, h))
        h, doc, row, span = h[order], doc[order], row[order], span[order]
        head = _heads(h)
        keys, size = h[head], np.diff(np.append(head, len(h)))
        at, cell, before = np.searchsorted(self.known, keys), _cell(row[head], span[head] >> 12), np.zeros(len(keys), np.int64)
        old = np.zeros(len(keys), bool)
        if len(self.known):
            at = np.minimum(at, len(self.known) - 1)
            old = self.known[at] == keys
            cell, before = np.where(old, self.cell[at], cell), np.where(old, self.count[at], 0)
        many = before + size > 1
        out = np.repeat(many, size)
        nth = (np.repeat(before, size) + ragged_arange(size))[out]
        n = len(nth)
        yield _rows(n, kind=np.ones(n, np.int64), row=row[out], a=span[out], h=as_signed(np.repeat(cell, size)[out]), part=nth // HOT)
        hot = np.unique(cell[(before <= HOT) & (before + size > HOT)])
        yield _rows(len(hot), kind=np.full(len(hot), 2), h=as_signed(hot))
        self.once = [h[~out], doc[~out], row[~out], span[~out]]
        self.count[at[old]] = (before + size)[old]
        new = many & ~old
        turn = np.argsort(np.concatenate([self.known, keys[new]]), kind="stable")
        self.known, self.cell, self.count = (np.concatenate([x, y[new]])[turn] for x, y in ((self.known, keys), (self.cell, cell), (self.count, size)))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of buckets -> spans as they are, and the places whose key is met again, bucket by bucket."""
    bucket, met, held, n = None, _Met(), [], 0
    for batch in batches:
        plain = np.array(batch.column("kind").to_pylist()) == 0
        if plain.any():
            yield batch.filter(pa.array(plain))
        for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if blob is None:
                continue
            if own != bucket and held:
                yield from met.take(held)
                held, n = [], 0
            if own != bucket:
                bucket, met = own, _Met()
            held.append(_unpack(blob))
            n += len(held[-1][0])
            if n >= 200_000:
                yield from met.take(held)
                held, n = [], 0
    if held:
        yield from met.take(held)


_STRETCH = "h long, part long, id long, row long, pos long, n long, bytes binary"
_STRETCH_NAMES = [f.split()[0] for f in _STRETCH.split(", ")]


def _cut_stretches(one_part: bool):
    """Texts, each followed by its segments in order -> the stretches' bytes.  ``one_part``: whatever the segments' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, raw, doc = zstandard.ZstdDecompressor(), b"", None
        out: list[list] = [[] for _ in _STRETCH_NAMES]
        last = None  # cell, part, id, row, first window, window after the last

        def close() -> None:
            if last:
                for column, v in zip(out, (*last[:5], last[5] - last[4], raw[last[4] : last[5] + WINDOW - 1])):
                    column.append(v)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == 6 else pa.int64()) for k, v in enumerate(out)], names=_STRETCH_NAMES)

        for batch in batches:
            for row, at, z, own, h, part in zip(*(batch.column(k).to_pylist() for k in ("row", "at", "z", "id", "h", "part"))):
                if at < 0:
                    close()
                    last, raw, doc = None, unzip.decompress(z) if z else b"", NO_ID if own is None else own
                    continue
                start, stop = at >> 12, (at >> 12) + (at & 4095)
                part = 0 if one_part else part
                if last and start == last[5] and h == last[0] and part == last[1] and start < last[4] + STRETCH:
                    last = (*last[:5], stop)
                else:
                    close()
                    last = (h, part, doc, row, start, stop)
            if out[0]:
                yield rows()
                out = [[] for _ in _STRETCH_NAMES]
        close()
        if out[0]:
            yield rows()

    return run


def _settle(buckets: int):
    """Stretches in order of (cell, part) -> repeats; of cells with several parts, the other windows' places."""

    def compare(held: list[tuple]):
        h, doc, row, pos, n, raw = zip(*held)
        h, doc, row, pos, n = (np.array(x, np.int64) for x in (h, doc, row, pos, n))
        size = np.array([len(b) for b in raw], np.int64)
        begin = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(raw), np.uint8)
        found = repeated_starts(buf, begin, n, h, _rank(doc, row, pos))
        return buf, begin, found, _found_spans(found, begin, row, pos, buckets)

    def windows(held: list[tuple], buf, begin, found, hot: set) -> Iterator[pa.RecordBatch]:
        h, doc, row, pos, n = (np.array(x, np.int64) for x in zip(*(s[:5] for s in held)))
        some = np.flatnonzero(np.isin(h, np.array(sorted(hot), np.int64)))
        own, at = np.repeat(some, n[some]), _ranges(begin[some], n[some])
        own, at = own[~found[at]], at[~found[at]]
        if len(at):
            yield _packed(content_hash(buf, at, np.full(len(at), WINDOW)), doc[own], row[own], (pos[own] + at - begin[own]) << 12 | 1, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, flagged, hot, size, most = None, None, set(), 0, 2 * SETTLE_BYTES
        for batch in batches:
            for h, part, *rest in zip(*(batch.column(k).to_pylist() for k in _STRETCH_NAMES)):
                if rest[1] is None:  # the sign that the cell has several parts comes first
                    flagged = h
                    continue
                if (h, part) != last and size >= SETTLE_BYTES:
                    buf, begin, found, spans = compare(held)
                    yield spans
                    if hot:
                        yield from windows(held, buf, begin, found, hot)
                    held, hot, size, most = [], set(), 0, 2 * SETTLE_BYTES
                elif size >= most:  # copies from very many tasks: few stay
                    _, begin, found, spans = compare(held)
                    yield spans
                    held = [s for s, a in zip(held, begin.tolist()) if not found[a : a + s[4]].all()]
                    size = sum(len(s[5]) for s in held)
                    most = max(2 * SETTLE_BYTES, 2 * size)
                last = (h, part)
                if part or h == flagged:
                    hot.add(h)
                held.append((h, *rest))
                size += len(rest[4])
        if held:
            buf, begin, found, spans = compare(held)
            yield spans
            if hot:
                yield from windows(held, buf, begin, found, hot)

    return run


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, each followed by its spans in order -> what is removed and what stays."""
    unzip = zstandard.ZstdDecompressor()
    names = ["row", "doc_id", "n_bytes", "n_removed", "spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    out: list[list] = [[] for _ in names]
    text, spans, held = None, [], 0

    def close() -> int:
        row, doc, raw, carried = text
        at, kept = 0, []
        for a, b in spans:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        for column, v in zip(out, (row, doc, len(raw), sum(b - a for a, b in spans), spans, b"".join(kept))):
            column.append(v)
        others.append(carried)
        return len(raw)

    def rows(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out, types)), pa.array(others, kind)], names=[*names, "carried"])

    others: list = []
    kind = None
    for batch in batches:
        kind = batch.column("carried").type
        for row, at, z, doc, stop, carried in zip(*(batch.column(k).to_pylist() for k in ("row", "at", "z", "id", "b", "carried"))):
            if at < 0:
                if text:
                    held += close()
                text, spans = (row, doc, unzip.decompress(z) if z else b"", carried), []
                if held > 4 << 20:
                    yield rows(kind)
                    out, others, held = [[] for _ in names], [], 0
            elif spans and at <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], stop))
            else:
                spans.append((at, stop))
    if text:
        close()
        yield rows(kind)


def _beside(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Each text followed by its marks in order of place; a text of any number of marks streams by."""
    rows = texts.withColumn("at", F.lit(-1).cast("long")).unionByName(marks.withColumnRenamed("a", "at"), allowMissingColumns=True)
    return rows.repartition("row").sortWithinPartitions("row", "at")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, spans`` (removed runs of the text's UTF-8 bytes, as
    [start, stop]), ``kept`` (the bytes that stay) and the columns named in ``carry``.

    Null text counts as empty; texts of less than 100 bytes stay whole.  Every row is a document of its own: rows that
    share an id are in some fixed order, rows without an id come after all others.
    """
    spark = docs.sparkSession
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    kind = rows.schema["carried"].dataType.simpleString()
    texts = stage_table(rows.mapInArrow(released(_stage_rows), f"row long, id long, z binary, carried {kind}"), "texts")
    z = texts.select("row", "id", "z")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    match = lambda df: df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_match), _ROW)

    def fetched(marks: DataFrame, last: bool) -> DataFrame:
        places = marks.where("kind = 1").select("row", "a", "h", "part")
        cut = _beside(z, places).mapInArrow(released(_cut_stretches(last)), _STRETCH)
        if not last:
            cut = cut.unionByName(marks.where("kind = 2").select("h", F.lit(0).cast("long").alias("part")), allowMissingColumns=True)
        return cut.repartition("h", "part").sortWithinPartitions("h", "part", F.col("row").asc_nulls_first(), "pos")

    # a finished phase's shuffle files go with its plan, so its garbage is collected before the next phase writes
    places = stage_table(match(z.mapInArrow(released(_find_segments(buckets)), _ROW)), "places")
    release_shuffles(spark)
    settled = stage_table(match(fetched(places, False).mapInArrow(released(_settle(buckets)), _ROW)), "settled")
    release_shuffles(spark)
    ends = ["row", "a", "b"]
    spans = stage_table(places.where("kind = 0").unionByName(settled.where("kind = 0")).select(*ends), "spans")
    drop_tables(places)
    if not settled.where("kind = 1").isEmpty():
        spans = spans.unionByName(stage_table(fetched(settled, True).mapInArrow(released(_settle(buckets)), _ROW).where("kind = 0").select(*ends), "spans"))
        release_shuffles(spark)
    drop_tables(settled)
    cut = _beside(texts, spans).mapInArrow(released(_cut_texts), f"row long, doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, carried {kind}")
    return cut.select("doc_id", "n_bytes", "n_removed", "spans", "kept", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: what is removed of every document, and a digest of what stays."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """For tests: the same by looking at every window."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        raw = texts[doc]
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - WINDOW + 1):
            w = raw[s : s + WINDOW]
            if w in seen:
                gone[s : s + WINDOW] = True
            seen.add(w)
        runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
