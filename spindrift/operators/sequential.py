"""Operators whose next step depends on the last choice: greedy picks, dynamic programmes, matching.

Each works on one bounded group (the newest rows of a channel, a conversation, a week, an order) as a plain function on
lists, which Spark applies group by group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` on each group's rows, sorted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def over_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, f: Callable[[dict], tuple]) -> DataFrame:
    """``f`` on each group's columns (arrays, sorted by ``order``), for very many small groups: partitions come in order, and no
    frame is made for a group.  ``f`` gives the places of the rows that stay, and columns of theirs that are new."""
    types = {"boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    named = [x.split() for x in schema.split(", ")]

    def worked(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = {c: (table.column(c) if c in keys or not pa.types.is_integer(table.schema.field(c).type) else table.column(c).fill_null(0)).to_numpy() for c in table.column_names}
        rows, fresh = [], []
        for a, b in zip(new.tolist(), np.append(new[1:], table.num_rows).tolist()):
            at, made = f({c: x[a:b] for c, x in cols.items()})
            if len(at):
                rows.append(a + np.asarray(at))
                fresh.append(made)
        if rows:
            kept = table.take(pa.array(np.concatenate(rows)))
            out = [pa.array(np.concatenate([x[c] for x in fresh]), types[kind]) if c in fresh[0] else kept.column(c).combine_chunks() for c, kind in named]
            yield pa.RecordBatch.from_arrays(out, names=[c for c, _ in named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held[-1:], batch])
            new = np.zeros(table.num_rows, bool)
            for c in keys:
                x = table.column(c).combine_chunks()
                x, before = x[1:], x[:-1]
                new[1:] |= pc.coalesce(pc.not_equal(x, before), pc.not_equal(pc.is_null(x), pc.is_null(before))).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if not len(starts):  # the last group goes on
                held = [table.combine_chunks().to_batches()[0]]
                continue
            last = int(starts[-1])
            yield from worked(table.slice(0, last), np.append(0, starts[:-1]))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from worked(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pick_peaks(at: Sequence[float], level: Sequence[float], apart: float, above: float, most: int) -> list[int]:
    """Indices of the highest levels that reach ``above`` and lie more than ``apart`` from every pick; in order of level, of
    equal ones the latest first."""
    picked: list[int] = []
    places: list[float] = []
    for i in sorted(range(len(at)), key=lambda i: (-level[i], -at[i], i)):
        if level[i] < above or len(picked) == most:
            break
        k = bisect_left(places, at[i])
        if all(abs(places[j] - at[i]) > apart for j in (k - 1, k) if 0 <= j < len(places)):
            picked.append(i)
            places.insert(k, at[i])
    return picked


def diverse_top(score: Sequence[float], kind: Sequence, most: int, per_kind: int) -> list[int]:
    """The best ``most`` with at most ``per_kind`` of a kind."""
    out: list[int] = []
    used: dict = {}
    for i in sorted(range(len(score)), key=lambda i: (-score[i], i)):
        if len(out) < most and used.get(kind[i], 0) < per_kind:
            out.append(i)
            used[kind[i]] = used.get(kind[i], 0) + 1
    return out


def match_slots(slots: Sequence[float], uploads: Sequence[float], late: float = 0) -> list[tuple[int, int]]:
    """Greedy pairs of a slot and an upload: those whose slot lies at or before the upload (``late`` after it at most)
    first, then the nearest, then by upload and slot."""
    pairs = sorted((s > u + late, abs(u - s), j, i) for i, s in enumerate(slots) for j, u in enumerate(uploads))
    out: list[tuple[int, int]] = []
    left, right = set(range(len(slots))), set(range(len(uploads)))
    for _, _, j, i in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            out.append((i, j))
    return sorted(out)


def suppress(boxes: Sequence[tuple[float, float, float, float]], score: Sequence[float], most: float) -> list[int]:
    """Boxes (x, y, w, h) kept, best first: one goes if it shares more than ``most`` (IoU) with a better one."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-score[i], i)):
        if all(iou(boxes[i], boxes[k]) <= most for k in kept):
            kept.append(i)
    return kept


def suppressed(boxes: str, w: float, h: float, most: float) -> Column:
    """As ``suppress``, of an array of structs (x, y, ...) in order, best first, all boxes ``w`` by ``h``: those kept."""

    def covers(a: Column, b: Column) -> Column:
        side = lambda c, n: F.greatest(F.lit(0), F.least(a[c], b[c]) + n - F.greatest(a[c], b[c]))
        shared = side("x", w) * side("y", h)
        return shared / (2 * w * h - shared) > most

    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda a: covers(a, b)), kept).otherwise(F.array_append(kept, b)))


def iou(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole columns of bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    left = all_
    for c in b:
        hit = left & at.get(c, 0)
        left = ((left + hit) | (left - hit)) & all_
    return len(a) - left.bit_count()


def alike(a: str, b: str, share: float) -> bool:
    """Whether the matching share of two whole strings is at least ``share``; upper bounds first: lengths, letters, and
    the longest common subsequence, as matching blocks are one."""
    if a == b:
        return True
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < share:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    if m.quick_ratio() < share or 2 * common(a, b) / (len(a) + len(b)) < share:
        return False
    return m.ratio() >= share


def coalesce_lines(at: Sequence[float], same: Callable[[int, int], bool], gap: float, window: int = 40) -> list[int]:
    """Event number of each line: the latest of the last ``window`` events whose last line is near in time and the
    ``same`` (later line, earlier line), else a new one."""
    events: list[int] = []
    out: list[int] = []
    for i, t in enumerate(at):
        for k in range(len(events) - 1, max(-1, len(events) - 1 - window), -1):
            if t - at[events[k]] <= gap and same(i, events[k]):
                events[k] = i
                out.append(k)
                break
        else:
            events.append(i)
            out.append(len(events) - 1)
    return out


def cut_at_pauses(starts: Sequence[float], ends: Sequence[float], least: float, most: float) -> list[int]:
    """Indices at which a new chapter starts: from ``least`` after the last cut on, at the longest pause before ``most``."""
    cuts, last = [0], 0
    while len(starts) and ends[-1] - starts[last] > most:
        room = [i for i in range(last + 1, len(starts)) if least <= starts[i] - starts[last] <= most]
        if not room:
            room = [i for i in range(last + 1, len(starts)) if starts[i] - starts[last] > most][:1]
            if not room:
                break
        last = max(room, key=lambda i: (starts[i] - ends[i - 1], -i))
        cuts.append(last)
    return cuts


def cut_at_gaps(starts: Sequence[float], gaps: Sequence[float], end: float, least: float, most: float) -> list[int]:
    """As ``cut_at_pauses``, from the pause before each start and the last end; starts that cannot be cut at may be left out."""
    cuts, last = [0], 0
    while end - starts[last] > most:
        a = bisect_left(starts, starts[last] + least, last + 1)
        b = bisect_right(starts, starts[last] + most, a)
        if a == b == len(starts):
            break
        last = max(range(a, b), key=lambda i: (gaps[i], -i)) if a < b else b
        cuts.append(last)
    return cuts


def split_lines(words: Sequence[str], width: int) -> list[int]:
    """First word of each line: least sum of squared free places, lines of at most ``width`` (a longer word stands alone)."""
    best = [0.0] + [float("inf")] * len(words)
    back = [0] * (len(words) + 1)
    for j in range(1, len(words) + 1):
        size = -1
        for i in range(j - 1, -1, -1):
            size += len(words[i]) + 1
            if size > width and i < j - 1:
                break
            cost = best[i] + (0 if j == len(words) and size <= width else (width - min(size, width)) ** 2)
            if cost < best[j]:
                best[j], back[j] = cost, i
    out, j = [], len(words)
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def first_fit(items: Sequence[str], budget: int, gap: int = 1) -> list[str]:
    """Items in order while they fit; one that does not is passed over, later ones are still tried; repeats go."""
    out: list[str] = []
    used, seen = 0, set()
    for x in items:
        need = len(x) + (gap if out else 0)
        if x and x.lower() not in seen and used + need <= budget:
            out.append(x)
            used += need
            seen.add(x.lower())
    return out


def _falls(ranks):
    """The pairs of entries of which the first is the greater one, each once, by steps of a radix partition: (places of entries,
    how many greater ones of the step stand before each, where these begin in the last array, places of the greater ones)."""
    import numpy as np

    at = np.arange(len(ranks))
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        group, one = ranks >> (bit + 1), (ranks >> bit) & 1
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(ranks)))
        ahead = np.cumsum(one) - one
        first = np.repeat(ahead[starts], sizes)
        before, zero = ahead - first, one == 0
        yield at[zero], before[zero], first[zero], at[~zero]
        zeros = np.repeat(sizes - np.add.reduceat(one, starts), sizes)
        to = np.where(zero, np.arange(len(ranks)) - before, np.repeat(starts, sizes) + zeros + before)
        moved = np.empty_like(at)
        moved[to] = np.arange(len(at))
        ranks, at = ranks[moved], at[moved]


def _lift_ranks(x, y, slope: float):
    """Ranks by y - slope * x, to twice a double's digits; equal ones share a rank.  At an infinite slope by x, then y."""
    import numpy as np

    if np.isinf(slope):
        high, low = -np.sign(slope) * x, y
    else:

        def halves(v):
            c = 134217729.0 * v
            return c - (c - v), v - (c - (c - v))

        p = slope * x
        (a, b), (c, d) = halves(np.float64(slope)), halves(x)
        off = ((a * c - p) + a * d + b * c) + b * d  # slope * x = p + off
        s = y - p
        back = s - y
        rest = (y - (s - back)) - (p + back) - off
        high = s + rest
        low = rest - (high - s)
    order = np.lexsort((low, high))
    ranks = np.empty(len(x), np.int64)
    ranks[order] = np.cumsum(np.append(False, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
    return ranks


def theil_sen(x: Sequence[float], y: Sequence[float], held: int = 2_000_000) -> tuple[float, float]:
    """(intercept, slope): median of the slopes of pairs more than 1e-12 apart, and of the rest; without such a pair, the median
    and 0; 0 and 0 without points.

    Where there are more than ``held`` slopes they are not worked out one by one: those less than a given slope are pairs of
    points whose order by y - slope * x is not that by x, and are counted in n log n steps.  Such counts at slopes of drawn
    pairs narrow a range down to ``held`` slopes or to one slope that many pairs share; which are drawn says only how many
    counts that takes."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    far = np.searchsorted(x, x + 1e-12, side="right")
    total = int((n - far).sum())
    if not total:
        return (float(np.median(y)) if n else 0.0), 0.0
    xs, starts = np.unique(x, return_index=True)
    ends = np.append(starts[1:], n)
    upto = np.searchsorted(xs, xs + 1e-12, side="right")
    close = [(a, b) for a in np.flatnonzero(upto > np.arange(len(xs)) + 1).tolist() for b in range(a + 1, int(upto[a]))]

    def falls(ranks) -> int:
        ranks = ranks[np.lexsort((ranks, x))]
        count = sum(int(before.sum()) for _, before, _, _ in _falls(ranks))
        for a, b in close:  # pairs that are too near to count
            count -= int(np.searchsorted(ranks[starts[b] : ends[b]], ranks[starts[a] : ends[a]], side="left").sum())
        return count

    def listed(lo: float, hi: float):
        """Slopes between two."""
        order = np.lexsort((_lift_ranks(x, y, hi), _lift_ranks(x, y, lo)))
        found = [x[:0]]
        for later, many, first, greater in _falls(_lift_ranks(x, y, hi)[order]):
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            i, j = order[greater[np.repeat(first, many) + nth]], order[np.repeat(later, many)]
            i, j = (k[x[j] - x[i] > 1e-12] for k in (i, j))
            found.append((y[j] - y[i]) / (x[j] - x[i]))
        return np.sort(np.concatenate(found))

    def middle(first: int, last: int, lo: float, hi: float, before: int, inside: int, drawn) -> tuple[float, float]:
        """Slopes number ``first`` and ``last``; both are in the range, of which ``before`` are lower."""
        while inside > held and len(drawn):
            at = len(drawn) // 2
            near = 2.0**-50 * abs(drawn[at])  # more than the rounding of a slope
            less = falls(_lift_ranks(x, y, drawn[at] - near))
            if last < less:
                hi, inside, drawn = drawn[at] - near, less - before, drawn[:at]
                continue
            upto = total - falls(_lift_ranks(x, -y, -drawn[at] - near))
            if first >= upto:
                lo, before, inside, drawn = drawn[at] + near, upto, inside - (upto - before), drawn[at + 1 :]
            elif less <= first and last < upto:
                return drawn[at], drawn[at]
            else:
                return tuple(middle(k, k, lo, hi, before, inside, drawn)[0] for k in (first, last))
        found = listed(lo, hi)
        return found[first - before], found[last - before]

    rng = np.random.default_rng(7)
    i = rng.integers(0, n, 500_000)
    i = i[far[i] < n]
    j = rng.integers(far[i], n)
    first, last = middle((total - 1) // 2, total // 2, -np.inf, np.inf, 0, total, np.unique((y[j] - y[i]) / (x[j] - x[i])))
    slope = float((first + last) / 2)
    return float(np.median(y - slope * x)), slope
