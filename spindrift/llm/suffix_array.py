"""Suffix arrays by linear grouping (suffixes grouped by their Lyndon prefix), many texts at once.

Phase 1 starts from groups of equal first symbols and takes a text's groups in descending order.  For each member s of
the group, prev(s) is the nearest earlier position whose group is lower; positions that s points at grow their Lyndon
prefix by s's, so they leave their group for new groups right after it, those that more members point at further up.
Each position moves as often as its prefix grows, nothing is renamed recursively.  Phase 2 walks the suffix array from
its least entry: the entry before each suffix, and the chain of prev pointers from it, come next in their groups.

Here thousands of short texts (lanes) are worked on together: each step takes one group of every lane that still has
one, so a step is a fixed number of array operations over all of them.
"""

from __future__ import annotations

import numpy as np

from .common import ragged_arange


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """text: lanes one after another, each ending with its only 0.  Returns positions in ``text``: lane by lane, the
    lane's suffixes in ascending order."""
    lengths = np.asarray(lengths, np.int64)
    n = len(text)
    lane_end = np.cumsum(lengths)
    lane_start = lane_end - lengths
    lane = np.repeat(np.arange(len(lengths)), lengths)
    key = lane * 1024 + text
    sa = np.argsort(key, kind="stable")
    where = np.empty(n, np.int64)
    where[sa] = np.arange(n)
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    group = np.empty(n, np.int64)  # of a position: first index of its group's interval
    group[sa] = np.repeat(begin, size)
    group_end = np.zeros(n + 1, np.int64)  # by first index
    group_end[begin] = begin + size
    start_of_last = np.zeros(n + 1, np.int64)  # by last index
    start_of_last[begin + size - 1] = begin
    prev = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    floor = lane_start[lane]
    cur, active = lane_end.copy(), np.arange(len(lengths))
    while len(active):
        first = start_of_last[cur[active] - 1]
        cur[active], count = first, cur[active] - first
        # the group of the final 0 stands first and has nothing below it
        go = first > lane_start[active]
        active, first, count = active[go], first[go], count[go]
        if not len(active):
            break
        s = sa[np.repeat(first, count) + ragged_arange(count)]
        mark = np.repeat(first, count)
        p = s - 1
        open_ = np.flatnonzero(p >= floor[s])
        p[p < floor[s]] = -1
        while len(open_):
            q = p[open_]
            own = group[q]
            high = own >= mark[open_]
            open_, q, own = open_[high], q[high], own[high]
            q = np.where(own > mark[open_], prev[q], q - 1)
            low = q < floor[s[open_]]
            q[low] = -1
            p[open_] = q
            open_ = open_[~low]
        prev[s] = p
        p = p[p >= 0]
        if not len(p):
            continue
        up, times = np.unique(p, return_counts=True)
        old = group[up]
        order = np.lexsort((times, old))
        up, times, old = up[order], times[order], old[order]
        lead = np.ones(len(up), bool)
        lead[1:] = old[1:] != old[:-1]
        at = np.flatnonzero(lead)
        m = np.diff(np.append(at, len(up)))
        whole = old[at]
        tail = group_end[whole] - m
        target = np.repeat(tail, m) + ragged_arange(m)
        moved[up] = True
        there = sa[target]
        stay = there[~moved[there]]
        spot = where[up]
        holes = spot[spot < np.repeat(tail, m)]
        sa[holes], where[stay] = stay, holes
        sa[target], where[up] = up, target
        moved[up] = False
        group_end[whole] = tail
        rest = tail > whole
        start_of_last[tail[rest] - 1] = whole[rest]
        lead[1:] |= times[1:] != times[:-1]
        at = np.flatnonzero(lead)
        stop = np.append(at[1:], len(up))
        fresh = target[at]
        group[up] = np.repeat(fresh, stop - at)
        group_end[fresh] = target[stop - 1] + 1
        start_of_last[target[stop - 1]] = fresh

    out = np.zeros(n, np.int64)
    out[lane_start] = lane_end - 1
    placed = np.zeros(n + 1, bool)  # the last entry stands for "no position"
    placed[lane_end - 1] = placed[n] = True
    free = np.arange(n)  # next free index of a group, by first index
    prev[prev < 0] = n
    before = np.arange(-1, n - 1)
    before[lane_start] = n
    at, stop = lane_start.copy(), lane_end
    p = before[out[at]]
    while len(at):
        ready = ~placed[p]
        q = p[ready]
        g = group[q]
        out[free[g]] = q
        free[g] += 1
        placed[q] = True
        p[ready] = prev[q]
        on = ~ready
        at[on] += 1
        if (at >= stop).any():
            keep = at < stop
            at, stop, p, on = at[keep], stop[keep], p[keep], on[keep]
        p[on] = before[out[at[on]]]
    return out
