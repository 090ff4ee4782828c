"""Moments against plain loops, with a key of most rows and small blocks."""

import random
import statistics
from functools import partial

from pyspark.sql import functions as F

from spindrift.operators import moments, talk


def events(rng, keys=5):
    return [(k, 1000 * k + i, t, rng.randrange(4)) for k in range(keys) for i, t in enumerate(sorted(rng.sample(range(2000), 400 if k == 0 else 30)))]


def test_rows_of_equals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(moments, "in_blocks", partial(moments.in_blocks, size=16))
    rng = random.Random(1)
    rows = [(k, i, t, rng.choice([None, "a", "a", "a", "b"])) for k, i, t, _ in events(rng)]
    want = []
    for k in range(5):
        own, i = [r for r in rows if r[0] == k], 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][3] == own[i][3]:
                j += 1
            want += [r[1] for n, r in enumerate(own[i:j]) if j - i <= 4 or n < 2]
            i = j
    got = moments.without_rows_of_equals(spark.createDataFrame(rows, "k int, id int, t int, v string"), ["k"], "t", ["t", "id"], "v", 100)
    assert sorted(r.id for r in got.collect()) == sorted(want) and len(want) < len(rows)


def test_best_of_close(spark):
    rng = random.Random(2)
    rows, want = events(rng), {}
    for k in range(5):
        kept = []
        for _, i, t, s in [r for r in rows if r[0] == k]:
            if kept and t - kept[-1][0] < 9:
                if s > kept[-1][2]:
                    kept[-1] = (t, i, s)
            else:
                kept.append((t, i, s))
        want |= {i: s / max(x[2] for x in kept) for _, i, s in kept}
    got = {r.id: r.share for r in moments.best_of_close(spark.createDataFrame(rows, "k int, id int, t long, s int"), ["k"], "t", "s", 9, 50).collect()}
    assert got == want


def test_spikes_at_the_ends_and_in_talk(spark):
    rng = random.Random(3)
    rows, talk, want = [], [], []
    for k, n in ((0, 500), (1, 1), (2, 40)):
        level = [rng.choice([-50.0, -48.0, -30.0, -20.0]) for _ in range(n)]
        spans = [(a, a + rng.randrange(4)) for a in rng.sample(range(n), n // 10)]
        padded = [level[0]] * 4 + level + [level[-1]] * 4
        hot = [x - statistics.median(padded[i : i + 9]) >= 12 and x > -35 for i, x in enumerate(level)]
        i = 0
        while i < n:
            j = i
            while j < n and hot[j]:
                j += 1
            if 0 < j - i < 3 and not any(a - 1 <= i <= b + 1 for a, b in spans):
                want.append((k, i, j - 1, max(level[i:j])))
            i = max(j, i + 1)
        rows += [(k, i, x) for i, x in enumerate(level)]
        talk += [(k, a, b) for a, b in spans]
    got = moments.spikes(spark.createDataFrame(rows, "key int, i long, level double"), spark.createDataFrame(talk, "key int, a long, b long"), reach=4, rise=12, least=-35, longest=3, slack=1, bucket=32)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20


def test_shots_cutaways_and_numbers(spark):
    cuts = spark.createDataFrame([(1, c) for c in (10.0, 12.0, 40.0, 41.0, 90.0, -1.0, 200.0)] + [(2, 5.0)], "key int, at double")
    lengths = spark.createDataFrame([(1, 100.0), (3, 8.0)], "key int, dur double")
    got = {(r.key, r.part): (r.n, r.median) for r in moments.shot_lengths(cuts, lengths).collect()}
    assert got == {(1, "head"): (3, 10.0), (1, "body"): (2, 25.0), (1, "tail"): (1, 10.0), (3, "head"): (1, 8.0)}
    gaps = spark.createDataFrame([(1, 9.0, 13.0), (1, 39.0, 95.0), (1, 300.0, 310.0), (2, 0.0, 9.0)], "key int, a double, b double")
    assert sorted(tuple(r) for r in moments.cutaways(gaps, cuts).collect()) == [(1, 39.0, 95.0, 41.05, 89.95)]
    asked = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 20, 0), (1, 3, 30, 7), (1, 4, 40, None), (2, 1, 5, 0)], "c int, id int, t int, want int")
    stored = spark.createDataFrame([(1, 2, 4), (1, 9, 5), (1, 3, 2)], "c int, id int, number int")
    got = {(r.c, r.id): r.number for r in moments.assigned_numbers(asked, stored, ["c"], "t", ["t", "id"], 10).collect()}
    assert got == {(1, 1): 8, (1, 2): 4, (1, 3): 7, (1, 4): 9, (2, 1): 1}


def test_onsets_and_smoothing_equal_plain_loops(spark):
    rng = random.Random(5)
    rows, talk, want, smooth = [], [], [], {}
    for k, n in ((0, 600), (1, 1), (2, 60), (3, 5)):
        level = [rng.choice([-60.0, -58.0, -45.0, -30.0, -10.0]) for _ in range(n)]
        spans = [(a, a + rng.randrange(3)) for a in rng.sample(range(n), n // 12)]
        base = [level[0]] * 10 + level
        last = -99
        for i, x in enumerate(level):
            peak, tail = max(level[i : i + 4]), level[i + 12 : i + 20]
            low = level[0] if i == 0 else min(base[i : i + 10])
            if x - low >= 9 and x > -38 and i - last >= 25 and not (tail and statistics.mean(tail) > peak - 8) and not any(a <= i <= b for a, b in spans):
                want.append((k, i))
                last = i
        holes = [x if rng.random() < 0.6 and k != 3 else None for x in level]
        known = [i for i, x in enumerate(holes) if x is not None]
        for i in range(n):
            p, q = max((j for j in known if j <= i), default=None), min((j for j in known if j >= i), default=None)
            fill = None if p is None and q is None else holes[q] if p is None else holes[p] if q is None or p == q else holes[p] + (holes[q] - holes[p]) * (i - p) / (q - p)
            smooth[k, i] = fill
        rows += [(k, i, x, h) for i, (x, h) in enumerate(zip(level, holes))]
        talk += [(k, a, b) for a, b in spans]
    frame = spark.createDataFrame(rows, "key int, i long, level double, value double")
    got = moments.onsets(frame.select("key", "i", "level"), spark.createDataFrame(talk, "key int, a long, b long"), bucket=32)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10
    sizes = {k: n for k, n in ((0, 600), (1, 1), (2, 60), (3, 5))}
    for r in moments.smoothed(frame.select("key", "i", "value"), 3, bucket=16).collect():
        reach = min(3, r.i, sizes[r.key] - 1 - r.i)
        around = [smooth[r.key, j] for j in range(r.i - reach, r.i + reach + 1)]
        assert (r.value is None and None in around) or abs(r.value - statistics.mean(around)) < 1e-9


def test_summaries_by_chapters_and_shares(spark):
    said = [(1, 1.0, "early", 9), (1, 10.0, "one", 1), (1, 11.0, "two", 5), (1, 12.0, "three", 5), (1, 13.0, "four", 2), (1, 14.0, "two", 99), (1, 50.0, "last", 0), (2, 5.0, "none", 1), (1, None, "x", 3), (1, 15.0, None, 3)]
    rows = spark.createDataFrame(said, "key int, start double, text string, s int")
    got = talk.chapter_summaries(rows, F.col("s"), spark.createDataFrame([(1, 40.0), (1, 9.0), (1, 9.0)], "key int, t double")).orderBy("chapter", "place").collect()
    assert [(r.chapter, r.place, r.text) for r in got] == [(9.0, 1, "two"), (9.0, 2, "three"), (9.0, 3, "four"), (40.0, 1, "last")]
    segs = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 10.0, 10.5, "b"), (1, 11.0, 21.0, "b"), (1, 30.0, 60.0, "a"), (1, 70.0, 90.0, None), (2, 0.0, 1.0, "a")], "key int, start double, end double, label string")
    got = {(r.key, r.label): r for r in talk.speaker_shares(segs).collect()}
    assert abs(got[1, "a"].share - 0.8) < 1e-9 and got[1, "b"].seconds == 10 and got[1, "a"].speakers == 2 and abs(got[1, "a"].turns_per_minute - 2.0) < 1e-9
    assert got[2, "a"].share == 1 and got[2, "a"].turns_per_minute == 0


def test_montages_equal_a_plain_walk(spark):
    rng = random.Random(8)
    cuts, music, said, want = [], [], [], []
    for k in range(6):
        n = 1500 if k == 0 else 200
        own = sorted(rng.sample(range(n), n // 5))
        notes = [(t, rng.choice([0.0, 0.5, 1.0])) for t in range(0, n, 4)]
        talk_ = [(a, a + rng.randrange(1, 12)) for a in rng.sample(range(n), n // 40)]
        spoken = {t for a, b in talk_ for t in range(a, b)}
        found = []
        for c in own:
            near = [x for x in own if c <= x <= c + 16]
            if len(near) < 5:
                continue
            levels = [x for t, x in notes if c <= t <= c + 16]
            fine = bool(levels) and statistics.mean(levels) > 0.5 and len(spoken & set(range(c, c + 16))) < 0.3 * 16
            if found and c < found[-1][1]:
                found[-1][1] = max(found[-1][1], near[-1])
            elif fine:
                found.append([c, near[-1]])
        want += [(k, a, b) for a, b in found]
        cuts, music, said = cuts + [(k, c) for c in own], music + [(k, *x) for x in notes], said + [(k, *x) for x in talk_]
    got = moments.montages(spark.createDataFrame(cuts, "key int, at long"), spark.createDataFrame(music, "key int, at long, level double"), spark.createDataFrame(said, "key int, a long, b long"), span=16, level=0.5, bucket=64)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10


def test_quiet_drift(spark):
    rng = random.Random(9)
    history, uploads, want = [], [], {}
    for k in range(5):
        own = [(t, rng.choice([None, 10.0 * t, 50.0])) for t in sorted(rng.sample(range(900), 300 if k == 0 else 12))]
        ups = rng.sample(range(900), 60 if k == 0 else 5)
        known = [x for x in own if x[1] is not None]
        steps = [(b[1] - a[1]) / ((b[0] - a[0]) / 7) for a, b in zip(known, known[1:]) if b[0] - a[0] >= 6 and not any(a[0] < u <= b[0] for u in ups)]
        want[k] = (len(steps), max(0.0, statistics.median(steps)) if steps else 0.0)
        history, uploads = history + [(k, *x) for x in own], uploads + [(k, u) for u in ups]
    got = moments.quiet_drift(spark.createDataFrame(history, "key int, at long, subs double"), spark.createDataFrame(uploads, "key int, at long"), apart=6, week=7, bucket=40).collect()
    assert {r.key: (r.pairs, round(r.drift, 6)) for r in got} == {k: (n, round(d, 6)) for k, (n, d) in want.items()} and any(n for n, _ in want.values())
