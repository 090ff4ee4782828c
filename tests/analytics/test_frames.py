"""Inserts and far frames against plain loops, with a recording that holds most frames."""

import math
import random

from spindrift.operators import frames

SCHEMA = "video long, t long, hash long, hist array<double>, flat double, sat double"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def made(rng, video, n):
    scene, out = rng.getrandbits(64), []
    for t in range(n):
        if rng.random() < 0.15:
            scene = rng.getrandbits(64)
        bits = scene
        for _ in range(rng.randrange(4)):
            bits ^= 1 << rng.randrange(64)
        if rng.random() < 0.3:
            bits = rng.getrandbits(64)
        hist = [0.0] * 4
        hist[rng.choice([0, 0, 0, 1, 2, 3])] = 1.0
        out.append((video, t, signed(bits), hist, rng.choice([0.03, 0.05, 0.05, 0.05, 0.3]), rng.choice([0.2, 0.6, 0.9])))
    return out


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def plain_inserts(rows, cuts):
    """One recording, by the rule."""
    n, out = len(rows), []
    dur = float(n)
    intro = int(max(20, min(60, dur * 0.15)))
    mean = [sum(r[3][k] for r in rows) / n for k in range(4)]
    cards = [r[1] for r in rows if r[1] < intro and r[4] < 0.04 and r[5] > 0.35]
    edges = sorted({0.0, dur, *[c for c in cuts if 0 < c < dur]})
    for a, b in zip(edges, edges[1:]):
        if not 0.4 <= b - a <= 4:
            continue
        secs = [t for t in range(math.ceil(a), math.floor(b) + 1) if t < n and a <= t < b]
        odd = 0
        for t in secs:
            outside = [distance(rows[t][2], r[2]) for r in rows if not int(a) - 2 <= r[1] < int(b) + 3]
            chi = 0.5 * sum((p - q) ** 2 / (p + q + 1e-6) for p, q in zip(rows[t][3], mean))
            odd += bool(outside) and min(outside) >= 24 and chi > 0.5 and rows[t][4] < 0.06 and rows[t][5] > 0.35
        if secs and 2 * odd >= len(secs) and not (a < intro and any(c <= a < c + 1 for c in cards)):
            out.append((rows[0][0], a, b, len(secs), odd))
    return out


def test_inserts_equal_plain_loops(spark):
    rng = random.Random(8)
    rows, cuts, want = [], [], []
    for video in range(12):
        n = 900 if video == 0 else rng.choice([2, 6, 20, 45, 90])  # one recording holds more than half of all frames
        own = made(rng, video, n)
        marks = [round(rng.random() * n * 4) / 4 for _ in range(n // 3)]
        rows, cuts, want = rows + own, cuts + [(video, m) for m in marks], want + plain_inserts(own, marks)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = frames.inserts(table, spark.createDataFrame(cuts, "video long, at double"), 4)
    assert sorted(tuple(r) for r in got.select("video", "a", "b", "seconds", "odd").collect()) == sorted(want)
    assert len(want) >= 5
    assert frames.inserts(table.limit(0), spark.createDataFrame(cuts, "video long, at double"), 4).count() == 0


def test_far_frames_over_blocks(spark, monkeypatch):
    """Blocks of 16 seconds: the same answer, and what two witnesses settle never meets the rest."""
    monkeypatch.setattr(frames, "BLOCK", 16)
    rng = random.Random(5)
    rows = made(rng, 1, 300) + made(rng, 2, 5)
    known = spark.createDataFrame(rows, SCHEMA)
    asked = known.selectExpr("video", "t", "hash", "t - 4 AS lo", "t + 4 AS hi")
    want = set()
    for v, t, h, *_ in rows:
        others = [distance(h, r[2]) for r in rows if r[0] == v and not t - 4 <= r[1] <= t + 4]
        if others and min(others) >= 24:
            want.add((v, t))
    assert {tuple(r) for r in frames.far_frames(asked, known).collect()} == want and want
    rest = frames.witnessed(asked, known)
    assert want <= {(r.video, r.t) for r in rest.collect()} and rest.count() < 0.9 * len(rows)


def test_chi_square_and_shots(spark):
    got = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>").select(frames.chi_square("p", "q").alias("c")).collect()
    assert abs(got[0].c - 1) < 1e-5 and got[1].c == 0
    cuts = spark.createDataFrame([(1, 0.2), (1, 1.0), (1, 9.0), (1, -3.0), (1, 50.0), (1, 9.0), (2, 1.0)], "video long, at double")
    lengths = spark.createDataFrame([(1, 12.0), (3, 2.0)], "video long, dur double")
    assert sorted(tuple(r) for r in frames.shots(cuts, lengths).collect()) == [(1, 0.2, 1.0), (1, 9.0, 12.0), (3, 0.0, 2.0)]
