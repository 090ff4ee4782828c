"""Starts against every choice there is, properties of the times, stretches against whole recordings."""

import itertools
import random

from spindrift.operators import sounds
from spindrift.plans.catalogue import QUERIES


def least_cost(options):
    """The least cost over all choices, by trying them all."""
    best = None
    for picks in itertools.product(*[range(len(o) + 1) for o in options]):
        last, cost, fits = -(10**12), 0, True
        for o, k in zip(options, picks):
            free = [x for x in o if x[0] >= last + sounds.APART] or [(last + sounds.APART, sounds.SILENT)]
            if k >= len(free):
                fits = False
                break
            last, c = free[k]
            cost += c
        if fits and (best is None or cost < best):
            best = cost
    return best


def cost_of(starts, options):
    total, last = 0, -(10**12)
    for s, o in zip(starts, options):
        assert s >= last + sounds.APART
        free = dict(reversed([x for x in o if x[0] >= last + sounds.APART] or [(last + sounds.APART, sounds.SILENT)]))
        total, last = total + free[s], s
    return total


def made(rng, n, gap=(0, 20, 100, 400, 1500)):
    t, words, blobs, u = 0, [], [], 0
    for _ in range(n):
        t += rng.choice(gap)
        words.append((t, t + rng.choice([0, 30, 200, 600]), rng.choice(["a", "word", "longerword"])))
    while u < t + 1000:
        u += rng.choice([50, 200, 700, 2000])
        to = u + rng.choice([100, 400, 1500])
        blobs.append((u, to))
        u = to + 1
    return words, blobs


def test_starts_cost_least():
    rng = random.Random(1)
    for _ in range(300):
        words, blobs = made(rng, rng.randrange(1, 6))
        options = sounds._options(words, blobs)
        assert [sounds.choices(s, e, blobs) for s, e, _ in words if any(b > s for _, b in blobs)][:1] == [o for o, (s, e, _) in zip(options, words) if any(b > s for _, b in blobs)][:1]
        starts = sounds.best_starts(options)
        assert cost_of(starts, options) == least_cost(options)


def test_times_keep_order_and_do_not_overlap():
    rng = random.Random(2)
    for _ in range(300):
        words, blobs = made(rng, rng.randrange(1, 60))
        out = sounds.aligned(words, blobs)
        assert all(s < e for s, e in out) and all(a[1] <= b[0] for a, b in zip(out, out[1:])) and all(s >= w[0] for (s, _), w in zip(out, words))
    assert sounds.aligned([(100, 400, "so"), (1000, 1300, "it")], []) == [(100, 400), (1000, 1300)]
    assert sounds.aligned([(100, 400, "so")], [(300, 900)]) == [(300, 600)]  # silence: on to the sound
    assert sounds.aligned([(100, 110, "tonight")], [(50, 900)]) == [(100, 900)]  # no time for its letters: the blob's
    assert sounds.aligned([(100, 110, "tonight"), (500, 800, "now")], [(50, 900)]) == [(100, 500), (500, 800)]
    assert sounds.aligned([(0, 5, "far")], [(5000, 6000)]) == [(0, 50)]


def test_stretches_give_what_a_whole_recording_does(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(sounds, "STRETCH", 60_000)
    rows, blobs, want = [], [], {}
    for key in range(4):
        words, own = made(rng, 900 if key == 0 else 80, (20, 100, 400, 1500))
        rows += [(key, i, *w) for i, w in enumerate(words)] + [(key, 10**6, None, 5, "x")]
        blobs += [(key, *b) for b in own]
        want |= {(key, i): t for i, t in enumerate(sounds.aligned(words, own))}
    frame = spark.createDataFrame(rows, "key long, at long, s long, e long, w string").repartition(4)
    got = sounds.align_to_sound(frame, spark.createDataFrame(blobs, "key long, a long, b long")).collect()
    assert len(got) == len(want) and {(r.key, r.at): (r.s, r.e) for r in got} == want and 0 < sum(r.moved for r in got) < len(got)


def test_query_equals_recordings(spark):
    home = "/root/testdata/sf0.001"
    from spindrift.plans.speech_plans import spoken

    words = {}
    for r in spoken(spark, home).orderBy("key", "s", "at").collect():
        words.setdefault(r.key, []).append((r.s, r.e, r.w, r["at"]))
    turns = {}
    for r in spark.read.parquet(f"{home}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append(r.turn)
    want = {}
    for key, own in words.items():
        blobs = sorted((t * 60000 + k * 2000 + 300, t * 60000 + k * 2000 + 1700) for t in turns[key] for k in range(30))
        want |= {(key, w[3]): t for w, t in zip(own, sounds.aligned([w[:3] for w in own], blobs))}
    got = {(r.key, r.place): (r.s, r.e) for r in QUERIES["j22_words_on_sound"](spark, home).collect()}
    assert got == want


def test_free_words_are_not_gone_through(monkeypatch):
    rng = random.Random(4)
    for _ in range(400):
        words, blobs = made(rng, rng.randrange(1, 80), rng.choice([(0, 5, 20), (20, 400, 1500), (300, 600, 2500)]))
        blobs = blobs if rng.random() < 0.9 else blobs[:1]
        starts = sounds.best_starts(sounds._options(words, blobs))
        assert [s for s, _ in sounds.aligned(words, blobs)] == starts
    calls, plain = [], sounds.choices
    monkeypatch.setattr(sounds, "choices", lambda *x: calls.append(1) or plain(*x))
    words = [(600 * i, 600 * i + 550, "word") for i in range(1000)]
    sounds.aligned(words, [(2000 * i + 300, 2000 * i + 1700) for i in range(300)])
    assert len(calls) < 500


def test_small_groups_make_no_frames(spark):
    """Groups over batch borders, a null key among them, give what whole groups do; the query makes no frame a group."""
    from spindrift.operators.sequential import over_groups

    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(2), i, rng.choice([None, "x"])) for i in range(200)] + [(7, 0, 500 + i, "y") for i in range(40)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        frame = over_groups(spark.createDataFrame(rows, "key long, part long, at long, w string").repartition(3), ["key", "part"], ["at"], "key long, at long, w string, n long", lambda g: ([*range(0, len(g["at"]), 2)], {"n": [len(g["at"])] * -(-len(g["at"]) // 2)}))
        got = sorted(map(str, frame.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want, groups = [], {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[:2], []).append(r)
    for (key, _), g in groups.items():
        want += [f"Row(key={key}, at={r[2]}, w={r[3]!r}, n={len(g)})" for r in g[::2]]
    assert got == sorted(want)
    assert "FlatMapGroups" not in QUERIES["j22_words_on_sound"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
