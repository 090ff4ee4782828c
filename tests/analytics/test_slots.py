"""Quotas with carry-over and greedy matches against plain loops, with a week that holds most uploads."""

import math
import random

from spindrift.operators import sequential, slots

H, D, W = slots.HOUR, slots.DAY, slots.WEEK


def plain_open(plan, ups, last):
    key, rate, days, hour, start = plan
    out, first = [], (start - slots.MONDAY) // W
    for week in range(first, max(first, last) + 1):
        before = sum((u - slots.MONDAY) // W == week - 1 for u, _ in ups)
        q = int(rate) + (rate > int(rate) and before < math.ceil(rate))
        per = [q // len(days) + (i < q % len(days)) for i in range(len(days))]
        at = sorted(slots.MONDAY + week * W + d * D + hour * H + math.floor((-1 if hour >= 12 else 1) * slots.SPREAD * k / max(1, n - 1)) for d, n in zip(days, per) for k in range(n))
        own = sorted(u for u, _ in ups if (u - slots.MONDAY) // W == week)
        filled = {i for i, _ in sequential.match_slots(at, own, slots.LATE)}
        out += [(key, week, q, i, a) for i, a in enumerate(at) if i not in filled and a >= start]
    return out


def test_open_slots_equal_plain_loops(spark):
    rng = random.Random(9)
    plans, ups = [], []
    for key in range(30):
        start = rng.randrange(10 * W)
        plans.append((key, rng.choice([0.0, 0.5, 1.0, 2.5, 4.25, 9.0]), rng.choice([[0], [1, 4], [0, 2, 5, 6]]), rng.choice([9, 12, 20]), start))
        n = 500 if key == 0 else rng.randrange(12)
        ups += [(key, 1000 * key + i, start - W + rng.randrange(W if key == 0 else 6 * W)) for i in range(n)]
    last = max((u - slots.MONDAY) // W for _, _, u in ups) + 1
    want = [r for p in plans for r in plain_open(p, [(u, i) for k, i, u in ups if k == p[0]], last)]
    got = slots.open_slots(spark.createDataFrame(plans, "key long, rate double, days array<int>, hour int, start long"), spark.createDataFrame(ups, "key long, id long, at long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100


def test_matches_equal_plain_loops(spark):
    rng = random.Random(10)
    places, ups, want = [], [], set()
    for key in range(40):
        own = sorted(rng.randrange(7 * 24) for _ in range(rng.randrange(6)))
        at = sorted({rng.randrange(7 * 24) for _ in range(200 if key == 0 else rng.randrange(8))})
        places += [(key, i, a * H) for i, a in enumerate(own)]
        ups += [(key, 100 * key + j, a * H) for j, a in enumerate(at)]
        want |= {(key, i, 100 * key + j) for i, j in sequential.match_slots([a * H for a in own], [a * H for a in at], slots.LATE)}
    got = slots.matched(spark.createDataFrame(places, "key long, slot long, at long"), spark.createDataFrame(ups, "key long, id long, at long"), ["key"])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40
