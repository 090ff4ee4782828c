"""Channel keys, small stores and habits on odd entries."""

import math
import random
import statistics

from pyspark.sql import functions as F

from spindrift.functions.urls import channel_key, channel_keys
from spindrift.operators import style
from spindrift.plans.catalogue import QUERIES
from spindrift.sources import registries

UC = "UCabcdefghijklmnopqrstuv"


def test_channel_keys(spark):
    cases = {
        f"https://www.youtube.com/channel/{UC}/videos?view=0": f"id:{UC}", UC: f"id:{UC}", "https://youtube.com/@Some.Name/featured": "handle:@some.name", "@Some": "handle:@some", "some": "handle:@some", "HTTPS://www.youtube.com/c/My%20Show": "path:/c/my show",
        "https://www.youtube.com/user/Old/": "path:/user/old", "youtube.com/Custom": "path:/c/custom", "https://www.youtube.com/Custom/shorts": "path:/c/custom", "https://www.youtube.com/watch?v=1": None, "https://www.youtube.com/": None, "": None, "  ": None, "https://www.youtube.com/channel/none": None, "https://www.youtube.com/a/b/c": None,
    }
    rows = spark.createDataFrame([*cases.items(), (None, None)], "u string, want string")
    assert [tuple(r) for r in rows.select("u", "want", channel_key(F.col("u")).alias("got")).collect() if r.got != r.want] == []
    row = spark.createDataFrame([(UC, "@Me", "https://youtube.com/@me", None), (None, None, None, ""), ("", "Name", None, None)], "a string, b string, c string, d string")
    got = [r.k for r in row.select(channel_keys(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k")).collect()]
    assert got == [[f"id:{UC}", "handle:@me"], [], ["path:/user/name"]]


def test_provenance_keeps_what_is_good(spark):
    texts = [(1, '{"files": {"a.mp4": {"x": 1}, "b.mp4": 7, "c.mp4": null}, "own": {"ids": ["u", 3, null], "handles": ["@h"]}, "lookup": {"q": {}}}'), (2, "[1]"), (3, '{"files": 5, "own": {}}'), (4, None)]
    got = registries.provenance(spark.createDataFrame(texts, "id int, t string"), "t")
    assert [tuple(r) for r in got["files"].collect()] == [(1, "a.mp4", '{"x":1}')]
    assert sorted(tuple(r) for r in got["own"].collect()) == [(1, "handles", "@h"), (1, "ids", "u")]
    assert got["ids"].count() == 0 and [r.name for r in got["lookup"].collect()] == ["q"]


def test_dictionaries(spark):
    texts = [("a", '{"terms": [" two  words ", "x", "x", "", 5, null, "' + "y" * 31 + '"], "fix": {"a": "b", " c  d ": "cd", "same": "same", "n": 3, "": "e"}}'), ("b", "broken"), ("c", '{"terms": []}')]
    terms, fixes = registries.dictionaries(spark.createDataFrame(texts, "k string, t string"), "t")
    assert [tuple(r) for r in terms.orderBy("place").collect()] == [("a", 0, "two words"), ("a", 1, "x")]
    assert sorted(tuple(r) for r in fixes.collect()) == [("a", "a", "b"), ("a", "c d", "cd")]


def test_uploads_and_references(spark):
    schema = "c int, video string, at long, kind string"
    old = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 3, "x"), (2, "a", 1, "x")], schema)
    new = spark.createDataFrame([(1, "b", 9, "y"), (1, "c", 4, "y")], schema)
    assert sorted(tuple(r) for r in registries.put_uploads(old, new, ["c"], 2).collect()) == [(1, "a", 5, "x", 2), (1, "b", 9, "y", 1), (2, "a", 1, "x", 1)]
    known = spark.createDataFrame([("k", "one", True), ("gone", "one", True), ("lost", "one", None)], "name string, channel string, learned boolean")
    here = spark.createDataFrame([("k", "d1", 5), ("new", "d1", 6), ("odd", None, 7)], "name string, top string, size long")
    got = {r.name: tuple(r)[1:] for r in registries.adopted(known, here, spark.createDataFrame([("one", "d1")], "channel string, folder string")).collect()}
    assert got == {"k": ("one", True, 5, True, True), "gone": ("one", False, 0, True, True), "lost": ("one", False, 0, False, False), "new": ("one", True, 6, False, True), "odd": (None, True, 7, False, True)}


def test_habits(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 0.0, 0.1, 0.13, 0.2]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["top", "middle", "bottom", None]), rng.choice(["yellow", "white", "black"]), rng.choice("AB"), rng.choice([None, 0.0, 0.3, 0.5])) for k in range(6) for _ in range(300 if k == 0 else 9)]
    rows.append((7, None, None, None, "white", "A", None))
    got = {r.key: r for r in style.habits(spark.createDataFrame(rows, "key int, text_h double, lines int, pos string, accent string, mode string, face double"), "key").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        text = [r for r in own if r[1]]
        assert (got[k].n, got[k].with_text) == (len(own), len(text))
        assert got[k].text_h == (round(statistics.median(r[1] for r in text), 3) if text else None)
        lines = [r[2] for r in text if r[2]]
        assert got[k].lines == (statistics.median(lines) if lines else None)
        faces = [r[6] for r in own if r[6]]
        assert got[k].face == (round(statistics.median(faces), 3) if faces else None)
        places = [r[3] for r in text]
        best = max((places.count(p), o, p) for p, o in (("top", 3), ("middle", 2), ("bottom", 1)))
        assert got[k].pos == (best[2] if text and best[0] >= places.count(None) else got[k].pos)


def test_normal_cdf(spark):
    rows = QUERIES["n8_normal_cdf"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 1000 and all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 1e-7 for r in rows)


def test_seed_channels(spark):
    texts = [(1, '{"at": 2.5, "channels": [{"key": "a", "videos": {"x": {}}}, {"key": 3, "videos": {}}, {"key": "b", "videos": []}, "c", null, {"key": "a", "videos": {}}]}'), (2, "{}"), (3, "[]"), (4, None)]
    got = registries.seed_channels(spark.createDataFrame(texts, "id int, t string"), "t").collect()
    assert [(r.id, r.key, r["at"], r.videos) for r in got] == [(1, "a", 2.5, 0)]
