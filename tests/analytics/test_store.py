"""Stores that are written again and again: repeated, late and failed batches, rotated logs, artefacts, listings."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from spindrift.sources import library, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_is_idempotent_and_atomic(spark, tmp_path):
    docs = store.DocumentStore(spark, f"file://{tmp_path}/store", "key long, at long, value string", key="key", at="at", parts=8).create()
    assert docs.create().read().count() == 0  # what is there stays
    made = lambda data: spark.createDataFrame(data, "key long, at long, value string")
    docs.upsert(made([(k, 1, f"a{k}") for k in range(50)] + [(None, 1, "x"), (3, None, "x")]))
    batch = made([(1, 2, "b1"), (2, 0, "late"), (99, 5, "new"), (1, 2, "b0")])
    docs.upsert(batch)
    want = sorted([(k, 1, f"a{k}") for k in range(50) if k != 1] + [(1, 2, "b1"), (99, 5, "new")])
    assert rows(docs.read()) == want
    files = {f for _, _, names in os.walk(tmp_path / "store") for f in names if f.startswith("part-")}
    docs.upsert(batch)  # again: nothing changes
    docs.upsert(batch.limit(0))
    assert rows(docs.read()) == want

    def broken(merged):
        return merged.withColumn("value", F.when(F.col("key") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("value")))

    with pytest.raises(Exception, match="no"):
        docs.upsert(made([(k, 9, "z") for k in range(50)]), broken)
    assert rows(docs.read()) == want
    untouched = {f for _, _, names in os.walk(tmp_path / "store") for f in names if f.startswith("part-")} & files
    assert untouched  # partitions that no row of the batch belongs to keep their files


def test_stream_into_a_store_over_a_restart(spark, tmp_path):
    docs = store.DocumentStore(spark, f"file://{tmp_path}/store", "key long, at long, value string", key="key", at="at", parts=4).create()
    for n in range(3):
        spark.createDataFrame([(k, n, f"{n}") for k in range(n, 10)], "key long, at long, value string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key long, at long, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        docs.follow(stream, f"{tmp_path}/state").awaitTermination()
    assert rows(docs.read()) == [(k, min(k, 2), str(min(k, 2))) for k in range(10)]


def test_log_is_followed_over_rotation(spark, tmp_path):
    log, want = tmp_path / "log", []
    log.mkdir()
    for round_ in range(4):
        for part in range(2):
            lines = [f"{round_}.{part}.{i}" for i in range(5 + part)]
            want += lines
            (log / f"studio-{round_}-{part}.log").write_text("\n".join(lines) + "\n")
        n = store.follow_log(spark, f"file://{log}", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        assert n == len(want)
        if round_ == 1:  # rotation: what has been read goes elsewhere
            shutil.move(log / "studio-0-0.log", tmp_path / "studio-0-0.old")
    got = store.lines_since(spark, f"file://{tmp_path}/out", 0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(want))) and [r.line for r in got] == want
    assert [r.line for r in store.lines_since(spark, f"file://{tmp_path}/out", len(want) - 3).orderBy("n").collect()] == want[-3:]
    assert store.follow_log(spark, f"file://{log}", f"file://{tmp_path}/out", f"file://{tmp_path}/state") == len(want)


def test_only_what_differs_is_computed(spark):
    files = spark.createDataFrame([("a", 1, 1.0, True), ("b", 2, 2.0, True), ("c", 3, 3.0, False), ("d", 4, 4.0, True), ("e", 5, None, True), ("f", 6, 6.0, True)], "name string, size long, mtime double, ocr boolean")
    old = spark.createDataFrame([(2, "a", 1, 1.0, "old", True), (1, "b", 2, 2.0, "old", True), (2, "c", 3, 3.0, "old", False), (2, "d", 4, 4.5, "old", True), (2, "e", 5, None, "old", True), (2, "f", 6, 6.0, "old", False), (2, "gone", 1, 1.0, "old", True)], "ver int, name string, size long, mtime double, value string, ocr boolean")
    computed = []

    def compute(stale):
        computed.append(sorted(r.name for r in stale.select("name").collect()))
        return stale.withColumn("value", F.lit("new"))

    got = {r.name: (r.value, r.reused, r.ver) for r in store.refreshed(old, files, compute, 2, ["ocr"]).collect()}
    assert computed == [["b", "d", "f"]]  # another version, another time, a model that was missing
    assert got == {n: ("new", False, 2) if n in "bdf" else ("old", True, 2) for n in "abcdef"}


def test_the_newer_list_wins(spark):
    lists = spark.createDataFrame([("L", "cache", 5.0, ["a"]), ("L", "own", 9.0, ["b", "c"]), ("S", "cache", 5.0, ["x"]), ("S", "own", 9.0, []), ("T", "cache", None, ["t"]), ("T", "own", None, ["u"])], "kind string, source string, at double, rows array<string>")
    got = {r.kind: (r.source, r.rows) for r in store.newer(lists, ["kind"], "at", "rows", most=1).collect()}
    assert got == {"L": ("own", ["b"]), "S": ("cache", ["x"]), "T": ("cache", ["t"])}


def test_listing_folders_and_formats(spark, tmp_path):
    home = tmp_path / "videos"
    for name, size in {"a.mp4": 10, "b.MTS": 5, "one/c.mov": 7, "one/two/d.mp4": 8, "one/x.txt": 3, "2/e.avi": 4, "2/f.mp4": 1}.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_bytes(b"x" * size)
    files = library.listing(spark, f"file://{home}")
    assert rows(files.select("path", "name", F.coalesce("top", F.lit("-")), "size"))[0] == ("2/e.avi", "e.avi", "2", 4)
    assert files.select("path").count() == 7
    copying = spark.createDataFrame([("one/c.mov",), ("one/c.mov",)], "path string")
    assert rows(library.folders(files, copying)) == [("2", 1, 1, 0), ("one", 2, 15, 1)]
    assert rows(library.folders(files, copying, deepest=1)) == [("2", 1, 1, 0), ("one", 1, 7, 1)]
    assert rows(library.unusable(files)) == [("b.MTS", 5, "mts")]
    marks = spark.createDataFrame([("a.mp4", "analysed", 4e9), ("f.mp4", "exported", 5e9), ("f.mp4", "seen", None)], "name string, kind string, at double")
    got = [(r.name, r.analysed) for r in library.videos(files, marks).collect()]
    assert got[:2] == [("f.mp4", False), ("a.mp4", True)] and sorted(n for n, _ in got[2:]) == ["c.mov", "d.mp4"]
    plan = library.listing(spark, f"file://{home}")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_renamed_work_is_matched_one_to_one(spark):
    work = spark.createDataFrame([("Old.mp4", 10, 100.0), ("old2.mp4", 10, 101.0), ("here.mp4", 10, 100.0), ("timeless.mp4", 77, None), ("none.mp4", None, 1.0), ("far.mp4", 10, 500.0), (None, 1, 1.0)], "old string, size long, mtime double")
    files = spark.createDataFrame([("HERE.mp4", 10, 100.0), ("new1.mp4", 10, 100.5), ("new2.mp4", 10, 101.5), ("new3.mp4", 77, 9.0), ("new4.mp4", 77, 9.0)], "name string, size long, mtime double")
    assert rows(library.renamed(work, files)) == [("Old.mp4", "new1.mp4"), ("old2.mp4", "new2.mp4"), ("timeless.mp4", "new3.mp4")]
    rng = random.Random(2)
    work = [(f"o{i:02}", rng.randrange(3), round(rng.random() * 30, 1)) for i in range(40)]
    files = [(f"n{i:02}", rng.randrange(3), round(rng.random() * 30, 1)) for i in range(40)]
    got = rows(library.renamed(spark.createDataFrame(work, "old string, size long, mtime double"), spark.createDataFrame(files, "name string, size long, mtime double")))
    assert len({o for o, _ in got}) == len({n for _, n in got}) == len(got) > 20
    size, at = {n: (s, t) for n, s, t in files}, {o: (s, t) for o, s, t in work}
    assert all(size[n][0] == at[o][0] and abs(size[n][1] - at[o][1]) <= 2 for o, n in got)
    pairs = sorted((abs(t - u), o, n) for o, s, t in work for n, r, u in files if s == r and abs(t - u) <= 2)
    assert (pairs[0][1], pairs[0][2]) in got
