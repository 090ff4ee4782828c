"""Fingerprints word by word, and the join against all pairs."""

import random

from pyspark.sql import functions as F

from spindrift.operators import fingerprint as fp


def plain(words):
    bits = [fp.word_bits(w) for w in set(words)]
    if not bits:
        return None
    out = 0
    for k in range(64):
        ones = sum(b >> (63 - k) & 1 for b in bits)
        out = out << 1 | (2 * ones > len(bits))
    return out - 2**64 if out >= 2**63 else out


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "one one", *[" ".join(f"w{rng.randrange(80)}" for _ in range(rng.randrange(60))) for _ in range(60)]]
    got = {r.id: r.hash for r in fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got == {i: plain((t or "").encode().split()) for i, t in enumerate(texts)}


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for h in list(prints):
        for _ in range(rng.randrange(4)):
            near = h
            for _ in range(rng.randrange(1, 11)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in enumerate(sorted(prints))]
    want = {(i, j, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in rows for j, b in rows if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 7}
    got = [tuple(r) for r in fp.near_pairs(spark.createDataFrame(rows, "id long, hash long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_edited_copies_are_near_and_no_band_is_hot(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    prints = fp.fingerprints(rows, "id", "text").where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"))
    n = prints.count()
    bands = F.explode(F.array(*[F.struct(F.lit(i), F.shiftrightunsigned("hash", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]))
    most = prints.select(bands.alias("key")).groupBy("key").count().agg(F.max("count").alias("m")).first().m
    assert most <= max(0.02 * n, 12)
    words = [f"word{i}" for i in range(300)]
    edited = words[:10] + ["other"] + words[11:]
    a, b = (plain([w.encode() for w in x]) for x in (words, edited))
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 7


def test_the_join_builds_nothing_on_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "id long, hash long").write.parquet(str(tmp_path / "prints"))
    pairs = fp.near_pairs(spark.read.parquet(str(tmp_path / "prints")))
    assert len(pairs.collect()) == 1
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
