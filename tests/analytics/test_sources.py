"""File sources on texts that the driver's tables do not hold: broken, rejected, empty and odd ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import lift, sequential, transcript
from spindrift.plans.catalogue import QUERIES
from spindrift.sources import files

SF = "/root/testdata/sf0.001"


def test_documents_and_quarantine(spark, tmp_path):
    texts = ['{\n  "key": 1,\n  "name": "a"\n}\n', '{"key": "x", "name": "b"}', '{\n "key": 2', "", "[1]", "7", '{"key": 3, "more": {"x": 1}}', "null", '\ufeff{"key": 4}', '{"key": 5} {"key": 6}']
    (tmp_path / "d").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / f"d/{i}.json").write_text(t)
    good, bad = files.read_documents(spark, f"file://{tmp_path}/d", "key long, name string")
    got = {r.file[-6]: (r.key, r.name) for r in good.collect()}
    assert {k: v for k, v in got.items() if k not in "89"} == {"0": (1, "a"), "1": (None, "b"), "6": (3, None)}
    rest = {r.file[-6]: r.value for r in bad.collect()}
    assert {k: rest[k] for k in "2457"} == {"2": '{\n "key": 2', "4": "[1]", "5": "7", "7": "null"}
    assert len(got) + len(rest) in (len(texts), len(texts) - 1)  # Spark makes no row of an empty file
    files.set_aside(bad, f"file://{tmp_path}/bad")
    aside = {str(r.bad): r.value for r in spark.read.text(f"file://{tmp_path}/bad", wholetext=True).collect()}
    assert aside["2.json"].removesuffix("\n") == '{\n "key": 2' and len(aside) == len(rest)  # as they were
    assert len(list((tmp_path / "d").iterdir())) == len(texts)  # and the files themselves stay


FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns:yt="http://www.youtube.com/xml/schemas/2015" xmlns:media="http://search.yahoo.com/mrss/" xmlns="http://www.w3.org/2005/Atom">
 <link rel="self" href="http://www.example.org/feed"/>
 <yt:channelId>none</yt:channelId>
 <title> A channel </title>
 <author><name>n</name><uri>https://www.example.org/channel/UCabcdefghijklmnopqrstuv</uri></author>
ENTRIES</feed>
"""


def entry(i, title="x", at="2024-02-03T04:05:06+00:00", href="https://x/watch?v=1", views="1", likes="8", channel="UCABCDEFGHIJKLMNOPQRSTUV"):
    star = f'<media:starRating count="{likes}" average="5.00" min="1" max="5"/>' if likes else ""
    return f""" <entry>
  <id>yt:video:{i}</id>
  <yt:videoId>{i}</yt:videoId>
  <yt:channelId>{channel}</yt:channelId>
  <title>{title}</title>
  <link rel="alternate" href="{href}"/>
  <author><name>n</name><uri>u</uri></author>
  <published>{at}</published>
  <updated>2026-01-01T00:00:00+00:00</updated>
  <media:group>
   <media:title>not this</media:title>
   <media:content url="u" type="t" width="640" height="390"/>
   <media:description></media:description>
   <media:community>{star}<media:statistics views="{views}"/></media:community>
  </media:group>
 </entry>
"""


def test_feeds(spark):
    good = FEED.replace("ENTRIES", entry("a" * 11) + entry("short", channel="UC" + "z" * 22) + entry("b-_" + "b" * 8, title="  two\n\n words &amp; ", at="soon", href="x/shorts/1", views="-4", likes=None))
    by_author = FEED.replace("ENTRIES", entry("c" * 11, channel="none"))
    feeds = {
        "good": good, "author": by_author, "empty": FEED.replace("ENTRIES", ""), "doctype": good.replace("<feed", "<!DOCTYPE feed [<!ENTITY x 'y'>]><feed", 1), "broken": good[:-20], "inner": good.replace("</title>", "</titel>", 1),
        "html": "<html><body>x</body></html>", "doc": "<!doctype html><html></html>", "big": "x" * (files.FEED_MOST + 1), "text": "글자", "null": None, "other": good.replace(files.ATOM, "http://example.org"), "prefixed": good.replace("<feed", "<a:feed").replace("</feed", "</a:feed").replace("xmlns=", "xmlns:a="),
    }
    frame = spark.createDataFrame(list(feeds.items()), "name string, xml string")
    heads = {r.name: r for r in files.read_feeds(frame, "xml").collect()}
    assert {k: r.state for k, r in heads.items()} == {"good": "ok", "author": "ok", "empty": "ok", "prefixed": "ok", "doctype": "doctype", "doc": "doctype", "broken": "broken", "inner": "broken", "html": "other", "text": "other", "null": "other", "other": "other", "big": "big"}
    assert heads["good"].feed_title == "A channel" and heads["good"].channel_id == "UCABCDEFGHIJKLMNOPQRSTUV" and heads["author"].channel_id == heads["empty"].channel_id == "UCabcdefghijklmnopqrstuv"
    rows = {}
    for r in files.parse_feeds(frame, "xml").collect():
        rows.setdefault(r.name, []).append((r.id, r.title, r.pub, r.shorts, r.views, r.likes))
    want = [("a" * 11, "x", 1706933106.0, False, 1, 8), ("b-_" + "b" * 8, "two words &", None, True, None, None)]
    assert rows["good"] == rows["prefixed"] == want and set(rows) == {"good", "author", "prefixed"}


def test_feed_comes_before_the_list(spark):
    schema = "c int, id string, shorts boolean, title string, views long, likes long, pub double, place long"
    base = spark.createDataFrame([(1, "a", False, "A", 5, None, 1.0, 0), (1, "b", False, "B", 6, 2, None, 1), (1, "s", True, "S", 1, None, None, 0), (1, "x", False, "X", 1, None, None, None)], schema)
    feed = spark.createDataFrame([(1, "n1", False, "N1", 9, None, 2.0, 0), (1, "b", False, "", None, 3, 4.0, 1), (1, "n2", False, "N2", 8, None, None, 2), (2, "q", True, "Q", None, None, None, 0)], schema.replace("place", "pos"))
    got = {(r.c, r.id): (r.place, r.fresh, r.original, r.title, r.views, r.likes) for r in files.merge_feed(base, feed, ["c"], 4).collect()}
    assert got == {
        (1, "n1"): (0, True, True, "N1", 9, None), (1, "n2"): (1, True, True, "N2", 8, None), (1, "a"): (2, False, False, "A", 5, None), (1, "b"): (3, False, False, "B", 6, 3),
        (1, "s"): (0, False, False, "S", 1, None), (1, "x"): (None, False, False, "X", 1, None), (2, "q"): (0, True, True, "Q", None, None),
    }
    assert {r.id: r.place for r in files.merge_feed(base, feed, ["c"], 3).collect()}["b"] is None  # beyond the list


def test_subtitles(spark):
    text = "﻿1\r\n00:00:03,500 --> 00:00:02,000\r\n<b>late</b>\r\n  and more\r\n\r\n2\n00:00:01.5 --> 00:00:02,25\n{\\an8}early\n \t\n3\nno time\n\n4\n01:00:00,000 --> 01:00:01,000\n\n"
    rows = files.parse_srt(spark.createDataFrame([(1, text), (2, None), (3, "")], "file long, srt string"), "srt")
    assert sorted((r.start, r.end, r.text) for r in rows.collect()) == [(1.005, 2.025, "early"), (3.5, 3.5, "late and more")]
    again = files.parse_srt(files.to_srt(rows, ["file"]), "srt")
    assert sorted((r.start, r.end, r.text) for r in again.collect()) == [(1.005, 2.025, "early"), (3.5, 3.5, "late and more")]


def test_log_and_listing(spark, tmp_path):
    log = "silence_start: 1.234\nsilence_end: 2.5 |\nsilence_start: 7"
    assert [tuple(r) for r in files.log_spans(spark.createDataFrame([(1, log), (2, ""), (3, None)], "id long, log string"), "log").collect()] == [(1, 1.23, 2.5)]
    folder = str(tmp_path / "log")
    files.append_lines(spark.createDataFrame([("a", 5, 1)], "k string, at long, subs long"), folder)
    files.append_lines(spark.createDataFrame([("a", 9, None), (None, 3, 1)], "k string, at long, subs long"), folder)
    assert sorted((r.k, r.at) for r in files.read_log(spark, folder, "k string, at long, subs long").collect()) == [("a", 5), ("a", 9)]


def test_slots_before_the_upload_come_first():
    assert sequential.match_slots([10, 20], [12]) == [(0, 0)]
    assert sequential.match_slots([10, 13], [12], late=2) == [(1, 0)]
    assert sequential.match_slots([10, 20], [9, 9], late=0) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("n", [1, 2, 9, 40, 2600])
def test_theil_sen_is_the_median_of_all_slopes(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 50, n).astype(float) if n < 100 else rng.normal(size=n), rng.normal(size=n)
    i, j = np.triu_indices(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slopes = ((y[j] - y[i]) / (x[j] - x[i]))[x[i] != x[j]]
    slope = float(np.median(slopes)) if len(slopes) else 0.0
    assert np.allclose(sequential.theil_sen(x, y), (np.median(y - slope * x), slope), atol=1e-12)
    assert sequential.theil_sen([3, 3, 3], [1, 5, 9]) == (5.0, 0.0)


def test_checkups_equal_plain_loops(spark):
    day = 24 * 3_600_000_000
    rows = [(r.channel, r.id, r.pub) for r in QUERIES["o1_by_views"](spark, SF).where("fmt = 'purchase'").join(spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pub")), "id").select("channel", "id", "pub").collect()]
    kept: dict = {}
    for channel, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = kept.setdefault(channel, [])
        if own and at - own[-1][1] < 3 * day:
            own.pop()
        own.append((i, at))
    assert sorted((r.channel, r.id) for r in QUERIES["m6_checkup_upsert"](spark, SF).collect()) == sorted((c, i) for c, own in kept.items() for i, _ in own)


def test_pauses_end_sentences(spark):
    words = [(1, 0, "so", 0.0), (1, 1, "what?", 0.1), (1, 2, "then", 0.2), (1, 3, "later", 1.2), (1, 4, "on.", 0.1)]
    got = transcript.sentences(spark.createDataFrame(words, "id long, at int, word string, pause double"), ["id"], gap="pause").orderBy("sentence").collect()
    assert [r.text for r in got] == ["so what?", "then", "later on."]


def test_series_are_named_in_three_ways(spark):
    titles = ["[Big Show EP. 3] one", "【Big Show 12】 two", "Long Run '3탄 end", "Long Run 4탄", "Talk ㅣ x", "Talk: y", "[7] no"]
    rows = spark.createDataFrame([("c", i, t, float(i), 0.0) for i, t in enumerate(titles)], "channel string, id long, title string, views double, resid double")
    got = {r["name"]: (r.n, r.top) for r in lift.series(rows, ["channel"], "title").collect()}
    assert got == {"[Big Show]": (2, 1), "Long Run N탄": (2, 3), "Talk |": (2, 5)}


@pytest.mark.parametrize("held", [0, 20, 10**6])
def test_theil_sen_counts_as_it_lists(held):
    rng = np.random.default_rng(held)
    for t in range(60):
        n = int(rng.integers(2, 50))
        x, y = np.log(rng.integers(1, 20, n)), np.log(rng.integers(1, 9, n))
        x = x + rng.integers(0, 3, n) * 4e-13 * (t % 2)  # some no more than 1e-12 apart
        i, j = np.triu_indices(n, 1)
        far = np.abs(x[i] - x[j]) > 1e-12
        slope = float(np.median((y[j] - y[i])[far] / (x[j] - x[i])[far])) if far.any() else 0.0
        assert np.allclose(sequential.theil_sen(x, y, held), (np.median(y - slope * x), slope), atol=1e-11)


def test_theil_sen_of_many_points_takes_no_pass_over_pairs():
    """Copies of points leave the median slope (an odd number of slopes, or the middle two alike) as it is."""
    rng = np.random.default_rng(3)
    x, y = np.log(rng.integers(1, 10**6, 403)), np.log(rng.integers(2000, 7000, 403))
    began = time.monotonic()
    assert np.allclose(sequential.theil_sen(np.tile(x, 200), np.tile(y, 200)), sequential.theil_sen(x, y), atol=1e-12)
    assert time.monotonic() - began < 30


def test_documents_of_a_sequence_share_files(spark, tmp_path):
    """Documents over many lines, a broken one with a separator in it and one that is no object, in one file of one partition."""
    values = ['{\n  "key" : 1,\n\n  "name" : "a\\u001eb"\n}', '{"key": 2', "[3]", '{"key": 4, "na\x1e', '{"key": 5, "name": "\u00e9"}']
    rows = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    files.write_sequence(rows, f"file://{tmp_path}/d")
    assert len(list((tmp_path / "d").glob("part-*"))) == 1
    good, bad = files.read_sequence(spark, f"file://{tmp_path}/d", "key long, name string")
    assert sorted((r.key, r.name) for r in good.collect()) == [(1, "a\x1eb"), (5, "\u00e9")]
    assert sorted(r.value for r in bad.collect()) == ["[3]", '{"key": 2', '{"key": 4, "na\\u001e']


def test_files_do_not_grow_with_channels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "fresh_folder", lambda spark, name: f"{tmp_path}/{name}")
    assert QUERIES["s2_s3_slim_channels"](spark, SF).count() > 0
    written = len([f for f in (tmp_path / "channels").rglob("part-*")])
    assert written <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count() > written


def test_subtitle_times_are_looked_for_once(spark):
    rows = [(1, 0.0, 0.0005, "a"), (1, 59.9996, 3599.9994, "b"), (1, 360000.5, 360001.25, "far"), (2, 7.1, 6.0, "back")]
    frame = spark.createDataFrame(rows, "file long, start double, end double, text string")
    made = {r.file: r.srt for r in files.to_srt(frame, ["file"]).collect()}
    assert made[1] == "﻿1\n00:00:00,000 --> 00:00:00,001\na\n\n2\n00:01:00,000 --> 00:59:59,999\nb\n\n3\n100:00:00,500 --> 100:00:01,250\nfar\n"
    text = "1\n1:02:03.5 --> 99:59:59,999\nx\n\n2\n00:00:01,20  -->  00:00:00,1\ny\n\nno time\nz\n\n3\n00:00:01,000 --> 00:00:02,000\n"
    read = files.parse_srt(spark.createDataFrame([(1, text)], "file long, srt string"), "srt")
    assert sorted((r.start, r.end, r.text) for r in read.collect()) == [(1.02, 1.02, "y"), (3723.005, 359999.999, "x")]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
