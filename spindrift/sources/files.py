"""File sources and sinks: JSON documents with quarantine, JSON lines, feeds, listings, subtitles, detector logs.

Each reader takes text that Spark has read and gives rows; what cannot be read is kept beside it, never dropped silently.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.history import shared_dir

SLIM_IDS = 120
FEED_MOST = 2 << 20
TITLE_MOST, FEED_TITLE_MOST = 300, 200
LISTED_MOST = 400
#: What a video id and a time of a subtitle line look like.
ID = r"^[\w-]{11}$"
SEPARATOR = "\x1e"
CHANNEL = r"UC[\w-]{22}"
ATOM = "http://www.w3.org/2005/Atom"
SRT_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def read_documents(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON documents, one per file and laid out as one likes -> (documents with their ``file``, files that are
    none).  A file that holds no JSON object goes to the second, as it is, with its ``file`` and ``value``; of an object,
    fields of another type are null."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_documents(files, "value", schema)


def read_sequence(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON text sequences (RFC 7464: many documents a file, laid out as one likes, a record separator between two),
    read as ``read_documents`` reads files."""
    docs = spark.read.text(folder, lineSep=SEPARATOR).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_documents(docs.where("value <> ''"), "value", schema)


def split_documents(rows: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``text`` is a JSON object -> its fields beside the other columns; and the rows whose text is none."""
    doc = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = F.coalesce(F.col(text).rlike(r"^\ufeff?\s*\{") & F.try_parse_json(text).isNotNull(), F.lit(False))
    marked = rows.withColumn("_good", good)
    others = [c for c in rows.columns if c != text]
    return marked.where("_good").select(*others, doc.alias("_d")).select(*others, "_d.*").drop("_corrupt"), marked.where("not _good").drop("_good")


def set_aside(bad: DataFrame, folder: str) -> None:
    """Write files that are no documents beside the others, each under its name: a folder a file, whose text is as it was (and
    ends with a line end)."""
    named = bad.select(F.regexp_replace("value", r"\n\z", "").alias("value"), F.regexp_extract("file", "([^/]+)$", 1).alias("bad"))
    named.write.mode("overwrite").partitionBy("bad").text(folder)


def write_documents(docs: DataFrame, name: str, folder: str) -> None:
    """One file a document: ``value``, under a folder of its ``name``."""
    docs.select("value", name).repartition(name).write.mode("append").partitionBy(name).text(folder)


def write_sequence(docs: DataFrame, folder: str) -> None:
    """Documents in ``value`` as JSON text sequences: as many files as there are partitions, however many documents there are.  A
    separator within a document can only stand in a broken one (JSON escapes it): there it is escaped too."""
    value = F.replace(F.col("value"), F.lit(SEPARATOR), F.lit("\\u001e"))
    docs.select(value.alias("value")).write.mode("append").text(folder, lineSep=SEPARATOR)


def decoded(content: str | Column) -> Column:
    """Bytes of a text file as text, whatever wrote it: UTF-16 with a byte-order mark, UTF-8 with or without one, the older Korean
    code page; what is none of them as UTF-8 with marks for what it cannot be."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw.decode("utf-16", "replace")
        for name in ("utf-8-sig", "cp949"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "replace")

    return F.pandas_udf(lambda raws: raws.map(one), "string")(content)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``file, text`` of all files of a folder, decoded."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), decoded("content").alias("text"))


def repaired(c: str | Column) -> Column:
    """A text that can be written: bytes that are no characters (halves of a surrogate pair among them) become marks."""
    return F.make_valid_utf8(c)


def slim_ids(docs: DataFrame, keys: list[str], ids: str, most: int = SLIM_IDS) -> DataFrame:
    """Documents with a list of ids, newest first -> one row per id that stays, with the whole number of ids."""
    rows = docs.select(*keys, F.size(ids).cast("long").alias("n_ids"), F.posexplode(F.slice(ids, 1, most)).alias("pos", "id"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def append_lines(rows: DataFrame, folder: str) -> None:
    """Append to a log of JSON lines."""
    rows.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A log of JSON lines: broken lines go, and rows whose key or time is missing or of another type."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    return rows.where("k is not null and at is not null")


def iso_seconds(c: str | Column) -> Column:
    """ISO 8601 with Z or an offset (or none: UTC) -> seconds since 1970; null if it is no time."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))) / 1e6


def safe_count(c: str | Column) -> Column:
    """Whole numbers from 0 on; all else is null."""
    n = F.expr("1") if c is None else (F.col(c) if isinstance(c, str) else c).try_cast("long")
    return F.when(n >= 0, n)


_STATS = "STRUCT<community: STRUCT<statistics: STRUCT<_views: STRING>, starRating: STRUCT<_count: STRING>>>"
_ENTRY = f"STRUCT<videoId: STRING, channelId: STRING, title: STRING, published: STRING, link: ARRAY<STRUCT<_href: STRING>>, `group`: {_STATS}>"
_FEED = f"STRUCT<title: STRING, author: STRUCT<uri: STRING>, entry: ARRAY<{_ENTRY}>, _corrupt: STRING>"


def read_feeds(feeds: DataFrame, xml: str) -> DataFrame:
    """Atom feeds as XML text -> ``feeds``' other columns with ``state``, ``feed_title``, ``channel_id`` and ``entries``.

    ``state`` says what a text is: ok, or why it is none: big, doctype (a document type or entity), broken, other (another
    root or namespace).  Namespaces are the feed's own affair: elements count by their names, whatever the prefixes.
    The channel is that of the first entry that names one, else the author's."""
    body = F.coalesce(xml, F.lit(""))
    upper = F.upper(body)
    root = body.rlike(rf"^\ufeff?\s*(<\?xml[^>]*\?>)?\s*(<!--(?s:.*?)-->\s*)*<(\w+:)?feed\b[^>]*xmlns(:\w+)?\s*=\s*[\"']{ATOM}[\"']")
    parsed = F.from_xml(F.when((F.octet_length(body) <= FEED_MOST) & ~upper.rlike("<!DOCTYPE|<!ENTITY") & root, body), F.lit(_FEED), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"})
    rows = feeds.withColumn("_f", parsed)
    broken = F.col("_f").isNull() | F.col("_f._corrupt").isNotNull() | ~body.rlike(r"</(\w+:)?feed>\s*$")
    state = F.when(F.octet_length(body) > FEED_MOST, "big").when(upper.rlike("<!DOCTYPE|<!ENTITY"), "doctype").when(~root, "other").when(broken, "broken").otherwise("ok")
    rows = rows.withColumn("state", state)
    entries = F.when(F.col("state") == "ok", F.filter(F.coalesce("_f.entry", F.array().cast(f"ARRAY<{_ENTRY}>")), lambda e: F.btrim(e["videoId"]).rlike(ID)))
    rows = rows.withColumn("entries", entries)
    named = F.filter(F.transform("entries", lambda e: F.btrim(e["channelId"])), lambda c: c.rlike(f"^{CHANNEL}$"))
    author = F.nullif(F.regexp_extract("_f.author.uri", f"({CHANNEL})", 1), F.lit(""))
    head = F.substring(F.btrim(F.coalesce("_f.title", F.lit(""))), 1, FEED_TITLE_MOST)
    ok = F.col("state") == "ok"
    return rows.withColumns({"feed_title": F.when(ok, head), "channel_id": F.when(ok, F.coalesce(F.get(named, F.lit(0)), author))}).drop("_f", xml)


def parse_feeds(feeds: DataFrame, xml: str) -> DataFrame:
    """Atom feeds as XML text -> their entries, with ``feeds``' other columns: ``channel_id, pos, id, title, pub, shorts, views,
    likes``.  Feeds that :func:`read_feeds` does not call ok give none; so do entries without a valid id."""
    rows = read_feeds(feeds, xml).where("state = 'ok'").select("*", F.posexplode("entries").alias("pos", "_e")).drop("state", "feed_title", "entries")
    title = F.substring(F.btrim(F.regexp_replace(F.coalesce("_e.title", F.lit("")), r"\s+", " ")), 1, TITLE_MOST)
    shorts = F.coalesce(F.contains(F.get("_e.link", F.lit(0))["_href"], F.lit("/shorts/")), F.lit(False))
    community = "_e.group.community"
    return rows.withColumns({
        "pos": F.col("pos").cast("long"), "id": F.btrim("_e.videoId"), "title": title, "pub": iso_seconds("_e.published"), "shorts": shorts,
        "views": safe_count(F.col(f"{community}.statistics._views")), "likes": safe_count(F.col(f"{community}.starRating._count")),
    }).drop("_e")


def listed_rows(listings: DataFrame, keys: list[str], entries: str) -> DataFrame:
    """Listings with ``entries`` (id, title, view_count, duration) in order -> their rows: valid ids, the first of each,
    counts from 0 on and durations above 0, else null."""
    rows = listings.select(*keys, F.posexplode(entries).alias("pos", "e")).where(F.col("e.id").rlike(ID))
    first = F.row_number().over(Window.partitionBy(*keys, "e.id").orderBy("pos"))
    rows = rows.withColumn("_k", first).where("_k = 1")
    views, duration = F.col("e.view_count"), F.col("e.duration")
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("e.id").alias("id"), F.when(views >= 0, views.cast("long")).alias("views"), F.when(duration > 0, duration).alias("duration"))


def merge_feed(base: DataFrame, feed: DataFrame, keys: list[str], keep: int = LISTED_MOST) -> DataFrame:
    """Known videos (keys, id, shorts, title, views, likes, pub, place: from 0 in their list of shorts or others, null if in none)
    and a feed's entries (keys, id, shorts, title, views, likes, pub, pos) -> all of both.

    What the feed has wins, and a title from it is marked original; a video that was not in its list comes before the
    list, in the feed's order, so places go on from those; beyond ``keep`` it has none."""
    parts = ("title", "views", "likes", "pub", "shorts", "pos")
    listed = base.where("place is not null").select(*keys, "id", "shorts", F.lit(False).alias("fresh"))
    entries = feed.join(listed, [*keys, "id", "shorts"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
    ahead = F.row_number().over(Window.partitionBy(*keys, "shorts", "fresh").orderBy("pos")) - 1
    entries = entries.withColumn("_ahead", F.when(F.col("fresh"), ahead.cast("long")))
    count = entries.where("fresh").groupBy(*keys, "shorts").agg(F.count(F.lit(1)).alias("_new"))
    both = base.join(entries.select(*keys, "id", "fresh", "_ahead", *[F.col(c).alias(f"_{c}") for c in parts]), [*keys, "id"], "full")
    title = F.when(F.col("_title") != "", F.col("_title"))
    out = both.withColumns({"title": F.coalesce(title, "title"), "original": title.isNotNull(), "fresh": F.coalesce("fresh", F.lit(False)), **{c: F.coalesce(f"_{c}", c) for c in ("views", "likes", "pub", "shorts")}})
    out = out.join(count, [*keys, "shorts"], "left")
    place = F.when(F.col("fresh"), F.col("_ahead")).otherwise(F.col("place") + F.coalesce("_new", F.lit(0)))
    return out.withColumn("place", F.when(place < keep, place)).select(*keys, "id", "shorts", "title", "views", "likes", "pub", "original", "fresh", "place")


def parse_srt(files: DataFrame, text: str) -> DataFrame:
    """Subtitle files -> ``start, end, text`` beside the other columns: blocks end at an empty line, tags and overrides go,
    an end before its start is the start, blocks without a time or words are passed over.  A block's times are looked for
    once, then cut apart."""
    whole = F.regexp_replace(F.regexp_replace(F.ltrim(F.col(text), F.lit("﻿")), r"\r\n?", "\n"), r"\n[ \t]*(?=\n)", "\n")
    rows = files.withColumn("_block", F.explode(F.split(whole, r"\n\n+"))).drop(text)
    after = F.regexp_extract("_block", r"(?s)-->[^\n]*\n(.*)$", 1)
    line = F.btrim(F.regexp_replace(F.regexp_replace(after, r"\s*\n\s*", " "), r"<[^>]*>|\{\\[^}]*\}", ""))
    times = F.split(F.regexp_extract("_block", SRT_TIME, 0), r"\s*-->\s*|[:,.]")
    # a row of its own: else the filter would work both out a second time
    rows = rows.select(*[c for c in rows.columns if c != "_block"], F.inline(F.array(F.struct(times.alias("_times"), line.alias("text")))))
    rows = rows.where("size(_times) = 8 and text <> ''")
    part = lambda k: F.get("_times", F.lit(k)).cast("int")
    seconds = lambda k: (part(k) * 3_600_000 + part(k + 1) * 60_000 + part(k + 2) * 1000 + part(k + 3)) / 1000
    rows = rows.withColumns({"start": seconds(0), "_end": seconds(4)})
    return rows.withColumn("end", F.greatest("start", "_end")).drop("_times", "_end")


def _srt_time(ms: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours, minutes, seconds = ((ms / n).cast("long") for n in (3_600_000, 60_000, 1000))
    plain = F.concat(two(hours), F.lit(":"), two(minutes % 60), F.lit(":"), two(seconds % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.when((ms >= 0) & (ms < 360_000_000), plain).otherwise(F.format_string("%02d:%02d:%02d,%03d", hours, minutes % 60, seconds % 60, ms % 1000))


def to_srt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``start, end, text`` rows -> one subtitle text per key, with a byte-order mark; blocks are numbered in order of start.
    A block is made before the rows of its key meet, all but its number."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = rows.withColumns({"_from": ms("start"), "_to": ms("end")})
    body = F.concat(F.lit("\n"), _srt_time(F.col("_from")), F.lit(" --> "), _srt_time(F.col("_to")), F.lit("\n"), F.col("text"), F.lit("\n"))
    block = F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "text", body.alias("body")))), lambda x, i: F.concat((i + 1).cast("string"), x["body"]))
    return rows.groupBy(*keys).agg(F.concat(F.lit("﻿"), F.array_join(block, "\n")).alias("srt"))


def log_spans(logs: DataFrame, log: str, start: str = r"silence_start: ([\d.]+)", end: str = r"silence_end: ([\d.]+)") -> DataFrame:
    """A detector's log -> its spans: starts and ends in order, paired as far as both go."""
    at = lambda rx: F.transform(F.regexp_extract_all(log, F.lit(rx)), lambda x: F.round(x.cast("double"), 2))
    rows = logs.withColumns({"_a": at(start), "_b": at(end)}).withColumn("_n", F.least(F.size("_a"), F.size("_b")))
    pairs = F.arrays_zip(F.slice("_a", 1, F.col("_n")), F.slice("_b", 1, F.col("_n")))
    rows = rows.withColumn("_s", F.explode(pairs)).drop(log)
    return rows.select("*", F.col("_s")["0"].alias("start"), F.col("_s")["1"].alias("end")).drop("_a", "_b", "_n", "_s")
