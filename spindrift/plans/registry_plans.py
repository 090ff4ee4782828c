"""Queries of small stores, folders, channel keys and habits, over the driver's tables in their form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import channel_key, channel_keys
from ..operators import style
from ..sources import files, library, registries
from ..sources.tables import table
from .registry import query

_WAYS = ["https://www.youtube.com/@N?x=1", "https://www.youtube.com/channel/U/videos", "@N", "m.youtube.com/c/N/", "https://youtube.com/user/N/about", "https://www.youtube.com/N/videos", "https://www.youtube.com/watch?v=1", "U", "N", ""]


@query(
    "f13_channel_keys",
    """WITH w AS (SELECT c_custkey AS id, c_custkey % 10 AS way, 'Name_' || c_custkey AS n, 'UC' || lpad(CAST(c_custkey AS VARCHAR), 22, 'x') AS u FROM customer)
    SELECT id, CASE way WHEN 0 THEN 'handle:@' || lower(n) WHEN 1 THEN 'id:' || u WHEN 2 THEN 'handle:@' || lower(n) WHEN 3 THEN 'path:/c/' || lower(n) WHEN 4 THEN 'path:/user/' || lower(n) WHEN 5 THEN 'path:/c/' || lower(n) WHEN 7 THEN 'id:' || u WHEN 8 THEN 'handle:@' || lower(n) END AS key,
    CASE WHEN way = 6 OR way = 9 THEN 2 WHEN way = 1 OR way = 7 THEN 2 WHEN way = 4 THEN 2 ELSE 3 END AS keys FROM w""",
)
def f13_keys(spark, sf_dir):
    """Customers' addresses in all the ways there are, and how many keys a record with id, user name and address names."""
    name, own = F.concat(F.lit("Name_"), F.col("c_custkey").cast("string")), F.concat(F.lit("UC"), F.lpad(F.col("c_custkey").cast("string"), 22, "x"))
    way = F.array(*[F.lit(w) for w in _WAYS])[(F.col("c_custkey") % 10).cast("int")]
    url = F.replace(F.replace(way, F.lit("/U"), F.concat(F.lit("/"), own)), F.lit("N"), name)
    url = F.when(way == "U", own).otherwise(url)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), url.alias("url"), name.alias("n"), own.alias("u"))
    return rows.select("id", channel_key(F.col("url")).alias("key"), F.size(channel_keys(F.col("u"), F.col("n"), F.col("url"))).alias("keys"))


@query(
    "s26_provenance",
    """SELECT c_nationkey AS store, count(*) FILTER (c_custkey % 3 <> 0) AS files, count(*) FILTER (c_custkey % 4 = 0) AS own, round(sum(c_acctbal) FILTER (c_custkey % 3 <> 0), 2) AS total FROM customer WHERE c_nationkey <> 7 GROUP BY 1 HAVING count(*) FILTER (c_custkey % 3 <> 0) > 0""",
)
def s26(spark, sf_dir):
    """A nation's customers as one store; a third of the files are no objects, some own ids no texts; one store is cut short."""
    rows = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("f"), F.col("c_custkey").cast("string")))
    cell = F.concat(F.lit('"'), "name", F.lit('": '), F.when(F.col("c_custkey") % 3 == 0, F.lit("5")).otherwise(F.format_string('{"balance": %.2f}', "c_acctbal")))
    own = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.lit("1"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ", ")
    stores = rows.groupBy(F.col("c_nationkey").alias("store")).agg(F.concat(F.lit('{"files": {'), listed(cell), F.lit('}, "own": {"ids": ['), listed(own), F.lit("]}}")).alias("text"))
    text = F.when(F.col("store") == 7, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    got = registries.provenance(stores.select("store", text.alias("text")), "text")
    known = got["files"].groupBy("store").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(F.get_json_object("record", "$.balance").cast("double")), 2).alias("total"))
    mine = got["own"].groupBy("store").agg(F.count(F.lit(1)).alias("own"))
    return known.join(mine, "store", "left").select("store", "files", F.coalesce("own", F.lit(0)).alias("own"), "total")


@query(
    "s27_adopted_references",
    """WITH r AS (SELECT 'f' || p_partkey AS name, p_brand AS channel, p_size > 25 AS learned FROM part WHERE p_partkey % 3 <> 0), h AS (SELECT 'f' || p_partkey AS name, p_size::BIGINT AS size, 'dir ' || p_brand AS top FROM part WHERE p_partkey % 4 <> 0),
    c AS (SELECT DISTINCT p_brand AS channel, 'dir ' || p_brand AS folder FROM part WHERE p_brand < 'Brand#4')
    SELECT coalesce(r.name, h.name) AS name, coalesce(r.channel, c.channel) AS channel, h.size IS NOT NULL AS present, coalesce(h.size, 0) AS size, coalesce(learned, false) AS learned, h.size IS NOT NULL OR coalesce(learned, false) AS usable FROM r FULL JOIN h ON h.name = r.name LEFT JOIN c ON c.folder = h.top""",
)
def s27(spark, sf_dir):
    """Parts as reference files: some registered, some only there, in folders of which some are a channel's."""
    parts = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).withColumn("folder", F.concat(F.lit("dir "), "p_brand"))
    known = parts.where("p_partkey % 3 <> 0").select("name", F.col("p_brand").alias("channel"), (F.col("p_size") > 25).alias("learned"))
    here = parts.where("p_partkey % 4 <> 0").select("name", F.col("folder").alias("top"), F.col("p_size").cast("long").alias("size"))
    return registries.adopted(known, here, parts.where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("channel"), "folder").distinct())


@query(
    "s28_dictionaries",
    """WITH p AS (SELECT p_brand AS book, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
    t AS (SELECT book, p_name AS term, min(k) AS first FROM p WHERE length(p_name) BETWEEN 1 AND 30 GROUP BY 1, 2), tt AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY first) - 1 AS place FROM t)
    SELECT book, 'term' AS kind, place, term, NULL AS right_ FROM tt WHERE place < 200 UNION ALL SELECT book, 'fix', NULL, 'w' || p_partkey, p_type FROM p WHERE k <= 200 AND p_type <> 'PROMO'""",
)
def s28(spark, sf_dir):
    """A brand's parts as a dictionary: names as terms, with spaces to be made one; types as right words, some no texts."""
    rows = table(spark, sf_dir, "part")
    term = F.concat(F.lit('"  '), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit('"'))
    fix = F.concat(F.lit('"w'), F.col("p_partkey").cast("string"), F.lit('": '), F.when(F.col("p_type") == "PROMO", F.lit("3")).otherwise(F.concat(F.lit('"'), "p_type", F.lit('"'))))
    listed = lambda c, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("c")))), lambda x: x["c"]), 1, n), ", ")
    books = rows.groupBy(F.col("p_brand").alias("book")).agg(F.concat(F.lit('{"terms": [7, '), listed(term, 1 << 30), F.lit('], "fix": {'), listed(fix, 200), F.lit("}}")).alias("text"))
    terms, fixes = registries.dictionaries(books, "text")
    return terms.select("book", F.lit("term").alias("kind"), "place", "term", F.lit(None).cast("string").alias("right_")).unionByName(fixes.select("book", F.lit("fix").alias("kind"), F.lit(None).cast("long").alias("place"), F.col("wrong").alias("term"), F.col("right").alias("right_")))


@query(
    "s30_upload_history",
    """WITH e AS (SELECT user_id % 5 AS channel, 'v' || (event_id % 97) AS video, epoch_us(ts) AS t, event_type AS kind FROM events), l AS (SELECT channel, video, max(t) AS t, arg_max(kind, t) AS kind FROM e GROUP BY 1, 2)
    SELECT channel, video, t AS uploaded, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t DESC, video) AS place FROM l) WHERE place <= 10""",
)
def s30(spark, sf_dir):
    """Events as uploads of a few videos over and over: the first half is the history, the second comes on top."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("channel"), F.concat(F.lit("v"), (F.col("event_id") % 97).cast("string")).alias("video"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind"), (F.col("event_id") % 2 == 0).alias("old"))
    got = registries.put_uploads(rows.where("old").drop("old"), rows.where("not old").drop("old"), ["channel"], 10)
    return got.select("channel", "video", F.col("at").alias("uploaded"), "kind", "place")


@query(
    "s20_library_folders",
    "SELECT 'nation=' || c_nationkey AS top, 1 AS n, length('header') + sum(length(c_name) + 1)::BIGINT AS bytes, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS copying FROM customer GROUP BY c_nationkey",
)
def s20(spark, sf_dir):
    """A file a nation, in folders: listed with all that is below, and summed by folder."""
    home = files.fresh_folder(spark, "library")
    names = F.concat(F.lit("header"), F.array_join(F.transform(F.sort_array(F.collect_list("c_name")), lambda n: F.concat(F.lit("\n"), n)), ""))
    files.write_documents(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(names.alias("value")), "nation", home)
    found = library.listing(spark, home)
    copying = found.where(F.regexp_extract("top", "([0-9]+)$", 1).cast("int") % 2 == 0).select("path")
    got = library.folders(found, copying, endings=["txt"])
    return got.select("top", F.col("n").cast("int").alias("n"), (F.col("bytes") - 1).alias("bytes"), F.col("copying").cast("int").alias("copying"))


@query(
    "a32_habits",
    """WITH m AS (SELECT l_orderkey % 40 AS channel, l_quantity / 100 AS text_h, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS lines, CASE WHEN l_discount > 0.06 THEN 'top' WHEN l_discount > 0.03 THEN 'middle' ELSE 'bottom' END AS pos, CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'N' THEN 'white' ELSE 'black' END AS accent, l_linestatus AS mode, l_tax AS face FROM lineitem),
    t AS (SELECT * FROM m WHERE text_h > 0.05), p AS (SELECT channel, pos, count(*) AS n FROM t GROUP BY 1, 2), a AS (SELECT channel, accent, count(*) AS n FROM t WHERE accent <> 'black' GROUP BY 1, 2), d AS (SELECT channel, mode, count(*) AS n FROM t GROUP BY 1, 2),
    g AS (SELECT channel, count(*) AS n, count(*) FILTER (text_h > 0.05) AS with_text, round(median(text_h) FILTER (text_h > 0.05), 3) AS text_h, round(median(lines) FILTER (text_h > 0.05 AND lines > 0), 1) AS lines, round(median(face) FILTER (face > 0), 3) AS face FROM m GROUP BY 1)
    SELECT g.*, (SELECT arg_max(pos, [n, CASE pos WHEN 'top' THEN 3 WHEN 'middle' THEN 2 ELSE 1 END]) FROM p WHERE p.channel = g.channel) AS pos, (SELECT arg_max(accent, [n, CASE accent WHEN 'white' THEN 2 ELSE 1 END]) FROM a WHERE a.channel = g.channel) AS accent, (SELECT arg_max(mode, [n, ascii(mode)]) FROM d WHERE d.channel = g.channel) AS mode FROM g""",
)
def a32(spark, sf_dir):
    """Order lines as measured pictures of forty channels."""
    off, flag = F.col("l_discount"), F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("channel"), (F.col("l_quantity") / 100).alias("text_h"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")).alias("lines"), F.when(off > 0.06, "top").when(off > 0.03, "middle").otherwise("bottom").alias("pos"),
        F.when(flag == "A", "yellow").when(flag == "N", "white").otherwise("black").alias("accent"), F.col("l_linestatus").alias("mode"), F.col("l_tax").alias("face"),
    )
    return style.habits(rows, "channel", least_text=0.05)


@query(
    "s7_seed_channels",
    "SELECT c_nationkey AS book, 'c' || c_custkey AS key, (c_nationkey * 1.5)::DOUBLE AS at_, (c_custkey % 3)::BIGINT AS videos FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_nationkey <> 3",
)
def s7(spark, sf_dir):
    """A nation's customers as shipped channels; some have no key that is a text, some no videos, one set is cut short."""
    rows = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit('"c'), F.col("c_custkey").cast("string"), F.lit('"')))
    some = F.array_join(F.slice(F.array(F.lit('"a": {}'), F.lit('"b": {}')), F.lit(1), (F.col("c_custkey") % 3).cast("int")), ", ")
    videos = F.when(F.col("c_custkey") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit("{"), some, F.lit("}")))
    cell = F.concat(F.lit('{"key": '), key, F.lit(', "videos": '), videos, F.lit("}"))
    docs = rows.groupBy(F.col("c_nationkey").alias("book")).agg(F.concat(F.lit('{"at": '), (F.first("c_nationkey") * 1.5).cast("string"), F.lit(', "channels": [5, '), F.array_join(F.collect_list(cell), ", "), F.lit("]}")).alias("text"))
    text = F.when(F.col("book") == 3, F.expr("substring(text, 1, length(text) - 2)")).otherwise(F.col("text"))
    return registries.seed_channels(docs.select("book", text.alias("text")), "text").select("book", "key", F.col("at").alias("at_"), "videos")
