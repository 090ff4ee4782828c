"""Small stores that are kept as JSON, as tables: where files come from, reference files, dictionaries, uploads, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import newest_n
from .files import split_documents

#: Letters of a dictionary's words, entries of a dictionary, uploads that a history keeps.
TERM_MOST, FIX_MOST, ENTRIES_MOST, UPLOADS_MOST = 30, 40, 200, 100


def provenance(stores: DataFrame, text: str) -> dict[str, DataFrame]:
    """Stores of provenance (JSON documents with the objects files, ids, channels and lookup, and own: ids, handles) -> a table
    of each: the store's columns, ``name`` and ``record`` (JSON); of own: ``kind`` and ``key``.

    Entries that are no objects are passed over, as are own ids that are no texts: one bad cell costs nothing else.  A store
    that is no JSON object is empty."""
    others = [c for c in stores.columns if c != text]
    maps = {k: f"{k} map<string, variant>" for k in ("files", "ids", "channels", "lookup")}
    good, _ = split_documents(stores, text, ", ".join([*maps.values(), "own struct<ids: array<variant>, handles: array<variant>>"]))
    out = {}
    for k in maps:
        rows = good.select(*others, F.explode(k).alias("name", "_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
        out[k] = rows.select(*others, "name", F.to_json("_v").alias("record"))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    keys = F.explode(F.concat(*[F.transform(F.coalesce(f"own.{k}", F.array().cast("array<variant>")), named(k)) for k in ("ids", "handles")])).alias("_k")
    out["own"] = good.select(*others, keys).where(F.schema_of_variant("_k.v") == "STRING").select(*others, "_k.kind", F.try_variant_get("_k.v", "$", "string").alias("key"))
    return out


def adopted(registry: DataFrame, files: DataFrame, channels: DataFrame) -> DataFrame:
    """Reference files known (name, channel, learned) and there (name, top, size) -> ``name, channel, present, size, learned, usable``.

    A file that nobody has registered is taken in as one of the channel whose folder (channels: channel, folder) it lies in, if
    any.  A registered file that is gone stays usable if it has been learned."""
    here = files.groupBy("name").agg(F.max(F.struct("size", "top")).alias("f")).select("name", "f.size", "f.top")
    both = registry.join(here, "name", "full").join(channels.select(F.col("channel").alias("_c"), F.col("folder").alias("top")), "top", "left")
    present = F.col("size").isNotNull()
    learned = F.coalesce("learned", F.lit(False))
    return both.select("name", F.coalesce("channel", "_c").alias("channel"), present.alias("present"), F.coalesce("size", F.lit(0)).alias("size"), learned.alias("learned"), (present | learned).alias("usable"))


def dictionaries(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Dictionaries (JSON: terms, a list; fix, wrong -> right) -> terms (``place, term``) and fixes (``wrong, right``) beside the other columns.

    White space is made one; empty, too long and repeated words go, and fixes that change nothing; ``ENTRIES_MOST`` of each."""
    others = [c for c in docs.columns if c != text]
    good, _ = split_documents(docs, text, "terms array<variant>, fix map<string, variant>")
    clean = lambda c, most: F.when(F.length(F.trim(F.regexp_replace(c, r"\s+", " "))).between(1, most), F.trim(F.regexp_replace(c, r"\s+", " ")))
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    terms = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("terms", F.array().cast("array<variant>")), lambda v: clean(plain(v), TERM_MOST)), lambda t: t.isNotNull())), 1, ENTRIES_MOST)
    fixes = F.filter(F.transform(F.map_entries("fix"), lambda e: F.struct(clean(e["key"], FIX_MOST).alias("wrong"), clean(plain(e["value"]), FIX_MOST).alias("right"))), lambda e: (e["wrong"] != e["right"]))
    one = lambda c: good.select(*others, F.posexplode(c).alias("place", "x"))
    return one(terms).select(*others, F.col("place").cast("long").alias("place"), F.col("x").alias("term")), one(F.slice(fixes, 1, ENTRIES_MOST)).select(*others, "x.wrong", "x.right")


def put_uploads(history: DataFrame, fresh: DataFrame, keys: list[str], most: int = UPLOADS_MOST) -> DataFrame:
    """A history of uploads (keys, video, at, and more) with ``fresh`` ones: of a video the latest entry stays, of all the
    ``most`` latest."""
    rest = [c for c in history.columns if c not in (*keys, "video")]
    latest = history.unionByName(fresh).groupBy(*keys, "video").agg(F.max(F.struct("at", *[c for c in rest if c != "at"])).alias("_u")).select(*keys, "video", "_u.*")
    return newest_n(latest, keys, [F.desc("at"), "video"], most).select(*history.columns, "place")


def seed_channels(docs: DataFrame, text: str) -> DataFrame:
    """A shipped set of channels (JSON: at, channels, each with key and videos, an object) -> the other columns, ``at, key, channel``
    (JSON) and ``videos``, how many.  Entries without a key or videos are passed over; of a key's the last stays; a document that
    is none gives no rows."""
    others = [c for c in docs.columns if c != text]
    good, _ = split_documents(docs, text, "at double, channels array<variant>")
    rows = good.select(*others, "at", F.posexplode(F.coalesce("channels", F.array().cast("array<variant>"))).alias("_i", "_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    key, videos = F.try_variant_get("_v", "$.key", "variant"), F.try_variant_get("_v", "$.videos", "map<string, variant>")
    rows = rows.where(F.schema_of_variant(key) == "STRING").select(*others, "at", "_i", F.try_variant_get("_v", "$.key", "string").alias("key"), F.to_json("_v").alias("channel"), F.size(videos).cast("long").alias("videos"), videos.isNotNull().alias("_ok")).where("_ok")
    return rows.groupBy(*others, "key").agg(F.max_by(F.struct("at", "channel", "videos"), "_i").alias("_c")).select(*others, "key", "_c.*")
