"""Addresses of channels -> the key that they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of channels, and first parts of a path that name no channel.
CHANNEL_ID = r"UC[\w-]{22}"
NO_NAMES = ["watch", "playlist", "shorts", "live", "embed", "results", "feed", "channel"]


def channel_key(c: Column) -> Column:
    """``kind:key`` of a channel's address, id or handle: ``id:UC...``, ``handle:@name``, ``path:/c/name`` or ``path:/user/name``; null if it
    names none.  Addresses may lack the scheme, and old ones the ``/c``; what is no address is a handle."""
    url = F.trim(F.coalesce(c, F.lit("")))
    full = F.when(url.rlike("(?i)^https?://"), url).when(url.rlike(r"(?i)^(?:(?:www|m)\.)?youtube\.com/"), F.concat(F.lit("https://"), url)).otherwise(F.concat(F.lit("https://www.youtube.com/"), F.when(url.startswith("@"), "").otherwise("@"), url))
    raw = F.regexp_extract(full, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), "/+$", "")
    own = F.regexp_extract(path, f"^/channel/({CHANNEL_ID})(?:/|$)", 1)
    handle = F.lower(F.regexp_extract(path, "^/(@[^/]+)", 1))
    kind, name = (F.lower(F.regexp_extract(path, "(?i)^/(c|user)/([^/]+)", g)) for g in (1, 2))
    old = F.lower(F.regexp_extract(path, "^/([^/@]+)(?:/(?:videos|shorts|streams|featured|about))?$", 1))
    return F.when(url == "", None).when(url.rlike(f"^{CHANNEL_ID}$"), F.concat(F.lit("id:"), url)).when(own != "", F.concat(F.lit("id:"), own)).when(handle != "", F.concat(F.lit("handle:"), handle)).when(kind != "", F.concat(F.lit("path:/"), kind, F.lit("/"), name)).when((old != "") & ~old.isin(*NO_NAMES), F.concat(F.lit("path:/c/"), old))


def channel_keys(channel_id: Column, uploader_id: Column, *urls: Column) -> Column:
    """All keys that a record's fields name, each once: its id, the uploader's id, handle or user name, its addresses."""
    uploader = F.when(uploader_id.startswith("@") | uploader_id.rlike(f"^{CHANNEL_ID}$"), channel_key(uploader_id)).when(uploader_id != "", F.concat(F.lit("path:/user/"), F.lower(uploader_id)))
    named = F.when(channel_id != "", F.concat(F.lit("id:"), channel_id))
    return F.array_distinct(F.array_compact(F.array(named, uploader, *[channel_key(u) for u in urls])))
