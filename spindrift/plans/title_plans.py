"""Fuzzy matching of titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..sources.stage import staged
from ..sources.tables import table
from .registry import query


@query("j18_fuzzy_titles")
def j18(spark, sf_dir):
    """Titles (first sentences) of the documents whose id is divisible by 20, against those of all documents: one row per
    such document with its class (least id of the same title), and links to rows and classes of other titles."""
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.array_join(fuzzy.title_words(title), " ").alias("title"))
    rows = staged(rows, "titles")
    asked = rows.where("id % 20 = 0")
    every, own = (staged(fuzzy.classes(x, "id", "title"), "classes") for x in (rows, asked))
    found = fuzzy.fuzzy_links(own, every).join(every.select(F.col("class").alias("b"), "n"), "b")
    links = found.groupBy("a").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_classes"), F.min("b").alias("first_link"))
    named = own.select("seq", F.col("class").alias("a")).join(every.select("seq", F.col("class").alias("class_id")), "seq").join(links, "a", "left")
    out = asked.join(named, asked["title"] == named["seq"], "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_classes")], "first_link")
