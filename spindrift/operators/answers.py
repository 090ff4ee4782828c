"""Answers that should be JSON: taken strictly, cut to their limits, or told apart by why they are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an answer, of its parts, and how many of each.
LONGEST, SUMMARY = 60_000, 600
LISTS = {"diagnosis": (6, 300), "titles": (6, 100), "risks": (5, 300)}
ACTIONS, ACTION = 8, 300


def json_part(text: str | Column) -> Column:
    """The object in an answer: that of a fenced block, else from the first brace to the last; null without one."""
    t = F.trim(F.coalesce(text, F.lit("")) if isinstance(text, Column) else F.coalesce(F.col(text), F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(plain), F.lit(""))


def _line(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def _list(v: Column, name: str, n: int, most: int) -> Column:
    """Texts of a list, or of a single value, without empty ones."""
    some = F.try_variant_get(v, f"$.{name}", "array<string>")
    one = F.try_variant_get(v, f"$.{name}", "string")
    raw = F.coalesce(some, F.when(one.isNotNull() & ~one.rlike(r"^\s*[\[{]"), F.array(one)), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(raw, lambda x: _line(F.coalesce(x, F.lit("")), most)), lambda x: x != ""), 1, n)


def parse_answers(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``state`` (ok; long, none: no object in it; broken: no JSON) and, where ok, ``summary``, ``diagnosis``, ``titles``,
    ``risks`` and ``actions`` (text, why, priority; by priority, then as given)."""
    part = json_part(text)
    v = F.try_parse_json(part)
    state = F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > LONGEST, "long").when(part.isNull(), "none").when(v.isNull(), "broken").otherwise("ok")
    out = rows.withColumns({"state": state, "_v": v})
    ok = F.col("state") == "ok"
    items = F.coalesce(F.try_variant_get("_v", "$.actions", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda a, k: F.try_variant_get(a, f"$.{k}", "string")
    plain = lambda a: F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))
    action = lambda a, i: F.struct(
        F.coalesce(F.try_variant_get(a, "$.priority", "int"), i + 1).alias("priority"), i.alias("place"), F.substring(F.trim(F.coalesce(plain(a), get(a, "text"), F.lit(""))), 1, ACTION).alias("text"), F.substring(F.trim(F.coalesce(get(a, "why"), F.lit(""))), 1, ACTION).alias("why"),
    )
    kept = F.filter(F.transform(items, lambda a: F.struct(a.alias("a"), F.trim(F.coalesce(plain(a), get(a, "text"), F.lit(""))).alias("t"))), lambda x: x["t"] != "")
    actions = F.slice(F.array_sort(F.transform(kept, lambda x, i: action(x["a"], i))), 1, ACTIONS)
    cells = {"summary": _line(F.coalesce(get(F.col("_v"), "summary"), F.lit("")), SUMMARY), **{k: _list(F.col("_v"), k, n, most) for k, (n, most) in LISTS.items()}}
    out = out.withColumns({k: F.when(ok, c) for k, c in cells.items()} | {"actions": F.when(ok, F.transform(actions, lambda a: F.struct(a["text"].alias("text"), a["why"].alias("why"), a["priority"].alias("priority"))))})
    return out.drop("_v")
