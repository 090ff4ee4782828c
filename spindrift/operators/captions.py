"""Text on screen: which lines are text at all, what kind of caption one is; and sounds that keep clear of talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the picture's height, confidences, shares of letters.
TALLEST, DIGITS_SURE, LETTERS_SURE, LETTER_SHARE = 0.35, 0.8, 0.85, 0.6
BIG, SMALL, QUOTE_BIG = 0.07, 0.045, 0.1
PAD, INSIDE = 0.01, 0.5
ALIKE = 0.6
#: Patterns of names, counts, sounds, thoughts and situations.
INFO_NAME = r"^[가-힣]{2,4}\s?(감독|선수|코치|님|씨|대표|프로)(님)?(\s?\(.{1,12}\))?$"
INFO_NUM = r"\d+\s*(초|m|km|개|점|%|회|골|번|kg|cm)|\d+\s*[:：]\s*\d+"
SOUND = r"^(쾅|퍽|뻥|슝|두둥|띠용|휙|탁|짠|팡|빵|쿵|툭|탕|휘익|두근|부들)+[!~?]*$"
REPEAT = r"^(.)\1{2,}$|^[!?.~]+$|^(ㅋ|ㅎ|ㅠ|ㅜ)+$"
INNER = r"^\(.*\)$|^（.*）$|…|\.\.\.|(ㅠㅠ|ㅜㅜ|;;|ㅋㅋ)$|속마음|\((당황|민망|뿌듯|머쓱|충격|분노|감동|씁쓸)\)"
SITUATION = r"(중|함|했음|하는 중|등장|시작|완료|성공|실패|도착|결과)$|^(그때|결국|그리고|한편|잠시 후|드디어)"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def plausible(text: Column, height: Column, sure: Column) -> Column:
    """Whether a line read off a picture is text: not too tall; Korean, or digits read surely, or letters read very surely."""
    t, sure = _bare(text), F.coalesce(sure, F.lit(0.0))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    digits = t.rlike(r"^[\d:.,%/-]+$")
    own = F.when(t.rlike("[가-힣]"), True).when(digits, (letters >= 2) & (sure >= DIGITS_SURE)).otherwise((letters >= 2) & (F.length(t) >= 2) & (sure >= LETTERS_SURE) & (letters >= LETTER_SHARE * F.length(t)))
    return (F.coalesce(height, F.lit(0.0)) <= TALLEST) & (t != "") & own


def outside_fixed(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """Lines (video, x0, y0, x1, y1 and more) but for those in a place where text always stands (video, a, b, c, d): with their
    middle in it, and at least half of their box."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    area = F.greatest(F.lit(1e-6), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    a, b, c, d = F.col("_a") - PAD, F.col("_b") - PAD, F.col("_c") + PAD, F.col("_d") + PAD
    shared = F.greatest(F.lit(0.0), F.least("x1", c) - F.greatest("x0", a)) * F.greatest(F.lit(0.0), F.least("y1", d) - F.greatest("y0", b))
    places = fixed.select(F.col("video").alias("_v"), *[F.col(k).alias(f"_{k}") for k in "abcd"])
    return lines.join(places, (F.col("video") == F.col("_v")) & cx.between(a, c) & cy.between(b, d) & (shared >= INSIDE * area), "left_anti")


def caption_kind(text: Column, height: Column, color: Column, place: Column, box: Column, lasts: Column, said: Column, transcript: Column) -> Column:
    """info, sfx, emph, speech, inner or situ: looks first, then whether it is what is ``said`` (likeness to the words heard; null
    unknown).  ``box``: x0, y0, x1, y1; ``transcript``: whether there is one at all."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = _bare(t)
    x0, y0, x1, y1 = (box[k] for k in ("x0", "y0", "x1", "y1"))
    corner = ((x0 < 0.25) | (x1 > 0.75)) & ((y0 < 0.25) | (y1 > 0.75)) & (x1 - x0 < 0.5)
    colored, loud = ~color.isin("white", "black"), t.rlike("[!?]")
    quoted = (height >= QUOTE_BIG) | ((place != "bottom") & (colored | (height >= SMALL))) | (colored & ((height >= BIG + 0.02) | loud))
    rules = [
        (t.rlike(INFO_NAME), F.lit("info")),
        (((F.length(n) <= 4) & n.rlike(SOUND)) | n.rlike(REPEAT), F.lit("sfx")),
        (F.coalesce(said >= ALIKE, F.lit(False)), F.when(quoted, "emph").otherwise("speech")),
        ((t.rlike(INFO_NUM) & (F.length(n) <= 14)) | n.rlike(r"^[\d:.,%/~-]+$") | ((height < SMALL) & corner & (lasts >= 3)), F.lit("info")),
        (~transcript & (place == "bottom") & (color == "white") & (lasts >= 2) & (height < BIG), F.lit("speech")),
        (t.rlike(INNER), F.lit("inner")),
        (n.rlike(SITUATION) & (F.length(n) >= 3), F.lit("situ")),
        ((height >= BIG) | (color != "white") | loud, F.lit("emph")),
        (place == "bottom", F.lit("speech")),
    ]
    return F.coalesce(*[F.when(test, kind) for test, kind in rules], F.lit("situ"))


def clear_of_talk(sounds: DataFrame, words: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Sounds (key, id, lo, hi: their loud part, seconds) that no word (key, s, e) overlaps by more than a trim, and that do not
    sit where one word has just ended and the next is about to begin."""
    trim = F.least(F.lit(0.02), (F.col("hi") - F.col("lo")) / 4)
    spread = lambda df, lo, hi: df.withColumn("_b", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    asked = spread(sounds.where("lo <= hi"), F.col("lo") - 0.35, F.col("hi") + 0.35)
    said = spread(words.where("s <= e").select(F.col("key").alias("_key"), "s", "e"), F.col("s"), F.col("e")).withColumnRenamed("_b", "_b2")
    over = (F.col("s") < F.col("hi") - trim) & (F.col("e") > F.col("lo") + trim)
    before, after = F.col("e").between(F.col("lo") - 0.35, F.col("lo") + 0.05), F.col("s").between(F.col("hi") - 0.05, F.col("hi") + 0.35)
    near = asked.join(said, (F.col("key") == F.col("_key")) & (F.col("_b") == F.col("_b2")))
    marked = near.groupBy("key", "id").agg(F.max(over).alias("over"), F.max(before).alias("before"), F.max(after).alias("after"))
    return sounds.where("lo <= hi").join(marked.where("over or (before and after)"), ["key", "id"], "left_anti")
