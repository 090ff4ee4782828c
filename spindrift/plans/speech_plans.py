"""Queries of what a recogniser made up, of corrections that keep times, and of talk beside the script, with their SQL.

The driver's conversations have no times, so the queries give them some: a turn begins every minute, a word every 0.6 s.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import alignment, asr, offscript, sounds
from ..sources.tables import table
from .registry import query

_LISTS = r"SELECT conv_id AS key, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS x FROM conversations WHERE text IS NOT NULL"
#: Every third group of four words repeats the one before it at one point in time; every fifth group of six is one word.
_SPOKEN = f"""l AS ({_LISTS}), u AS (SELECT key, turn, x, unnest(range(len(x))) AS pos FROM l),
  o AS (SELECT key, turn * 100000 + pos AS place, CASE WHEN pos // 4 % 3 = 2 THEN x[pos - 3] WHEN pos // 6 % 5 = 4 THEN x[pos // 6 * 6 + 1] ELSE x[pos + 1] END AS w,
    turn * 60000 + CASE WHEN pos // 4 % 3 = 2 THEN pos // 4 * 2400 ELSE pos * 600 END AS s, CASE WHEN pos // 4 % 3 = 2 THEN pos % 4 * 5 ELSE 550 END AS d, (key * 7 + turn * 13 + pos * 29) % 100 / 100.0 AS p FROM u),
  t AS (SELECT key, place, w, s, s + d AS e, p, regexp_replace(w, '[^0-9A-Za-z가-힣]', '', 'g') AS t, row_number() OVER (PARTITION BY key ORDER BY s, place) AS num FROM o),
  f AS (SELECT *, length(t) > 0 AND e - s < 50 * length(t) AS collapsed FROM t)"""


def spoken(spark, sf_dir):
    """key, at, s, e, p, w of all turns' words."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), "turn", words.alias("x"))
    rows = rows.select("key", "turn", "x", F.posexplode("x").alias("pos", "own"))
    squeezed = F.expr("pos div 4 % 3 = 2")
    w = F.when(squeezed, F.expr("get(x, pos - 4)")).when(F.expr("pos div 6 % 5 = 4"), F.expr("get(x, cast(pos div 6 * 6 as int))")).otherwise(F.col("own"))
    s = F.col("turn") * 60000 + F.when(squeezed, F.expr("pos div 4 * 2400")).otherwise(F.expr("cast(pos as long) * 600"))
    rows = rows.select("key", (F.col("turn") * 100000 + F.col("pos")).alias("at"), s.alias("s"), F.when(squeezed, F.col("pos") % 4 * 5).otherwise(550).alias("d"), ((F.col("key") * 7 + F.col("turn") * 13 + F.col("pos") * 29) % 100 / 100.0).alias("p"), w.alias("w"))
    return rows.withColumn("e", F.col("s") + F.col("d")).drop("d")


@query(
    "p13_hallucinations",
    f"""WITH RECURSIVE {_SPOKEN},
    q AS (SELECT conv_id AS key, turn * 60000 + 5000 AS a, turn * 60000 + 9000 AS b FROM conversations),
    own AS (SELECT key, num, CASE WHEN collapsed AND p < 0.15 THEN 'collapsed' WHEN regexp_full_match(t, '[A-Za-z0-9]*[A-Za-z]{{3,}}[A-Za-z0-9]*') AND p < 0.5 THEN 'foreign' END AS rule, collapsed, p, s, e FROM f WHERE t <> ''),
    sil AS (SELECT key, num FROM (SELECT o.key, o.num, any_value(o.s) AS s, any_value(o.e) AS e, sum(greatest(0, least(o.e, q.b) - greatest(o.s, q.a))) AS inside, bool_or(o.e <= o.s AND o.s BETWEEN q.a AND q.b) AS point FROM own o JOIN q ON q.key = o.key AND q.a <= o.e AND q.b >= o.s WHERE o.rule IS NULL AND o.p < 0.6 GROUP BY 1, 2)
      WHERE point OR (e > s AND inside >= 0.95 * (e - s))),
    k0 AS (SELECT key, num, s, CASE WHEN lag(num) OVER w = num - 1 AND s - lag(s) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM f WHERE collapsed WINDOW w AS (PARTITION BY key ORDER BY num)),
    k1 AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY num) AS c FROM k0),
    k AS (SELECT *, max(num) OVER (PARTITION BY key, c ORDER BY s RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING) - num + 1 AS n, min(num) OVER (PARTITION BY key, c) AS head FROM k1),
    r AS (SELECT key, c, num, n, s FROM k WHERE num = head UNION ALL SELECT k.key, k.c, k.num, k.n, k.s FROM r JOIN k ON k.key = r.key AND k.c = r.c AND k.num = r.num + CASE WHEN r.n >= 3 THEN r.n ELSE 1 END),
    near AS (SELECT r.key, r.num, any_value(r.n) AS n, string_agg(f.t, '' ORDER BY f.num) AS near FROM r JOIN f ON f.key = r.key AND NOT f.collapsed AND abs(f.s - r.s) <= 20000 WHERE r.n >= 3 GROUP BY 1, 2),
    parts AS (SELECT e.key, e.num AS head, e.n, e.near, f.num, f.t, lag(f.t) OVER v AS back, lead(f.t) OVER v AS onward FROM near e JOIN f ON f.key = e.key AND f.num BETWEEN e.num AND e.num + e.n - 1 WINDOW v AS (PARTITION BY e.key, e.num ORDER BY f.num)),
    shadow AS (SELECT key, head, n FROM parts GROUP BY 1, 2, 3 HAVING sum(CASE WHEN coalesce(contains(near, back || t), false) OR coalesce(contains(near, t || onward), false) OR (n = 1 AND contains(near, t)) THEN length(t) ELSE 0 END) >= 0.8 * sum(length(t))),
    i0 AS (SELECT key, num, t, CASE WHEN lag(t) OVER (PARTITION BY key ORDER BY num) = t THEN 0 ELSE 1 END AS new FROM f),
    i1 AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY num) AS c FROM i0),
    rep AS (SELECT key, num FROM (SELECT *, count(*) OVER (PARTITION BY key, c) AS n, row_number() OVER (PARTITION BY key, c ORDER BY num) AS i FROM i1) WHERE t <> '' AND n > 4 AND i > 2),
    hits AS (SELECT key, num, CASE rule WHEN 'collapsed' THEN 1 ELSE 2 END AS o FROM own WHERE rule IS NOT NULL
      UNION ALL SELECT o.key, o.num, CASE WHEN o.collapsed THEN 3 ELSE 6 END FROM own o JOIN sil USING (key, num)
      UNION ALL SELECT f.key, f.num, 4 FROM f JOIN shadow h ON h.key = f.key AND f.num BETWEEN h.head AND h.head + h.n - 1
      UNION ALL SELECT key, num, 5 FROM rep),
    best AS (SELECT key, num, min(o) AS o FROM hits GROUP BY 1, 2)
    SELECT f.key, f.place, f.w, ['collapsed', 'foreign', 'silent', 'mirrored', 'repeated', 'soft'][best.o] AS rule FROM best JOIN f USING (key, num)""",
)
def p13(spark, sf_dir):
    silences = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), (F.col("turn") * 60000 + 5000).alias("a"), (F.col("turn") * 60000 + 9000).alias("b"))
    rows = asr.hallucinations(spoken(spark, sf_dir), silences)
    return rows.where("rule is not null").select("key", F.col("at").alias("place"), "w", "rule")


_HINT = "h AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS h, lower(replace(p_brand, '#', '')) AS term FROM (SELECT DISTINCT p_brand FROM part))"


@query(
    "p12_prompt_echoes",
    f"""WITH {_HINT}, l AS ({_LISTS}), n AS (SELECT count(*) AS n FROM h), u AS (SELECT key, turn AS seg, x, unnest(range(len(x))) AS pos FROM l),
    w AS (SELECT u.key, u.seg, u.pos, coalesce(h.term || CASE WHEN pos % 3 = 0 THEN ',' ELSE '' END, u.x[pos + 1]) AS w, (u.key + u.seg * 3 + pos * 7) % 10 / 10.0 AS p FROM u CROSS JOIN n LEFT JOIN h ON 4 * u.pos < (2 + (u.key + u.seg) % 3) * len(u.x) AND h.h = (u.key + u.pos) % n.n),
    t AS (SELECT key, seg, pos, p, regexp_replace(w, '[,.?!…~]+$', '') AS tok, count(*) OVER (PARTITION BY key, seg) AS tokens FROM w),
    m AS (SELECT t.*, pos - h.h AS d FROM t JOIN h ON h.term = t.tok), i AS (SELECT *, pos - row_number() OVER (PARTITION BY key, seg, d ORDER BY pos) AS island FROM m),
    r AS (SELECT *, count(*) OVER v AS n, sum(p) OVER v AS sure FROM i WINDOW v AS (PARTITION BY key, seg, d, island ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT key, seg, max(n) AS n, any_value(tokens) AS tokens FROM r WHERE n >= 6 AND 3 * n >= 2 * tokens AND sure / n < 0.5 GROUP BY 1, 2""",
)
def p12(spark, sf_dir):
    """The dictionary: brands in order; segments: turns of which the first half, three quarters or all are the dictionary's words."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    place = (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("long")  # a dictionary: a few dozen brands
    hint = brands.select(place.alias("h"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("term"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), F.col("turn").alias("seg"), words.alias("x"))
    rows = rows.select("key", "seg", F.size("x").alias("n"), F.posexplode("x").alias("at", "own"))
    size = hint.agg(F.count(F.lit(1)).alias("size"))
    said = rows.crossJoin(F.broadcast(size)).withColumn("h", F.when(4 * F.col("at") < (2 + (F.col("key") + F.col("seg")) % 3) * F.col("n"), (F.col("key") + F.col("at")) % F.col("size")))
    mark = F.when(F.col("at") % 3 == 0, ",").otherwise("")
    said = said.join(hint, "h", "left").withColumn("w", F.coalesce(F.concat("term", mark), F.col("own")))
    said = said.withColumn("p", (F.col("key") + F.col("seg") * 3 + F.col("at") * 7) % 10 / 10.0)
    return asr.echoes(said.select("key", "seg", F.col("at").cast("long").alias("at"), "p", "w"), hint)


def _timed_lines(spark, sf_dir):
    """key, seg, text, words: lines of turns; a turn begins every minute, a line every five seconds, a word every 0.3, each
    a quarter of a second long."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = rows.select("key", (F.col("turn") * 10000 + F.col("line")).alias("seg"), (F.col("turn") * 60.0 + F.col("line") * 5.0).alias("from"), words.alias("x"))
    word = lambda w, i: F.struct(w.alias("w"), (F.col("from") + i * 0.3).alias("s"), (F.col("from") + i * 0.3 + 0.25).alias("e"), ((F.col("key") + i) % 10 / 10.0).alias("p"))
    return rows.where(F.size("x") > 0).select("key", "seg", F.array_join("x", " ").alias("text"), F.transform("x", word).alias("words"))


@query("j23_corrected_times")
def j23(spark, sf_dir):
    """Every line corrected: each seventh word is dropped, each fifth gets a letter, each eleventh a word before it."""
    lines = _timed_lines(spark, sf_dir)
    edit = lambda w, i: F.when(i % 7 == 6, "").when(i % 5 == 4, F.concat(w["w"], F.lit("s"))).when(i % 11 == 10, F.concat(F.lit("so "), w["w"])).otherwise(w["w"])
    fixed = F.array_join(F.filter(F.transform("words", edit), lambda x: x != ""), " ")
    rows = alignment.apply_corrections(lines, lines.select("key", "seg", fixed.alias("fixed")), ["key", "seg"])
    rows = rows.select("key", "seg", "corrected", F.posexplode("words").alias("place", "word"))
    return rows.select("key", "seg", "corrected", F.col("place").cast("long").alias("place"), "word.*")


#: A dictionary as people keep one: phrases, and words that fall apart.
_DICTIONARY = {"the": "The", "of the": "ofthe", "und": "u n d", "de la": "del", "que": "ke", "in die": "indie rein"}


@query("f6_dictionary_words")
def f6_words(spark, sf_dir):
    """Every line corrected by a dictionary, with its words' times."""
    book = spark.createDataFrame(list(_DICTIONARY.items()), "wrong string, right string")
    rows = alignment.correct_words(_timed_lines(spark, sf_dir), book)
    return rows.select("key", "seg", "fixes", F.md5("text").alias("text_md5"), F.posexplode("words").alias("place", "word")).select("key", "seg", "fixes", "text_md5", F.col("place").cast("long").alias("place"), "word.*")


#: The driver's texts are invented words: patterns of their letters stand for what is said.
_SAYS = offscript.Script(opening="^O", preroll="^[PV]", ready="^[IEÉ]", polite="zz$", reply="^(?:Th|Le|De|D)", closing=r"[aeio]s?\.$", cut="^Q", after_cut="zzz", thanks=r"on\.$", cta="^[LR]", cta_goes_on="^[A-D]", channel="a", request="que|the|di", told="xq", ask="zz", promo_goes_on=r"t\.$")


@query(
    "p20_off_script",
    r"""WITH l AS (SELECT conv_id AS key, turn, unnest(range(len(x))) AS i, unnest(x) AS text FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations WHERE text IS NOT NULL)),
    s0 AS (SELECT key, turn * 60.0::DOUBLE + i * 3.5::DOUBLE AS st, turn * 60.0::DOUBLE + i * 3.5::DOUBLE + 1 + length(text) % 3 AS en, text, regexp_replace(text, '[\s.,!?~…]+', '', 'g') AS bare FROM l),
    s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY st, en, text) AS n, regexp_matches(trim(regexp_replace(text, '[.,!?~…]+', '', 'g')), '^(?:Th|Le|De|D)') AS reply, regexp_matches(text, '^O') AS opens, regexp_matches(text, '[aeio]s?\.$') AS closing,
      regexp_matches(text, '^Q|zzz') AS strong, regexp_matches(text, 'on\.$') AS weak, regexp_matches(text, '^[LR]') AS cta, regexp_matches(text, 'a') AND regexp_matches(text, 'que|the|di') AND NOT (regexp_matches(text, 'xq') AND NOT regexp_matches(text, 'zz')) AS promo, regexp_matches(trim(text), '^[A-D]') AS on_cta, regexp_matches(text, 't\.$') AS on_promo,
      (regexp_matches(text, '^[PV]') AND (length(bare) <= 16 OR rtrim(text) LIKE '%?')) AS pre, regexp_matches(text, '^[IEÉ]') AS ready FROM s0 WHERE bare <> ''),
    h AS (SELECT *, pre OR (ready AND (NOT regexp_matches(text, 'zz$') OR coalesce(lead(reply) OVER (PARTITION BY key ORDER BY n), false))) AS hit FROM s),
    k AS (SELECT key, min(n) FILTER (st >= 90 OR opens OR NOT (hit OR reply)) AS k FROM h GROUP BY 1),
    g AS (SELECT h.key, any_value(k.k) AS k FROM h JOIN k ON k.key = h.key AND h.n < k.k GROUP BY 1 HAVING bool_or(h.hit)),
    b AS (SELECT s.*, coalesce(g.k, 1) AS begin_ FROM s LEFT JOIN g USING (key)),
    pre_ AS (SELECT b.key, 0.0 AS a, least(min(st) FILTER (n = begin_), max(en) FILTER (n = begin_ - 1) + 0.3) AS b, 'pre' AS kind, string_agg(text, ' ' ORDER BY n) FILTER (n < begin_) AS text FROM b JOIN g USING (key) GROUP BY 1),
    c0 AS (SELECT *, max(CASE WHEN n < begin_ OR NOT (closing OR cta OR promo OR on_promo OR reply OR strong OR weak) THEN n ELSE 0 END) OVER (PARTITION BY key) AS content FROM b),
    c1 AS (SELECT *, min(n) FILTER (strong OR weak) OVER (PARTITION BY key) AS p FROM c0 WHERE n > content),
    c2 AS (SELECT *, max(n) FILTER (closing AND NOT strong AND (p IS NULL OR n <= p)) OVER (PARTITION BY key) AS c FROM c1),
    c3 AS (SELECT *, min(n) FILTER (n > c AND NOT ((cta OR on_cta) AND NOT strong AND NOT weak)) OVER (PARTITION BY key) AS since FROM c2),
    post_ AS (SELECT key, since, least(max(en) FILTER (n = since - 1) + 0.5, greatest(max(en) FILTER (n = since - 1), max(en) FILTER (n = since))) AS a, arg_max(en, n) + 1 AS b, 'post' AS kind, string_agg(text, ' ' ORDER BY n) FILTER (n >= since) AS text FROM c3 WHERE since IS NOT NULL GROUP BY 1, 2
      HAVING coalesce(bool_or(strong) FILTER (n >= since), false) OR (bool_or(weak) FILTER (n >= since) AND NOT bool_or(closing AND NOT strong AND NOT weak) FILTER (n >= since)) OR (bool_and(reply) FILTER (n >= since) AND sum(en - st) FILTER (n >= since) <= 6)),
    r AS (SELECT b.*, CASE WHEN n >= begin_ AND (p.since IS NULL OR n < p.since) THEN CASE WHEN cta THEN 'cta' WHEN promo THEN 'promo' END END AS own, n >= begin_ AND (p.since IS NULL OR n < p.since) AS inside FROM b LEFT JOIN post_ p ON p.key = b.key),
    w AS (SELECT *, lag(own) OVER v AS k0, lag(en) OVER v AS e0, lead(own) OVER v AS k1, lead(st) OVER v AS s1 FROM r WINDOW v AS (PARTITION BY key ORDER BY n)),
    x AS (SELECT *, coalesce(own, CASE WHEN st - e0 <= 3 AND ((k0 = 'cta' AND on_cta) OR (k0 = 'promo' AND on_promo)) THEN k0 END, CASE WHEN s1 - en <= 3 AND k1 = 'promo' AND on_promo THEN k1 END) AS kind FROM w WHERE inside),
    y AS (SELECT key, n, kind, text, greatest(0, st - CASE WHEN e0 IS NULL THEN 0.3 ELSE least(0.3, greatest(0, (st - e0) / 2)) END) AS a, en + CASE WHEN s1 IS NULL THEN 0.3 ELSE least(0.3, greatest(0, (s1 - en) / 2)) END AS b FROM x WHERE kind IS NOT NULL),
    z AS (SELECT *, CASE WHEN lag(kind) OVER v = kind AND a <= lag(b) OVER v + 0.05 + 1e-9 THEN 0 ELSE 1 END AS new FROM y WINDOW v AS (PARTITION BY key ORDER BY n)),
    m AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY n) AS piece FROM z),
    every AS (SELECT key, a, b, kind, text FROM pre_ UNION ALL SELECT key, a, b, kind, text FROM post_ UNION ALL SELECT key, min(a), max(b), any_value(kind), string_agg(text, ' ' ORDER BY n) FROM m GROUP BY key, piece)
    SELECT key, round(a, 2) AS a, round(b, 2) AS b, kind, md5(text) AS text_md5 FROM every""",
)
def p20(spark, sf_dir):
    """Lines of turns as sentences: a turn begins every minute, a line every 3.5 seconds."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    start = F.col("turn") * 60.0 + F.col("i") * 3.5
    rows = rows.select("key", start.alias("start"), (start + 1 + F.length("text") % 3).alias("end"), "text")
    return offscript.off_script(rows, _SAYS).select("key", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "kind", F.md5("text").alias("text_md5"))


@query("j22_words_on_sound")
def j22(spark, sf_dir):
    """The spoken words on made sound: every two seconds 1.4 seconds of it."""
    sound = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.explode(F.sequence(F.col("turn") * 60000, F.col("turn") * 60000 + 58000, F.lit(2000).cast("long"))).alias("a"))
    rows = sounds.align_to_sound(spoken(spark, sf_dir).drop("p"), sound.select("key", (F.col("a") + 300).alias("a"), (F.col("a") + 1700).alias("b")))
    return rows.select("key", F.col("at").alias("place"), "s", "e", "moved")
