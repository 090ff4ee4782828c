"""The fuzzy join against all pairs."""

import random
import re

from pyspark.sql import functions as F

from spindrift.operators import fuzzy
from spindrift.plans.catalogue import QUERIES

WORD = re.compile("[0-9A-Za-z가-힣À-ÖØ-öø-ÿ]+")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def linked(a, b):
    """How two lists of words are linked, by the definition."""
    if a == b or min(len("".join(a)), len("".join(b))) < 6:
        return None
    if 2 * len(set(a) & set(b)) < len(set(a) | set(b)):
        return None
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    if inside(b, a):
        return "contains"
    if inside(a, b):
        return "within"
    x, y = "".join(a), "".join(b)
    return "alike" if 2 * lcs(x, y) >= 0.8 * (len(x) + len(y)) else None


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["pass", "shot", "the", "of", "turn", "ball", "wall", "keeper", "drill", "step", "left", "right"] + [f"skill{i}" for i in range(25)]
    titles = []
    for _ in range(260):
        words = [rng.choice(vocabulary[:6] if rng.random() < 0.4 else vocabulary) for _ in range(rng.randrange(1, 8))]
        titles.append(" ".join(words))
        if rng.random() < 0.6:  # a variant: a word more, a word less, a letter changed, a copy with other marks
            k = rng.randrange(len(words))
            titles.append(rng.choice([" ".join(words + ["pass"]), " ".join(words[:k] + words[k + 1 :]), " ".join(words)[:-1] + "x", "! ".join(words).upper()]))
    titles += [None, "", "...", "ab", "the of"]
    rows = list(enumerate(titles))
    frame = spark.createDataFrame(rows + [(None, "the shot")], "id long, title string").repartition(4)
    asked = frame.where("id % 3 = 0")
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    group = lambda ids: {" ".join(words[i]): [j for j in ids if words[j] == words[i]] for i in sorted(ids, reverse=True)}
    left, right = group([i for i, _ in rows if i % 3 == 0]), group([i for i, _ in rows])
    want = {}
    for x, a in left.items():
        for y, b in right.items():
            how = linked(x.split(), y.split())
            if how:
                want[min(a), min(b)] = (len(a), len(b), how)
    got = {(r.a, r.b): (r.n_a, r.n_b, r.how) for r in fuzzy.fuzzy_join(asked, frame).collect()}
    assert got == want
    assert {v[2] for v in want.values()} == {"contains", "within", "alike"} and len(want) > 100
    assert fuzzy.fuzzy_join(asked.limit(0), frame).count() == 0 and fuzzy.fuzzy_join(asked, frame.limit(0)).count() == 0


def test_no_key_meets_all_titles(spark):
    """A word in every title is a key for none that have a rarer one."""
    rows = spark.createDataFrame([(i, f"the word{i % 200} item{i}") for i in range(400)], "id long, title string")
    a = fuzzy.ranked_words(fuzzy.classes(rows, "id", "title"), rows.select(F.explode(fuzzy.title_words("title")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    assert fuzzy.prefixes(a, 0.5).where("word = 'the'").count() == 0


def test_query_equals_all_pairs(spark):
    home = "/root/testdata/sf0.001"
    docs = [(r.doc_id, WORD.findall(re.match(r"[^.!?\n]*", r.text or "").group().lower())) for r in spark.read.parquet(f"{home}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["j18_fuzzy_titles"](spark, home).collect()}
    assert set(got) == {i for i, _ in docs if i % 20 == 0}
    for i, own in docs:
        if i % 20 == 0:
            links = [j for j, other in docs if linked(own, other)]
            enough = len("".join(own)) >= 6
            first = min(min(k for k, w in docs if w == dict(docs)[j]) for j in links) if links else None
            assert (got[i].n_links, got[i].first_link) == (len(links), first)
            assert got[i].class_id == (min(j for j, other in docs if other == own) if enough else i)
