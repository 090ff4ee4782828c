import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spindrift.llm import rules, runs
from spindrift.llm.queries import QUERIES
from spindrift.llm.whitening import fit_whitening, op11_whitening, whiten, whole_numbers

SF = "/root/testdata/sf0.01"


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# -- whitening


def naive(vectors):
    """Whole numbers, exact deviations, eigenvalues and whitened vectors of the rows, with plain Python and LAPACK."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centre = lambda rows: np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in rows])
    c = centre(fit)
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    return n, deviation, value, centre(x) @ vector, c.T @ c / n


def test_whitening_equals_naive(spark):
    got = op11_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    n, deviation, value, projected, cov = naive(rows["embedding"])
    assert len(got) == 16 * len(rows) and set(got["component"]) == set(range(1, 17)) and set(got["n"]) == {n}
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    want = projected[:, :16] / np.sqrt(value[:16])
    sign = np.sign((own * want).sum(axis=0))
    assert np.abs(own - want * sign).max() < 1e-7
    first = got[got["component"] == 1].set_index("vec_id").loc[rows["vec_id"]]
    assert first["deviation"].tolist() == deviation
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, value[:16] / np.trace(cov), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"][0] < 1e-8


def test_whitening_copies_odd_rows_and_clashes(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 5)).round(2).tolist()
    rows = [(i, v, "a") for i, v in enumerate(base)] + [(100 + i, base[0], "b") for i in range(50)]  # copies weigh once
    odd = [(200, None, ""), (201, [1.0, None, 0.0, 0.0, 0.0], ""), (202, [float("nan")] * 5, ""), (203, [float("inf")] * 5, ""), (204, [], ""), (205, [1.0, 2.0], "")]
    rows += odd + [(None, base[1], None), (7, base[2], None)]
    home = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, x string")
    got = op11_whitening(spark, home).toPandas()
    kept = [v for i, v, _ in rows if i is None or not 200 <= i <= 205]
    n, deviation, value, projected, cov = naive(kept)
    assert set(got["n"]) == {n} == {40} and len(got) == 5 * len(kept)
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation)
    assert np.allclose(got.groupby("component")["explained"].first(), value / value.sum()) and got["identity_error"].max() < 1e-9
    for k in range(5):
        assert np.allclose(np.sort(np.abs(got[got["component"] == k + 1]["whitened"])), np.sort(np.abs(projected[:, k] / np.sqrt(value[k]))))


def test_whitening_degenerate(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    assert op11_whitening(spark, written(spark, tmp_path / "none", "embeddings", [], schema)).count() == 0
    one = op11_whitening(spark, written(spark, tmp_path / "one", "embeddings", [(1, [1.0, 2.0])] * 3, schema)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)} and len(one) == 6
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]  # one direction only
    got = op11_whitening(spark, written(spark, tmp_path / "line", "embeddings", line, schema)).toPandas()
    assert got[got["component"] == 1]["whitened"].notna().all() and got[got["component"] > 1]["whitened"].isna().all()
    assert got["explained"].max() == pytest.approx(1) and got["identity_error"].max() < 1e-9
    # numbers whose squares go beyond a long: exact where they fit, null where they don't
    wide = [(0, [1e16, 0.0]), (1, [-1e16, 1.0]), (2, [0.0, 5.0])]
    numbers = whole_numbers(spark.createDataFrame(wide, schema))
    model = fit_whitening(numbers)
    n, deviation, *_ = naive([np.float32(v) for _, v in wide])
    assert {r.vec_id: r.deviation for r in whiten(numbers, model).collect()} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    assert model.sums == [sum(int(np.floor(64 * float(np.float32(v[k])))) + 1_000_000 for _, v in wide) for k in (0, 1)]


# -- rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    again = {w for w in windows if windows.count(w) > 1} if len(words) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = {i + j for i, w in enumerate(windows) if w in again for j in range(3)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


ODD = [None, "", " \n\t\x0b", "a", "a a a a", "a a a", "\x1c\x85 x y", "é#\n é#\né#\n\n\n", "x y z x y z", "日本 語\r\n日本 語\r\n", "w " * 60000, "v\x00 b"]


def test_counts_equal_plain(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab #|\n\t ") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert rules.measure((t or "").encode())[0] == plain_counts(t), t
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    empty = rules.grow_forest(np.zeros((0, rules.N_SHARES)), np.zeros((0, rules.N_SHARES)))
    got = {r.doc_id: r for r in rules.judge(docs, empty).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = plain_counts(t)
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, chars, symbols, dup, repeat]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)


def test_forest_is_a_plain_walk():
    rng = np.random.default_rng(2)
    normal, odd = rng.normal(size=(600, 3)), rng.normal(6, 1, size=(60, 3))
    forest = rules.grow_forest(normal, odd, trees=30)
    x = np.vstack([normal[:20], odd[:20]])

    def path(tree, row):
        at = 0
        while forest.feature[tree, at] >= 0:
            at = 2 * at + 1 + bool(row[forest.feature[tree, at]] >= forest.cut[tree, at])
        return forest.path[tree, at]

    c = rules.expected_path(forest.size)
    want = [2 ** (-np.mean([path(t, row) for t in range(30)]) / c) for row in x]
    assert np.allclose(forest.scores(x), want)
    assert forest.scores(odd).min() > np.median(forest.scores(normal)) + 0.1
    same = rules.grow_forest(np.ones((50, 2)), np.zeros((0, 2)))  # ties: nothing to split
    assert np.allclose(same.scores(np.ones((3, 2))), 0.5, atol=0.02)
    assert rules.calibrate(np.arange(10.0), np.array([])) == float("inf")
    assert 9 < rules.calibrate(np.arange(10.0), np.array([5.0, 12.0]), 0.0) < 12


def test_rules_query_on_held_out_labels(spark):
    home = "/root/testdata/sf0.1"
    got = rules.op12_rules(spark, home).join(spark.read.parquet(f"{home}/labels.parquet"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").toPandas()
    good, bad = got[(got["quality"] == 1) & ~got["base_failed"]], got[got["quality"] == 0]
    assert len(bad) > 150 and bad["kept"].mean() <= 0.05
    assert len(good) > 1000 and good["kept"].mean() >= 0.99
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = rules.train(docs.limit(0), spark.read.parquet(f"{SF}/labels.parquet"))
    assert rules.judge(docs, forest).where("kept = base_failed").count() == 0  # no labels: only the base rules
    assert rules.judge(docs.limit(0), forest).count() == 0


# -- runs


def plain_runs(s, least=6, exponent=4):
    out = set()
    for p in range(1, len(s) // exponent + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i:
                a, b = i, j + p
                t = s[a:b]
                if b - a >= max(least, exponent * p) and not any(t[q:] == t[:-q] for q in range(1, p)):
                    out.add((a, b - a, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng, n):
    k, s = rng.choice([1, 2, 3, 6]), []
    while len(s) < n:
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 8))]
        s += (unit * rng.randint(1, 7))[: rng.randint(1, 45)] if rng.random() < 0.5 else unit
    return s


def test_runs_equal_plain():
    rng = random.Random(11)
    for _ in range(800):
        s = sequence(rng, rng.randrange(90))
        for least, exponent in ((6, 4), (4, 2), (9, 3)):
            want = plain_runs(s, least, exponent)
            assert runs.segment_runs(s, least, exponent) == want
            assert runs.word_runs(np.array(s, np.int64), least, exponent) == want  # the mask takes nothing away
    assert runs.least_overlap(6, 4) == 5 and runs.least_overlap(4, 2) == 2
    assert not runs.repeated_mask(np.arange(500), 5).any()
    assert runs.repeated_mask(np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 7]), 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False]


def digest(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for a, size, p in found for i in range(a + p, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{size},{p}\n" for a, size, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_contract(spark, tmp_path):
    rng = random.Random(12)
    texts = [*ODD[:10], *["".join(f"{w}{rng.choice([' ', chr(10), chr(9)])}" for w in sequence(rng, rng.randrange(300))) for _ in range(150)]]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    home = written(spark, tmp_path, "documents", rows, "doc_id long, text string, runs string")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in runs.op13_runs(spark, home).collect()}
    assert got == {i: digest(i, t) for i, t, _ in rows}
    assert sum(v[0] > 0 for v in got.values()) > 50


def test_runs_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in QUERIES["op13_runs"](spark, "/root/testdata/sf0.001").collect()}
    short = docs[docs["text"].str.len() < 6000]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[r.doc_id] == digest(r.doc_id, r.text) for r in short.itertuples())


def test_runs_odd_rows(spark):
    long = "a b c " * 40000
    docs = spark.createDataFrame([(None, "x " * 9, 1), (1, None, 2), (1, "", 3), (2, long, 4), (3, "a b " * 4 + "a c " * 4, 5)], "doc_id long, text string, n_words int")
    got = runs.collapse_runs(docs).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 9, 16, 120000]
    by = {r.n_words: r for r in got}
    assert by[9].collapsed == "x" and by[120000].collapsed == "a b c" and by[0].runs == [] and by[0].collapsed == ""
    assert [tuple(r) for r in by[16].runs] == [(0, 9, 2), (8, 8, 2)] and by[16].collapsed == "a b c"
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    assert runs.planted(None, [b"a"] * 9) == [b"a"] * 9


def test_forest_and_threshold_see_all_labelled_rows(spark):
    """More labelled rows than any sample of 8192: draws and threshold equal those of all of them."""
    rng = np.random.default_rng(3)
    shares = rng.random((20_000, rules.N_SHARES))
    y = (rng.random(20_000) < 0.9).astype(int)
    rows = spark.createDataFrame([(k, int(y[k]), bytearray(shares[k].tobytes())) for k in range(20_000)], "id long, y int, x binary").repartition(5)
    drawn = rows.mapInArrow(rules._draws(9, 2, 7), "tree int, y int, h long, x binary").toPandas()
    place = {shares[k].tobytes(): k for k in range(20_000)}
    salt = rules.mix64(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for t in range(7):
        h = rules.mix64(rules.mix64(np.arange(20_000, dtype=np.uint64) + np.uint64(1)) ^ salt[t])
        for kind, most in ((1, 9), (0, 2)):
            own = drawn[(drawn.tree == t) & (drawn.y == kind)].sort_values("h")[:most]
            at = np.flatnonzero(y == kind)
            assert [place[bytes(x)] for x in own.x] == at[np.argsort(h[at])][:most].tolist()
    score = np.round(rng.random(20_000), 4)
    scores = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, score double")
    assert rules.threshold(scores) == rules.calibrate(score[y == 1], score[y == 0])
    from spindrift.llm import toxicity

    labels = spark.range(15_000).selectExpr("id AS doc_id", "1 AS quality")
    assert toxicity.labels_by_id(labels, "quality").count() == labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").count() > 8192
