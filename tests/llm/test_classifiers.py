import zlib

import numpy as np

from spindrift.llm import langid, quality, toxicity
from spindrift.llm.textkit import RangeHash, Words, shingles

ODD = [None, "", "   \n", "123 !!", "a", "word " * 30000, "émile ça", "日本語"]


def test_words_and_ranges():
    w = Words(["Ab c-d", None, "é1 ab"])
    assert w.per_doc.tolist() == [3, 0, 2]
    assert w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == 4
    buf = np.frombuffer(b"abcabcab", np.uint8)
    h = RangeHash(buf)
    assert h.of(np.array([0]), np.array([3]))[0] == h.of(np.array([3]), np.array([6]))[0] == h.all_grams(3)[0]
    s, own = shingles(w.hash, w.doc, w.per_doc, 2)
    assert own.tolist() == [0, 0, 2]


def test_langid(spark):
    text = {"en": "the cat sat on the mat and the dog", "de": "der hund und die katze sind nicht schön", "fr": "le chat est sur la table où il dort"}
    rows = [(i, text[k] * (1 + i % 3), k) for i, k in enumerate(list(text) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, profile = langid.train(docs)
    assert langs == sorted(text)
    # brute force: the prototype is the sum of the vectors of the language's texts
    brute = langid.text_vectors([t for _, t, k in rows if k == "de"])[0].sum(axis=0)
    assert np.allclose(brute, profile[langs.index("de")])
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(odd, langs, profile).collect()}
    assert [got[i].lang_pred == "und" for i in range(len(ODD))] == [t is None or not any(c.isalpha() for c in t) for t in ODD]
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    same = langid.predict(docs, langs, profile)
    assert same.where("lang_pred <> lang").count() == 0
    assert langid.train(docs.limit(0))[0] == [] and langid.predict(docs.limit(0), [], profile[:0]).count() == 0


def test_toxicity_finds_pairs():
    """Neither word alone is toxic; both together are.  Additive weights cannot say that."""
    rng = np.random.default_rng(3)
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = " ".join(f"w{rng.integers(0, 300)}" for _ in range(12))
        texts.append(("insultx " if a else "") + noise + (" groupy" if b else ""))
        label.append(float(a and b))
    term, doc = toxicity.terms(texts)
    rows = [np.unique(term[doc == i]) for i in range(len(texts))]
    model = toxicity.fit(rows, np.array(label), rounds=800)
    said = model.score(["insultx", "groupy", "insultx w1 groupy", "w1 w2"])
    assert said[2] > 0.7 and max(said[0], said[1], said[3]) < 0.5
    # the fast form of the pairwise sum equals the double loop
    d, i = model.present(*toxicity.terms(["insultx w1 groupy"]))
    slow = model.bias + model.weight[i].sum() + sum(model.factor[x] @ model.factor[y] for k, x in enumerate(i) for y in i[k + 1 :])
    assert np.isclose(model.logits(d, i, 1)[0], slow)


def test_toxicity_and_quality_on_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, column, floor in ((toxicity.op10_toxicity, "toxic", 0.9), (quality.op8_quality, "quality", 0.93)):
        got = query(spark, sf).collect()
        assert len(got) == 1000
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        held = [r for r in got if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][column] for r in held]) >= floor
    odd = spark.createDataFrame([(i, t, i, 1.5) for i, t in enumerate(ODD)], "doc_id long, text string, y int, toxicity_score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, name in ((toxicity, "toxicity_score"), (quality, "quality_score")):
        model = module.train(odd, none)
        assert all(0 <= r[name] <= 1 for r in module.score_documents(odd, model).collect())
        assert module.score_documents(odd.limit(0), model).count() == 0


def test_toxic_and_bad_rows_on_the_held_out_fold(spark):
    """What is caught, and what clean rows are lost, at the thresholds of the contract."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = toxicity.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert toxic[toxic["toxic"] == 1]["predicted"].mean() >= 0.8 and toxic[toxic["toxic"] == 0]["predicted"].mean() <= 0.01
    good = quality.op8_quality(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert good[good["quality"] == 0]["predicted"].mean() <= 0.05 and good[good["quality"] == 1]["predicted"].mean() >= 0.97


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    rows = [(None, "one two three", "en"), (1, "le chat est la", "fr"), (2, "the cat is here", "en"), (3, "12 34", "xx"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (langid.op6_language_id, quality.op8_quality, toxicity.op10_toxicity):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 5 and all(r.held_out is False for r in got if r.doc_id is None) and all(r.held_out is not None for r in got)
    langs, _ = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert langs == ["en", "fr"]  # texts without a letter teach nothing


def test_risk_is_non_negative_and_its_gradient_right():
    """The two parts of the risk against loops, and the fit's direction against differences of the risk."""
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, 40), rng.normal(0, 1, 60)
    sig = lambda z: 1 / (1 + np.exp(-z))
    first, second = quality.risk(p, u, 0.3)
    assert np.isclose(first, 0.3 * sum(sig(-z) for z in p) / 40) and np.isclose(second, sum(sig(z) for z in u) / 60 - 0.3 * sum(sig(z) for z in p) / 40)
    x, y = rng.normal(size=(200, 3)) + [1, 0, 0], rng.normal(size=(400, 3))
    y[:120] += [1, 0, 0]
    model = quality.fit_nnpu(x, y, 0.3)
    flat = quality.fit_nnpu(x, y, 0.3, rounds=0)
    total = lambda m: (lambda a, b: a + max(0, b))(*quality.risk(m.logits(m.columns(x)), m.logits(m.columns(y)), 0.3))
    assert total(model) < total(flat)


def test_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        good = rng.normal(size=(1500, 4)) + [3, 0, 0, 0]
        web = rng.normal(size=(3000, 4))
        web[: int(3000 * share)] += [3, 0, 0, 0]
        assert abs(quality.estimate_prior(good, web) - share) < 0.08


def test_op6_on_table(spark):
    """Predictions of the query against prototypes and cosines taken text by text; accuracy on the fold held out."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    langs = sorted({r.lang for r in rows if r.lang and not out(r.doc_id)})
    learnt = [r for r in rows if r.text is not None and r.lang is not None and not out(r.doc_id)]
    proto = {k: langid.text_vectors([r.text for r in learnt if r.lang == k])[0].astype(float).sum(axis=0) for k in langs}
    got = {r.doc_id: r for r in langid.op6_language_id(spark, sf).collect()}
    assert len(got) == len(rows) and all(r.held_out == out(d) for d, r in got.items())
    for r in rows[:200]:
        v, lettered = langid.text_vectors([r.text])
        cosine = [v[0] @ proto[k] / np.linalg.norm(v[0]) / np.linalg.norm(proto[k]) if lettered[0] else 0 for k in langs]
        if not lettered[0]:
            assert got[r.doc_id].lang_pred == "und"
        else:
            assert np.isclose(got[r.doc_id].score, max(0, max(cosine)), atol=1e-4) and cosine[langs.index(got[r.doc_id].lang_pred)] >= max(cosine) - 1e-4
    held = [r for r in rows if out(r.doc_id) and r.lang and r.text]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_shared_ids_do_not_multiply_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) <= 2 and all(r.text == "text 0" for r in got if r.id == 1)
    assert quality.train(docs, labels) is not None
