import numpy as np
import pytest

import corpus_pipeline
from spindrift.llm import decontaminate as dc
from spindrift.llm import suffix_dedup
from spindrift.llm.textkit import Words

SF = "/root/testdata/sf0.01"


def test_wand_equals_scoring_everything():
    rng = np.random.default_rng(8)
    vocabulary = [f"t{i}" for i in range(120)]
    pick = lambda n: " ".join(vocabulary[int(k)] for k in np.minimum(rng.zipf(1.3, n) - 1, 119))
    index = dc.ItemIndex([(i, pick(int(rng.integers(3, 25)))) for i in range(300)], threshold=0.45)
    hits = 0
    for _ in range(150):
        own = np.unique(index.lookup(Words([pick(40)]).hash))
        own = own[own >= 0].tolist()
        score = np.zeros(len(index.ids))
        for t in own:
            a, b = index.first[t], index.first[t + 1]
            score[index.items[a:b]] += index.impact[a:b]
        want = {int(i): score[i] for i in np.flatnonzero(score >= index.threshold - 1e-9)}
        got = dict(index.retrieve(own))
        assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in got)
        hits += len(want)
        # a passage that reaches the threshold has an essential word
        assert not want or index.essential[own].any()
    assert hits > 100


def test_split_item():
    assert dc.split_item("What is it? A cat.") == ("What is it? ", "A cat.")
    assert dc.split_item("One line\ntwo") == ("One line\n", "two")
    assert dc.split_item("First one. Last one.") == ("First one.", "Last one.")
    assert dc.split_item("only") == ("only", "only")


def _holds(text, item):
    """Brute force: the item's words in a row."""
    a, b = Words([text]).hash.tolist(), Words([item]).hash.tolist()
    return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1) if a[i] == b[0])


def test_contamination_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text[:12].lower() in d.text.lower() and _holds(d.text, i.text)}
    got = {(r.doc_id, r.item_id): r for r in dc.find_contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert want and want == set(got)
    assert all(r.score >= 0.6 and r.question_overlap >= 0.5 for r in got.values())


def test_parts_of_a_benchmark_do_not_matter(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.where("doc_id < 150")
    whole = sorted(map(tuple, dc.find_contamination(docs, items.limit(40)).collect()))
    monkeypatch.setattr(dc, "PART_BYTES", 4000)
    assert len(list(dc.index_parts(items.limit(40)))) > 1
    assert sorted(map(tuple, dc.find_contamination(docs, items.limit(40)).collect())) == whole


def test_contamination_of_odd_rows(spark, monkeypatch):
    item = "who wrote the long book about whales and when? it was written by herman melville in eighteen fifty one"
    edited = item.replace("fifty one", "fifty two")
    far = "z " * 30000
    texts = [None, "", item, far + item.upper() + far, edited, item.split("?")[0], "who wrote the book and when", item]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "..."), (None, item), (4, "ab cd")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_contamination(docs, bench).collect()} == {(2, 1), (3, 1), (4, 1), (7, 1)}
    monkeypatch.setattr(dc, "PART_BYTES", 1)
    nameless = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert {r.doc_id for r in dc.drop_contaminated(docs, nameless).collect()} == {0, 1, 5, 6}
    assert {r.doc_id for r in dc.drop_contaminated(docs, bench).collect()} == {0, 1, 5, 6}
    assert dc.find_contamination(docs, bench.limit(0)).count() == 0 and dc.drop_contaminated(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages(spark, stages):
    from test_near_dups import UnionFind, nd

    raw = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = [{r.doc_id: r for r in s.collect()} for s in stages[:4]]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:4])
    gone = raw.keys() - after[0].keys()
    assert gone and np.mean([labels[d] for d in gone if d in labels]) > 0.8
    # near duplicates: exactly the least of each class of the stage's input
    links = UnionFind()
    texts = {d: nd.Text((nd.Words([r.text]).hash >> np.uint64(32)).astype("<u4").tobytes()) for d, r in after[0].items()}
    for d, t in texts.items():
        for e, u in texts.items():
            if e < d and links.find(e) != links.find(d) and (after[0][e].text == after[0][d].text or nd.similar(u, t)):
                links.union(e, d)
    assert {links.find(d) for d in after[0]} == after[1].keys()
    # repeated strings
    want = suffix_dedup.brute_force({d: r.text.encode() for d, r in after[1].items()})
    assert after[2].keys() == after[1].keys()
    assert all(len(after[2][d].text.encode()) <= want[d][0] - want[d][1] and len(after[2][d].text.encode()) >= want[d][0] - want[d][1] - 6 * (want[d][2] + 1) for d in want)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, r in after[2].items() if any(i[:12].lower() in r.text.lower() and _holds(r.text, i) for i in items)}
    assert dirty and after[3].keys() <= after[2].keys() - dirty and len(after[2]) - len(after[3]) <= len(dirty) + 2
    assert {r.doc_id for r in stages[4].collect()} == after[3].keys()


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[4].drop("sequence_id", "offset").collect()))


def test_stages_on_odd_rows(spark):
    """Null, shared and repeated ids, null and empty texts: each row fares by its own text and keeps its own columns."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 7))
    t, u, v = (" ".join(word() for _ in range(60)) for _ in range(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, z string"
    rows = [(1, t, "a", "s1"), (5, t, "b", "s2"), (5, u, "c", "s3"), (None, v, "en", "s1"), (None, u[:200] + v[200:], "de", "s2"), (7, "", "d", "s4"), (7, "", "d", "s4"), (8, None, None, None), (None, None, None, "s9")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 3, "x") for r in rows], schema)
    near = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    kept = lambda df: sorted((str(r.doc_id), str(r.lang), str(r.source)) for r in df.collect())
    rest = sorted([("1", "a", "s1"), ("5", "c", "s3"), ("None", "en", "s1"), ("None", "de", "s2"), ("7", "d", "s4"), ("8", "None", "None"), ("None", "None", "s9")])
    assert near.columns == corpus_pipeline.COLUMNS and kept(near) == rest
    cut = corpus_pipeline.suffix_dedup_stage(spark, docs, SF)
    got = sorted((str(r.doc_id), str(r.lang), str(r.source), r.text) for r in cut.collect())
    assert [r[:3] for r in got] == sorted((str(a), str(c), str(d)) for a, _, c, d in rows)
    assert ("1", "a", "s1", t) in got and ("5", "b", "s2", "") in got and ("5", "c", "s3", u) in got and ("None", "None", "s9", "") in got
    assert cut.columns == corpus_pipeline.COLUMNS and all(r.n_chars == len(r.text) for r in cut.collect())
    for stage in (corpus_pipeline.toxicity_stage, corpus_pipeline.decontamination_stage):
        assert stage(spark, docs, SF).count() == len(rows) and stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
    pieces = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert len(pieces) >= len(rows) and sum(p.length for p in pieces if p.doc_id == 7) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
