import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import near_dedup as nd
from spindrift.llm.components import UnionFind, connected_components
from spindrift.llm.embed_dedup import Block, integer_products, link_embeddings, quantise, tile_links


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, 601 + i) for i in range(300)] + [(3, 3)]
    uf = UnionFind()
    for a, b in pairs:
        if a != b:
            uf.union(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {x: uf.find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24), st.integers(0, 12))
def test_band_distance_equals_the_full_table(a, b, most):
    assert nd.band_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(_distance(a, b), most + 1)


def _words_of(text):
    words = nd.Words([text])
    return (words.hash >> np.uint64(32)).astype("<u4")


def _brute_class(texts, similarity=0.8):
    """All pairs, edit distance of their words by dynamic programming."""
    seqs = [_words_of(t).tolist() for t in texts]
    uf = UnionFind()
    for i, a in enumerate(seqs):
        for j in range(i):
            b = seqs[j]
            if texts[i] is not None and texts[i] == texts[j]:
                uf.union(i, j)
            elif a and b and uf.find(i) != uf.find(j) and 1 - _distance(a, b) / max(len(a), len(b)) >= similarity:
                uf.union(i, j)
    return [uf.find(i) for i in range(len(texts))]


def test_recall_on_edited_copies(spark):
    """One copy of each text, with 2 to 19 of 100 words replaced, taken out or put in: links, none of them through others."""
    rng = np.random.default_rng(12)
    texts, kinds = [], []
    for share in (0.02, 0.05, 0.10, 0.15, 0.18, 0.19):
        for _ in range(150):
            words = [f"v{i}" for i in rng.integers(0, 5000, int(rng.integers(80, 500)))]
            own = list(words)
            for at in sorted(rng.choice(len(words), max(1, int(share * len(words))), replace=False).tolist(), reverse=True):
                act = int(rng.integers(3))
                own[at : at + (act != 2)] = [] if act == 1 else [f"v{rng.integers(0, 5000)}"]
            kinds.append((len(texts), share))
            texts += [" ".join(words), " ".join(own)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for share in (0.02, 0.05, 0.10, 0.15, 0.18, 0.19):
        pairs = [a for a, s in kinds if s == share and 1 - _distance(_words_of(texts[a]).tolist(), _words_of(texts[a + 1]).tolist()) / max(len(texts[a].split()), len(texts[a + 1].split())) >= 0.8]
        assert len(pairs) > 140 and sum(got[a] == got[a + 1] for a in pairs) / len(pairs) >= 0.9, share
    assert all(got[i] // 2 == i // 2 for i in got)


def test_shared_and_missing_ids(spark):
    """Rows are texts of their own: exactly one row of each class stays, whatever the ids."""
    t, u = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, t), (5, t), (5, u), (5, u), (None, t), (None, None), (None, "x y z"), (None, "x y z")]
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "1", True), ("5", "1", False), ("5", "5", True), ("5", "5", False), ("None", "1", False), ("None", "None", True), ("None", "None", True), ("None", "None", False)])


def test_open_sketches_are_worked_through(spark, monkeypatch):
    """A chain whose ends differ, around a passage that all share: pairs beyond the pivot's are found, in many blocks."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 4)
    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(12):
        own = [f"w{k}_{i}" for i in range(40)]
        for _ in range(3):
            texts.append(" ".join(passage + own))
            own = list(own)
            own[int(rng.integers(0, 40))] = "other"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_class(texts)


def test_frequent_sketches_lose_no_link(spark, monkeypatch):
    """Copies whose only common shingles are the two of a passage that all texts have: a third shingle is never common."""
    monkeypatch.setattr(nd, "HOT_TEXTS", 8)
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 4)
    passage = [f"p{i}" for i in range(6)]
    texts = [" ".join([f"a{k}", f"b{k}x{m}", *passage, f"c{k}x{m}", f"d{k}"]) for k in range(60) for m in range(2)]
    texts += ["one", "two", "one!", "a b", "a b c"]
    _, first, finer = nd.sketches(*nd.labelled_shingles(texts))
    shared = [k for k in range(0, 120, 2) if set(first[k].tolist()) & set(first[k + 1].tolist())]
    assert len(shared) > 30 and not any(set(finer[k].tolist()) & set(finer[k + 1].tolist()) for k in shared)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    truth = _brute_class(texts)
    assert all(got[k] == got[k + 1] == truth[k + 1] for k in shared)
    assert all(truth[got[i]] == truth[i] for i in got)


def test_every_link_between_open_texts_is_found(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 5)
    rng = np.random.default_rng(8)
    seqs = []
    for _ in range(160):
        if seqs and rng.random() < 0.6:
            own = list(seqs[int(rng.integers(len(seqs)))])
            for _ in range(int(rng.integers(0, 1 + len(own) // 4))):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(0, 30, int(rng.integers(0, 2)))]
        else:
            own = rng.integers(0, 30, int(rng.choice([1, 2, 3, 4, 5, 9, 30]))).tolist()
        seqs.append(own or [7])
    words = spark.createDataFrame([(k, bytearray(np.array(w, "<u4").tobytes()), len(w)) for k, w in enumerate(seqs)], "rep long, words binary, n long")
    for s in (0.8, 0.6):
        truth = {(b, a) for a in range(160) for b in range(a) if 1 - _distance(seqs[a], seqs[b]) / max(len(seqs[a]), len(seqs[b])) >= s - 1e-12}
        got = nd._rest(words.select("rep", words.rep.alias("part")), words, s).collect()
        assert len(truth) > 50 and {(r.a, r.b) for r in got} == truth


def test_a_passage_in_the_prefixes_meets_its_texts_once(spark, monkeypatch):
    """Texts that are mostly one passage share many of its word pairs: they meet by one key of it, and every link is found."""
    monkeypatch.setattr(nd, "HOT_TEXTS", 8)
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 16)
    rows, stage = {}, nd.stage_table

    def counted(df, name):
        table = stage(df, name)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(nd, "stage_table", counted)
    rng = np.random.default_rng(4)
    passage = list(range(1000, 1070))
    seqs = [[*passage, *rng.integers(0, 900, int(rng.integers(20, 30))).tolist()] for _ in range(60)]
    seqs += [[*w[:60], *w[62:]] for w in seqs[:10]] + [rng.integers(0, 60, 12).tolist() for _ in range(30)]
    words = spark.createDataFrame([(k, bytearray(np.array(w, "<u4").tobytes()), len(w)) for k, w in enumerate(seqs)], "rep long, words binary, n long")
    truth = {(b, a) for a in range(100) for b in range(a) if 1 - _distance(seqs[a], seqs[b]) / max(len(seqs[a]), len(seqs[b])) >= 0.8 - 1e-12}
    got = nd._rest(words.select("rep", words.rep.alias("part")), words, 0.8).collect()
    assert len(truth) > 9 and {(r.a, r.b) for r in got} == truth
    assert rows["met"] > 1000 and rows["named"] <= 100


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[vocabulary[k] for k in rng.integers(0, 400, n)] for n in (60, 90, 40)]
    texts = ["", None, "", "one two", "one two", "One two!", " ".join(["again"] * 70), " ".join(["again"] * 64), " ".join(["again"] * 30), None]
    for words in base:
        for _ in range(9):
            own = list(words)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = vocabulary[int(rng.integers(0, 400))]
            texts.append(" ".join(own))
        texts.append(" ".join(words[len(words) // 2 :] + words[: len(words) // 2]))  # another order
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    got = {r.doc_id: r for r in nd.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == _brute_class(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_on_table(spark):
    """Every pair with 0.8 of its 5-word shingles in common (as sets of words in a row) is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        h, _ = nd.labelled_shingles([r.text])
        sets.append(set(h.tolist()))
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    common: dict = {}
    for own in where.values():
        if len(own) < 1000:
            for n, i in enumerate(own):
                for j in own[:n]:
                    common[j, i] = common.get((j, i), 0) + 1
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    near = [(j, i) for (j, i), c in common.items() if c / (len(sets[i]) + len(sets[j]) - c) >= 0.8]
    assert len(near) > 20
    assert all(got[rows[i].doc_id] == got[rows[j].doc_id] for j, i in near)
    # and a class holds nothing that no chain of similar texts leads to
    linked, members = UnionFind(), {}
    for i, r in enumerate(rows):
        members.setdefault(got[r.doc_id], []).append(i)
    for own in members.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                a, b = _words_of(rows[i].text), _words_of(rows[j].text)
                most = int(0.2 * max(len(a), len(b)) + 1e-9)
                if rows[i].text == rows[j].text or nd.band_distance(a, b, most) <= most:
                    linked.union(rows[i].doc_id, rows[j].doc_id)
    assert {d: linked.find(d) for d in got} == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=24), st.lists(st.integers(0, 9), max_size=24))
def test_similarity_is_that_of_the_edit_distance(a, b):
    x, y = (nd.Text(np.array(v, "<u4").tobytes()) for v in (a, b))
    assert nd.similar(x, y) == bool((a or b) and 1 - _distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12)


def _brute_links(vectors):
    unit = [None if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v, np.float32).astype(float) for v in vectors]
    n, uf = [0] * len(unit), UnionFind()
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                uf.union(i, j)
    return n, [uf.find(i) for i in range(len(unit))]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    from spindrift.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "LEAST_ROWS", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    vectors = [(base[i % 12] + rng.normal(size=16) * (0.1 + 0.05 * (i % 9))).astype(np.float32).tolist() for i in range(200)]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15, [1.0, 0.0], [2.0, 0.0], vectors[0]]
    df = spark.createDataFrame([(i, v, 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in link_embeddings(df).collect()}
    n, comp = _brute_links([v if v else None for v in vectors])
    assert [got[i].n_links for i in range(len(vectors))] == n
    assert [got[i].component_id for i in range(len(vectors))] == comp
    assert link_embeddings(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)).astype("<f4")
    b = Block(np.arange(300, dtype="<i8").tobytes(), x.tobytes())
    q, scale, error = quantise(b.unit)
    about = (q.astype(int) @ q.astype(int).T) * scale[:, None] * scale
    assert (np.abs(about - b.unit @ b.unit.T) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()
    count, _, _, again = tile_links(b, b, 0.3, True)
    truth = (b.unit @ b.unit.T >= 0.3).sum(axis=1) - 1
    assert (count + tile_links(b, b, 0.3, True)[1] == truth).all() and 0 < again < truth.sum()


def test_wide_vectors_keep_their_bounds():
    """Integer products beyond 2^24 are still exact, so no pair at the threshold is lost at width 4096."""
    rng = np.random.default_rng(9)
    q = np.full((3, 4096), 127, np.float32)
    q[1] = rng.integers(-127, 128, 4096)
    q[2] = rng.integers(100, 128, 4096)
    assert (integer_products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    base = rng.normal(size=4096)
    x = np.stack([base + rng.normal(size=4096) * s for s in np.linspace(0.2, 0.6, 60)])
    b = Block(np.arange(60, dtype="<i8").tobytes(), x.tobytes(), "<f8")
    count_a, count_b, _, again = tile_links(b, b, 0.9, True)
    assert (count_a + count_b == (b.unit @ b.unit.T >= 0.9).sum(axis=1) - 1).all() and again > 0


def test_double_vectors_are_not_rounded(spark):
    """Two vectors whose cosine passes the threshold in double precision only."""
    t = np.arccos(0.9 + 1e-12)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(t)), float(np.sin(t))]), (2, [9.0, 9.0]), (None, [1.0, 0.0]), (3, [1e-200, 0.0]), (4, [1e300, 0.0])]
    got = sorted((r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 4, 1, True), (2, 1, 1, False), (2, 5, 1, False), (3, 4, 1, False), (4, 4, 1, False), (99, 4, 1, False)]


def test_few_links_are_few_files(spark):
    """However many partitions a shuffle has, a round of components writes as many files as its links need."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = connected_components(spark.createDataFrame([(i, i + 1000) for i in range(300)] + [(i, i + 1) for i in range(0, 200, 2)], "a long, b long"))
        assert len(got.inputFiles()) <= 2
        parts = {r.node: r.component for r in got.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert parts == {i + far: i - (i % 2 if i < 200 else 0) for i in range(300) for far in (0, 1000)}
