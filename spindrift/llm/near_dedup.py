"""Near-duplicate texts by order MinHash, verified by banded alignment.

A text's 5-word shingles are labelled with their occurrence number, so repeats differ.  Each of 64 sketches picks the
2 labelled shingles of least hash and keeps them in text order; texts that share a sketch are candidates.  Two edited
copies share one even if some passages differ, while texts with the same words in another order rarely do.  Of copies
with a share e of their words replaced, (1-e)^5 of the shingles stay, and sketches of two still find 0.9 of those at
e = 0.2.  A sketch that more than ``HOT_TEXTS`` texts have (of a passage that they share) is compared by the same with a
third shingle first; what these leave unconnected among its texts is then joined exactly (``_rest``).

A candidate pair is verified on its words: edit distance within a band, similarity = 1 - distance / words of the longer
text, at least 0.8.  The band is as wide as that distance, so it loses no pair.  Exact copies are one text from the
start.  Each text is first aligned with one pivot: of the least texts of its sketches the one that most of them have;
most are linked by that.  Only sketches whose texts are not connected then are worked through pair by pair, in tiles of
bounded blocks, where pairs that are connected already, or that another sketch takes, are passed over.

Texts of frequent sketches that are not connected by then are joined by their rarest pairs of words: so many edits as a
link allows leave a known number of a text's word pairs in its partner, so two linked texts share one of the rarest, of
which each has that many too few to miss it (prefix filter).  The passage itself is frequent, and so in no prefix of a
text that is not nearly all passage.  This finds every link among these texts, whatever sketches they share.  How rare a
pair is comes from counts in cells of a fixed number, and the many pairs of one passage count as one key.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, as_signed, bounded_batches, drop_tables, mix64, ragged_arange, released, stage_table, text_slices
from .components import UnionFind, connected_components
from .textkit import Words, shingles

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 64
PICKED = 2
HOT_TEXTS = 256
BLOCK_TEXTS = 512
BLOCK_WORDS = 1 << 20
CELLS = 512
GRAM_CELLS = 1 << 20
NO_ID = (1 << 63) - 1
_ODD = np.random.default_rng(31).integers(1, 2**63, SKETCHES, dtype=np.uint64) * U64(2) + U64(1)


def labelled_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each occurrence-labelled shingle, texts' bounds): shingles in text order."""
    words = Words(texts)
    h, doc = shingles(words.hash, words.doc, words.per_doc, SHINGLE)
    key = mix64(h ^ (doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.flatnonzero(new)
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    again = np.flatnonzero(nth)
    h[again] = mix64(h[again] + nth[again].astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have shingles, their sketches: texts x SKETCHES, the same with one shingle more each)."""
    own = np.flatnonzero(np.diff(bounds))
    out, finer = np.zeros((len(own), SKETCHES), np.uint64), np.zeros((len(own), SKETCHES), np.uint64)
    if not len(own):
        return own, out, finer
    begin, size = bounds[own], np.diff(bounds)[own]
    row = np.repeat(np.arange(len(own)), size)
    for s in range(SKETCHES):
        v = ((h * _ODD[s]) >> U64(32)).astype(np.uint32) >> np.uint32(1)
        at = np.full((len(own), PICKED + 1), np.iinfo(np.int64).max)
        for pick in range(PICKED + 1):
            hit = np.flatnonzero(v == np.minimum.reduceat(v, begin)[row])
            texts, first = np.unique(row[hit], return_index=True)
            enough = size[texts] > pick
            at[texts[enough], pick] = hit[first[enough]]
            v[hit[first]] = 0xFFFFFFFF
        out[:, s], finer[:, s] = (_in_order(h, at[:, :n], U64(s + 1)) for n in (PICKED, PICKED + 1))
    return own, out, finer


def _in_order(h: np.ndarray, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One number for the shingles at these places (those that are) in text order."""
    at = np.sort(at, axis=1)
    sketch = np.full(len(at), seed)
    for pick in range(at.shape[1]):
        some = at[:, pick] < len(h)
        sketch[some] = mix64(sketch[some] * U64(0x9E3779B97F4A7C15) + h[at[some, pick]])
    return sketch


class Text:
    """Words of a text (32 bits of each one's hash)."""

    def __init__(self, words: bytes):
        self.words = np.frombuffer(words, "<u4")
        self.bag = Counter(self.words.tolist())


def band_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is greater: bit-parallel over a band of 2 * most + 1 diagonals,
    which moves down one row a column."""
    if len(a) < len(b):
        a, b = b, a
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b, n = a[lead:], b[lead:], n - lead
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    shift = len(a) - len(b)
    if shift > most:
        return most + 1
    if not len(b):
        return shift
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << (2 * most + 1)) - 1
    up, down = full & ~((1 << most) - 1), 0  # vertical steps of +1 and -1; rows above the first have none
    goal, distance = 1 << (most + shift), shift  # the diagonal that ends in the last cell
    for j, x in enumerate(b.tolist()):
        same = places.get(x, 0)
        same = (same >> (j - most) if j >= most else same << (most - j)) & full
        free = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (full & ~(free | up)), free & up
        if not free & goal:
            distance += 1
            if distance > most:
                return most + 1
        free >>= 1
        up, down = right_down | (full & ~(free | right_up)), free & right_up
    return distance


def similar(a: Text, b: Text, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of the words is at least ``similarity``."""
    longer = max(len(a.words), len(b.words))
    most = int((1 - similarity) * longer + 1e-9)
    if not longer or longer - min(len(a.words), len(b.words)) > most:
        return False
    small, large = (a.bag, b.bag) if len(a.bag) < len(b.bag) else (b.bag, a.bag)
    if longer - sum(min(n, large.get(w, 0)) for w, n in small.items()) > most:  # words that only one text has
        return False
    return band_distance(a.words, b.words, most) <= most


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches):
        texts = piece.column("text").to_pylist()
        own, *both = sketches(*labelled_shingles(texts))
        rows: list = [[] for _ in texts]
        for i, r in zip(own.tolist(), as_signed(np.hstack(both)).tolist()):
            rows[i] = r
        exact = [None if t is None else hashlib.md5(t.encode("utf-8", "replace"), usedforsecurity=False).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("id"), pa.array(exact, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["row", "id", "exact", "sketch"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches):
        words = Words(piece.column("text").to_pylist())
        raw = (words.hash >> U64(32)).astype("<u4").tobytes()
        ends = np.cumsum(words.per_doc)
        flat = pa.array([raw[4 * a : 4 * b] for a, b in zip((ends - words.per_doc).tolist(), ends.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column("row"), flat, pa.array(words.per_doc.astype(np.int64))], names=["rep", "words", "n"])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _star(similarity: float):
    """Rows by (pivot, salt), the pivot's own first: each text against its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, key = None, None
        for batch in batches:
            out = []
            for a, salt, rep, words in zip(*(batch.column(k).to_pylist() for k in ("pivot", "salt", "rep", "words"))):
                if rep == a:
                    pivot, key = Text(words), (a, salt)
                elif key == (a, salt) and similar(pivot, Text(words), similarity):
                    out.append((a, rep))
            yield _links(out)

    return run


def _tiles(similarity: float):
    """Rows by (key, i, j): all pairs of the tile that are not connected yet."""

    def tile(rows: list[dict]) -> list[tuple[int, int]]:
        key, cross = rows[0]["key"], rows[0]["i"] != rows[0]["j"]
        texts, keys = [Text(r["words"]) for r in rows], [set(r["keys"]) for r in rows]
        links, found = UnionFind(), []
        order = sorted(range(len(rows)), key=lambda k: rows[k]["rep"])
        for n, x in enumerate(order):
            for y in order[:n]:
                if cross and rows[x]["block"] == rows[y]["block"]:
                    continue
                a, b = rows[y]["part"], rows[x]["part"]
                if links.find(a) != links.find(b) and min(keys[x] & keys[y]) == key and similar(texts[y], texts[x], similarity):
                    links.union(a, b)
                    found.append((rows[y]["rep"], rows[x]["rep"]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if held and (r["key"], r["i"], r["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                    out += tile(held)
                    held = []
                held.append(r)
            yield _links(out)
        if held:
            yield _links(tile(held))

    return run


def least_common(n: int, q: int, similarity: float) -> int:
    """Least number of ``q``-word grams (a repeat counts again) that a text of ``n`` words shares with any similar text that is
    no shorter than it, or, of itself, with any shorter one."""
    longest = int(n / similarity + 1e-9)
    return max(1, min(size - q + 1 - q * int((1 - similarity) * size + 1e-9) for size in range(n, longest + 1)))


def labelled_grams(words: bytes, q: int) -> np.ndarray:
    """Hashes of a text's ``q``-word grams, sorted, each with its number among equal ones."""
    w = np.frombuffer(words, "<u4").astype(U64)
    g = np.sort(mix64(w[:-1] << U64(32) | w[1:]) if q == 2 and len(w) > 1 else mix64(w + U64(1)))
    new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    nth = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
    return np.where(nth > 0, mix64(g + nth.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), g)


def _gram_cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> U64(44)).astype(np.int64)


def _counted(q: int):
    """words -> cell, many: how many grams fall in each of ``GRAM_CELLS`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GRAM_CELLS, np.int64)
        for batch in batches:
            if batch.num_rows:
                grams = np.concatenate([labelled_grams(raw, q) for raw in batch.column("words").to_pylist()])
                counts += np.bincount(_gram_cell(grams), minlength=GRAM_CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "many"])

    return run


def _prefixes(similarity: float, q: int, counts):
    """rep, part, n, words -> key, rep, part, n: as many of a text's grams as it takes to meet its links, those of the least full
    cells first; any order of grams that is the same for all texts finds every link.  A gram alone in its cell is met nowhere."""
    known: dict[int, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = counts.value
        for batch in batches:
            keys, at = [], []
            for row, (raw, n) in enumerate(zip(batch.column("words").to_pylist(), batch.column("n").to_pylist())):
                if n not in known:
                    known[n] = least_common(n, q, similarity) if n >= q else 1
                g = labelled_grams(raw, q)
                full = many[_gram_cell(g)]
                first = np.lexsort((g, full))[: len(g) - known[n] + 1]
                first = first[full[first] > 1]
                keys.append(as_signed(g[first]))
                at.append(np.full(len(first), row))
            if keys:
                rows = batch.select(["rep", "part", "n"]).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *rows.columns], names=["key", "rep", "part", "n"])

    return run


def cells(words: np.ndarray, many: int = CELLS) -> np.ndarray:
    """How many of a text's words fall in each of ``many`` cells of hashes (255: that or more)."""
    return np.minimum(np.bincount((words >> np.uint32(8)) % np.uint32(many), minlength=many), 255).astype(np.uint8)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = pa.array([cells(np.frombuffer(w, "<u4")).tobytes() for w in batch.column("words").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("part"), batch.column("n"), flat], names=["rep", "part", "n", "cells"])


def _near(similarity: float):
    """Rows by (key, i, j): pairs of a tile in two parts whose lengths and cells allow a link (an edit takes one word from each at most)."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, rep, part, n, block = (rows.column(k).to_numpy() for k in ("key", "i", "j", "rep", "part", "n", "block"))
        at = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(len(rep), CELLS)
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        ahead = np.arange(len(rep)) - begin
        upto = np.cumsum(ahead)
        first = 0
        while first < len(rep):  # rows whose pairs with those before them in the tile are some hundred thousand
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 300_000, "right")))
            y = np.repeat(np.arange(first, last), ahead[first:last])
            x = ragged_arange(ahead[first:last]) + begin[y]
            most = ((1 - similarity) * np.maximum(n[x], n[y]) + 1e-9).astype(np.int64)
            fit = (part[x] != part[y]) & (np.abs(n[x] - n[y]) <= most) & ((i[y] == j[y]) | (block[x] != block[y]))
            x, y, most = x[fit], y[fit], most[fit]
            room = 2 * most - np.abs(n[x] - n[y])  # words that one text has too many, and the other: ``most`` each
            near = [x[:0]]
            for c in range(0, len(x), 4096):
                apart = np.abs(at[x[c : c + 4096]].astype(np.int16) - at[y[c : c + 4096]]).sum(axis=1)
                near.append(c + np.flatnonzero(apart <= room[c : c + 4096]))
            near = np.concatenate(near)
            both = np.sort(np.stack([rep[x[near]], rep[y[near]]], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key, i, j = (batch.column(k).to_numpy() for k in ("key", "i", "j"))
            ended = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            first = held[0].slice(0, 1).to_pylist()[0]
            if len(ended) or (first["key"], first["i"], first["j"]) != (key[0], i[0], j[0]):
                cut = int(ended[-1]) + 1 if len(ended) else 0  # the last tile may go on in the next batch
                yield from pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _verified(similarity: float):
    def close(x: bytes, y: bytes) -> bool:
        most = int((1 - similarity) * (max(len(x), len(y)) // 4) + 1e-9)
        a, b = (cells(np.frombuffer(w, "<u4"), 4 * CELLS).astype(np.int16) for w in (x, y))
        return int(np.abs(a - b).sum()) + abs(len(x) - len(y)) // 4 <= 2 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("a", "b", "x", "y")))
            yield _links([(a, b) for a, b, x, y in rows if close(x, y) and similar(Text(x), Text(y), similarity)])

    return run


def _rest(open_: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """All links between texts of different parts.  open_: rep, part.  words: rep, words, n.  -> staged a, b."""
    q = 2 if similarity >= 0.75 else 1
    own = stage_table(open_.join(words, "rep").select("rep", "part", "words", "n"), "open")
    filled = own.select("words").mapInArrow(released(_counted(q)), "cell long, many long").groupBy("cell").agg(F.sum("many").alias("many")).toArrow()
    counts = np.zeros(GRAM_CELLS, np.int64)
    counts[filled.column("cell").to_numpy()] = filled.column("many").to_numpy()
    counts = own.sparkSession.sparkContext.broadcast(counts)
    picked = stage_table(own.mapInArrow(released(_prefixes(similarity, q, counts)), "key long, rep long, part long, n long"), "prefixes")
    counts.unpersist()
    met = picked.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("texts")).where("x < y").select("key", "texts")
    met = stage_table(picked.join(met, "key").select("key", "rep", "texts"), "met")
    drop_tables(picked)
    # nearly the same texts have all word pairs of a passage: such keys get one name, the least of those beside them in a text,
    # so that two texts meet once and not once a key (texts that share a key share its name)
    hot = met.where(F.col("texts") > HOT_TEXTS)
    least = F.min("key").over(Window.partitionBy("rep"))
    named = stage_table(hot.withColumn("least", least).groupBy("key").agg(F.min("least").alias("name")), "names")
    hot = stage_table(hot.join(named, "key").select(F.col("name").alias("key"), "rep").distinct(), "named")
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).alias("blocks"))
    hot_ = hot.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    hot_ = hot_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    hot_ = hot_.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    zero = F.lit(0).cast("long")
    rows = met.where(F.col("texts") <= HOT_TEXTS).select("key", zero.alias("i"), zero.alias("j"), zero.alias("block"), "rep").unionByName(hot_)
    form = own.mapInArrow(released(_cells), "rep long, part long, n long, cells binary")
    pairs = rows.join(form, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(released(_near(similarity)), "a long, b long")
    pairs = stage_table(pairs.distinct(), "pairs")
    drop_tables(met, named, hot)
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("rep").alias("b"), F.col("words").alias("y")), "b")
    found = stage_table(both.select("a", "b", "x", "y").mapInArrow(released(_verified(similarity)), "a long, b long"), "rest")
    drop_tables(own, pairs)
    return found


def keyed_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` in the shared folder with a key per row: ``row, id, text`` and the columns named in ``carry``."""
    named = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in carry]]
    return stage_table(bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), *named), "rows")


def classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row, id, text`` (from a table, so that it reads the same each time) -> ``row, id, class_id, kept``."""
    signed = stage_table(rows.select("row", "id", "text").mapInArrow(released(_signatures), "row long, id long, exact binary, sketch array<long>"), "signatures")
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)), "row", "sketch")).alias("s")
    texts = stage_table(signed.where("exact is not null").groupBy("exact").agg(first).select("exact", F.col("s.row").alias("rep"), F.col("s.sketch").alias("sketch")), "texts")
    # the sketches are most of both tables: only what is needed to the end stays
    wide, signed, reps = signed, stage_table(signed.select("row", "id", "exact"), "rows"), stage_table(texts.select("exact", "rep"), "reps")
    drop_tables(wide)
    both = F.arrays_zip(F.slice("sketch", 1, SKETCHES).alias("key"), F.slice("sketch", SKETCHES + 1, SKETCHES).alias("finer"))
    bands = texts.select("rep", F.explode(both).alias("k")).select("rep", "k.key", "k.finer")

    def met(bands: DataFrame) -> DataFrame:
        pivots = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1")
        return bands.join(pivots, "key")

    held = stage_table(met(bands), "held")
    drop_tables(texts)
    # a sketch of very many texts (of a passage that they share) gives way to the one with a shingle more, for a start
    hot = stage_table(held.where(F.col("many") > HOT_TEXTS).select("rep", "key"), "hot")
    finer = met(held.where(F.col("many") > HOT_TEXTS).select("rep", F.col("finer").alias("key")).distinct())
    shared = stage_table(held.where(F.col("many") <= HOT_TEXTS).select("rep", "key", "pivot").unionByName(finer.select("rep", "key", "pivot")), "shared")
    drop_tables(held)
    words = rows.select("row", "text").join(shared.select("rep").union(hot.select("rep")).distinct(), F.col("row") == F.col("rep"), "left_semi").mapInArrow(released(_words), "rep long, words binary, n long")
    words = stage_table(words, "words")

    stars = shared.where("pivot < rep").groupBy("rep").agg(F.mode("pivot", True).alias("pivot"))
    salts = stage_table(stars.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).alias("salts")), "salts")
    members = stars.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "salts").alias("salt"), "rep")
    heads = salts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("rep"))
    beside = members.unionByName(heads).join(words, "rep").select("pivot", "salt", "rep", "words")
    beside = beside.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("rep") != F.col("pivot"))
    found = stage_table(beside.mapInArrow(released(_star(similarity)), "a long, b long"), "star")
    drop_tables(salts)

    parts = stage_table(connected_components(found), "parts")

    def unconnected(keyed: DataFrame) -> DataFrame:
        placed = keyed.select("rep", "key").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        open_ = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("texts")).where("x < y").select("key", "texts")
        return placed.join(open_, "key")

    # what more texts share than a sketch compares is all of frequent sketches: left to the join of the rest
    left = stage_table(unconnected(shared).where(F.col("texts") <= HOT_TEXTS), "left")
    drop_tables(shared)
    if not left.isEmpty():
        blocks = left.join(words.select("rep", "n"), "rep").groupBy("key").agg(F.greatest(F.ceil(F.max("texts") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_WORDS)).alias("blocks"))
        keys = left.groupBy("rep").agg(F.collect_list("key").alias("keys"))
        rows_ = left.join(blocks, "key").join(keys, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows_ = rows_.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "part", "keys").join(words.select("rep", "words"), "rep")
        more = rows_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(released(_tiles(similarity)), "a long, b long")
        found = found.unionByName(stage_table(more, "tiles"))
        parts = stage_table(connected_components(found), "parts")
    rest = stage_table(unconnected(hot).select("rep", "part").distinct(), "open")
    if not rest.isEmpty():
        parts = stage_table(connected_components(found.unionByName(_rest(rest, words, similarity))), "parts")
    drop_tables(words, left, hot, rest)
    copies = signed.join(reps, "exact", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    copies = copies.select("row", "id", F.coalesce("component", "rep", "row").alias("part"))
    least = copies.groupBy("part").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row")).alias("least"))
    out = copies.join(least, "part").select("row", copies.id, F.nullif("least.id", F.lit(NO_ID)).alias("class_id"), (F.col("row") == F.col("least.row")).alias("kept"))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, kept``; class_id is the least id of the class (null if none of
    it has an id), and one row of each class is kept: the one of least id (null last), of repeated rows any one.

    Texts with the same characters are one class whatever their length; apart from that, a text without a word and a
    null text are alone.  Texts of less than five words have one shingle, of all their words.  Classes are connected by
    pairs that share a sketch and have a ``similarity`` or more.  Rows that share an id are texts of their own.
    """
    return classes(keyed_texts(docs, id_col=id_col, text_col=text_col), similarity).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
