"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max WAND.

Every passage of every training text is a query against the items.  Impacts are BM25 weights divided by the item's
own total, so a score is the share of the item (rare words weigh most) that the passage holds, and all pairs at or
above one threshold are retrieved.  A passage can only reach it if it has a word of the item's essential ones (its
heaviest words, without which the rest stays below); passages without any such word of any item are passed over at
once.  For all other passages of a batch together, the block maxima of their words are added up per block of items;
WAND runs in the blocks whose sum reaches the threshold, the others cannot hold a hit.  Hits are verified: shingles of five words of the item's question and of its answer must recur near the passage.

The index goes to every task, so the benchmark is taken in parts of at most ``PART_BYTES``, one pass over the texts each;
weights of words are those of the whole benchmark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_signed, bounded_batches, ragged_arange, released, stage_table, text_slices
from .textkit import Words, shingles

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8  # of all shingles of the item
PART_OVERLAP = 0.5  # of those of its question, and of its answer
SHINGLE = 5
BLOCK_ITEMS = 8
LEAST_STRIDE = 32
PART_BYTES = 16 << 20


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): up to the first question mark or line break, and the rest; without these, all but the last
    sentence and the last sentence; a single sentence is both."""
    for cut in (r"\?\s*", r"\n+"):
        m = re.search(cut, text)
        if m and re.search(r"\w", text[: m.start()]) and re.search(r"\w", text[m.end() :]):
            return text[: m.end()], text[m.end() :]
    m = re.match(r"(.*[.!;:])\s+(.*\w.*)$", text, re.S)
    return (m[1], m[2]) if m and re.search(r"\w", m[1]) else (text, text)


def _grams(text: str) -> tuple[np.ndarray, int]:
    """Distinct shingles of a text, and the words of each."""
    words = Words([text])
    k = max(1, min(SHINGLE, len(words.hash)))
    return np.unique(shingles(words.hash, words.doc, words.per_doc, k)[0]), k


class ItemIndex:
    """Inverted index of test items: per term, items in order with impacts, the greatest impact and that of each block.

    ``whole``: of the benchmark that the items are a part of, the number of items with words, their mean length, and its
    terms (sorted) with the items that hold each; by default the items are the benchmark."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, whole: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.threshold = threshold
        words = Words([t for _, t in items])
        keep = np.flatnonzero(words.per_doc)
        self.ids = [items[i][0] for i in keep]
        self.length = words.per_doc[keep]
        self.stride = max(LEAST_STRIDE, int(self.length.max(initial=1)))
        renumber = np.full(len(items), -1)
        renumber[keep] = np.arange(len(keep))
        order = np.lexsort((renumber[words.doc], words.hash))
        h, d = words.hash[order], renumber[words.doc][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        h, d = h[at], d[at]
        self.terms, first, df = np.unique(h, return_index=True, return_counts=True)
        n = max(len(keep), 1)
        total, mean, held_by = n, self.length.mean() if len(d) else 1.0, df
        if whole and len(self.terms):
            total, mean, held_by = whole[0], whole[1], whole[3][np.searchsorted(whole[2], self.terms)]
        idf = np.log(1 + (total - held_by + 0.5) / (held_by + 0.5))
        size = self.length[d] / mean
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size))
        impact = impact / np.bincount(d, impact, n)[d] if len(d) else impact
        self.items, self.impact, self.first = d, impact, np.append(first, len(d))
        self.greatest = np.maximum.reduceat(impact, first) if len(d) else impact
        # Heaviest words of each item whose weights exceed what may be missing
        self.essential = np.zeros(len(self.terms), bool)
        by = np.lexsort((-impact, d))
        before = np.cumsum(impact[by]) - impact[by]
        before -= np.repeat(before[np.flatnonzero(np.append(True, np.diff(d[by])))], np.bincount(d, minlength=n)[np.bincount(d, minlength=n) > 0]) if len(d) else 0
        self.essential[np.repeat(np.arange(len(df)), df)[by][before <= 1 - threshold + 1e-9]] = True
        self.lists = [self._list(t) for t in range(len(self.terms))]
        block = d // BLOCK_ITEMS
        term = np.repeat(np.arange(len(df)), df)
        fresh = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (term[1:] != term[:-1]))) if len(d) else np.zeros(0, np.int64)
        self.block, self.block_most = block[fresh], np.maximum.reduceat(impact, fresh) if len(d) else impact
        self.block_first = np.searchsorted(term[fresh], np.arange(len(df) + 1))
        self.n_blocks = len(keep) // BLOCK_ITEMS + 1
        parts = [split_item(items[i][1]) for i in keep]
        self.whole = [_grams(items[i][1]) for i in keep]
        self.question, self.answer = [_grams(q) for q, _ in parts], [_grams(a) for _, a in parts]
        self._seen = np.zeros(1 << 16, bool)
        self._seen[(self.terms & U64(0xFFFF)).astype(np.int64)] = True

    def _list(self, t: int) -> tuple[list[int], list[float], float, dict[int, float]]:
        a, b = self.first[t], self.first[t + 1]
        items, impact = self.items[a:b].tolist(), self.impact[a:b].tolist()
        blocks: dict[int, float] = {}
        for i, w in zip(items, impact):
            blocks[i // BLOCK_ITEMS] = max(blocks.get(i // BLOCK_ITEMS, 0.0), w)
        return items, impact, float(self.greatest[t]), blocks

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, or -1."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self._seen[(hashes & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), max(len(self.terms) - 1, 0))
        hit = self.terms[at] == hashes[maybe] if len(self.terms) else np.zeros(0, bool)
        out[maybe[hit]] = at[hit]
        return out

    def reachable(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima add up to the threshold.  ``passage``: ascending, 0..n-1, with
        distinct terms each; passages are taken in runs, so that a run's sums stay small."""
        step = int(np.clip((1 << 17) // self.n_blocks, 1, 4096))
        cuts = np.searchsorted(passage, np.arange(0, n + step, step))
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            first = self.block_first[term[a:b]]
            count = self.block_first[term[a:b] + 1] - first
            at = np.repeat(first, count) + ragged_arange(count)
            cell = np.repeat(passage[a:b] - k * step, count) * self.n_blocks + self.block[at]
            hit = np.flatnonzero(np.bincount(cell, self.block_most[at], step * self.n_blocks) >= self.threshold - 1e-6)
            out.append(np.stack([hit // self.n_blocks + k * step, hit % self.n_blocks]))
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def retrieve(self, terms: list[int], lo: int = 0, hi: int = 1 << 62) -> list[tuple[int, float]]:
        """All items of lo..hi-1 whose score for these distinct terms is at least the threshold: block-max WAND."""
        need = self.threshold - 1e-9
        cursors = [[bisect_left(self.lists[t][0], lo), *self.lists[t]] for t in terms]  # position, items, impacts, greatest, blocks
        cursors = [c for c in cursors if c[0] < len(c[1])]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            if item >= hi:
                break
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(c[4].get(block, 0.0) for c in cursors[: pivot + 1]) < need:
                # no item of this block can do it with these lists: on to the next block, or to the next list's item
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][1][cursors[pivot + 1][0]])
                move = cursors[: pivot + 1]
            elif cursors[0][1][cursors[0][0]] == item:
                score = sum(c[2][c[0]] for c in cursors[: pivot + 1])
                if score >= need:
                    found.append((item, score))
                to, move = item + 1, cursors[: pivot + 1]
            else:
                to, move = item, cursors[:pivot]
            for c in move:
                c[0] = bisect_left(c[1], to, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def verify(self, item: int, near: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles among the words ``near``."""
        out = []
        for grams, k in (self.whole[item], self.question[item], self.answer[item]):
            there = shingles(near, np.zeros(len(near), np.int64), np.array([len(near)]), k)[0]
            out.append(float(np.isin(grams, there).mean()))
        return out[0], out[1], out[2]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of each contaminated pair, best passage each."""
        words = Words(texts)
        term = self.lookup(words.hash)
        known = term >= 0
        essential = np.zeros(len(term), bool)
        essential[known] = self.essential[term[known]]
        at = np.flatnonzero(essential)
        begin = np.cumsum(words.per_doc) - words.per_doc
        # passage p of a text: words p*stride .. (p+2)*stride; an item fits into one of them whole
        p = (at - begin[words.doc[at]]) // self.stride
        passages = np.unique(np.concatenate([words.doc[at] << 32 | p, (words.doc[at] << 32 | np.maximum(p - 1, 0))]))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        doc, p = passages >> 32, passages & 0xFFFFFFFF
        lo = begin[doc] + p * self.stride
        size = np.minimum(lo + 2 * self.stride, (begin + words.per_doc)[doc]) - lo
        own = np.repeat(np.arange(len(doc)), size)
        there = term[np.repeat(lo, size) + ragged_arange(size)]
        pair = np.unique((own * len(self.terms) + there)[there >= 0])
        own, there = pair // max(len(self.terms), 1), pair % max(len(self.terms), 1)
        cuts = np.searchsorted(own, np.arange(len(doc) + 1))
        for k, block in zip(*(x.tolist() for x in self.reachable(own, there, len(doc)))):
            text, lo_k, hi_k = int(doc[k]), int(lo[k]), int(lo[k] + size[k])
            a, stop = int(begin[text]), int(begin[text] + words.per_doc[text])
            for item, score in self.retrieve(there[cuts[k] : cuts[k + 1]].tolist(), block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS):
                reach = int(self.length[item])
                whole, question, answer = self.verify(item, words.hash[max(a, lo_k - reach) : min(stop, hi_k + reach)])
                if whole >= OVERLAP and min(question, answer) >= PART_OVERLAP and score > best.get((text, item), (0.0,))[0]:
                    best[text, item] = (score, question, answer)
        return [(doc, item, *v) for (doc, item), v in sorted(best.items())]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> their distinct terms; the first row of an item with words also has its length."""
    for piece in text_slices(batches):
        words = Words(piece.column("text").to_pylist())
        for i in np.flatnonzero(words.per_doc).tolist():
            begin = int(words.per_doc[:i].sum())
            terms = np.unique(words.hash[begin : begin + words.per_doc[i]])
            size = np.append(int(words.per_doc[i]), np.zeros(len(terms) - 1, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), piece.column("row")[i].as_py())), pa.array(as_signed(terms)), pa.array(size)], names=["row", "term", "size"])


def index_parts(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", without_id: bool = False) -> Iterator[ItemIndex]:
    """Indexes over the items in parts of bounded size (an item alone may be more).  Null texts, and texts without a
    word, cannot be found and are left out, and so are items without an id unless asked for; rows that share an id are
    items of their own.  Weights of words come from the whole benchmark, so results do not depend on its parts: items
    counted per word, number of items and mean length are Spark aggregates, and a part brings its own words' counts."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("text is not null" if without_id else "i is not null and text is not null")
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    terms = stage_table(rows.select("row", "text").mapInArrow(released(_item_terms), "row long, term long, size long"), "terms")
    sums = terms.agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("items")).first()
    counted = terms.join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    part, counts, held = [], {}, 0

    def index() -> ItemIndex:
        known = np.array(sorted((t & 0xFFFFFFFFFFFFFFFF, n) for t, n in counts.items()), dtype=object).reshape(-1, 2)
        return ItemIndex(part, whole=(sums["items"], sums["words"] / max(sums["items"], 1), known[:, 0].astype(np.uint64), known[:, 1].astype(np.int64)))

    for r in rows.join(counted, "row").orderBy(F.col("i").asc_nulls_last(), "text", "row").toLocalIterator():
        part.append((r.i, r.text))
        counts.update({t.term: t.n for t in r.terms})
        held += len(r.text)
        if held >= PART_BYTES:
            yield index()
            part, counts, held = [], {}, 0
    if part:
        yield index()


_HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated (document, item): ids, BM25 share, overlaps of question and answer.

    Null and empty texts hold nothing; repeated rows give repeated pairs; whole texts are searched, without a shuffle.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], _HIT)
    for index in index_parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches):
                ids = piece.column("id").to_pylist()
                hits = [(ids[d], index.ids[i], s, q, a) for d, i, s, q, a in index.search(piece.column("text").to_pylist())]
                if hits:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(rows.mapInArrow(released(run), _HIT))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a test item, with an id or without (columns as they are; ``text`` is
    searched).  Null and empty texts hold none and stay; each of repeated rows goes or stays by its own text."""
    for index in index_parts(benchmark, without_id=True):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches):
                clean = np.ones(piece.num_rows, bool)
                clean[[h[0] for h in index.search(piece.column("text").to_pylist())]] = False
                yield piece.filter(pa.array(clean))

        docs = bounded_batches(docs).mapInArrow(released(run), docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated pairs of all documents and all test items."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
