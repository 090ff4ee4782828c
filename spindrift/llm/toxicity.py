"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and their first 4, 6 and 8 bytes (so that inflected forms share a term), hashed
to 32 bits.  score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the terms that are present; the pairwise part
learns combinations, such as an insult with a group's name, that no additive weights express.

The fit uses at most ``sample_rows`` labelled rows (those of least hash of their id), keeps the terms whose
association with the label is beyond chance among all terms tried (the ``max_terms`` strongest at most: the size of the
model, like the number of factors), and runs on the driver over these rows' term hashes alone; scoring is one pass over
all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, released, text_slices
from .textkit import Words

SAMPLE_ROWS = 8192
MAX_TERMS = 4096
FACTORS = 8
THRESHOLD = 0.7
PREFIXES = (4, 6, 8)


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit term, document) of all terms, repeats included."""
    words = Words(texts)
    found = [(words.hash, words.doc)] + [words.prefix(k) for k in PREFIXES]
    salted = [h ^ U64(i << 20) for i, (h, _) in enumerate(found)]
    return (np.concatenate(salted) >> U64(32)).astype(np.uint32), np.concatenate([d for _, d in found])


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted, uint32
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # terms x FACTORS

    def logits(self, doc: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """doc, index: each document's distinct terms, as positions in ``terms``."""
        out = self.bias + np.bincount(doc, self.weight[index], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[index, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, index = self.present(*terms(texts))
        return 1 / (1 + np.exp(-self.logits(doc, index, len(texts))))

    def present(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[self.terms & np.uint32(0xFFFF)] = True
        maybe = seen[term & np.uint32(0xFFFF)]
        term, doc = term[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        pair = np.unique(doc[hit].astype(np.int64) * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)


def _g2(a: np.ndarray, n: np.ndarray, pos: int, total: int) -> np.ndarray:
    """Likelihood ratio of (term present) x (label): a of a term's n documents are positive."""
    out = np.zeros(len(n))
    for got, row, col in ((a, n, pos), (n - a, n, total - pos), (pos - a, total - n, pos), (total - n - pos + a, total - n, total - pos)):
        expect = row * col / total
        out += np.where(got > 0, 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(expect, 1e-9)), 0)
    return out


def fit(rows: list[np.ndarray], label: np.ndarray, *, max_terms: int = MAX_TERMS, rounds: int = 400, l2: float = 2e-5, seed: int = 11) -> FactorizationMachine:
    """rows: each labelled document's distinct terms."""
    n, pos = len(rows), int(label.sum())
    prior = np.log((pos + 0.5) / (n - pos + 0.5))
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    ids, count = np.unique(flat, return_counts=True)
    inverse = np.searchsorted(ids, flat).astype(np.int32)
    del flat
    if not len(ids) or not pos or pos == n:
        return FactorizationMachine(np.zeros(0, np.uint32), float(np.clip(prior, -8, 8)), np.zeros(0), np.zeros((0, FACTORS)))
    g2 = _g2(np.bincount(inverse, label[doc], len(ids)), count, pos, n)
    beyond = np.flatnonzero(g2 > 2 * np.log(len(ids)) + 4)
    chosen = np.sort(beyond[np.argsort(-g2[beyond], kind="stable")[:max_terms]])
    model = FactorizationMachine(ids[chosen], float(prior), np.zeros(len(chosen)), np.random.default_rng(seed).normal(0, 0.02, (len(chosen), FACTORS)))
    position = np.full(len(ids), -1)
    position[chosen] = np.arange(len(chosen))
    at = position[inverse]
    doc, at = doc[at >= 0], at[at >= 0]
    state = [np.zeros(2), np.zeros((2, len(chosen))), np.zeros((2, len(chosen), FACTORS))]
    for step in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-model.logits(doc, at, n))) - label
        sums = np.stack([np.bincount(doc, model.factor[at, f], n) for f in range(FACTORS)], axis=1)
        e = error[doc]
        grad_w = np.bincount(at, e, len(chosen)) / n + l2 * model.weight
        grad_v = np.stack([np.bincount(at, e * (sums[doc, f] - model.factor[at, f]), len(chosen)) for f in range(FACTORS)], axis=1) / n + l2 * model.factor
        for i, (grad, rate) in enumerate(((error.mean(), 0.05), (grad_w, 0.05), (grad_v, 0.02))):  # Adam
            s = state[i]
            s[0] = 0.9 * s[0] + 0.1 * grad
            s[1] = 0.999 * s[1] + 0.001 * grad**2
            move = rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
            if i == 0:
                model.bias -= float(move)
            elif i == 1:
                model.weight = model.weight - move
            else:
                model.factor = model.factor - move
    return model


def held_out(column: str, folds: int = 3, fold: int = 1):
    """Whether crc32(id as text) mod ``folds`` is ``fold``; false for a row without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labels_by_id(labels: DataFrame, label: str) -> DataFrame:
    """All ids (id, y) with a 0/1 label outside the held-out fold; one with several labels has the greatest."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` rows (id, text, y) with a 0/1 label outside the held-out fold, least hash first.

    An id with several labels counts once, as the greatest; of rows that share an id, the one of least text counts, so
    the sample has at most one row per id.  The ids are bounded, so they are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    picked = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = rows.join(F.broadcast(picked), rows.id == picked.label_id).select("id", "text", "y")
    return own.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            term, doc = terms(piece.column("text").to_pylist())
            pair = np.unique(doc.astype(np.uint64) << U64(32) | term)
            cuts = np.searchsorted(pair >> U64(32), np.arange(piece.num_rows + 1, dtype=np.uint64))
            low = (pair & U64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["id", "y", "terms"])

    got = labelled_sample(docs, labels, label, sample_rows).mapInArrow(released(hashed), "id long, y int, terms binary").collect()
    got.sort(key=lambda r: (r.id, bytes(r.terms)))
    return fit([np.frombuffer(r.terms, "<u4") for r in got], np.array([r.y for r in got], float), max_terms=max_terms)


def score_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """All of ``docs``' columns and ``toxicity_score`` (0 to 1).  Null and empty texts get the score of no terms; repeated
    rows get the same score each, and a column of that name is replaced."""
    others = [c for c in docs.columns if c != "toxicity_score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema) + ", toxicity_score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            got = pa.array(model.score(piece.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*piece.columns, got], names=[*others, "toxicity_score"])

    return bounded_batches(docs).select(*others).mapInArrow(released(score), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("toxicity_score")
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
