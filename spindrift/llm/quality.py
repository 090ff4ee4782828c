"""Quality: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good; everything else is unlabelled web text, good and bad.  With class prior p,
    risk = p E_P[l(+g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])
is an unbiased estimate of the classification risk, kept from going below zero (where it would overfit): while the
second part is negative, the step goes up its gradient instead.  The prior is estimated from the positives and the
unlabelled rows alone: whatever region a score picks, it holds at least p times the positives' share of the unlabelled
rows, so p is at most the least such ratio, which a region of (nearly) only positives attains.
g is additive over the quantile bins of measures of a text's form: shares of kinds of bytes, of repeated words,
lines and word pairs, lengths.  The fit uses ``sample_rows`` labelled rows at most and ``unlabelled_rows`` rows of the
web text, a documented bound of the fit (its standard error goes with the root of it); scoring is one pass over all
whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix64, released, text_slices
from .textkit import Words, RangeHash
from .toxicity import held_out, labelled_sample

SAMPLE_ROWS = 8192
BINS = 12
THRESHOLD = 0.5


def _classes() -> np.ndarray:
    """byte -> bits: upper, lower, digit, space, line end, mark of a sentence, other mark, non-ASCII."""
    kinds = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        kinds[b] = [c.isupper() and b < 128, c.islower() and b < 128, c.isdigit() and b < 128, c == " ", c == "\n", c in ".,;:?'\"()-", 32 < b < 127 and not c.isalnum() and c not in ".,;:?'\"()-", b >= 128]
    return kinds


_KINDS = _classes()


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: share of distinct keys, and share of the most frequent one."""
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[first], runs)
    return np.bincount(d[first], minlength=n) / count, top / count


def measures(texts: list[str | None]) -> np.ndarray:
    """documents x measures."""
    n = len(texts)
    words = Words(texts)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    length = np.maximum(size, 1)
    # the added line end of each text is taken off again
    shares = np.stack([np.add.reduceat(_KINDS[:, k].astype(np.float32)[buf], begin) for k in range(8)], axis=1) if n else np.zeros((0, 8))
    shares[:, 4] -= 1
    shares = shares / length[:, None]
    unique, top = _distinct(words.doc, words.hash, n)
    pair_doc = words.doc[1:]
    same = words.doc[1:] == words.doc[:-1]
    again = same & (words.hash[1:] == words.hash[:-1])
    pairs = mix64(words.hash[:-1] * U64(3) + words.hash[1:])[same]
    pair_unique, pair_top = _distinct(pair_doc[same], pairs, n)
    n_words = np.maximum(words.per_doc, 1)
    echoes = np.bincount(pair_doc[again], minlength=n) / n_words
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    full = ends > starts
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(begin, starts, side="right") - 1
    line_unique, line_top = _distinct(line_doc, RangeHash(buf).of(starts, ends), n)
    letters = np.bincount(words.doc, (words.stop - words.start), n) / n_words
    return np.column_stack([shares, unique, top, pair_unique, pair_top, echoes, line_unique, line_top, letters, np.log1p(words.per_doc), np.log1p(size), words.per_doc / length])


@dataclass
class BinnedModel:
    edges: list[np.ndarray]
    weight: np.ndarray
    bias: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """One column number per document and measure."""
        at, out = 0, []
        for k, e in enumerate(self.edges):
            out.append(at + np.searchsorted(e, x[:, k], side="right"))
            at += len(e) + 1
        return np.column_stack(out)

    def logits(self, columns: np.ndarray) -> np.ndarray:
        return self.bias + self.weight[columns].sum(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.columns(measures(texts)))))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, least: float = 0.5, rounds: int = 2) -> float:
    """Share of positives among the unlabelled rows, from measures of the two samples.

    A ranking learnt on one half of both is read on the other, and the other way round: the least ratio of the
    unlabelled to the positive rows' share above a score, over scores that at least ``least`` of the positives reach; two
    standard errors of each ratio are added before the least is looked for, so that chance does not choose it.  A ranking
    depends on the prior it is learnt with (a wrong one puts odd positives above the usual ones), so the estimate goes
    into the next round's."""
    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    prior = 0.5
    for _ in range(rounds):
        found = []
        for half in (0, 1):
            model = fit_nnpu(positive[half::2], unlabelled[half::2], prior)
            p, u = (np.sort(model.logits(model.columns(x[1 - half :: 2]))) for x in (positive, unlabelled))
            cut = p[: int(len(p) * (1 - least)) + 1]
            above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), np.maximum(1 - np.searchsorted(u, cut) / len(u), 1 / len(u))
            ratio = above_u / above_p
            error = ratio * np.sqrt((1 - above_u) / (above_u * len(u)) + (1 - above_p) / (above_p * len(p)))
            found.append(ratio[np.argmin(ratio + 2 * error)])
        prior = float(np.clip(np.mean(found), 0.02, 0.98))
    return prior


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk for the logits of both samples, with sigmoid loss l(z) = sigmoid(-z)."""
    loss = lambda z: float(np.mean(1 / (1 + np.exp(z))))
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 1500, rate: float = 0.03, l2: float = 1e-4) -> BinnedModel:
    """Measures of the two samples -> model.  Without positives or unlabelled rows, every score is the prior."""
    both = np.vstack([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(both) else np.zeros(0) for k in range(both.shape[1])]
    prior = float(np.clip(prior, 0.02, 0.98))
    model = BinnedModel(edges, np.zeros(sum(len(e) + 1 for e in edges)), float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled):
        return model
    model.bias = 0.0
    cp, cu = model.columns(positive), model.columns(unlabelled)
    m, v = np.zeros(len(model.weight) + 1), np.zeros(len(model.weight) + 1)

    def gradient(columns: np.ndarray, slope: np.ndarray) -> np.ndarray:
        per = np.bincount(columns.ravel(), np.repeat(slope, columns.shape[1]), len(model.weight)) / len(columns)
        return np.append(per, slope.mean())

    for step in range(1, rounds + 1):
        # sigmoid loss, l(z) = sigmoid(-z): bounded, so that the difference of two large means does not drown in noise
        sp, su = 1 / (1 + np.exp(-model.logits(cp))), 1 / (1 + np.exp(-model.logits(cu)))
        negative = su.mean() - prior * sp.mean()
        down = gradient(cu, su * (1 - su)) - prior * gradient(cp, sp * (1 - sp))
        grad = down - prior * gradient(cp, sp * (1 - sp)) if negative >= 0 else -down
        grad[:-1] += l2 * model.weight
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weight = model.weight - move[:-1]
        model.bias -= float(move[-1])
    return model


def _measured(rows: DataFrame) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            x = measures(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(released(run), "id long, y int, x binary").collect()
    got.sort(key=lambda r: (r.id if r.id is not None else -1, bytes(r.x)))
    return got


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = SAMPLE_ROWS) -> BinnedModel:
    """Positives: labelled good, of at most ``sample_rows`` labelled rows (labels of 0 are not read).  Unlabelled: the
    texts of ``unlabelled_rows`` ids outside the held-out fold, labelled or not (least hash of the id first; of rows that
    share an id, the one of least text), also for bins and prior."""
    known = _measured(labelled_sample(docs, labels, label, sample_rows).where("y = 1"))
    web = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").where(~held_out("id"))
    ids = web.select(F.col("id").alias("web_id")).distinct().orderBy(F.xxhash64("web_id", F.lit(5)), "web_id").limit(unlabelled_rows)
    free = _measured(web.join(F.broadcast(ids), web.id == ids.web_id).groupBy("id").agg(F.min("text").alias("text")).withColumn("y", F.lit(0)))
    width = len(measures(["a"])[0])
    stack = lambda rows: np.array([np.frombuffer(r.x, "<f8") for r in rows]).reshape(-1, width)
    good = [r for r in known if r.y == 1]
    return fit_nnpu(stack(good), stack(free), estimate_prior(stack(good), stack(free)))


def score_documents(docs: DataFrame, model: BinnedModel) -> DataFrame:
    """All of ``docs``' columns and ``quality_score`` (0 to 1); null counts as the empty text.  Repeated rows get the
    same score each; a column of that name is replaced."""
    others = [c for c in docs.columns if c != "quality_score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema) + ", quality_score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.score(piece.column("text").to_pylist()))], names=[*others, "quality_score"])

    return bounded_batches(docs).select(*others).mapInArrow(released(score), schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("quality_score")
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
