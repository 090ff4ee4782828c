"""Quality rules: an isolation forest on rule statistics.

One pass over whole texts counts words, symbols, repeated lines and repeated three-word windows exactly (bytes decide,
no hashes), and the shares that the forest sees: what the fixed rules judge already (repeats, length) is not among them,
so that a clean text with a repeated line is no anomaly.  Trees split a random statistic at a random place between its least and greatest
value until documents are alone; documents of strange form end early, so a short mean path marks an anomaly.  The forest
is grown on draws from all labelled rows, a fresh one for each tree, with rows labelled bad mixed in at the rate that an
anomaly is expected (``contamination``), so that many bad rows of a kind do not look normal to each other.  The threshold
on the score comes from the labels of all these rows: the one that rejects most rows labelled bad while at most
``good_loss`` of the rows labelled good go.  Rows that the fixed rules reject take no part, as the verdict is not about
them.  Fit and threshold take nothing from the fold that quality operators hold out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, bounded_batches, drop_tables, mix64, released, stage_table, text_slices
from .toxicity import held_out, labels_by_id

TREES = 200
SUBSAMPLE = 256
CONTAMINATION = 0.02
GOOD_LOSS = 0.002
SEED = 20
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER, _LOWER, _DIGIT = ((_BYTE >= ord(a)) & (_BYTE <= ord(b)) for a, b in ("AZ", "az", "09"))
_FIRST = (_BYTE & 0xC0) != 0x80  # first byte of a code point
_SPACE = np.isin(_BYTE, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_SYMBOL


def numbered_words(words: list[bytes]) -> np.ndarray:
    """The same number for the same word, from 0 by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_windows(ids: np.ndarray, k: int = 3) -> np.ndarray:
    """Of each word, whether it lies in a window of ``k`` words that occurs twice or more; exact."""
    inside = np.zeros(len(ids), bool)
    if len(ids) <= k:
        return inside
    key, names = ids[: len(ids) - k + 1], int(ids.max()) + 1
    for j in range(1, k):
        if len(ids) * names >= 1 << 62:  # cannot be: both are below 2^31
            raise ValueError("text too long")
        key = np.unique(key * names + ids[j : len(ids) - k + 1 + j], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    for j in range(k):
        inside[j : len(ids) - k + 1 + j] |= again
    return inside


def measure(raw: bytes) -> tuple[list[int], list[float]]:
    """The five counts of a text (UTF-8), and the statistics that the forest sees."""
    words = raw.split()  # bytes: at spaces and \\x09 to \\x0d, no others
    n = len(words)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, symbols = int(kinds[_FIRST & ~_SPACE].sum()), int(kinds[_SYMBOL].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    ids = numbered_words(words)
    repeated = int(repeated_windows(ids).sum())
    per = lambda x, of: float(x) / max(of, 1)
    most = int(np.bincount(ids).max(initial=0))
    upper, lower = int(kinds[_UPPER].sum()), int(kinds[_LOWER].sum())
    shares = [
        per(chars, n), per(symbols, n), per(upper, upper + lower), per(kinds[_MARK].sum(), n),
        per(kinds[ord("!")], n), per(kinds[ord("|")], n), per(most, n), np.log1p(per(n, len(lines))),
    ]
    return [n, chars, symbols, dup_lines, repeated], shares


N_SHARES = len(measure(b"")[1])


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` in a binary search tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees of equal depth as arrays: node k has the children 2k+1 and 2k+2, a leaf is its own end (feature -1)."""

    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    path: np.ndarray  # of leaves: depth and what is expected below
    size: int  # rows a tree was grown on
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): towards 1 for anomalies, 0.5 and less for what is usual."""
        if not self.feature.shape[0]:
            return np.zeros(len(x))
        tree = np.arange(self.feature.shape[0])
        at = np.zeros((len(x), len(tree)), np.int64)
        while True:
            feature = self.feature[tree, at]
            inner = feature >= 0
            if not inner.any():
                break
            right = np.take_along_axis(x, np.maximum(feature, 0), axis=1) >= self.cut[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return 2.0 ** (-self.path[tree, at].mean(axis=1) / max(float(expected_path(self.size)), 1e-9))


def draw_sizes(n_normal: int, n_odd: int, subsample: int = SUBSAMPLE, contamination: float = CONTAMINATION) -> tuple[int, int]:
    """(normal, odd) rows of a tree's draw from so many."""
    size = min(subsample, n_normal + n_odd)
    few = min(int(np.ceil(contamination * size)), n_odd) if n_normal else size
    return min(size - few, n_normal), few


def grow_forest(normal: np.ndarray, odd: np.ndarray, *, trees: int = TREES, subsample: int = SUBSAMPLE, contamination: float = CONTAMINATION, seed: int = SEED) -> IsolationForest:
    """Trees on random draws of ``normal`` rows, with ``contamination`` of each draw from ``odd`` (all from the other
    where one has no rows)."""
    rng, size = np.random.default_rng(seed), min(subsample, len(normal) + len(odd))
    some, few = draw_sizes(len(normal), len(odd), subsample, contamination)
    take = lambda rows, n: rows[rng.permutation(len(rows))[:n]]
    return grow_trees((np.vstack([take(normal, some), take(odd, few)]) for _ in range(trees if size else 0)), size, trees, rng)


def grow_trees(draws: Iterable[np.ndarray], size: int, trees: int, rng: np.random.Generator) -> IsolationForest:
    """A tree on each draw of at most ``size`` rows."""
    depth = max(int(np.ceil(np.log2(max(size, 2)))), 1)
    nodes = 2 ** (depth + 1) - 1
    trees = trees if size else 0
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t, draw in enumerate(draws):
        todo = [(0, 0, draw)]
        while todo:
            node, level, rows = todo.pop()
            least, most = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
            apart = np.flatnonzero(most > least)
            if level == depth or len(rows) < 2 or not len(apart):
                path[t, node] = level + expected_path(len(rows))
                continue
            f = int(rng.choice(apart))
            at = least[f] + (most[f] - least[f]) * (1 - rng.random())
            feature[t, node], cut[t, node] = f, at
            right = rows[:, f] >= at
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return IsolationForest(feature, cut, path, size)


def calibrate(good: np.ndarray, bad: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The score above which a document goes: midway between the score that at most ``good_loss`` of the good rows
    exceed and the next bad row's; infinite without good or bad rows."""
    if not len(good) or not len(bad):
        return float("inf")
    bound = np.sort(good)[::-1][int(good_loss * len(good))]
    over = bad[bad > bound]
    return float((bound + over.min()) / 2) if len(over) else float("inf")


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` under 50 words, or with more than half of the words in repeated three-word windows."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def _texts(piece: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]


def _draws(some: int, few: int, trees: int):
    """id, y, x -> tree, y, h, x: of a task's rows those of least hash for each tree, ``some`` good and ``few`` bad ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, trees + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # y -> (hashes: trees x rows, falling out from the right; rows' x)
        for batch in batches:
            ids, ys, xs = batch.column("id").to_numpy().astype(np.uint64), batch.column("y").to_numpy(), np.array(batch.column("x").to_pylist(), object)
            for y, most in ((1, some), (0, few)):
                for own in np.array_split(np.flatnonzero(ys == y), max(1, batch.num_rows // 2048)):
                    if not most or not len(own):
                        continue
                    h = mix64(mix64(ids[own] + U64(1))[None, :] ^ salt[:, None])
                    x = np.broadcast_to(xs[own], h.shape)
                    if y in held:
                        h, x = np.hstack([held[y][0], h]), np.hstack([held[y][1], x])
                    keep = np.argsort(h, axis=1, kind="stable")[:, :most]
                    held[y] = np.take_along_axis(h, keep, axis=1), np.take_along_axis(x, keep, axis=1)
        for y, (h, x) in held.items():
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h.shape[1], t, np.int32)), pa.array(np.full(h.shape[1], y, np.int32)), pa.array((h[t] >> U64(1)).astype(np.int64)), pa.array(x[t].tolist(), pa.binary())], names=["tree", "y", "h", "x"])

    return run


def _scored(forest: IsolationForest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                x = np.frombuffer(b"".join(piece.column("x").to_pylist()), "<f8").reshape(-1, N_SHARES)
                yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(forest.scores(x))], names=["y", "score"])

    return run


def threshold(scores: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """As ``calibrate``, over rows y (1 good, 0 bad), score of any number."""
    n = {r.y: r.n for r in scores.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return float("inf")
    bound = scores.where("y = 1").orderBy(F.desc("score")).limit(int(good_loss * n[1]) + 1).agg(F.min("score")).first()[0]
    over = scores.where((F.col("y") == 0) & (F.col("score") > bound)).agg(F.min("score")).first()[0]
    return float("inf") if over is None else float((bound + over) / 2)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", trees: int = TREES, good_loss: float = GOOD_LOSS) -> IsolationForest:
    """Trees' draws and threshold come from all labelled rows.  Without labelled rows the forest has no tree and rejects
    nothing.  A row's label counts as good where it is 1; of rows that share an id, the one of least shares counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            measured = [measure(t) for t in _texts(piece)]
            failed = base_failed(np.array([c for c, _ in measured], np.int64).reshape(-1, len(COUNTS)))
            shares = [None if bad else np.array(x, "<f8").tobytes() for bad, (_, x) in zip(failed, measured)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(shares, pa.binary())], names=["id", "x"])

    # texts are measured where they lie, so that the join moves shares alone
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").where(~held_out("id"))
    each = texts.mapInArrow(released(run), "id long, x binary").where("x is not null").join(labels_by_id(labels, label), "id")
    rows = stage_table(each.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")), "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some, few = draw_sizes(n.get(1, 0), n.get(0, 0))
    place = F.row_number().over(Window.partitionBy("tree", "y").orderBy("h", "x"))
    drawn = rows.mapInArrow(released(_draws(some, few, trees)), "tree int, y int, h long, x binary").withColumn("place", place)
    got = drawn.where(F.col("place") <= F.when(F.col("y") == 1, some).otherwise(few)).select("tree", "y", "h", "x").collect()
    got.sort(key=lambda r: (r.tree, -r.y, r.h, bytes(r.x)))
    draws = [np.array([np.frombuffer(r.x, "<f8") for r in own]).reshape(-1, N_SHARES) for _, own in groupby(got, key=lambda r: r.tree)]
    forest = grow_trees(draws, some + few, trees, np.random.default_rng(SEED))
    scores = stage_table(rows.mapInArrow(released(_scored(forest)), "y int, score double"), "scores")
    forest.threshold = threshold(scores, good_loss)
    drop_tables(rows, scores)
    return forest


def judge(docs: DataFrame, forest: IsolationForest) -> DataFrame:
    """All of ``docs``' columns, the five counts (long), ``base_failed``, ``anomaly`` (0 to 1) and ``kept``.

    A null text has no words.  Each row is judged by its own text alone, so repeated rows and ids get the same verdict
    each; columns of these names are replaced.  ``kept``: not ``base_failed``, and the anomaly not above the forest's threshold."""
    added = [*COUNTS, "base_failed", "anomaly", "kept"]
    others = [c for c in docs.columns if c not in added]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    schema = ", ".join([*fields, *[f"{c} long" for c in COUNTS], "base_failed boolean, anomaly double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            measured = [measure(t) for t in _texts(piece)]
            counts = np.array([c for c, _ in measured], np.int64).reshape(-1, len(COUNTS))
            failed = base_failed(counts)
            anomaly = forest.scores(np.array([x for _, x in measured]).reshape(-1, N_SHARES))
            kept = ~failed & (anomaly <= forest.threshold)
            yield pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(anomaly), pa.array(kept)], names=[*others, *added])

    return bounded_batches(docs).select(*others).mapInArrow(released(run), schema)


def op12_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: the rules and the forest's verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, forest).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
