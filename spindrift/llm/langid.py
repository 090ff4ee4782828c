"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds its letters' vectors, permuted by place:
rot(a, 2) * rot(b, 1) * c.  A text's vector bundles (adds up) those of its trigrams, and a language's prototype
bundles its training texts.  The language whose prototype has the greatest cosine with the text is the prediction.

Letters are lower-cased; any run of other characters is one boundary.  a-z have symbols of their own, all other
letters share 101 symbols by code point, so there are at most 128^3 trigrams and every table here is bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, text_slices
from .toxicity import held_out

DIMS = 1024
SYMBOLS = 128
UNKNOWN = "und"
_HELD_ROWS = 16_000  # trigram vectors that a worker keeps: 64 MB


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % 101
    return table


_STATE: dict = {}


def _symbols() -> np.ndarray:
    if "table" not in _STATE:
        _STATE["table"] = _symbol_table()
    return _STATE["table"]


def _letters(dims: int) -> np.ndarray:
    return np.random.default_rng(97).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def trigram_vectors(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    letter = _STATE.setdefault(("letters", dims), _letters(dims))
    a, b, c = ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
    return (np.roll(letter, 2, axis=1)[a] * np.roll(letter, 1, axis=1)[b] * letter[c]).astype(np.float32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram ids of all texts in order, first trigram of each text and the end, whether a text has a letter)."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), "<u4")
    size = np.array([len(t) + 1 for t in lowered])
    s = _symbols()[codes]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)  # boundaries in a row count once
    ends = np.cumsum(keep)[np.append(0, np.cumsum(size))]
    s = s[keep].astype(np.int32)
    ids = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)
    # A text's trigrams start at its left boundary and end with its right one.
    cuts = np.maximum(ends - 1, 0)
    return ids, cuts, np.diff(cuts) > 0


def text_vectors(texts: list[str | None], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(bundled vector of each text, whether it has a letter)."""
    ids, cuts, lettered = trigrams(texts)
    out = np.zeros((len(texts), dims), np.float32)
    for i in np.flatnonzero(lettered):
        own = ids[cuts[i] : max(cuts[i + 1] - 1, cuts[i] + 1)]
        rows, counts = _rows(own, dims)
        for at in range(0, len(rows), _HELD_ROWS):
            out[i] += counts[at : at + _HELD_ROWS] @ _held(rows[at : at + _HELD_ROWS], dims)
    return out, lettered


def _rows(ids: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(ids, return_counts=True)
    return found, counts.astype(np.float32)


def _held(ids: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of distinct trigrams, from a bounded store."""
    key = ("store", dims)
    if key not in _STATE or _STATE[key]["n"] + len(ids) > _HELD_ROWS:
        _STATE[key] = {"n": 0, "where": np.full(SYMBOLS**3, -1, np.int32), "vectors": _STATE.get(key, {}).get("vectors", np.zeros((_HELD_ROWS, dims), np.float32))}
    store = _STATE[key]
    new = ids[store["where"][ids] < 0]
    if len(new):
        store["vectors"][store["n"] : store["n"] + len(new)] = trigram_vectors(new, dims)
        store["where"][new] = np.arange(store["n"], store["n"] + len(new))
        store["n"] += len(new)
    return store["vectors"][store["where"][ids]]


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """(languages in order, one prototype each), over all rows with a text and a language.

    Each task adds up its rows' trigrams and sends one vector per language; the sums come to the driver as
    languages x ``dims`` numbers.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for piece in text_slices(batches):
            langs = np.array(piece.column("lang").to_pylist(), object)
            texts = piece.column("text").to_pylist()
            for lang in sorted(set(langs)):
                ids, cuts, lettered = trigrams([t for t, own in zip(texts, langs == lang) if own])
                if lang not in counts:
                    counts[lang] = np.zeros(SYMBOLS**3, np.int64)
                counts[lang] += np.bincount(ids, minlength=SYMBOLS**3)
        for lang, seen in counts.items():
            ids, total = np.flatnonzero(seen), np.zeros(dims)
            for at in range(0, len(ids), _HELD_ROWS):
                part = ids[at : at + _HELD_ROWS]
                total += seen[part].astype(np.float64) @ trigram_vectors(part, dims).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims)), pa.array(total)], names=["lang", "i", "v"])

    rows = bounded_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    got = rows.mapInArrow(released(bundle), "lang string, i long, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r.lang for r in got})
    profile = np.zeros((len(langs), dims))
    for r in got:
        profile[langs.index(r.lang), r.i] = r.v
    lettered = profile.any(axis=1)  # a language whose texts have no letter teaches nothing
    return [k for k, some in zip(langs, lettered) if some], profile[lettered]


def predict(docs: DataFrame, langs: list[str], profile: np.ndarray, *, dims: int = DIMS) -> DataFrame:
    """All of ``docs``' columns, ``lang_pred`` (``und`` without a letter, or if nothing was learnt) and ``lang_score``
    (the cosine, 0 at least).  Ties go to the language that sorts first."""
    others = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema) + ", lang_pred string, lang_score double"
    unit = (profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            vectors, lettered = text_vectors(piece.column("text").to_pylist(), dims)
            if langs:
                cosine = (vectors @ unit.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                best = cosine.argmax(axis=1)
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).astype(np.float64)
                name = [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            else:
                score, name = np.zeros(piece.num_rows), [UNKNOWN] * piece.num_rows
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(name, pa.string()), pa.array(score)], names=[*others, "lang_pred", "lang_score"])

    return bounded_batches(docs).select(*others).mapInArrow(released(run), schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: language of every document, learnt from four of five folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out("doc_id", 5, 0)
    langs, profile = train(docs.where(~fold))
    found = predict(docs.select("doc_id", "text"), langs, profile)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
