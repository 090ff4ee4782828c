"""Fast exact token ids from a ``tokenizers`` file.

Byte-pair encoding works on pre-tokens one by one, so the ids of a text are the ids of its pre-tokens in
order.  Texts made only of characters whose splitting and lower-casing are beyond doubt are split with a
regular expression, and each distinct piece goes through the library's model once per worker (bounded cache); any
other text goes to the library whole.  Both ways give the library's ids.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import ragged_arange

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"

# The pre-tokenizer patterns stated in the tokenizer files, over the plain character set below.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r !-~{_LETTER}]*")
_WORD_RX = re.compile(rf"[{_LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}0-9]+")
_BYTE_RX = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Entries that a worker keeps (some 200 bytes each); beyond that, it starts again.  Shards hold nothing but ids, which
#: leaves room for more words there.
_CACHE_LIMIT = {WORD_FILE: 600_000, BYTE_FILE: 200_000}
_CACHED_CHARS = 64  # longer pieces are not kept


def _byte_chars() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it (in byte order, others from 256)."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without NUL characters: one join and one split beat a conversion each."""
    if not len(column):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), pa.scalar("\0", column.type))
    return joined[0].as_py().split("\0")


class _Pieces(dict):
    """Text between two spaces (with the space before it, where spaces count) -> its ids, learnt when first asked for."""

    def __init__(self, model, rx: re.Pattern):
        self.tokenize, self.split = model.tokenize, rx.findall

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.split(chunk)
        if len(pieces) == 1:
            spelled = pieces[0].encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelled)])
        else:
            ids = b"".join(map(self.__getitem__, pieces))
        if len(chunk) <= _CACHED_CHARS:
            self[chunk] = ids
        return ids


def _loose(text: str) -> bool:
    """White space at an end, or next to other white space: there, splitting at spaces could part a piece."""
    return text != text.strip() or any(two in text for two in ("  ", " \n", "\n ", "\n\n", "\t", "\r"))


class PieceEncoder:
    """Token ids of whole texts, concatenated: ``ids`` (unsigned 32 bits) and the number of ids of each text."""

    def __init__(self, file: str):
        self.tok = Tokenizer.from_file(public_tokenizers.path(file))
        self.lower = file == WORD_FILE
        self.rx = _WORD_RX if self.lower else _BYTE_RX
        self.chunks, self.most = _Pieces(self.tok.model, self.rx), _CACHE_LIMIT[file]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``None`` counts as the empty text."""
        if len(self.chunks) > self.most:
            self.chunks.clear()
        parts: list[list[str]] = []
        odd: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            text = text or ""
            if not _PLAIN.fullmatch(text) or "<|" in text:
                odd[i] = self.whole(text)
                text = ""
            elif self.lower:
                text = text.lower()
            elif _loose(text):
                odd[i] = np.frombuffer(b"".join(map(self.chunks.__getitem__, self.rx.findall(text))), "<u4")
                text = ""
            parts.append(text)
        flat = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        per_text = np.diff(flat.offsets.to_numpy()).astype(np.int64)
        words = flat.flatten()
        if not self.lower:  # all but a text's first chunk come after a space
            first = np.zeros(len(words), bool)
            first[(np.cumsum(per_text) - per_text)] = True
            words = pc.binary_join_element_wise(pc.if_else(pa.array(first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), words, pa.scalar("", pa.large_string()))
        coded = words.dictionary_encode()
        # An empty text has one chunk, the empty one, which has no ids.
        got = list(map(self.chunks.__getitem__, _strings(coded.dictionary)))
        table = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        n = size[index]
        ids = table[np.repeat(begin[index], n) + ragged_arange(n)]
        counts = np.add.reduceat(n, np.cumsum(per_text) - per_text) if len(per_text) else np.zeros(0, np.int64)
        if odd:
            cuts = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in odd.items():
                cuts[i], counts[i] = own, len(own)
            ids = np.concatenate(cuts)
        return ids.astype(np.uint32, copy=False), counts


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = PieceEncoder(file)
    return _ENCODERS[file]
