"""Token-ID output: documents' ids in shards, each one compressed wavelet matrix.

A wavelet matrix keeps a sequence of integers as bit-planes, highest bit first; at each plane the sequence is
parted stably into zeros and ones.  With counts of ones every 512 bits, ``access``, ``rank`` and ``select`` take
one step per plane, so a shard answers "which id stands at i", "how often does id x occur" and "where is the
k-th x" from its own bytes: the file holds these counts, and planes in compressed pieces of which a question opens a few.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, released, stage_table, text_slices
from .tokens import WORD_FILE, encoder

MAGIC, FILE_MAGIC = b"WMX2", b"WMSHARD1"
PIECE = 1 << 15  # bytes of a plane that are compressed together; whole blocks
BLOCK = 512  # bits between two entries of a rank directory
SHARD_TOKENS = 2_000_000  # a shard is closed once it holds so many ids
END_ID = 2
MOST_BROADCAST = 1_000_000


class Plane:
    """Bits of one level, in pieces that are unpacked when first asked for."""

    def __init__(self, pieces: list[bytes], size: int, packed: bool):
        self.pieces, self.size, self.packed = pieces, size, packed
        self.open: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits, bitorder="little").tobytes()
        return cls([raw[k : k + PIECE] for k in range(0, len(raw), PIECE)], len(raw), False)

    def piece(self, k: int) -> np.ndarray:
        if k not in self.open:
            raw = zstandard.ZstdDecompressor().decompress(self.pieces[k]) if self.packed else self.pieces[k]
            self.open[k] = np.frombuffer(raw, np.uint8)
        return self.open[k]

    def bytes_(self, first: int, last: int) -> np.ndarray:
        """Bytes first..last-1 of one block."""
        k = first // PIECE
        return self.piece(k)[first - k * PIECE : last - k * PIECE] if first < self.size else np.zeros(0, np.uint8)

    def whole(self) -> np.ndarray:
        return np.concatenate([self.piece(k) for k in range(len(self.pieces))]) if self.pieces else np.zeros(0, np.uint8)


class WaveletMatrix:
    """Bit-planes (highest first), zeros of each plane and a rank directory of each plane."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int], directory: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.directory = directory or [self._directory(p.whole()) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (x >> x.dtype.type(level)) & x.dtype.type(1) != 0
            planes.append(Plane.of(one))
            low = np.flatnonzero(~one)  # places are quicker than a mask of bits in no order
            zeros.append(len(low))
            x = np.concatenate([x[low], x[np.flatnonzero(one)]])
        return cls(len(ids), planes, zeros)

    def to_bytes(self) -> bytes:
        """The file: a head, the rank directories (ones of each block), where each piece of each plane begins, and the
        compressed pieces.  A reader opens head and directories, and of the planes only the pieces that it needs."""
        pack = zstandard.ZstdCompressor(level=1)
        pieces = [pack.compress(p) for plane in self.planes for p in plane.pieces]
        ones = np.concatenate([np.diff(d) for d in self.directory]).astype("<u2").tobytes()
        ends = np.cumsum([len(p) for p in pieces], dtype="<u8").tobytes()
        directory = pack.compress(ones)
        head = MAGIC + struct.pack("<QBII", self.n, len(self.planes), len(directory), len(pieces)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + directory + ends + b"".join(pieces)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n, bits, size, count = struct.unpack_from("<QBII", blob, 4)
        at = 4 + struct.calcsize("<QBII")
        zeros = list(struct.unpack_from(f"<{bits}Q", blob, at))
        at += 8 * bits
        ones = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size]), "<u2").reshape(bits, -1)
        at += size
        ends = np.frombuffer(blob, "<u8", count, at).astype(np.int64) + at + 8 * count
        begin = np.append(at + 8 * count, ends[:-1])
        pieces = [blob[a:b] for a, b in zip(begin.tolist(), ends.tolist())]
        per = count // bits
        planes = [Plane(pieces[k * per : (k + 1) * per], (n + 7) // 8, True) for k in range(bits)]
        return cls(n, planes, zeros, [np.concatenate([[0], np.cumsum(o, dtype=np.int64)]) for o in ones])

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        part = self.planes[level].bytes_(block * (BLOCK // 8), (i + 7) >> 3)
        ones = int(self.directory[level][block]) + int(np.bitwise_count(part).sum())
        return ones - (int(part[-1] >> (i & 7)).bit_count() if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level].bytes_(i >> 3, (i >> 3) + 1)[0] >> (i & 7) & 1)

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's ids among the first i stand after the last plane."""
        lo, hi = 0, i
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, upto: int | None = None) -> int:
        """Occurrences among the first ``upto`` ids (all by default)."""
        if symbol < 0 or symbol.bit_length() > len(self.planes):
            return 0
        lo, hi = self._range(symbol, self.n if upto is None else upto)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there are fewer."""
        if k < 0 or k >= self.count(symbol):
            return -1
        i = self._range(symbol, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(symbol >> (len(self.planes) - 1 - level) & 1)
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def _select_bit(self, level: int, one: bool, k: int) -> int:
        before = self.directory[level] if one else np.arange(len(self.directory[level])) * BLOCK - self.directory[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level].bytes_(first, first + BLOCK // 8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane upwards, undo each plane's parting."""
        x = None
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].whole(), count=self.n, bitorder="little").view(bool)
            weight = 1 << (len(self.planes) - 1 - level)
            y = np.empty(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
            z, low, high = self.zeros[level], np.flatnonzero(~one), np.flatnonzero(one)
            y[low] = 0 if x is None else x[:z]
            y[high] = (0 if x is None else x[z:]) + y.dtype.type(weight)
            x = y
        return (x if x is not None else np.zeros(0)).astype(np.uint32)


_SHARD = "part long, seq long, n_docs long, n_tokens long, shard binary"
_NO_ID = -(2**63)


class ShardFile:
    """One shard as one run of bytes: its documents' ids and numbers of tokens, compressed, and the wavelet matrix of their ids."""

    def __init__(self, owners: np.ndarray, counts: np.ndarray, matrix: WaveletMatrix):
        self.owners, self.counts, self.matrix = owners, counts, matrix
        self.ends = np.cumsum(counts)

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        heads = [squeeze(x.astype("<i8").tobytes()) for x in (self.owners, self.counts)]
        return FILE_MAGIC + struct.pack("<QQ", *map(len, heads)) + b"".join(heads) + self.matrix.to_bytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> ShardFile:
        if blob[: len(FILE_MAGIC)] != FILE_MAGIC:
            raise ValueError("no shard file")
        sizes = struct.unpack_from("<QQ", blob, len(FILE_MAGIC))
        at, heads = len(FILE_MAGIC) + 16, []
        for size in sizes:
            heads.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size]), "<i8"))
            at += size
        return cls(*heads, WaveletMatrix.from_bytes(blob[at:]))

    def document(self, i: int) -> list[int]:
        """The ids of the i-th document, by access alone."""
        return [self.matrix.access(k) for k in range(int(self.ends[i] - self.counts[i]), int(self.ends[i]))]

    def documents_with(self, symbol: int) -> np.ndarray:
        """Places of the documents that hold an id, by count and select."""
        at = np.array([self.matrix.select(symbol, k) for k in range(self.matrix.count(symbol))], np.int64)
        return np.unique(np.searchsorted(self.ends, at, side="right"))


def encode_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", file: str = WORD_FILE, end_id: int = END_ID) -> DataFrame:
    """Shards of token ids in ascending ``id_col`` order (nulls first; rows that share an id by text).

    Null text counts as empty; each document gets ``end_id`` appended.  Rows: ``part, seq`` (shards in order),
    ``n_docs, n_tokens`` and ``shard``, the bytes of a :class:`ShardFile`: all that is known of the shard is in them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(file), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        counts: list[int] = []
        ids: list[int | None] = []
        seq = total = 0

        def close() -> pa.RecordBatch:
            owners = np.array([_NO_ID if i is None else i for i in ids], np.int64)
            shard = ShardFile(owners, np.array(counts, np.int64), WaveletMatrix.build(np.concatenate(held)))
            row = [[part], [seq], [len(ids)], [total], [shard.to_bytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for v in row], names=["part", "seq", "n_docs", "n_tokens", "shard"])

        for piece in text_slices(batches, 4 << 20):
            got, n = enc.encode(piece.column("text").to_pylist())
            ends = np.cumsum(n)
            held.append(np.insert(got, ends, end_id).astype(np.uint32))
            counts += (n + 1).tolist()
            ids += piece.column("id").to_pylist()
            total += len(held[-1])
            if total >= SHARD_TOKENS:
                yield close()
                held, counts, ids, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(released(build), _SHARD)


def write_token_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards as Parquet (to ``path``, or to the shared folder) and return what was written, read back."""
    shards = encode_shards(docs, **options)
    if path is None:
        return stage_table(shards, "token-shards")
    shards.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document, from the shards alone: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32 bits).

    A shard's place is a running sum over one small row per shard (no ids, no bytes of it), joined to the shards.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(parts, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("first"))
    few = sizes.count() <= MOST_BROADCAST  # three longs a shard: 24 MB at most
    placed = shards.join(F.broadcast(places) if few else places, ["part", "seq"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardFile.from_bytes(row["shard"])
                flat = shard.matrix.decode().astype("<u4")
                owner, counts, ends = shard.owners, shard.counts, shard.ends
                begin = ends - counts
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owner, mask=owner == _NO_ID),
                        pa.array(begin + row["first"]),
                        pa.array(counts),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist())], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids binary")


def op7_token_shards(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids of all documents, written as wavelet shards and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read_token_shards(write_token_shards(docs))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    """The digest that ``op7`` returns, for tests."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
