"""Token ids in wavelet-matrix files.

The ids of a shard of consecutive documents, mapped to the shard's own alphabet,
are stored as bit-planes, highest bit first; after each plane the sequence is
stably parted into zeros and ones.  With a directory of ones per block the planes
answer access, rank (count), and select (occurrence lookup) without unpacking
the shard.  A file body is a small header, the alphabet, the document ids and
borders, and the planes, each compressed.

Documents are range-parted by id and sorted, encoded by the ``tokenizers``
library, and cut into shards of about ``SHARD_TOKENS`` ids between documents.
Shards are written as rows of Parquet part files (one binary body a row), so any
store that Spark writes to holds them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravel.llm.chunks import ChunkEncoder
from ravel.llm.common import slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 20
PARTITION_CHARS = 24 << 20
SLICE = 3 << 20
JOINED = 64
_MAGIC = b"WVM1"
_BLOCK = 512
_HEAD = struct.Struct("<4sIIIQ")


class WaveletMatrix:
    """Bit-planes over a dense alphabet."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], n: int):
        self.alphabet, self.planes, self.n = alphabet, planes, n
        self.zeros, self.blocks = [], []
        for plane in planes:
            ones = np.bitwise_count(plane).reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64)
            self.blocks.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(n - int(self.blocks[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        seq = (np.cumsum(present) - 1).astype(kind)[ids] if len(ids) else np.empty(0, kind)
        planes = []
        for level in reversed(range(int(max(len(alphabet) - 1, 0)).bit_length())):
            bit = seq & kind(1 << level) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.append(packed, np.zeros(-len(packed) % (_BLOCK // 8), np.uint8)))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(alphabet.astype(np.uint32), planes, len(ids))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        plane, whole = self.planes[level], at >> 3
        block = at // _BLOCK
        out = self.blocks[level][block].copy()
        for step in range(_BLOCK // 8):  # whole bytes between the block's start and the position
            byte = block * (_BLOCK // 8) + step
            inside = byte < whole
            if not inside.any():
                break
            out[inside] += np.bitwise_count(plane[byte[inside]])
        part = (at & 7) != 0
        low = plane[whole[part]] & ((1 << (at[part] & 7)) - 1).astype(np.uint8)
        out[part] += np.bitwise_count(low)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(at, np.int64).copy()
        code = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._ones(level, at)
            code = code << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return self.alphabet[code]

    def _code(self, token: int) -> int:
        code = int(np.searchsorted(self.alphabet, token))
        return code if code < len(self.alphabet) and self.alphabet[code] == token else -1

    def _walk(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, np.array([lo, hi])).tolist()
            if code >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo..hi-1."""
        code = self._code(token)
        if code < 0:
            return 0
        lo, hi = self._walk(code, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id, or -1."""
        code = self._code(token)
        if code < 0 or k < 0 or k >= self.count(token):
            return -1
        at = self._walk(code, 0, 0)[0] + k
        for level in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - level) & 1
            want = at - self.zeros[level] if bit else at
            lo, hi = 0, self.n  # the smallest prefix that holds want + 1 such bits
            while lo < hi:
                mid = (lo + hi) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0]) if mid + 1 < self.n else self.n - self.zeros[level]
                if (ones if bit else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the partings from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        code = np.zeros(self.n, kind)
        for level in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~bit] = code[: self.zeros[level]]
            up[bit] = code[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            code = up
        return self.alphabet[code] if self.n else np.empty(0, np.uint32)


def pack_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """File body of a shard: documents, their sizes and the wavelet matrix of their ids."""
    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    parts = [known.tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), sizes.astype("<i8").tobytes(),
             matrix.alphabet.astype("<u4").tobytes(), *(p.tobytes() for p in matrix.planes)]
    parts = [press(p) for p in parts]
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(matrix.alphabet), len(matrix.planes), matrix.n)
    return head + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def open_shard(body: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their sizes and the wavelet matrix of a file body."""
    magic, _, _, n_planes, n = _HEAD.unpack_from(body)
    if magic != _MAGIC:
        raise ValueError("not a wavelet shard")
    sizes = struct.unpack_from(f"<{4 + n_planes}I", body, _HEAD.size)
    at, parts = _HEAD.size + 4 * len(sizes), []
    unpress = zstandard.ZstdDecompressor()
    for size in sizes:
        parts.append(unpress.decompress(body[at : at + size]))
        at += size
    known, docs = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8").tolist()
    planes = [np.frombuffer(p, np.uint8) for p in parts[4:]]
    matrix = WaveletMatrix(np.frombuffer(parts[3], "<u4"), planes, n)
    return [d if k else None for d, k in zip(docs, known, strict=True)], np.frombuffer(parts[2], "<i8"), matrix


@lru_cache(maxsize=2)
def _library(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    # a special token cuts a text before anything else, so pieces joined by one are encoded as if alone
    special = next(((i, t.content) for i, t in library.get_added_tokens_decoder().items() if t.special), None)

    def one_by_one(distinct: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in library.encode_batch_fast(distinct, add_special_tokens=False)]

    def encode(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if special is None or any(special[1] in piece for piece in distinct):
            found = one_by_one(distinct)
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        found = one_by_one([special[1].join(distinct[i : i + JOINED]) for i in range(0, len(distinct), JOINED)])
        border = np.array([special[0]], np.int32)
        flat = np.concatenate([x for ids in found for x in (ids, border)])
        cuts = np.flatnonzero(flat == special[0])
        return flat[flat != special[0]], np.diff(cuts, prepend=-1) - 1

    return ChunkEncoder(encode, uncut=[t.content for t in library.get_added_tokens_decoder().values()])


def write_token_shards(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partition_chars: int = PARTITION_CHARS) -> None:
    """Write the ids of ``(doc_id, text)`` with ``end_id`` after each document, in ascending doc_id order, below ``out``.

    Null texts are empty; null doc_ids come first; repeated rows are written each,
    ordered by text; an empty table writes no shard.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // partition_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library(path)
        part, shard = TaskContext.get().partitionId(), 0
        held_docs, held_sizes, held_ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            body = pack_shard(held_docs, np.concatenate(held_sizes), np.concatenate(held_ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()), pa.array([body], pa.binary())],
                names=["part", "shard", "n_tokens", "body"],
            )

        for batch in slices(batches, "text", SLICE):
            ids, n = encoder.encode_column(batch.column("text"))
            full = n + 1
            whole = np.full(int(full.sum()), end_id, np.int32)
            last = np.cumsum(full) - 1
            body = np.ones(len(whole), bool)
            body[last] = False
            whole[body] = ids
            doc_ids, ends, lo = batch.column("doc_id").to_pylist(), last + 1, 0
            while lo < len(doc_ids):  # as many documents as the shard still takes
                begin = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + shard_tokens - held, "right")))
                held_docs += doc_ids[lo:hi]
                held_sizes.append(full[lo:hi])
                held_ids.append(whole[begin : int(ends[hi - 1])])
                held += int(ends[hi - 1]) - begin
                if held >= shard_tokens or hi < len(doc_ids):
                    yield flush()
                    shard += 1
                    held_docs, held_sizes, held_ids, held = [], [], [], 0
                lo = hi
        if held_docs:
            yield flush()

    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, shard int, n_tokens long, body binary").write.parquet(out)


def read_token_shards(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files below ``out``."""
    files = spark.read.schema("part int, shard int, n_tokens long, body binary").parquet(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, body in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "body")), strict=True):
                doc_ids, sizes, matrix = open_shard(body)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()),
                     pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "shard", "body").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # starts: partition totals in order (one row each), then shards within their partition
    sizes = files.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("p"))
    starts = sizes.withColumn("s", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("p") + F.col("s")).alias("base"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
