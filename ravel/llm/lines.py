"""Line dedup over sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; it
is handled as a 128-bit digest.  Distinct keys held by at least ``INDEX_FROM``
documents are dealt to shards; a shard is a minimal perfect hash whose slots
index a fingerprint array, a count array and an array of the largest doc_id.

Documents are dealt to blocks by a hash.  Each block's distinct digests visit the
shards they fall in and probe the arrays (a line in a third of all documents is
probed once a block, not once a document), and the few that are to go come back to
the block, where the documents drop them.  Neither lines nor documents are joined on lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import U64, bounded_batches, mix64, scratch_table, slices, text_bytes

MIN_CHARS, MIN_DOCS, INDEX_FROM = 40, 5, 2
SHARD_LINES, BLOCK_BYTES = 200_000, 2 << 20
WHITE = b" \t\n\x0b\x0c\r"
_NO_ID = -(2**63)
_GAMMA, _LEVELS = 2.0, 64


class MinimalPerfectHash:
    """Levels of bit arrays; a key's slot is the rank of the first bit that it alone has set."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.ranks = [np.cumsum(b) - b for b in bits]
        self.before = np.cumsum([0, *(int(b.sum()) for b in bits)])

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a ^ mix64(b + U64(level))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> MinimalPerfectHash:
        """Over distinct pairs of 64-bit numbers."""
        bits = []
        while len(a):
            if len(bits) == _LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(_GAMMA * len(a)))
            at = cls._place(a, b, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(bits)

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that was not built in gets any slot or -1."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, bits in enumerate(self.bits):
            at = self._place(a[todo], b[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.before[level] + self.ranks[level][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        flat = np.concatenate(self.bits) if self.bits else np.empty(0, bool)
        return [len(b) for b in self.bits], np.packbits(flat).tobytes()

    @classmethod
    def load(cls, sizes: list[int], body: bytes) -> MinimalPerfectHash:
        flat = np.unpackbits(np.frombuffer(body, np.uint8), count=sum(sizes)).astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, or None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(WHITE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, n, top)``: digest of every key, the documents (distinct doc_ids) that hold it and the largest doc_id among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, holders = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                own = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                keys += own
                holders += [_NO_ID if doc is None else doc] * len(own)
            if keys:
                a, b = _pairs(keys)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(holders, pa.int64())], names=["h1", "h2", "doc"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h1 long, h2 long, doc long")
    # a document may have several rows: its keys are counted once; the digest and the id together make no hot key
    return rows.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top"))


_INDEX = "shard long, sizes array<long>, bits binary, prints binary, counts binary, tops binary"


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """A row per shard: the minimal perfect hash and the fingerprint, count and largest-id arrays in slot order."""
    def build(key: tuple, table: pa.Table) -> pa.Table:
        a, b, n, top = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "top"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        mph = MinimalPerfectHash.build(a, b)
        slot = mph.slot(a, b)
        arrays = []
        for values, kind in ((b, "<u8"), (np.minimum(n, 2**32 - 1), "<u4"), (top, "<i8")):
            placed = np.empty(len(a), kind)
            placed[slot] = values
            arrays.append(placed.tobytes())
        sizes, bits = mph.dump()
        return pa.table([[key[0].as_py()], pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (bits, *arrays))],
                        names=["shard", "sizes", "bits", "prints", "counts", "tops"])

    return counts.withColumn("shard", F.pmod("h1", F.lit(n_shards))).groupBy("shard").applyInArrow(build, _INDEX)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (replacing columns of these names).

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all
    its lines except in rows with the largest doc_id that holds it.  Rows that share a doc_id are one
    document, and so are rows without one; a null doc_id is below all others; a null text is one empty line
    and stays null; texts without dropped lines stay as they are; an empty table
    gives an empty result.  Other columns are passed through.
    """
    if min_docs < INDEX_FROM:
        raise ValueError(f"min_docs must be at least {INDEX_FROM}")
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    block = "_block"
    while block in {c.lower() for c in names}:
        block += "_"
    size, = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    # lines of 40 characters and more in a text of so many bytes can't be more than this
    n_shards = max(1, -(-size // (SHARD_LINES * (min_chars + 1))))
    counts = scratch_table(line_counts(docs, min_chars).where(F.col("n") >= INDEX_FROM), "line-counts")
    index = build_index(counts, n_shards)

    blocked = docs.select(
        *(F.col(f"`{c}`") for c in names),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), F.lit(n_blocks)).alias(block),
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = {
                (number, key)
                for number, text in zip(batch.column(block).to_pylist(), text_bytes(batch.column("text")), strict=True)
                for key in {line_key(line, min_chars) for line in text.split(b"\n")}
                if key is not None
            }
            if seen:
                blocks, keys = zip(*seen, strict=True)
                a, b = _pairs(list(keys))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(a), pa.array(b)], names=["block", "h1", "h2"])

    probes = blocked.select(block, "text").mapInArrow(digests, "block long, h1 long, h2 long").distinct()
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(n_shards)))

    def lookup(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not (probes.num_rows and index.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("block", "h1", "h2", "top")})
        shard = index.to_pylist()[0]
        mph = MinimalPerfectHash.load(shard["sizes"], shard["bits"])
        a, b = (probes.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slot = mph.slot(a, b)
        prints, counts, tops = (np.frombuffer(shard[c], t) for c, t in (("prints", "<u8"), ("counts", "<u4"), ("tops", "<i8")))
        goes = (slot >= 0) & (prints[slot] == b) & (counts[slot] >= min_docs)
        kept = probes.select(["block", "h1", "h2"]).filter(pa.array(goes))
        return kept.append_column("top", pa.array(tops[slot[goes]], pa.int64()))

    gone = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(lookup, "block long, h1 long, h2 long, top long")

    def drop(docs: pa.Table, gone: pa.Table) -> pa.Table:
        tops = {}
        if gone.num_rows:
            both = np.stack([gone.column(c).to_numpy() for c in ("h1", "h2")], 1).astype("<i8").tobytes()
            tops = {both[16 * i : 16 * i + 16]: t for i, t in enumerate(gone.column("top").to_pylist())}
        texts, n_lines, n_dropped = [], [], []
        ids = docs.column("doc_id").cast(pa.int64()).to_pylist()
        for doc, text in zip(ids, docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            doc = _NO_ID if doc is None else doc
            stays = [line for line in lines if tops.get(line_key(line, min_chars), doc) == doc] if tops else lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stays))
            texts.append(text if len(stays) == len(lines) else b"\n".join(stays))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else docs.column(c) for c in names]
        return pa.table([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    out = docs.select(*(F.col(f"`{c}`") for c in names)).schema.add("n_lines", "long").add("n_dropped", "long")
    # groups are keyed by name, so the result columns must not clash with the key's
    return blocked.groupBy(block).cogroup(gone.groupBy("block")).applyInArrow(drop, out)


def line_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of documents after :func:`drop_repeated_lines`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


LINE_DIGESTS_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM documents)
), g AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT l.doc_id, l.i, l.line, g.top IS NOT NULL AND g.top <> l.doc_id AS gone FROM l LEFT JOIN g ON l.k = g.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
