"""Substring dedup by content-defined chunks with a gear rolling hash.

The gear hash adds a fixed random number per byte and shifts by one bit a byte; here it rolls over
``GEAR`` bytes.  Borders lie at beginnings of words: of each ``WINDOW`` words in a row, the one at
whose end the gear hash is smallest (the last of equal ones) begins a chunk.  So chunks vary with the content, only bytes
nearby decide, and an insertion moves the borders around it and no others.  Chunks of more than ``LONGEST`` bytes are cut there.  Chunks
are deduplicated by 128-bit digest of the chunk or, where it is shorter, the ``ANCHOR`` words from
its beginning, as single words are found anywhere.

A span is a run of neighbouring chunks that other documents hold as well, of at least
``MIN_WORDS`` words.  A repeated passage of n whole words has its first common border among the ``WINDOW`` words after its first ``GEAR`` bytes and its last among its last
``WINDOW``, whatever stands around it, and the same borders between; ``GEAR`` bytes begin six words at most.  So
its span has n - 30 words at least, and none of more than 50 words falls below ``MIN_WORDS``.
At its beginning a span may lack up to ``GEAR`` bytes and ``WINDOW`` words of the passage, at its end ``WINDOW`` words.  Each chunk belongs to the
smallest doc_id that holds it; a span is dropped where its chunks belong to others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import arrow_rows, mix64, slices, text_bytes
from ravel.operators.joins import join_per_key

MIN_WORDS = 20
SLICE = 1 << 20
WINDOW, GEAR, ANCHOR, LONGEST = 12, 12, 5, 1024
_GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_begins(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    return np.flatnonzero(~space & np.append(True, space[:-1]))


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash of the last ``GEAR`` (12) bytes at every byte (of fewer at the beginning)."""
    one = _GEAR[raw]

    def longer(near: np.ndarray, far: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` bytes and of those that ``far`` has before them."""
        out = near.copy()
        out[size:] += far[:-size] << np.uint64(size)
        return out

    two = longer(one, one, 1)
    four = longer(two, two, 2)
    eight = longer(four, four, 4)
    return longer(eight, four, 8)


def borders(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last one at its end."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    begins = word_begins(raw)
    whole = np.array([0, n])
    if len(begins) > WINDOW:
        space = _SPACE[raw]
        ends = np.flatnonzero(~space & np.append(space[1:], True))
        least = mix64(gear_hashes(raw)[ends])  # equal hashes only make more borders
        at = np.arange(len(begins))
        for step in (1, 2, 4, WINDOW - 8):  # after the doublings the smallest of 8 words, then of WINDOW
            later = least[step:] <= least[:-step]
            least = np.where(later, least[step:], least[:-step])
            at = np.where(later, at[step:], at[:-step])
        whole = np.union1d(whole, begins[at])
    gaps = np.flatnonzero(np.diff(whole) > LONGEST)
    if len(gaps):
        extra = np.concatenate([np.arange(whole[g] + LONGEST, whole[g + 1], LONGEST) for g in gaps])
        back = (raw[extra] & 0xC0) == 0x80
        while back.any():
            extra = extra - back
            back = (raw[extra] & 0xC0) == 0x80
        whole = np.union1d(whole, extra)
    return whole[1:]


def keyed_chunks(text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of a text's chunks: the border before each and the end, digests, and words begun before each border."""
    raw = np.frombuffer(text, np.uint8)
    cuts = np.append(0, borders(raw))
    begins = word_begins(raw)
    begun = np.searchsorted(begins, cuts)
    reach = np.append(begins, len(raw))[np.minimum(begun[:-1] + ANCHOR, len(begins))]
    ends = np.maximum(cuts[1:], np.minimum(reach, cuts[:-1] + LONGEST))
    return cuts, [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(cuts[:-1].tolist(), ends.tolist(), strict=True)], begun


_CHUNKS = "h1 long, h2 long, doc_id long, start int, size int, words int"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Every chunk of every row: digest, doc_id, first code point, code points, words begun."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            digests, ids, starts, sizes, words = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                if not text:
                    continue
                cuts, keys, begun = keyed_chunks(text)
                digests += keys
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[cuts]
                ids.append(np.full(len(keys), doc if doc is not None else -1, np.int64))
                starts.append(points[:-1])
                sizes.append(np.diff(points))
                words.append(np.diff(begun))
            if digests:
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield arrow_rows({
                    "h1": (both[:, 0], pa.int64()), "h2": (both[:, 1], pa.int64()), "doc_id": (np.concatenate(ids), pa.int64()),
                    **{c: (np.concatenate(v).astype(np.int32), pa.int32()) for c, v in (("start", starts), ("size", sizes), ("words", words))},
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, _CHUNKS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, n_words, n_words_dropped, owner_id, dropped)``: the repeated spans of every document.

    ``start`` and ``end`` are code points, end exclusive; ``n_words`` counts words begun
    in the span, ``n_words_dropped`` those in chunks that belong to a smaller
    doc_id; ``owner_id`` is the smallest owner in the span; ``dropped`` is
    whether any of it goes.  Documents without repeated spans have no row.
    Null, empty and short texts have none; rows with a null doc_id are left
    out; rows that share a doc_id are one document; empty tables give no rows.
    """
    chunks = chunk_rows(docs)
    per_doc = chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held"))
    # two documents hold a chunk exactly when its smallest and its largest doc_id differ
    repeated = per_doc.where("owner < last").select("h1", "h2", "owner", "held")
    # a passage in a third of all documents is no hot task: the rows of its chunks are dealt over salts
    held = join_per_key(chunks, repeated, ["h1", "h2"], "held", spread=["doc_id", "start"]).select("doc_id", "start", "size", "words", "owner")
    # a document's chunks come in order, so a run is followed from batch to batch without gathering it
    dealt = held.repartition("doc_id").sortWithinPartitions("doc_id", "start")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = np.empty((6, 0), np.int64)  # the last run, which may go on: doc, start, end, words, words lost, owner
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, size, words, owner = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "size", "words", "owner"))
            rows = np.stack([doc, start, start + size, words, np.where(owner != doc, words, 0), owner])
            rows = np.concatenate([pending, rows], axis=1)
            first = np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] > rows[2, :-1]))
            at = np.flatnonzero(first)
            whole = np.stack([rows[0, at], rows[1, at], np.maximum.reduceat(rows[2], at), np.add.reduceat(rows[3], at),
                              np.add.reduceat(rows[4], at), np.minimum.reduceat(rows[5], at)])
            pending = whole[:, -1:]
            yield from spans(whole[:, :-1])
        yield from spans(pending)

    def spans(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = whole[:, whole[3] >= min_words]
        if kept.shape[1]:
            names = ["doc_id", "start", "end", "n_words", "n_words_dropped", "owner_id", "dropped"]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in kept), pa.array(kept[4] > 0, pa.bool_())], names=names)

    return dealt.mapInArrow(runs, "doc_id long, start long, end long, n_words long, n_words_dropped long, owner_id long, dropped boolean")
