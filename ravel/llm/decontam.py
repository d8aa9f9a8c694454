"""Benchmark decontamination: size-partitioned MinHash containment search.

Both sides are sets of 5-word shingles (lower-cased A-Z, words split at ASCII
white space).  A document is contaminated by a test item when it holds at
least ``threshold`` of the item's shingles.

Items are partitioned by set size.  A partition whose largest item has u
shingles keeps, for each of its items, the ``u - ceil(threshold * u) + 1``
smallest shingle hashes: a document that misses all of an item's minima misses
too many shingles to reach the threshold, so the search loses nothing however
long the document is (MinHash banding over whole documents would: the Jaccard
similarity of a 30-shingle item and a 20,000-word document is near zero).
Candidates are verified by exact containment.

The items are a query set answered in blocks of at most ``BLOCK_CHARS`` characters
(an item longer than that is a block's own part), each sent to the tasks;
documents are streamed through once per block and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import empty_like, shingle_hashes, slices, text_bytes
from ravel.llm.jaccard import SHINGLES_SQL

BLOCK_CHARS = 8_000_000
_FILTER_BITS = 22


class ItemIndex:
    """Minima of a block of items, by size partition, and the items' whole shingle sets."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float):
        self.threshold = threshold
        ids, self.sets = [], []
        for item_id, text in items:
            found = np.unique(shingle_hashes(text))
            if len(found):
                ids.append(item_id)
                self.sets.append(found)
        self.ids: list[int | None] = ids
        sizes = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.array([math.ceil(round(threshold * n, 9)) for n in sizes], np.int64)
        minima, owners = [], []
        for part in np.unique(np.frexp(sizes.astype(float))[1]):  # sizes from 2^(k-1) up to 2^k
            members = np.flatnonzero(np.frexp(sizes.astype(float))[1] == part)
            largest = int(sizes[members].max())
            keep = largest - math.ceil(round(threshold * largest, 9)) + 1
            for i in members:
                minima.append(self.sets[i][:keep])
                owners.append(np.full(len(minima[-1]), i, np.int64))
        flat = np.concatenate(minima) if minima else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.minima, self.owners = flat[order], (np.concatenate(owners)[order] if owners else np.empty(0, np.int64))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.minima >> np.uint64(64 - _FILTER_BITS)] = True

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(item, shingles held, item's shingles)`` of every item that ``text`` holds to the threshold."""
        h = shingle_hashes(text)
        h = h[self.maybe[h >> np.uint64(64 - _FILTER_BITS)]]
        lo = np.searchsorted(self.minima, h, "left")
        hit = (lo < len(self.minima)) & (self.minima[np.minimum(lo, len(self.minima) - 1)] == h)
        if not hit.any():
            return []
        whole = np.unique(shingle_hashes(text))
        hi = np.searchsorted(self.minima, h[hit], "right")
        candidates = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo[hit], hi, strict=True)]))
        out = []
        for i in candidates:
            at = np.searchsorted(whole, self.sets[i])
            held = int((whole[np.minimum(at, len(whole) - 1)] == self.sets[i]).sum())
            if held >= self.need[i]:
                out.append((self.ids[i], held, len(self.sets[i])))
        return out


def _blocks(items: DataFrame, threshold: float, block_chars: int) -> Iterator[ItemIndex]:
    """An index for each block of the items (``item_id``, ``text``)."""
    tests = items.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    n_blocks = math.ceil((tests.agg(F.sum(F.length("t"))).first()[0] or 0) / block_chars)
    for block in range(n_blocks):
        rows = tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).collect()
        yield ItemIndex([(r["i"], r["t"].encode()) for r in rows], threshold)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds no item to the threshold; columns as they came.

    Cases as in :func:`contaminated_documents`; rows without text stay.
    """
    for index in _blocks(items, threshold, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                stays = [not sent.value.search(text) for text in text_bytes(batch.column("text"))]
                yield batch.filter(pa.array(stays, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def contaminated_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item_shingles, containment)``, a row per contaminated document and item.

    Null, empty and all-blank texts have no shingles and match nothing; a text or
    item of fewer than five words is one shingle, its whole word sequence.  Rows
    with a null id give rows with that null id.  Repeated rows give repeated
    result rows; empty tables give an empty result.  Other columns are ignored.
    """
    schema = "doc_id long, item_id long, n_shared long, n_item_shingles long, containment double"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = empty_like(docs.sparkSession, schema)
    for index in _blocks(items, threshold, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches, "text"):
                found = [
                    (doc, *hit)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True)
                    for hit in index.search(text)
                ]
                if found:
                    d, i, held, size = (list(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in (d, i, held, size)]
                        + [pa.array([a / b for a, b in zip(held, size, strict=True)], pa.float64())],
                        names=["doc_id", "item_id", "n_shared", "n_item_shingles", "containment"],
                    )

        result = result.union(source.mapInArrow(probe, schema))
    return result


CONTAMINATED_SQL = (
    "WITH d AS (" + SHINGLES_SQL.format(t="documents", i="doc_id") + "), i AS (" + SHINGLES_SQL.format(t="benchmark", i="item_id") + r"""),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
p AS (SELECT d.doc_id, i.item_id, count(*) AS c FROM d JOIN i ON d.sh = i.sh GROUP BY 1, 2)
SELECT p.doc_id, p.item_id, p.c AS n_shared, n.n AS n_item_shingles, p.c::DOUBLE / n.n AS containment
FROM p JOIN n ON n.item_id = p.item_id WHERE 10 * p.c >= 8 * n.n
"""
)
