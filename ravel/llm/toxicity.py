"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered integers 0..K-1.  One weight vector w over hashed word
features is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1 < ...; the expected severity is the sum of these
probabilities.  Features are the distinct words (lower-cased, punctuation cut
off) of the whole text and their beginnings of 3 to 6 characters, hashed to
2^18 slots, present or absent.  Training is proximal gradient descent with an
L1 penalty, so only features that carry evidence keep a weight and long clean
texts don't add up noise; what is kept is then fitted again without the penalty.

The fit uses at most ``TRAIN_ROWS`` labelled rows, the smallest by a hash of
doc_id (a bounded sample by parameter); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import arrow_rows, slices, texts

TRAIN_ROWS = 8_000
SLOTS = 1 << 18
STEPS = 400
L1 = 2e-4
FLAG_AT = 0.3
PREFIXES = (3, 4, 5, 6)
_EDGES = regex.compile(r"^[\W_]+|[\W_]+$")


class _Slots(dict):
    """Feature slots of a raw word (none if nothing is left of it), kept for words seen lately."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        core = _EDGES.sub("", word)
        parts = [core, *(f"{core[:n]}*" for n in PREFIXES if len(core) > n)] if core else []
        slots = self[word] = tuple(xxhash.xxh3_64_intdigest(p.encode()) & (SLOTS - 1) for p in parts)
        return slots


_slots = _Slots()


def features(text: str) -> np.ndarray:
    """Sorted feature slots of a whole text."""
    found = set(chain.from_iterable(map(_slots.__getitem__, set(text.lower().split()))))
    return np.sort(np.fromiter(found, np.int64, len(found)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _descend(row, col, above, w, theta, steps, l1):
    """Accelerated proximal gradient on the cumulative-link log loss; a little L2 keeps weights finite."""
    n, width = len(above), above.shape[1]
    share = np.bincount(col, minlength=len(w)) / n
    # the step of a word falls with the share of documents that hold it
    rate = np.minimum(0.08 / (width * np.maximum(share, 1e-9)), 40.0)
    look, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(row, weights=look[col], minlength=n)
        miss = _sigmoid(z[:, None] - theta[None, :]) - above
        slope = np.bincount(col, weights=miss.sum(1)[row], minlength=len(w)) / n + 1e-4 * share * look
        step = look - rate * slope
        new = np.sign(step) * np.maximum(np.abs(step) - l1 * rate, 0)
        if np.dot(look - new, new - w) > 0:  # the momentum overshoots: start it again
            look, t = new.copy(), 1.0
        else:
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, t = new + (t - 1) / after * (new - w), after
        w = new
        theta = np.sort(theta + miss.mean(0) * 0.5)
    return w, theta


class OrdinalModel:
    """Shared sparse weights and ordered thresholds."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.dense = np.zeros(SLOTS, np.float64)
        self.dense[slots] = weights
        self.thresholds = thresholds

    @classmethod
    def fit(cls, docs: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, l1: float = L1) -> OrdinalModel:
        """Learn which slots matter, then their weights and the thresholds."""
        k = int(grades.max(initial=0)) + 1
        if not len(docs) or k < 2:
            return cls(np.empty(0, np.int64), np.empty(0), np.full(max(1, k - 1), 30.0))
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs) if sizes.sum() else np.empty(0, np.int64)
        slots, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), sizes)
        above = (grades[:, None] > np.arange(k - 1)[None, :]).astype(float)
        share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
        theta = -np.log(share / (1 - share))
        # screening: a slot stays if three documents hold it and their grades lie 2 standard errors off the mean
        excess = np.bincount(col, weights=(above - share).sum(1)[row], minlength=len(slots))
        error = np.sqrt(seen * (above.sum(1).var() + 1e-12))
        alive = (seen >= 3) & (np.abs(excess) >= 2 * error)
        kept = alive[col]
        row, col = row[kept], (np.cumsum(alive) - 1)[col[kept]]
        slots = slots[alive]
        w = np.zeros(len(slots))
        w, theta = _descend(row, col, above, w, theta, steps, l1)
        alive = w != 0
        kept = alive[col]
        row, col = row[kept], (np.cumsum(alive) - 1)[col[kept]]
        slots = slots[alive]
        w, theta = _descend(row, col, above, w[alive], theta, steps // 2, 0.0)
        return cls(slots, w, theta)

    def above(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return _sigmoid(self.dense[found].sum() - self.thresholds)


def _in_train(doc_id: str) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``train_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade"))
        .where("doc_id is not null and grade >= 0").where(_in_train("doc_id"))
        .groupBy("doc_id").agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t).astype(np.int32).tobytes() for t in texts(batch.column("text"))]
            yield arrow_rows({"grade": (batch.column("grade"), pa.int32()), "found": (found, pa.binary())})

    # the label rows are at most train_rows, so sending them to every task is bounded
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.select("text", "grade").mapInArrow(gather, "grade int, found binary").toArrow()
    order = sorted(zip(rows.column("grade").to_pylist(), rows.column("found").to_pylist(), strict=True))
    sets = [np.frombuffer(b, np.int32).astype(np.int64) for _, b in order]
    return OrdinalModel.fit(sets, np.array([g for g, _ in order], np.int64))


def score_toxicity(docs: DataFrame, model: OrdinalModel, flag_at: float = FLAG_AT) -> DataFrame:
    """``(doc_id, held_out, expected_severity, grade, toxic)`` for every row of ``docs``.

    ``grade`` counts the thresholds passed with probability 1/2 or more; ``toxic``
    is P(grade > 0) >= ``flag_at``.  A null or empty text has no features and gets
    the base rates.  Repeated rows are scored each; other columns are ignored.
    """
    schema = "doc_id long, held_out boolean, expected_severity double, grade int, toxic boolean"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text"):
            p = np.array([model.above(features(t)) for t in texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p.sum(1), pa.float64()),
                 pa.array((p >= 0.5).sum(1), pa.int32()), pa.array(p[:, 0] >= flag_at, pa.bool_())],
                names=["doc_id", "held_out", "expected_severity", "grade", "toxic"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~_in_train("doc_id"), F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(score, schema)
