"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing: every token has a fixed sparse ternary index vector (drawn from
a hash of the token); a token's context vector is the sum of the index vectors of
its neighbours over the whole corpus.  Tokens are hashed to ``WORDS`` word slots and
``SHAPES`` slots of letter shapes (``Word,`` -> ``Aa,``), so the table of context
vectors has a fixed size whatever the corpus, and may be sent to every task.
A task adds up its documents in one table of integers and ships it in ``PARTS`` compressed parts, so the sums are
exact whatever their order.

A document is pooled to the mean and the spread of its tokens' vectors.  A
two-layer numpy network reads the pool; its temperature is fitted on training
rows that the network has not seen.  At most ``TRAIN_ROWS`` labelled rows, the
smallest by a hash of doc_id, are used for the fit; held-out rows
(crc32(doc_id) mod 5 = 0) never are.  Labels, lang, source and doc_id are no input of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import arrow_rows, slices, texts

WORDS, SHAPES, DIM, NONZERO, WINDOW = 1 << 14, 1 << 11, 32, 4, 2
SLOTS = WORDS + SHAPES
PARTS = 16
TRAIN_ROWS = 10_000
HIDDEN, EPOCHS = 32, 60
ACCEPT_AT = 0.3
_RUNS = regex.compile(r"(\p{Lu})+|(\p{L})+|(\p{N})+|([^\p{L}\p{N}])\4*")


def shape_of(raw: str) -> str:
    """Runs of capitals as A, of other letters as a, of digits as 0, of any sign as that sign; plain words with a sign at most are told without a search."""
    for body, tail in ((raw, ""), (raw[:-1], raw[-1])):
        if body.isalpha():
            if tail and (tail.isalnum() or not tail.isascii()):
                break
            if body.islower():
                return "a" + tail
            if body[0].isupper() and (len(body) == 1 or body[1:].islower()):
                return ("A" if len(body) == 1 else "Aa") + tail
    return "".join("A" if m[1] else "a" if m[2] else "0" if m[3] else m[4] for m in _RUNS.finditer(raw))


@lru_cache(maxsize=50_000)
def _shape_slot(shape: str) -> int:
    return xxhash.xxh3_64_intdigest(shape.encode()) % SHAPES


class _Tokens(dict):
    """Slots of a raw word, word slot and shape slot in one number; kept for words seen lately."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        word = xxhash.xxh3_64_intdigest(raw.lower().encode()) % WORDS
        key = self[raw] = word * SHAPES + _shape_slot(shape_of(raw))
        return key


_tokens = _Tokens()


def token_slots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word slots and shape slots of a whole text, in order."""
    raw = text.split()
    keys = np.fromiter(map(_tokens.__getitem__, raw), np.int64, len(raw))
    return keys // SHAPES, WORDS + keys % SHAPES


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of every slot: NONZERO entries of +-1; fixed by the seed."""
    rng = np.random.default_rng(20_24)
    at = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    out = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (SLOTS, NONZERO)), 1)
    return out


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all slots over all documents, rows scaled to length one (untouched rows are zero)."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.concatenate([index_vectors(), np.zeros((1, DIM), np.float32)])  # the last row is no token
        table, used = np.zeros((SLOTS, DIM), np.int64), False
        for batch in slices(batches, "text"):
            runs = [token_slots(t) for t in texts(batch.column("text"))]
            if not any(len(w) for w, _ in runs):
                continue
            used = True
            gap = np.full(WINDOW, SLOTS)  # so that no window reaches into the next document
            words = np.concatenate([gap, *(x for w, _ in runs for x in (w, gap))])
            shapes = np.concatenate([gap, *(x for _, s in runs for x in (s, gap))])
            own = index[words] + index[shapes]
            around = np.zeros_like(own)
            for off in range(1, WINDOW + 1):
                around[off:] += own[:-off]
                around[:-off] += own[off:]
            for slots in (words, shapes):
                order = np.argsort(slots.astype(np.uint16), kind="stable")
                kinds, first = np.unique(slots[order], return_index=True)
                sums = np.add.reduceat(around[order], first, axis=0)  # integers below 2**24, so exact
                table[kinds[kinds < SLOTS]] += sums[kinds < SLOTS].astype(np.int64)
        if used:
            for part, piece in enumerate(np.array_split(table, PARTS)):
                yield arrow_rows({"part": ([part], pa.int32()), "body": ([zlib.compress(piece.tobytes(), 1)], pa.binary())})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in rows:
            for body in frame["body"]:
                piece = np.frombuffer(zlib.decompress(body), np.int64)
                total = piece if total is None else total + piece
        yield pd.DataFrame({"part": [key[0]], "body": [total.tobytes()]})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "part int, body binary")
    # a part is met in two steps, so that no task reads a table from every other task
    salted = parts.withColumn("salt", F.spark_partition_id() % 16)

    def add_some(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in add(key, rows):
            yield pd.DataFrame({"part": [key[0]], "body": [zlib.compress(frame["body"][0], 1)]})

    some = salted.groupBy("part", "salt").applyInPandas(add_some, "part int, body binary")
    table = np.zeros((SLOTS, DIM))
    rows = {r["part"]: r["body"] for r in some.groupBy("part").applyInPandas(add, "part int, body binary").collect()}
    if rows:
        table = np.concatenate([np.frombuffer(rows[p], np.int64).reshape(-1, DIM) for p in range(PARTS)]).astype(np.float64)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pool(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors and of the shape vectors of a whole text; zeros for an empty one."""
    words, shapes = token_slots(text)
    if not len(words):
        return np.zeros(4 * DIM, np.float32)
    out = []
    for slots in (words, shapes):
        seen, times = np.unique(slots, return_counts=True)
        share = (times / len(slots)).astype(np.float32)
        v = vectors[seen]
        mean = share @ v
        out += [mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))]
    return np.concatenate(out)


class QualityNet:
    """Two layers over the pooled vectors; probabilities are calibrated by one temperature."""

    def __init__(self, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> QualityNet:
        """Adam on the rows outside ``calibrate``; the temperature on the rows inside."""
        net = cls(x.shape[1])
        fx, fy = x[~calibrate].astype(float), y[~calibrate].astype(float)
        if not len(fx):
            return net
        net.mean, net.scale = fx.mean(0), fx.std(0) + 1e-4
        z = (fx - net.mean) / net.scale
        rng, n = np.random.default_rng(11), len(z)
        m, v, step = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(n), max(1, n // 128)):
                a, t = z[rows], fy[rows]
                h = np.tanh(a @ net.w[0] + net.w[1])
                miss = (1 / (1 + np.exp(-np.clip(h @ net.w[2] + net.w[3][0], -35, 35))) - t) / len(rows)
                back = miss[:, None] * net.w[2][None, :] * (1 - h * h)
                slopes = [a.T @ back + 1e-4 * net.w[0], back.sum(0), h.T @ miss + 1e-4 * net.w[2], np.array([miss.sum()])]
                step += 1
                for i, g in enumerate(slopes):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    net.w[i] = net.w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if calibrate.any():
            raw, t = net.logits(x[calibrate].astype(float)), y[calibrate]
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, np.where(t > 0, -raw, raw) / g)) for g in grid]
            net.temperature = float(grid[int(np.argmin(loss))])
        return net


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _pools(source: DataFrame, vectors: np.ndarray, extra: dict[str, str]) -> DataFrame:
    """``extra`` columns beside the pooled vector of every text."""
    sent = source.sparkSession.sparkContext.broadcast(vectors)
    names = list(extra)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body = [pool(t, sent.value).astype(np.float32).tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(body, pa.binary())], names=[*names, "body"])

    schema = ", ".join(f"{n} {t}" for n, t in extra.items()) + ", body binary"
    return source.select(*names, "text").mapInArrow(gather, schema)


class QualityModel:
    def __init__(self, vectors: np.ndarray, net: QualityNet):
        self.vectors, self.net = vectors, net


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Context vectors over all of ``docs``; the network on at most ``train_rows`` labelled rows outside the held-out fold."""
    vectors = context_vectors(docs)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # the label rows are at most train_rows, so sending them to every task is bounded
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = _pools(sample, vectors, {"doc_id": "long", "y": "int"}).toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(b, np.float32) for b in rows.column("body").to_pylist()]).reshape(-1, 4 * DIM)
    ids = rows.column("doc_id").to_pylist()
    calibrate = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % 6 == 0 for i in ids], bool)
    return QualityModel(vectors, QualityNet.fit(x, np.array(rows.column("y").to_pylist(), np.int64), calibrate))


def score_quality(docs: DataFrame, model: QualityModel, accept_at: float = ACCEPT_AT, keep: bool = False) -> DataFrame:
    """Score every row of ``docs``.

    Returns ``(doc_id, held_out, score, predicted)``; with ``keep`` the rows of
    ``docs`` instead that are accepted (score >= ``accept_at``), columns as they came.
    A null or empty text pools to zeros and is scored as such; repeated rows are
    scored each; a null doc_id counts as not held out; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        return sent.value.net.score(np.array([pool(t, sent.value.vectors) for t in texts(batch.column("text"))], float))

    if keep:
        def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield batch.filter(pa.array(scores(batch) >= accept_at))

        return docs.mapInArrow(accept, docs.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = scores(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= accept_at).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return source.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
