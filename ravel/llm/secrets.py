"""Secret scans: patterns for the base kinds, a character network for the rest.

Base spans come from three patterns and always stay.  Further candidates are
all runs of at least ``LEAST_RUN`` letters, digits and password signs outside the base spans, plain words too.
Every candidate, base or not, is read with its surrounding context by
a convolutional network in numpy: character classes, one convolution with fixed random kernels, maximum and mean
over the positions of three zones, one output.  Labelled findings are the rows' own: values that
the patterns found are secrets, other candidates are not, unless they lie against a base span.

The output layer is fitted on every finding of every document, by weighted least squares in closed form: tasks add up
products of the pooled values, rounded to ``1 / GRAIN``, as integers, so the sums are exact whatever their order and of a fixed size.
Secrets weigh as much as all others, plain words as much as runs with digits or signs, which are far rarer.
Half of the findings, by a hash, are shown without context, so a value's own look has to count, and half cut to
a length of ``2 * LEAST_RUN`` and more, so that length alone tells nothing.
A quarter of the documents, by a hash of the text, are kept from the fit; on all of their findings the outputs are calibrated
(scale and shift), secrets and others weighing the same, by exact counts of the outputs in steps of ``1 / STEPS``.  The
threshold lies halfway between the probability that ``MIN_RECALL`` of their secrets
reach and the one that ``MIN_REFUSED`` of the others stay below, at ``LEAST_PROBABILITY`` at
least, but never so high that fewer secrets would be kept.  Where secrets or others stand on one side only, all findings serve
for both.  A candidate above the threshold becomes a span of kind ``net``.
A value of more than ``VALUE`` characters is read in overlapping windows, each with the value's context,
and has the largest of their probabilities; one of its windows, by a hash of the value, is learnt from and calibrated on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import U64, arrow_rows, mix64, slices, texts

KINDS = ("assign", "access", "hex", "net")
TRAIN_FINDINGS, GRAIN, STEPS, KEPT = 8_192, 1 << 10, 1 << 12, 4
MIN_RECALL, MIN_REFUSED, LEAST_PROBABILITY = 0.98, 0.999, 0.5
LEAST_RUN, CONTEXT, VALUE = 8, 16, 40
FILTERS, KERNEL = 24, 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=!@#$%%^&*?~-]{%d,}" % LEAST_RUN)
_WORD = re.compile(r"[A-Z]?[a-z]+[.!?]*")

# class 0 is a place without a character, the last class any other character
_CLASSES = 13
_CLASS = np.full(257, _CLASSES - 1, np.uint8)
_CLASS[0] = 0
for _k, _chars in enumerate(("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", "+/=", "._-", "\"'", ":", " \t\n\r\x0b\x0c", "!@#$%^&*?~")):
    _CLASS[[ord(_c) for _c in _chars]] = _k + 1
_WIDTH = 2 * CONTEXT + VALUE
_VIEWS_AT_ONCE = 128


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, in order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets, in the stretches between the base spans (in order of start)."""
    out, at = [], 0
    for start, _, end in [*base, (len(text), 0, len(text))]:
        if start - at >= LEAST_RUN:
            out += [m.span() for m in _RUN.finditer(text, at, start)]
        at = max(at, end)
    return out


def offsets(size: int) -> list[int]:
    """Where the windows over a value of ``size`` characters begin: every half ``VALUE``, the last one at its end."""
    return [*range(0, size - VALUE, VALUE // 2), size - VALUE] if size > VALUE else [0]


def windows(text: str, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per value from ``start`` to ``end``: character classes of the context before, up to ``VALUE`` characters of the value from its ``at``-th on, and the context after."""
    marks = np.append(_CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 256)], np.uint8(0))
    start, end, at = (np.asarray(v, np.int64)[:, None] for v in (start, end, at))
    body = start + at + np.arange(VALUE)
    where = np.concatenate([start + np.arange(-CONTEXT, 0), np.where(body < end, body, -1), end + np.arange(CONTEXT)], 1)
    return marks[np.where((where < 0) | (where >= len(text)), len(text), where)]


def views(text: str, values: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows over all values of a text, and how many each value has."""
    ends = np.array(values, np.int64).reshape(-1, 2)
    counts, at = np.ones(len(ends), np.int64), np.zeros(len(ends), np.int64)
    long = np.flatnonzero(ends[:, 1] - ends[:, 0] > VALUE)
    if len(long):
        own = {int(i): offsets(int(ends[i, 1] - ends[i, 0])) for i in long}
        counts[long] = [len(own[int(i)]) for i in long]
        at = np.zeros(counts.sum(), np.int64)
        first = np.cumsum(counts) - counts
        for i, steps in own.items():
            at[first[i] : first[i] + len(steps)] = steps
    ends = np.repeat(ends, counts, axis=0)
    return windows(text, ends[:, 0], ends[:, 1], at), counts


def _value_of(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """The value within a base span (an assignment's name is context)."""
    if kind:
        return start, end
    return end - len(_ASSIGN.match(text, start).group(2)), end


class SecretNet:
    """One convolution over one-hot classes with positions in three zones, maximum over each zone, one logit."""

    ZONES = (slice(0, CONTEXT), slice(CONTEXT, CONTEXT + VALUE), slice(CONTEXT + VALUE, _WIDTH))

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.3, (KERNEL * _CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 6 * FILTERS), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        one = np.eye(_CLASSES, dtype=np.float32)[x]
        padded = np.pad(one, ((0, 0), (KERNEL // 2, KERNEL // 2), (0, 0)))
        wide = np.lib.stride_tricks.sliding_window_view(padded, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), _WIDTH, -1)
        h = np.maximum(wide @ self.w[0].astype(np.float32) + self.w[1].astype(np.float32), 0)
        pooled = np.concatenate([p for z in self.ZONES for p in (h[:, z].max(1), h[:, z].mean(1))], 1)
        return wide, h, pooled, pooled @ self.w[2] + self.w[3][0]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The pooled values for every row, in single precision; the convolution is looked up by three and by two neighbouring classes."""
        n = _CLASSES + 1  # one more for the places beyond both ends
        w = np.zeros((KERNEL, n, FILTERS), np.float32)
        w[:, :_CLASSES] = self.w[0].reshape(KERNEL, _CLASSES, FILTERS)
        three = (w[0][:, None, None] + w[1][None, :, None] + w[2][None, None, :] + self.w[1].astype(np.float32)).reshape(-1, FILTERS)
        two = (w[3][:, None] + w[4][None, :]).reshape(-1, FILTERS)
        out = np.empty((len(x), 6 * FILTERS), np.float32)
        for lo in range(0, len(x), _VIEWS_AT_ONCE):
            # positions first, so that the sums and maxima over them run along whole rows
            c = np.pad(x[lo : lo + _VIEWS_AT_ONCE].T.astype(np.int16), ((KERNEL // 2, KERNEL // 2), (0, 0)), constant_values=_CLASSES)
            h = three.take((c[:-4] * n + c[1:-3]) * n + c[2:-2], axis=0)
            h += two.take(c[3:-1] * n + c[4:], axis=0)
            np.maximum(h, 0, out=h)
            out[lo : lo + _VIEWS_AT_ONCE] = np.concatenate([p for z in self.ZONES for p in (h[z].max(0), h[z].mean(0))], 1)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The output for every row, in single precision."""
        return self.pooled(x) @ self.w[2].astype(np.float32) + np.float32(self.w[3][0])

    def grains(self, x: np.ndarray) -> np.ndarray:
        """Pooled values as whole numbers of ``1 / GRAIN``, and a one."""
        return np.pad(np.rint(self.pooled(x).astype(float) * GRAIN), ((0, 0), (0, 1)), constant_values=GRAIN)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x).astype(float) + self.shift, -35, 35)))

    def solve(self, products: np.ndarray, counts: np.ndarray) -> None:
        """The output layer by weighted least squares, from the sums of products of :meth:`grains` and the number of findings of each of ``FOUND``."""
        others = 0.5 / max(np.count_nonzero(counts[:2]), 1)
        share = np.array([others, others, 0.5]) / np.maximum(counts, 1) / GRAIN**2
        gram = np.tensordot(share, products, 1)
        aim = np.tensordot(share * [-1, -1, 1], products[:, -1], 1)
        ridge = np.full(len(gram), 1e-5)
        ridge[-1] = 0
        w = np.linalg.solve(gram + np.diag(ridge), aim)
        self.w[2], self.w[3] = w[:-1], w[-1:]

    def calibrate(self, z: np.ndarray, t: np.ndarray, times: np.ndarray) -> None:
        """Scale, shift and threshold from outputs ``z`` with labels ``t`` met ``times`` often."""
        even = times * np.where(t > 0, 0.5 / times[t > 0].sum(), 0.5 / times[t == 0].sum())  # both labels weigh the same, as in the fit
        for _ in range(500):  # Platt scaling
            miss = even * (1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -35, 35))) - t)
            self.scale -= 0.05 * float((miss @ z) / (1 + even @ (z * z)) * 4)
            self.shift -= 0.5 * float(miss.sum())
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -35, 35)))

        def quantile(own: np.ndarray, share: float) -> float:
            order = np.argsort(p[own], kind="stable")
            upto = np.cumsum(times[own][order])
            return float(p[own][order][np.searchsorted(upto, share * (upto[-1] - 1), "right")])

        most = quantile(t > 0, 1 - MIN_RECALL)
        self.threshold = min(most, max(LEAST_PROBABILITY, (most + quantile(t == 0, MIN_REFUSED)) / 2))


#: Kinds of findings that the fit weighs: plain words, other runs, secrets.
FOUND = 3


def findings(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A window over every finding of a text, and its kind of ``FOUND``."""
    base = base_spans(text)
    borders = {a for a, _, _ in base} | {b for _, _, b in base}
    found = {(*_value_of(text, kind, a, b), 2) for a, kind, b in base}
    found |= {(a, b, 0 if _WORD.fullmatch(text, a, b) else 1) for a, b in candidates(text, base) if a not in borders and b not in borders}
    if not found:
        return np.empty((0, _WIDTH), np.uint8), np.empty(0, np.int64)
    start, end, kind = map(np.array, zip(*found, strict=True))
    at = np.zeros(len(start), np.int64)
    for i in np.flatnonzero(end - start > VALUE).tolist():  # one window of a value, the same for all its copies
        steps = offsets(int(end[i] - start[i]))
        at[i] = steps[xxhash.xxh3_64_intdigest(text[start[i] : end[i]].encode("utf-8", "replace")) % len(steps)]
    return windows(text, start, end, at), kind


def shown(x: np.ndarray) -> np.ndarray:
    """The windows as the fit sees them: half without context, half cut, by a hash of the window."""
    h = np.zeros(len(x), U64)
    for lane in np.ascontiguousarray(x).view(U64).T:
        h = mix64(h ^ lane)
    a = x.copy()
    a[np.ix_(h & U64(1) == 1, np.r_[0:CONTEXT, CONTEXT + VALUE : _WIDTH])] = 0
    size = np.where(h & U64(2) == 2, 2 * LEAST_RUN + (h >> U64(2)) % U64(VALUE - 2 * LEAST_RUN), VALUE)
    a[:, CONTEXT : CONTEXT + VALUE][np.arange(VALUE) >= size[:, None]] = 0
    return a


def _found_in(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and kinds of all findings of the batches' texts, about ``at_once`` at a time."""
    held, n = [], 0
    for batch in slices(batches, "text"):
        for text in texts(batch.column("text")):
            held.append(findings(text))
            n += len(held[-1][1])
            if n >= at_once:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def fit_secrets(docs: DataFrame, train_findings: int = TRAIN_FINDINGS) -> SecretNet:
    """Fit and calibrate on every finding of every document; about ``train_findings`` are added up at once in a task."""
    net = SecretNet()
    size = 6 * FILTERS + 1
    upper = np.triu_indices(size)
    corpus = docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(KEPT)) == 0).alias("kept")).where("text is not null")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((FOUND, len(upper[0])), np.int64), np.zeros(FOUND, np.int64)
        for x, kind in _found_in(batches, train_findings):
            g = net.grains(shown(x))
            for k in range(FOUND):
                own = g[kind == k]  # whole numbers: exact in double precision, whatever the order
                sums[k] += (own.T @ own)[upper].astype(np.int64)
                counts[k] += len(own)
        if counts.any():
            yield arrow_rows({"at": (np.arange(sums.size + FOUND), pa.int32()), "v": (np.append(sums, counts), pa.int64())})

    def sums_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(FOUND * len(upper[0]) + FOUND, np.int64)
        found = rows.mapInArrow(add, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # a fixed number of rows
        out[found.column("at").to_numpy()] = found.column("v").to_numpy()
        full = np.zeros((FOUND, size, size))
        full[:, *upper] = out[:-FOUND].reshape(FOUND, -1)
        full.transpose(0, 2, 1)[:, *upper] = full[:, *upper]
        return full, out[-FOUND:]

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.append(net.w[2], net.w[3]) * STEPS / GRAIN
        for x, kind in _found_in(batches, train_findings):
            z = np.rint(np.clip(net.grains(x) @ w, -(1 << 20), 1 << 20)).astype(np.int64)
            places, times = np.unique(z * 2 + (kind == 2), return_counts=True)
            yield arrow_rows({"at": (places, pa.int64()), "n": (times, pa.int64())})

    def seen(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The steps met (twice the step, and one more for a secret), in order, and how often: at most as many rows as there are steps."""
        found = rows.mapInArrow(outputs, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().sort_by("at")
        return found.column("at").to_numpy(), found.column("n").to_numpy()

    def both(n_others: int, n_secrets: int) -> bool:
        return bool(n_others and n_secrets)

    products, counts = sums_of(corpus.where("not kept"))
    places, times = np.empty(0, np.int64), np.empty(0, np.int64)
    if both(counts[:2].sum(), counts[2]):
        net.solve(products, counts)
        places, times = seen(corpus.where("kept"))
    if not both((places & 1 == 0).sum(), (places & 1).sum()):  # secrets or others stand on one side only
        more, n = sums_of(corpus.where("kept"))
        if not both((counts + n)[:2].sum(), (counts + n)[2]):
            return SecretNet()  # nothing to learn from: the threshold of 1 adds no span
        net.solve(products + more, counts + n)
        places, times = seen(corpus)
    net.calibrate((places >> 1) / STEPS, (places & 1).astype(float), times.astype(float))
    return net


def find_secrets(docs: DataFrame, net: SecretNet) -> DataFrame:
    """``(doc_id, spans)`` for every row: ``array<struct<kind, start, end, probability>>`` by start, then kind.

    Offsets are code points, end exclusive.  Null and empty texts have no spans; repeated rows
    are scanned each; a null id stays null; other columns are left out, whatever their names; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in slices(batches, "text"):
            spans, rows, found, parts, counts = [[] for _ in range(batch.num_rows)], [], [], [], []
            for row, text in enumerate(texts(batch.column("text"))):
                base = base_spans(text)
                own = base + [(a, 3, b) for a, b in candidates(text, base)]
                if own:
                    x, n = views(text, [(a, b) if kind else _value_of(text, kind, a, b) for a, kind, b in own])
                    rows += [row] * len(own)
                    found += own
                    parts.append(x)
                    counts.append(n)
            if found:
                n = np.concatenate(counts)
                p = np.maximum.reduceat(net.probability(np.concatenate(parts)), np.cumsum(n) - n)
                kept = (p >= net.threshold) | (np.array([kind for _, kind, _ in found]) < 3)
                for i in np.flatnonzero(kept).tolist():
                    spans[rows[i]].append((*found[i], float(p[i])))
            body = [[{"kind": KINDS[k], "start": a, "end": b, "probability": q} for a, k, b, q in sorted(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double>>"
    )


def secret_digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of :func:`find_secrets`."""
    def said(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "net")
    counts = [of_kind(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
