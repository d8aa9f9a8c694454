"""Embedding whitening by a matrix-free block Jacobi-Davidson eigensolver.

The covariance is never formed.  The solver sees it through centred products
``V Z``: one Spark job per block of a few columns, in which every task centres its rows
and multiplies them twice, and the partial products are summed by Spark.  So the
driver holds blocks of (dimension x a few columns) only.

Each outer step solves the correction equations

    (I - Q Q^T) (V - theta I) (I - Q Q^T) t = -r

for all Ritz pairs that have not converged, Q being the locked vectors and the
pair's own; the MINRES recurrences of the pairs run side by side, so that an inner step is
one product for all.  The corrections widen the search space, Rayleigh-Ritz follows,
pairs whose residual is down to double precision are locked, and a space that has become
too wide shrinks to its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import arrow_rows, scratch_table

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
LARGEST = 2**52  # integers up to here, and their differences, are exact as doubles
BLOCK_ROWS = 512
INNER, OUTER = 8, 100
_EPS = np.finfo(np.float64).eps

Product = Callable[[np.ndarray], np.ndarray]


def fixed_point(values: np.ndarray) -> np.ndarray:
    """``floor(1024 c) + 100000`` as long; the caller leaves out what is too large."""
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + SHIFT


def usable(column: pa.ListArray, dim: int | None = None) -> np.ndarray:
    """Rows whose vector holds something, no nulls and only finite numbers within the fixed-point range (and ``dim`` of them)."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = sizes > 0 if dim is None else sizes == dim
    flat = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        bad = ~(np.abs(flat * SCALE) < LARGEST)
    owner = np.repeat(np.arange(len(column)), np.where(pc.is_null(column).to_numpy(zero_copy_only=False), 0, sizes))
    return good & (np.bincount(owner[bad], minlength=len(column)) == 0)


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The usable rows of a batch, few at a time, and their x-vectors."""
    at = np.flatnonzero(usable(batch.column("embedding"), dim))
    for lo in range(0, len(at), BLOCK_ROWS):
        part = batch.take(pa.array(at[lo : lo + BLOCK_ROWS]))
        flat = part.column("embedding").cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
        yield part, fixed_point(flat).reshape(-1, dim)


class Fit:
    """The fit list: its blocks of x-vectors, their number n, sums S and the products with its covariance."""

    def __init__(self, vectors: DataFrame):
        self.source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.dim = self._dimension()
        self.n, self.sums = 0, [0] * self.dim
        if self.dim:
            self.blocks = scratch_table(self.source.select("embedding").mapInArrow(_to_blocks(self.dim), "body binary"), "whitening-blocks")
            self._add_up()
        if self.n:
            whole = [s // self.n for s in self.sums]
            self.base = np.array(whole, np.int64)
            self.rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def _dimension(self) -> int:
        """The length of most usable vectors (the larger of equally many), 0 without any."""
        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.list_value_length(batch.column("embedding")).filter(pa.array(usable(batch.column("embedding"))))
                values, counts = np.unique(sizes.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                yield arrow_rows({"dim": (values, pa.int64()), "n": (counts, pa.int64())})

        counts = self.source.select("embedding").mapInArrow(lengths, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
        most = counts.orderBy(F.desc("n"), F.desc("dim")).first()
        return most["dim"] if most else 0

    def _add_up(self) -> None:
        """n and S: exact, as sums of the high and low halves of the entries."""
        dim = self.dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((2, dim), np.int64)
            for x in _blocks(batches, dim):
                n += len(x)
                total += np.stack([(x >> 26).sum(0), (x & (2**26 - 1)).sum(0)])
            if n:
                yield arrow_rows({"i": (np.arange(2 * dim + 1), pa.int32()), "v": (np.append(total.ravel(), n), pa.int64())})

        parts = self.blocks.mapInArrow(sums, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        found = {r["i"]: int(r["v"]) for r in parts.collect()}  # 2 x dimension + 1 numbers
        if found:
            self.n = found[2 * dim]
            self.sums = [(found[i] << 26) + found[dim + i] for i in range(dim)]

    def _reduced(self, shape: tuple[int, int], per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all centred blocks of what ``per_block`` makes of them; only that sum comes to the driver."""
        dim, base, rest, size = self.dim, self.base, self.rest, shape[0] * shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x in _blocks(batches, dim):
                total += per_block((x - base).astype(np.float64) - rest)
            yield arrow_rows({"i": (np.arange(size), pa.int32()), "v": (total.ravel(), pa.float64())})

        out = np.zeros(size)
        for r in self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out.reshape(shape)

    def product(self, z: np.ndarray) -> np.ndarray:
        """``V z`` for the covariance V, divisor n."""
        z = np.ascontiguousarray(z)
        return self._reduced(z.shape, lambda c: c.T @ (c @ z)) / self.n

    def trace(self) -> float:
        return float(self._reduced((1, 1), lambda c: np.array([[np.square(c).sum()]]))[0, 0] / self.n)

    def whitened_error(self, weights: np.ndarray) -> float:
        """Largest absolute entry of (covariance of the rows times ``weights``) minus the identity."""
        k = weights.shape[1]
        mean = self._reduced((1, k), lambda c: (c @ weights).sum(0, keepdims=True)) / self.n

        def outer(c: np.ndarray) -> np.ndarray:
            w = c @ weights - mean
            return w.T @ w

        return float(np.abs(self._reduced((k, k), outer) / self.n - np.eye(k)).max())


def _to_blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _rows(batch, dim):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["body"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for body in batch.column("body"):
            yield np.frombuffer(body.as_buffer(), "<i8").reshape(-1, dim)


def orthonormal(new: np.ndarray, against: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors that span, beside the orthonormal ``against``, the columns of ``new``; columns without anything new give way to random ones."""
    basis, dim = against, len(against)
    out = np.empty((dim, 0))
    for v in new.T:
        for _ in range(4):
            size = np.linalg.norm(v)
            if size and np.isfinite(size):
                v = v / size
                for _ in range(2):
                    v = v - basis @ (basis.T @ v)
                if np.linalg.norm(v) > 1e-8:
                    v = v / np.linalg.norm(v)
                    v = v - basis @ (basis.T @ v)
                    v = (v / np.linalg.norm(v))[:, None]
                    basis, out = np.hstack([basis, v]), np.hstack([out, v])
                    break
            if basis.shape[1] >= dim:
                return out
            v = rng.standard_normal(dim)
    return out


def minres(apply: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of independent symmetric systems, one per column; ``apply`` takes all columns at once.

    The Lanczos recurrence with Givens rotations; a column whose recurrence ends, or whose residual is below
    ``tolerance`` of its right side, stays as it is.
    """
    k = b.shape[1]
    x, beta1 = np.zeros_like(b), np.linalg.norm(b, axis=0)
    safe = lambda a: np.where(a > 0, a, 1.0)
    old, v, beta = np.zeros_like(b), b / safe(beta1), np.zeros(k)
    w_old, w, phi = np.zeros_like(b), np.zeros_like(b), beta1.copy()
    cs, sn, dbar, eps = -np.ones(k), np.zeros(k), np.zeros(k), np.zeros(k)
    live = beta1 > 0
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * old
        after = np.linalg.norm(p, axis=0)
        delta, gbar = cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps_now, eps, dbar = eps, sn * after, -cs * after
        gamma = np.hypot(gbar, after)
        ended = gamma <= _EPS * beta1
        cs, sn = np.where(ended, cs, gbar / safe(gamma)), np.where(ended, sn, after / safe(gamma))
        w_old, w = w, (v - eps_now * w_old - delta * w) / safe(gamma)
        step = live & ~ended
        x = x + np.where(step, cs * phi, 0.0) * w
        phi = phi * sn
        live = step & (np.abs(phi) > tolerance * beta1) & (after > _EPS * np.abs(alpha))
        old, v, beta = v, p / safe(after), after
    return x


def jacobi_davidson(product: Product, dim: int, wanted: int, seed: int = 5, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator without negative ones, and their unit vectors (columns).

    Ends when every pair is locked, that is when its residual is at the rounding error of a
    product, ``8 eps sqrt(dim)`` of the largest eigenvalue, or has stopped falling within a hundred times that.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    least, most = min(dim, wanted + 4), min(dim, 4 * wanted + 8)
    locked, locked_av, values = np.empty((dim, 0)), np.empty((dim, 0)), []
    space = orthonormal(rng.standard_normal((dim, least)), locked, rng)
    image = product(space)
    best: dict[int, float] = {}
    for turn in range(outer):
        # Rayleigh-Ritz
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, image = space @ y, image @ y
        scale = max([abs(theta[0]) if len(theta) else 0.0, *values])
        floor = 8 * _EPS * np.sqrt(dim) * scale
        left = wanted - len(values)
        u, r = space[:, :left], image[:, :left] - space[:, :left] * theta[:left]
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        done = 0
        for j in range(left):  # in order, so that no larger value is passed over
            place = len(values) + j
            stalled = size[j] <= 100 * floor and size[j] >= 0.5 * best.get(place, np.inf)
            best[place] = min(best.get(place, np.inf), size[j])
            if size[j] > floor and not stalled:
                break
            done += 1
        full = locked.shape[1] + space.shape[1] >= dim
        if full:  # the space is whole: its Ritz pairs are the eigenpairs
            done = left
        if done:
            locked, locked_av = np.hstack([locked, space[:, :done]]), np.hstack([locked_av, image[:, :done]])
            values += theta[:done].tolist()
            space, image, u, r, theta, size = space[:, done:], image[:, done:], u[:, done:], r[:, done:], theta[done:], size[done:]
        if len(values) >= wanted:
            break
        if space.shape[1] + u.shape[1] > most:
            space, image = space[:, :least], image[:, :least]
        shift = theta[: u.shape[1]]

        def apart(t: np.ndarray, u: np.ndarray = u, locked: np.ndarray = locked) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - u * (u * t).sum(0)

        def correction(t: np.ndarray, shift: np.ndarray = shift, apart: Product = apart) -> np.ndarray:
            t = apart(t)
            return apart(product(t) - shift * t)

        # the first steps only need the way to go; close to the end an accurate solution pays
        t = minres(correction, -apart(r), 1 if turn < 2 else inner, 0.5 ** (turn + 1))
        new = orthonormal(apart(t), np.hstack([locked, space]), rng)
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((dim, 1)), np.hstack([locked, space]), rng)
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError("the eigensolver did not converge")
    small = locked.T @ locked_av
    theta, y = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], np.linalg.qr(locked @ y[:, ::-1])[0]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``vectors`` (``vec_id``, ``embedding``): one row per usable vector and component.

    Returns vec_id, component (1 has the largest eigenvalue), n, deviation, whitened, explained and
    identity_error.  Vectors that are null or empty, hold null or non-finite entries or entries of 2**42 and more
    are left out; so are those whose length isn't that of most vectors (the larger
    of equally frequent lengths).  Components without variance (an eigenvalue below 1e-12 of the largest) don't exist, so
    constant tables, single rows and empty tables give no rows.  Repeated rows and null ids
    count like any others; a deviation beyond a long is null.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit(vectors)
    if not fit.n:
        return spark.createDataFrame([], schema)
    e, u = jacobi_davidson(fit.product, fit.dim, components)
    keep = e > max(1e-12 * e[0], 0.0)
    if not keep.any():
        return spark.createDataFrame([], schema)
    e, u = e[keep], u[:, keep]
    weights = u / np.sqrt(e)
    error, explained = fit.whitened_error(weights), e / fit.trace()
    dim, n, base, rest, k = fit.dim, fit.n, fit.base, fit.rest, len(e)
    offset = np.array([s - n * int(b) for s, b in zip(fit.sums, base, strict=True)], object)  # S - n base, below n
    narrow = n < 2**20

    def deviations(x: np.ndarray) -> list[int | None]:
        d = x - base
        if narrow and np.abs(d).max() < 2**20:  # |n d - offset| < 2**41: the squares fit in two halves
            y = n * d - offset.astype(np.int64)
            hi, lo = y >> 20, y & (2**20 - 1)
            a, b, c = (hi * hi).sum(1), (hi * lo).sum(1), (lo * lo).sum(1)
            exact = [(p << 40) + (q << 21) + r for p, q, r in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
        else:
            exact = [int(v) for v in np.square(n * d.astype(object) - offset).sum(1)]
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _rows(batch, dim):
                w = ((x - base).astype(np.float64) - rest) @ weights
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n), pa.int64()),
                     pa.array([v for v in deviations(x) for _ in range(k)], pa.int64()), pa.array(w.ravel(), pa.float64()),
                     pa.array(np.tile(explained, len(x)), pa.float64()), pa.array(np.full(len(x) * k, error), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fit.source.mapInArrow(run, schema)
