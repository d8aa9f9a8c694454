"""Embedding near-duplicates by lattice hashing.

A vector of length one is projected at random to ``BLOCKS`` times eight dimensions;
each block is decoded to its nearest point of the E8 lattice, and the points
together name the vector's cell in a table.  There are ``TABLES`` tables with
projections of their own.  A vector resides in its own cell and also visits the
``PROBES`` nearest neighbouring cells of each table; residents of a cell meet one another and its
visitors, and every meeting is verified by cosine in double precision.

Equal vectors of a label are one class that counts as often as it has rows.  A
pair that meets more than once counts in the first table only (both cells lists
travel with the vectors), so links are counted without listing pairs.  Cells
with many vectors are cut into units of at most ``UNIT`` by ``UNIT``; a unit returns a
count per vector and one edge per vector that joins what it linked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import U64, arrow_rows, connected_components, mix64, scratch_table

LEAST_COSINE = 0.93
BLOCKS, TABLES, PROBES, WIDTH = 2, 6, 7, 0.45
UNIT = 4096
_NEAR = 4
_STRIP = 512


def _e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_ROOTS = _e8_roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: E8 is D8 together with D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=4)
def _projections(dim: int) -> np.ndarray:
    """(tables, dim, 8 * blocks), columns orthogonal where the dimension allows, scaled to keep lengths in the mean."""
    out = []
    for table in range(TABLES):
        rng = np.random.default_rng([41, dim, table])
        m = rng.normal(size=(dim, 8 * BLOCKS))
        m = np.linalg.qr(m)[0] if dim >= 8 * BLOCKS else m / np.sqrt(dim)
        out.append(m * (np.sqrt(dim / (8 * BLOCKS)) if dim >= 8 * BLOCKS else 1.0) / WIDTH)
    return np.array(out)


def cells(unit: np.ndarray) -> np.ndarray:
    """(n, tables, 1 + PROBES) 32-bit cell names of unit vectors; the own cell first, then by distance."""
    n, tables = len(unit), []
    for table, m in enumerate(_projections(unit.shape[1])):
        x = (unit @ m).reshape(n, BLOCKS, 8)
        names, far = np.full((n, 1), table + 1, np.uint64), np.zeros((n, 1))
        for k in range(BLOCKS):
            point = nearest_e8(x[:, k])
            gain = (x[:, k] - point) @ _ROOTS.T
            top = np.argsort(-gain, axis=1, kind="stable")[:, :_NEAR]
            points = np.concatenate([point[:, None], point[:, None] + _ROOTS[top]], 1)
            d = np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, top, 1)], 1)
            code = np.zeros(points.shape[:2], np.uint64)
            for axis in np.moveaxis(np.rint(points * 2).astype(np.int64).view(np.uint64), -1, 0):
                code = mix64(code + axis)
            names = mix64(names[:, :, None] * U64(0x9E3779B97F4A7C15) + code[:, None, :]).reshape(n, -1)
            far = (far[:, :, None] + d[:, None, :]).reshape(n, -1)
        order = np.argsort(far[:, 1:], axis=1, kind="stable")[:, :PROBES] + 1
        tables.append(np.concatenate([names[:, :1], np.take_along_axis(names, order, 1)], 1) >> U64(32))
    return np.stack(tables, 1).astype(np.uint32)


_SIGNED = "vec_id long, label long, dim int, vector binary, cells binary, d1 long, d2 long"


def signed_vectors(vectors: DataFrame) -> DataFrame:
    """Cells and digest of every usable vector; label, cells and vector are null for the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = part.column("embedding").to_pylist()
                arrays = [None if v is None or label is None or any(x is None for x in v) else np.array(v, np.float64) for v, label in zip(rows, part.column("label").to_pylist(), strict=True)]
                good = [i for i, v in enumerate(arrays) if v is not None and len(v) and np.isfinite(v).all() and v.any()]
                out: dict[str, list] = {c: [None] * len(rows) for c in ("dim", "vector", "cells", "d1", "d2")}
                for dim in {len(arrays[i]) for i in good}:
                    at = [i for i in good if len(arrays[i]) == dim]
                    x = np.stack([arrays[i] for i in at])
                    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for i, v, c in zip(at, x, cells(x), strict=True):
                        a, b = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), "<i8").tolist()
                        out["dim"][i], out["vector"][i], out["cells"][i], out["d1"][i], out["d2"][i] = dim, v.tobytes(), c.tobytes(), a, b
                kinds = {"dim": pa.int32(), "vector": pa.binary(), "cells": pa.binary(), "d1": pa.int64(), "d2": pa.int64()}
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *(pa.array(out[c], t) for c, t in kinds.items())], names=["vec_id", "label", *kinds])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    return source.mapInArrow(run, _SIGNED)


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit_links(ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, cell: np.ndarray, side: np.ndarray, table: int, name: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a unit: (positions, other vectors linked there, position of a vector of the same component).

    Sides 0 and 1 pair across, 2 pairs within; only pairs that meet here first are counted.
    """
    n = len(ids)
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    found_i, found_j = [], []
    for lo in range(0, len(left), _STRIP):
        a = left[lo : lo + _STRIP]
        i, j = np.nonzero(vectors[a] @ vectors[right].T >= least)
        i, j = a[i], right[j]
        keep = (side[i] != 2) | (i < j)
        found_i.append(i[keep])
        found_j.append(j[keep])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    first = np.ones(len(i), bool)
    for t in range(table):
        first &= ~((cell[i, t, :1] == cell[j, t]).any(1) | (cell[j, t, :1] == cell[i, t]).any(1))
    # in this table they may meet in the own cell of each; the smaller name counts
    own_i, own_j = cell[i, table, 0], cell[j, table, 0]
    other = np.where(own_i == name, own_j, own_i)
    meets = np.where(own_i == name, (cell[i, table] == own_j[:, None]).any(1), (cell[j, table] == own_i[:, None]).any(1))
    first &= (own_i == own_j) | ~meets | (other > name)
    i, j = i[first], j[first]
    count = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
    label = _joined(n, i, j)
    at = np.flatnonzero(count)
    return at, count[at].astype(np.int64), label[at]


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, unit: int = UNIT) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors link when labels and lengths are equal and the cosine is at least
    ``least``.  Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing.  Repeated rows are vectors
    of their own that count as others; a null vec_id is never linked.  Empty tables give no rows.
    """
    signed = scratch_table(signed_vectors(vectors), "vector-cells")
    good = signed.where("cells is not null and vec_id is not null")
    class_key = ["label", "dim", "d1", "d2"]
    classes = good.groupBy(*class_key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    member = scratch_table(good.select("vec_id", *class_key).join(classes, class_key).select("vec_id", "rep", "weight"), "vector-classes")
    first = good.groupBy(*class_key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("cells").alias("cells"))

    def name_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = TABLES * (1 + PROBES)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                names = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint32)
                each = {c: np.repeat(part.column(c).to_numpy(), wide) for c in ("rep", "label", "dim")}
                tables = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), part.num_rows)
                side = np.tile(np.arange(1 + PROBES) == 0, part.num_rows * TABLES)
                yield arrow_rows({
                    "label": (each["label"], pa.int64()), "dim": (each["dim"], pa.int32()), "t": (tables, pa.int32()), "cell": (names.astype(np.int64), pa.int64()),
                    "rep": (each["rep"], pa.int64()), "resident": (side, pa.bool_()),
                })

    reps = scratch_table(first, "vector-reps")
    placed = reps.select("label", "dim", "rep", "cells").mapInArrow(name_cells, "label long, dim int, t int, cell long, rep long, resident boolean")
    cell_key = ["label", "dim", "t", "cell"]
    busy = placed.groupBy(*cell_key).agg(F.count("*").alias("m"), F.max("resident").alias("lived")).where("m > 1 and lived")
    rows = placed.join(busy.withColumn("blocks", F.ceil(F.col("m") / unit)), cell_key)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    wide = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x, y = F.least("mine", "other"), F.greatest("mine", "other")
    across = F.when(F.col("mine") < F.col("other"), 0).otherwise(1)
    # residents with residents, block by block
    among = wide.where("resident").select(*cell_key, "rep", x.alias("x"), y.alias("y"), F.lit(0).alias("kind"), F.when(F.col("mine") == F.col("other"), 2).otherwise(across).alias("side"))
    # each block of residents with each block of visitors
    hosts = wide.where("resident").select(*cell_key, "rep", F.col("mine").alias("x"), F.col("other").alias("y"), F.lit(1).alias("kind"), F.lit(0).alias("side"))
    guests = wide.where("not resident").select(*cell_key, "rep", F.col("other").alias("x"), F.col("mine").alias("y"), F.lit(1).alias("kind"), F.lit(1).alias("side"))
    unit_key = [*cell_key, "x", "y", "kind"]
    units = among.union(hosts).union(guests)
    alive = units.groupBy(*unit_key).agg(F.count("*").alias("m"), F.min("side").alias("s"), F.max("side").alias("u")).where("m > 1 and (s < u or u = 2)")
    met = units.join(alive.select(*unit_key), unit_key).join(reps.select("rep", "weight", "vector", "cells"), "rep")

    def link(key: tuple, table: pa.Table) -> pa.Table:
        ids, weight, side = (table.column(c).to_numpy() for c in ("rep", "weight", "side"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
        cell = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint32).reshape(len(ids), TABLES, 1 + PROBES)
        at, n, to = unit_links(ids, weight, x, cell, side, key[2].as_py(), key[3].as_py(), least)
        return pa.table([pa.array(ids[at]), pa.array(n, pa.int64()), pa.array(ids[to])], names=["rep", "n", "to"])

    found = scratch_table(met.groupBy(*unit_key).applyInArrow(link, "rep long, n long, to long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).union(member.select("vec_id", "rep")))
    links = member.join(counts, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    links = links.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = signed.select("vec_id").join(links, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


NEAR_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (
  SELECT vec_id AS d, vec_id AS o FROM embeddings UNION SELECT r.d, l.b FROM r JOIN l ON r.o = l.a
), c AS (SELECT d, min(o) AS component_id FROM r GROUP BY d), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.d = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
