"""Prefix trie of conversations, rolled up by bands of depth.

A node is named by a 128-bit sum of one hash per turn (of depth, role and text), so the names of
all prefixes of a conversation are prefix sums.  They are taken band by band: a
conversation is cut every ``BAND`` turns, a group of Spark holds one band, and
the totals of whole bands are a shorter conversation to which the same is done; so
a conversation of any length is spread over many groups, and the levels grow
with the logarithm of its length.

Subtree totals go the same way up.  A node adds its own values to itself and its
ancestors within its band only (fewer than ``BAND`` rows); the band roots
form a shorter trie that is rolled up likewise; the completed totals of its
roots then go to the nodes of the band above, again fewer than ``BAND`` rows each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import U64, arrow_rows, empty_like, mix64, scratch_table, slices, texts
from ravel.operators.joins import join_per_key
from ravel.operators.ranking import global_rank

BAND = 8
FAMILY, LONGEST = 5, 8  # conversations that share a first one; the most turns they take from it
IDS = 1024
_TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        d1, d2, size = [], [], []
        for role, text in zip(texts(batch.column("role")), texts(batch.column("text")), strict=True):
            a, b = role.encode(), text.encode()
            h = xxhash.xxh3_128_digest(len(a).to_bytes(8, "little") + a + b)
            d1.append(int.from_bytes(h[:8], "little", signed=True))
            d2.append(int.from_bytes(h[8:], "little", signed=True))
            size.append(len(b))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(size, pa.int64())],
                                         names=["conv", "turn", "d1", "d2", "bytes"])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, d1, d2, bytes, last)`` of every rebuilt turn, and ``(conv, len)`` of every rebuilt conversation."""
    source = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    slim = scratch_table(source.mapInArrow(_digests, "conv long, turn long, d1 long, d2 long, bytes long"), "trie-digests").withColumn("u", F.monotonically_increasing_id())
    # places come from one order over all rows, so a conversation with very many turns is no single task
    ranked = global_rank(slim, ["conv", "turn", "d1", "d2", "u"], "rank").select("conv", "rank", "d1", "d2", "bytes")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (LONGEST + 1)
    found = scratch_table(ranked.groupBy("conv").agg(F.min("rank").alias("r0"), F.count(F.lit(1)).alias("n")), "trie-convs")
    own = found.select("*", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = scratch_table(
        own.join(found.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .select("conv", "base", "r0", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
        "trie-convs",
    )
    per_conv = convs.select("conv", "r0", "h", "taken", "len", F.col("n").alias("rows"))
    placed = join_per_key(ranked, per_conv, "conv", "rows", spread="rank").withColumn("p", F.col("rank") - F.col("r0") + 1)
    placed = scratch_table(placed.drop("rank", "r0"), "trie-turns")
    kept = placed.where("p > h").select("conv", (F.col("taken") + F.col("p") - F.col("h")).alias("depth"), "d1", "d2", "bytes", "len")
    heads = placed.where((F.col("p") <= LONGEST) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), F.col("p").alias("depth"), "d1", "d2", "bytes")
    copied = heads.join(convs.select("conv", "base", "h", "len"), "base").where("depth <= h").select("conv", "depth", "d1", "d2", "bytes", "len")
    rows = kept.union(copied)
    return rows.withColumn("last", F.col("depth") == F.col("len")).drop("len"), convs.select("conv", "len")


def _prefix_sums(lists: list[np.ndarray], offsets: np.ndarray) -> list[np.ndarray]:
    """Running sums (modulo 2**64) within each list of flat values."""
    out = []
    for flat in lists:
        total = np.cumsum(flat, dtype=U64)
        before = np.concatenate([np.zeros(1, U64), total])[offsets[:-1]]
        out.append(total - np.repeat(before, np.diff(offsets)))
    return out


def _list(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == U64 else values, pa.int64()))


_BANDS = "conv long, g long, m long, last boolean, s1 array<long>, s2 array<long>, bytes array<long>"


def banded(elements: DataFrame, first: bool, name: str) -> DataFrame:
    """Groups of ``BAND`` consecutive elements (conv, idx, t1, t2, bytes, last) with their running sums.

    On the ``first`` level t1 and t2 are digests of turns and are hashed with their depth; later on they are sums already.
    """
    grouped = elements.groupBy("conv", F.floor((F.col("idx") - 1) / BAND).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "t1", "t2", "bytes"))).alias("e"), F.max("last").alias("last"))
    flat = grouped.select("conv", "g", F.size("e").cast("long").alias("m"), "last", *(F.col(f"e.{c}").alias(c) for c in ("idx", "t1", "t2", "bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("idx", "t1", "t2", "bytes")}
            offsets = np.concatenate([[0], np.cumsum(batch.column("m").to_numpy())])
            lanes = [lists["t1"].view(U64), lists["t2"].view(U64)]
            if first:
                depth = lists["idx"].astype(U64)
                a = mix64(lanes[0] ^ mix64(depth))
                b = mix64(lanes[1] ^ mix64(depth + U64(1 << 40)))
                lanes = [mix64(a + b * U64(3)), mix64(b + a * U64(5))]
            s1, s2 = _prefix_sums(lanes, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "g", "m", "last")), _list(offsets, s1), _list(offsets, s2), _list(offsets, lists["bytes"])],
                                             names=["conv", "g", "m", "last", "s1", "s2", "bytes"])

    return scratch_table(flat.mapInArrow(run, _BANDS), name)


_PREFIXES = "conv long, idx long, k1 long, k2 long, bytes long, last boolean, up1 array<long>, up2 array<long>"


def unfolded(bands: DataFrame) -> DataFrame:
    """One row per prefix: its name, and the names of its ancestors from the nearest to the root of its band.

    ``bands`` has in b1, b2 the name of the prefix before each band.  The last prefix
    of a whole band is the root of the next one; its ancestors reach to the root before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").to_numpy()
            offsets, n = np.concatenate([[0], np.cumsum(m)]), int(m.sum())
            band = np.repeat(np.arange(len(m)), m)
            place = np.arange(n) - offsets[:-1][band]
            idx = batch.column("g").to_numpy()[band] * BAND + place + 1
            # positions of each prefix's ancestors in a row of names that has the base before every band
            at = offsets[:-1][band] + band + place + 1
            sizes = place + 1
            ends = np.cumsum(sizes)
            back = np.arange(int(ends[-1]) if n else 0) - np.repeat(ends - sizes, sizes)
            ups = np.repeat(at, sizes) - 1 - back
            up_offsets = np.concatenate([[0], ends])
            keys, lists = [], []
            for s, b in (("s1", "b1"), ("s2", "b2")):
                base = batch.column(b).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                names = np.empty(n + len(m), U64)
                names[offsets[:-1] + np.arange(len(m))] = base
                names[at] = batch.column(s).flatten().to_numpy(zero_copy_only=False).view(U64) + base[band]
                keys.append(names[at].view(np.int64))
                lists.append(_list(up_offsets, names[ups]))
            last = batch.column("last").to_numpy(zero_copy_only=False).astype(bool)[band] & (place == m[band] - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(band)), pa.array(idx, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), batch.column("bytes").flatten(), pa.array(last), *lists],
                names=["conv", "idx", "k1", "k2", "bytes", "last", "up1", "up2"],
            )

    return bands.mapInArrow(run, _PREFIXES)


def prefixes(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Per level, the prefixes whose length is a multiple of ``BAND ** level`` (idx counts in that unit)."""
    elements = turns.select("conv", F.col("depth").alias("idx"), F.col("d1").alias("t1"), F.col("d2").alias("t2"), "bytes", "last")
    levels = []
    while True:
        bands = banded(elements, not levels, f"trie-bands-{len(levels)}")
        levels.append(bands)
        if longest < BAND ** len(levels):
            break
        whole = bands.where(F.col("m") == BAND)
        elements = whole.select("conv", (F.col("g") + 1).alias("idx"), F.element_at("s1", -1).alias("t1"), F.element_at("s2", -1).alias("t2"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("last"))
    out: list[DataFrame] = []
    for bands in reversed(levels):
        if out:
            before = out[0].select("conv", F.col("idx").alias("g"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
            based = bands.join(before, ["conv", "g"], "left").fillna(0, subset=["b1", "b2"])
        else:
            based = bands.withColumns({"b1": F.lit(0).cast("long"), "b2": F.lit(0).cast("long")})
        out.insert(0, scratch_table(unfolded(based), "trie-prefixes"))
    return out


def _to_ancestors(rows: DataFrame, ups: DataFrame, spare_root: bool = False) -> DataFrame:
    """The values of rows given to their ancestors in ``ups``; with ``spare_root`` not to the last of them."""
    up = F.arrays_zip("up1", "up2")
    if spare_root:
        up = F.slice(up, 1, F.greatest(F.size("up1") - 1, F.lit(0)))
    wide = rows.join(ups.select("k1", "k2", "up1", "up2"), ["k1", "k2"]).select("idx", "leaves", "saved", F.posexplode(up).alias("i", "a"))
    return wide.select(F.col("a.up1").alias("k1"), F.col("a.up2").alias("k2"), (F.col("idx") - 1 - F.col("i")).alias("idx"), "leaves", "saved")


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2", "idx").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(values: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """``values`` (k1, k2, idx, leaves, saved) of every node summed over its subtree.

    ``ups`` has, per level, the ancestors within the band of every node of that level.
    """
    in_band = F.col("idx") % BAND != 0
    partial = scratch_table(_added(values.union(_to_ancestors(values.where(in_band), ups[0]))), "trie-partial")
    if len(ups) == 1:
        return partial
    roots = partial.where(~in_band).withColumn("idx", F.floor(F.col("idx") / BAND))
    totals = subtree_totals(roots, ups[1:]).withColumn("idx", F.col("idx") * BAND)
    inner = partial.where(in_band).union(_to_ancestors(totals.where("idx > 0"), ups[0], spare_root=True))
    return scratch_table(_added(inner).union(totals), "trie-totals")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``IDS`` ids of one node, joined by commas, from rows sorted by node and id."""
    for batch in batches:
        k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
        border = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        starts = np.flatnonzero(border)
        place = np.arange(len(k1)) - np.repeat(starts, np.diff(np.append(starts, len(k1))))
        lo = np.flatnonzero(place % IDS == 0)
        said = conv.tolist()
        joined = [",".join(map(str, said[a:b])) for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(said)], strict=True)]
        yield arrow_rows({"k1": (k1[lo], pa.int64()), "k2": (k2[lo], pa.int64()), "first": (conv[lo], pa.int64()), "ids": (joined, pa.string())})


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, run by run: only the hash's state is held, however many ids a node has."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == node:
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield arrow_rows(dict(zip(("k1", "k2", "ends_sha256"), zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True), strict=True)))
    if node:
        yield arrow_rows({"k1": ([node[0]], pa.int64()), "k2": ([node[1]], pa.int64()), "ends_sha256": ([state.hexdigest()], pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the nodes at which conversations (k1, k2, conv) end.

    The ids are sorted over range partitions, so the many of a hot node are sorted and joined in many tasks; the digest itself
    is one chain by nature and streams over the joined runs.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ends.select("k1", "k2", "conv").repartitionByRange(n, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    runs = runs.mapInArrow(_joined_ids, "k1 long, k2 long, first long, ids string")
    dealt = runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").drop("first")
    return dealt.mapInArrow(_hashed_ids, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    Turns go by number, null first; equal numbers go by a digest of role and text, and repeated rows are turns of their
    own.  Null role or text is empty; rows with a null conv_id belong to no conversation and are left out.  ``c % 5`` has the sign
    of c, so the ids from -4 to 4 share conversation 0.  An empty table has no root and gives no rows.  Other columns are ignored.
    Two different prefixes get one name with a probability below n^2 / 2**129 for n nodes.
    """
    turns, convs = rebuilt_turns(conversations)
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("len").alias("longest")).first()
    if not whole["n"]:
        return empty_like(conversations.sparkSession, _TRIE)
    levels = prefixes(turns, whole["longest"])
    first = levels[0]
    parents = (F.coalesce(F.get("up1", 0), F.lit(0)).alias("p1"), F.coalesce(F.get("up2", 0), F.lit(0)).alias("p2"))
    nodes = scratch_table(
        first.groupBy("k1", "k2", "idx").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("up1").alias("up1"), F.first("up2").alias("up2"))
        .select("*", *parents), "trie-nodes")
    root = conversations.sparkSession.createDataFrame([(0, 0, 0, whole["conv"], whole["n"], 0)], "k1 long, k2 long, idx long, conv_id long, n_convs long, bytes long")
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    slim = nodes.select("k1", "k2", "idx", "conv_id", "n_convs", "bytes").union(root)
    known = scratch_table(slim.join(children, ["k1", "k2"], "left").fillna(0, subset=["n_children"]), "trie-known")
    values = known.select("k1", "k2", "idx", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    ups = [nodes, *(level.groupBy("k1", "k2").agg(F.first("up1").alias("up1"), F.first("up2").alias("up2")) for level in levels[1:])]
    totals = subtree_totals(values, ups)
    per_parent = known.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_per_key(nodes.select("k1", "k2", "p1", "p2"), per_parent, ["p1", "p2"], "n_children", spread=["k1", "k2"]).select("k1", "k2", "parent_conv_id")
    ends = first.where("last").select("k1", "k2", "conv")
    turnless = convs.where("len = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv")
    out = known.join(totals.drop("idx"), ["k1", "k2"]).join(below, ["k1", "k2"], "left").join(end_digests(ends.union(turnless)), ["k1", "k2"], "left")
    return out.select(
        "conv_id", F.col("idx").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), b AS (SELECT c.conv_id, c.base, c.h, least(c.h, count(t.p)) AS taken FROM c LEFT JOIN t ON t.conv_id = c.base GROUP BY c.conv_id, c.base, c.h
), r AS (
  SELECT b.conv_id, t.p AS depth, t.role, t.text FROM b JOIN t ON t.conv_id = b.base AND t.p <= b.h
  UNION ALL
  SELECT b.conv_id, b.taken + t.p - b.h, t.role, t.text FROM b JOIN t ON t.conv_id = b.conv_id AND t.p > b.h
), s AS (SELECT conv_id, list(sha256(role) || sha256(text) ORDER BY depth) AS s FROM r GROUP BY conv_id
), m AS (
  SELECT r.conv_id, r.depth, sha256(array_to_string(s.s[:r.depth], '')) AS k, strlen(r.text) AS bytes FROM r JOIN s USING (conv_id)
  UNION ALL
  SELECT conv_id, 0, 'root', 0 FROM c
), n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own FROM m GROUP BY depth, k
), e AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
    SELECT conv_id, depth, k, max(depth) OVER (PARTITION BY conv_id) AS top FROM m) WHERE depth = top GROUP BY depth, k
), q AS (SELECT n.depth, n.k, u.k AS pk, pn.conv_id AS parent_conv_id FROM n JOIN m u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1 JOIN n pn ON pn.depth = u.depth AND pn.k = u.k
), w AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM q GROUP BY 1, 2
), v AS (SELECT n.*, coalesce(w.n_children, 0) AS n_children FROM n LEFT JOIN w USING (depth, k)
), x AS (SELECT u.depth, u.k, sum((v.n_children = 0)::INT) AS n_leaves, sum(v.own) AS saved FROM v JOIN m u ON u.conv_id = v.conv_id AND u.depth <= v.depth GROUP BY u.depth, u.k)
SELECT v.conv_id, v.depth::BIGINT AS depth, q.parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, x.n_leaves::BIGINT AS n_leaves,
  x.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN x USING (depth, k) LEFT JOIN q USING (depth, k) LEFT JOIN e USING (depth, k)
"""
