"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact verification.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Documents
with equal sets form a class (by a 128-bit digest of the sorted set) and only one of
each class goes on.  It leaves

* a bitmap, four bits a shingle: bit h is the parity of the shingles that hash
  to h.  The Hamming distance of two bitmaps (folded to the same width) is at most the size of the
  sets' symmetric difference, so ``(|A| + |B| - distance) / 2`` bounds the overlap from above;
* 28 tile keys, each a hash of three minima of the set.  Two sets of similarity 0.8
  share a tile key with probability 1 - (1 - 0.8^3)^28 > 1 - 2e-9.

Documents that share a tile are compared only within neighbouring size bands (a
band spans a factor of 1 / threshold, so similar sets lie in one band or in two neighbours).
The first round verifies, as far as the bitmaps allow a link, the documents of a tile against its smallest id and
joins what is linked; tiles within one component are done.  The later rounds compare the
bitmaps of the others' open pairs, in units of bounded size (a tile that fits in one is one): the second round verifies a spanning forest of the
pairs that the bound lets pass, the third all open pairs of the tiles where the forest was wrong.  So a group of many
near copies costs links in its size, not its square, and no link between
components is lost.  Verification intersects sorted arrays; it alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import U64, arrow_rows, connected_components, mix64, scratch_table, shingle_hashes, slices, text_bytes

PERCENT = 80
ROWS, TILES = 3, 28
UNIT = 4096
_LEAST_BITS, _MOST_BITS = 128, 1 << 16
_SEEDS = (mix64(np.arange(1, ROWS * TILES + 1, dtype=np.uint64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on sorted arrays of distinct hashes: 100 * intersection >= percent * union."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as 64-bit words; its width is a power of two near four bits a shingle."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << math.ceil(math.log2(4 * len(found)))))
    slots = (found & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """The same set's bitmap at a smaller width (parities add up)."""
    return np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def tile_keys(found: np.ndarray) -> np.ndarray:
    """Hashes of ROWS minima each, under 32-bit multiply-shift families of the mixed hashes."""
    least = np.full(len(_SEEDS), 2**32 - 1, np.uint32)
    short = (found >> U64(32)).astype(np.uint32)
    for lo in range(0, len(short), 1024):
        x = np.multiply.outer(_SEEDS, short[lo : lo + 1024])
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(1), out=least)
    out = np.arange(TILES, dtype=np.uint64) + U64(1)
    for column in least.astype(np.uint64).reshape(TILES, ROWS).T:
        out = mix64(out * U64(0x9E3779B97F4A7C15) + column)
    return out


def band_of(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("long")


_SIGNATURE = "doc_id long, n long, d1 long, d2 long, bits binary, tiles array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set digest, bitmap and tile keys of every row (null bitmap and keys for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, digests, maps, tiles = [], [], [], []
            for text in text_bytes(batch.column("text")):
                found = np.unique(shingle_hashes(text))
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                maps.append(bitmap(found).tobytes() if len(found) else None)
                tiles.append(tile_keys(found).view(np.int64) if len(found) else None)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield arrow_rows({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n": (n, pa.int64()), "d1": (both[:, 0], pa.int64()), "d2": (both[:, 1], pa.int64()),
                "bits": (maps, pa.binary()), "tiles": (tiles, pa.list_(pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNATURE)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` with a boolean ``same``, by exact intersection of the texts' sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            same = []
            for a, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "left", "right")), strict=True):
                if a != last:
                    last, held = a, np.frombuffer(left, np.uint64)
                same.append(linked(held, np.frombuffer(right, np.uint64), percent))
            yield arrow_rows({"a": (batch.column("a"), pa.int64()), "b": (batch.column("b"), pa.int64()), "same": (same, pa.bool_())})

    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("right")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, same boolean")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sorted shingle sets of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body = [np.unique(shingle_hashes(t)).tobytes() for t in text_bytes(batch.column("text"))]
            yield arrow_rows({"doc_id": (batch.column("doc_id"), pa.int64()), "found": (body, pa.binary())})

    # by a shuffle at every size (where the texts are large, Spark filters them by a Bloom filter of the ids first)
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, found binary")


def open_pairs(ids: np.ndarray, n: np.ndarray, component: np.ndarray, bits: list[bytes], side: np.ndarray, refuted: set, percent: int, spanning: bool) -> list[tuple[int, int]]:
    """Pairs across components that the bitmap bound lets pass: a spanning forest of them, or all.

    ``side`` 0 pairs with 1, and 2 with 2; ``refuted`` pairs are left out.
    """
    order = np.lexsort((ids, n))
    width = min(map(len, bits)) // 8
    maps = np.stack([fold(np.frombuffer(bits[i], np.uint64), width) for i in order])
    ids, n, component, side = ids[order], n[order], component[order], side[order]
    names, root = np.unique(component, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = root.copy()
    out = []
    for i in range(1, len(ids)):
        fit = np.flatnonzero(100 * n[:i] >= percent * n[i])
        if not len(fit):
            continue
        fit = fit[(label[fit] != label[i]) & ((side[fit] + side[i] == 1) | (side[fit] + side[i] == 4))]
        if not len(fit):
            continue
        apart = np.bitwise_count(maps[fit] ^ maps[i]).sum(1, dtype=np.int64)
        grown = False
        for j in fit[may_link(n[fit], n[i], apart, percent)].tolist():
            a, b = sorted((int(ids[i]), int(ids[j])))
            x, y = find(int(root[i])), find(int(root[j]))
            if (x != y or not spanning) and (a, b) not in refuted:
                out.append((a, b))
                if spanning:
                    parent[max(x, y)] = min(x, y)
                    grown = True
        if grown:
            label = np.array([find(r) for r in range(len(names))])[root]
    return out


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes at this bitmap distance can reach the threshold."""
    most = (n + m - apart) // 2
    return 100 * most >= percent * (n + m - most)


def bounded_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the bitmaps' bound lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
            widths = [min(len(x), len(y)) for x, y in zip(left, right, strict=True)]
            apart = [int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) for x, y, w in zip(left, right, widths, strict=True)]
            keep = may_link(batch.column("n").to_numpy(), batch.column("m").to_numpy(), np.array(apart, np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(reps.select(F.col("doc_id").alias("a"), "n", F.col("bits").alias("left")), "a")
    both = both.where(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    both = both.join(reps.select(F.col("doc_id").alias("b"), F.col("bits").alias("right")), "b")
    return both.select("a", "b", "n", "m", "left", "right").mapInArrow(run, "a long, b long")


def runs_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, of batches whose rows come key by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy() for c in key])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(columns[:, lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, component)`` of every node; a node without links is its own component."""
    found = connected_components(links)
    return nodes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def class_links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """Verified links ``(a, b)`` that connect all linked representatives."""
    keyed = reps.select("doc_id", "n", F.explode("tiles").alias("key"))
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "doc_id")).alias(f"s{i}") for i in (0, 1)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("centre"), *hashes).where("m > 1")
    # tiles with the same documents are one tile
    shared = shared.groupBy("m", "s0", "s1").agg(F.min("key").alias("key"), F.min("centre").alias("centre"))
    members = scratch_table(keyed.join(shared.select("key", "m", "centre"), "key").withColumn("band", band_of(F.col("n"), percent)), "tile-members")

    first = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("m")).distinct()
    first = scratch_table(bounded_pairs(first, reps, percent), "pairs-first")
    crowd = members.where("m > 2")  # in a tile of two the one pair has been looked at
    busy = first.select(F.col("a").alias("doc_id")).union(first.select("b")).union(crowd.select("doc_id")).distinct()
    sets = scratch_table(_sets(docs, busy), "tile-sets")
    tested = scratch_table(verify(first, sets, percent), "links-tested")

    unit_key = ["key", "band", "x", "y", "kind"]
    spread = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def compare(batches: Iterator[pa.RecordBatch], spanning: bool) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, unit_key):
            ids, n, component, side = (table.column(c).to_numpy() for c in ("doc_id", "n", "component", "side"))
            refuted = {(a, b) for a, others in zip(ids.tolist(), table.column("refuted").to_pylist(), strict=True) for b in others or ()}
            found = open_pairs(ids, n, component, table.column("bits").to_pylist(), side, refuted, percent, spanning)
            if found:
                a, b = zip(*found, strict=True)
                yield arrow_rows({"a": (a, pa.int64()), "b": (b, pa.int64())})

    def open_round(tested: DataFrame, tiles: DataFrame | None, spanning: bool) -> DataFrame:
        """Pairs still open after ``tested`` (in some ``tiles`` only), verified."""
        links = tested.where("same").select("a", "b")
        rows = crowd if tiles is None else crowd.join(tiles, "key", "left_semi")
        # component, bitmap and refuted partners (under the smaller id) join a document once and not once a tile
        nodes = rows.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("band").alias("band"), F.collect_list(F.struct("key", "m")).alias("tiles"))
        no = tested.where("not same").groupBy(F.least("a", "b").alias("doc_id")).agg(F.collect_set(F.greatest("a", "b")).alias("refuted"))
        labelled = nodes.join(_components(nodes.select("doc_id"), links), "doc_id").join(reps.select("doc_id", "bits"), "doc_id").join(no, "doc_id", "left")
        labelled = scratch_table(labelled, "tiles-labelled")
        flat = labelled.select("doc_id", "component", F.explode("tiles.key").alias("key"))
        still = flat.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        wide = labelled.select("*", F.explode("tiles").alias("t")).select(F.col("t.key").alias("key"), F.ceil(F.col("t.m") / unit).alias("blocks"), "doc_id", "n", "band", "component", "bits", "refuted")
        left = scratch_table(wide.join(still, "key"), "tiles-open")

        def units_of(rows: DataFrame, band: Column, x: Column, y: Column, side: Column, kind: int) -> DataFrame:
            return rows.select("key", "doc_id", "n", "component", band.cast("long").alias("band"), x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("int").alias("side"),
                               F.lit(kind).alias("kind"), "bits", "refuted")

        # a tile of at most ``unit`` documents is one unit, whatever their bands
        whole = units_of(left.where("blocks = 1"), F.lit(0), F.lit(0), F.lit(0), F.lit(2), 2)
        # a larger one is cut: block pairs within a band, the diagonal ones with all pairs, the others with pairs across; then a band and the next
        cut = left.where("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).repartition(spread, "key", "doc_id")
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        band, me, other = F.col("band"), F.col("mine"), F.col("other")
        within = units_of(cut, band, F.least(me, other), F.greatest(me, other), F.when(me == other, 2).when(me < other, 0).otherwise(1), 0)
        lower = units_of(cut, band, me, other, F.lit(0), 1)
        upper = units_of(cut, band - 1, other, me, F.lit(1), 1)
        met = whole.union(within).union(lower).union(upper)
        dealt = met.repartition(*unit_key).sortWithinPartitions(*unit_key, "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return compare(batches, spanning)

        pairs = scratch_table(dealt.mapInArrow(run, "a long, b long").distinct(), "pairs-open")
        return scratch_table(verify(pairs, sets, percent), "links-tested")

    second = open_round(tested, None, True)
    tested = tested.union(second)
    # only where a pair of a forest was refuted can a pair that the forest made needless be open still
    wrong = second.where("not same")
    if not wrong.isEmpty():
        touched = wrong.select(F.col("a").alias("doc_id")).union(wrong.select("b")).distinct()
        tested = tested.union(open_round(tested, crowd.join(touched, "doc_id", "left_semi").select("key").distinct(), False))
    return tested.where("same").select("a", "b")


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets;
    the component is the smallest doc_id reachable.  Fewer than five words: the
    whole sequence is the one shingle.  Null, empty or blank texts have an
    empty set and link with nothing, and a row with a null doc_id likewise has
    a null component of its own.  Rows with the same doc_id each get a row; the links of any of them
    are links of that doc_id.  Other columns are ignored; empty tables give no rows.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the tile keys are dimensioned for thresholds from 75 to 100 percent")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch_table(signatures(source), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    member = scratch_table(full.join(classes, ["d1", "d2", "n"]).select("doc_id", "n", "rep"), "members")
    # with repeated ids a representative can stand for several sets; its first is enough to start from
    reps = full.join(member.where("doc_id = rep").select("doc_id", "n"), ["doc_id", "n"], "left_semi").select("doc_id", "n", "bits", "tiles")
    reps = scratch_table(reps, "class-reps")
    links = class_links(source, reps, percent, unit)
    own = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links.union(own))
    sizes = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id stands for its group; of rows that share a doc_id one stays. Null ids stay."""
    groups = near_duplicate_groups(docs, percent)
    kept = groups.where("doc_id = component_id").select("doc_id")
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


#: Distinct shingles of a table's texts as DuckDB SQL; ``{t}`` the table, ``{i}`` its id.
SHINGLES_SQL = r"""
SELECT {i}, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
FROM (SELECT {i}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {t})
"""

GROUPS_SQL = (
    "WITH RECURSIVE s AS (" + SHINGLES_SQL.format(t="documents", i="doc_id") + r"""),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.o = e.a),
c AS (SELECT d, min(o) AS component_id FROM r GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.d = d.doc_id
"""
)
