"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merge order is the vocabulary's ranks.  All distinct pre-tokens of a slice
of texts lie in one linked list, with no links between pre-tokens.  A bucket
per merge rank holds the positions whose pair has that rank; a bitmap with 64
children a word, in levels, says which buckets hold anything, and find-first-set
picks the next rank.  An entry whose pair has changed since is stale and skipped.
A bucket's merges are made together, unless that could differ from one merge
after another within a pre-token; then only the leftmost of each pre-token is
made and the others go back.  The cost of a pre-token grows with its length
times the levels, not with its square, so very long pre-tokens are no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ravel.llm.chunks import ChunkEncoder, encode_pieces, gather
from ravel.llm.common import release_memory, slices

RANKS = "byte_bpe_50k.tiktoken"
SLICE = 3 << 19
DECODED_AT_ONCE = 1 << 18
_NONE = np.int32(2**31 - 1)


class RankBitmap:
    """Set of small integers as a tree of 64-bit words; ``first`` is a find-first-set per level."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, n: int) -> None:
        for level in self.levels:
            n, bit = n >> 6, 1 << (n & 63)
            if level[n] & bit:
                return
            level[n] |= bit

    def discard(self, n: int) -> None:
        for level in self.levels:
            n, bit = n >> 6, 1 << (n & 63)
            level[n] &= ~bit
            if level[n]:
                return

    def first(self) -> int:
        """The smallest member, or -1."""
        n = 0
        for level in reversed(self.levels):
            word = level[n]
            if not word:
                return -1
            n = (n << 6) | ((word & -word).bit_length() - 1)
        return n


class BytePairEncoder:
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        two = (self.single[:, None].astype(np.int64) << 20 | self.single[None, :]).ravel()
        self.byte_pairs = self.pair_ranks(two).reshape(256, 256)
        self.texts = ChunkEncoder(lambda distinct: encode_pieces(distinct, self.pattern.findall, lambda parts: self.merge([p.encode() for p in parts])))

    def pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and each piece's number of ids."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = len(raw)
        if not n:
            return np.empty(0, np.int32), size
        owner = np.repeat(np.arange(len(pieces)), size)
        ids = np.append(self.single[raw], np.int32(0))
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(size[size > 0]) - 1
        right[last] = n  # n: nothing to the right
        left[np.append(0, last[:-1] + 1)] = -1
        rank = np.full(n + 1, _NONE, np.int32)
        rank[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[last] = _NONE
        alive, touched = np.ones(n, bool), np.zeros(n, bool)
        buckets: dict[int, list[np.ndarray]] = defaultdict(list)
        queue = RankBitmap(len(self.tokens))

        def push(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r != _NONE], r[r != _NONE]
            if not len(at):
                return
            order = np.lexsort((at, r))
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                buckets[k].append(part)
                queue.add(k)

        def ranks_of(at: np.ndarray, to: np.ndarray) -> np.ndarray:
            found = self.pair_ranks(ids[at].astype(np.int64) << 20 | ids[to])
            return np.where(to < n, found, _NONE)

        push(np.arange(n))
        while (r := queue.first()) >= 0:
            held = buckets.pop(r)
            queue.discard(r)
            at = np.sort(np.concatenate(held)) if len(held) > 1 else held[0]
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(held) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
            # of pairs that overlap (a run of one token), every second one counted from the left
            joined = np.append(False, right[at[:-1]] == at[1:])
            if joined.any():
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(joined, 0, place))
                at = at[(place - start) % 2 == 0]
            same = owner[at[1:]] == owner[at[:-1]]
            if same.any():
                # made one after another, would a merge bring a pair of a lower rank before the next of its pre-token?
                after = right[right[at]]
                new = np.full(len(at), r, np.int64)
                follow = self.pair_ranks(new << 20 | ids[after])
                follow = np.where(after < n, follow, _NONE)
                before = left[at]
                lead = self.pair_ranks(ids[before].astype(np.int64) << 20 | new)
                own = self.pair_ranks(np.array([r << 20 | r]))[0]
                if (follow < r).any() or (np.where(before >= 0, lead, _NONE) < r).any() or own < r:
                    first = np.append(True, ~same)
                    buckets[r].append(at[~first])
                    queue.add(r)
                    at = at[first]
            gone = right[at]
            after = right[gone]
            ids[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            right[at] = after
            inner = after < n
            left[after[inner]] = at[inner]
            # where the next pair was merged as well, its place in the list stays; where it was swallowed it can't be
            rank[at] = ranks_of(at, right[at])
            before = left[at]
            before = before[before >= 0]
            rank[before] = ranks_of(before, right[before])
            touched[at] = True
            push(np.concatenate([at, before[~touched[before]]]))
            touched[at] = False
        return ids[:n][alive], np.bincount(owner[alive], minlength=len(pieces))

    def encode(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        return self.texts.encode(many)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens one after another, where each begins, and each one's number of bytes."""
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_column(self, lists: pa.ListArray) -> Iterator[pa.Array]:
        """The bytes of every row's ids (null: empty), in arrays of rows with about ``DECODED_AT_ONCE`` ids (one row at least)."""
        flat, starts, sizes = self.token_bytes
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(counts) - counts) // DECODED_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            body, n = gather(flat, starts, sizes, lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts[lo:hi]))]
            yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of every whole text as ``ids_col`` (replacing a column of that name).

    A null or empty text has no ids; repeated rows are encoded each; an empty
    table stays empty.  Special tokens' strings are ordinary text.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    names = [c for c in docs.columns if c != ids_col]
    source = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in slices(batches, text_col, SLICE):
            ids, n = bpe.texts.encode_column(batch.column(text_col))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[*names, ids_col]
            )
        bpe.texts.forget()
        release_memory()

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the bytes that ``ids_col`` stands for as ``bytes_col`` (null ids: empty)."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    names = [c for c in docs.columns if c != bytes_col]
    source = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            at = 0
            for body in bpe.decode_column(batch.column(ids_col)):
                rows = batch.slice(at, len(body))
                at += len(body)
                yield pa.RecordBatch.from_arrays([*rows.columns, body], names=[*names, bytes_col])
        release_memory()

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(bytes_col, BinaryType())]))


def encoding_digests(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of documents with their ``ids``."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        decimal = list(map(str, range(len(bpe.tokens))))
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            out = []
            for lo, hi in zip(offsets, offsets[1:], strict=False):
                ids = flat[lo:hi].tolist()
                said = " ".join(map(decimal.__getitem__, ids)).encode()
                out.append((hi - lo, hashlib.sha256(said).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
