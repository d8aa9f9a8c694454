"""Cutting texts where a byte-level BPE always starts a new pre-token, and encoding equal pieces once.

``PATTERN`` never matches across a single space that stands between two
non-space characters, so a text can be cut before each such space; nor do letters, digits and signs share a
pre-token, but for the signs before letters, so it can be cut after a letter or digit where another kind follows.  All
other white space stays inside a chunk.

The texts of a slice are handled as one array of bytes.  A chunk of up to ``SHORT`` bytes is named by
its bytes themselves, as three integers; chunks are counted, found among those encoded lately, and
their ids gathered by array operations, and only chunks not known yet become strings and meet the
tokenizer.  What is remembered is a few arrays of at most ``KEPT`` chunks, about 60 bytes each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ravel.llm.common import U64, mix64

SHORT, KEPT = 24, 500_000
# UTF-8 of the white space beyond ASCII
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_ANY = _ASCII.copy()
_ANY[0x80:] = True
# kinds of ASCII characters: 1 letters, 2 digits, 3 signs
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) one after another, and the border before each text and after the last."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def chunk_starts(raw: np.ndarray, offsets: np.ndarray, uncut: re.Pattern | None = None) -> np.ndarray:
    """Where chunks begin: at every text that isn't empty, at single spaces between characters that are no white space,
    and where a letter or digit is followed by an ASCII character of another kind."""
    if not len(raw):
        return np.empty(0, np.int64)
    solid = (_ASCII if _WIDE_SPACE.search(raw) else _ANY)[raw]
    at = np.flatnonzero(raw[1:-1] == 32) + 1
    at = at[solid[at - 1] & solid[at + 1]]
    begins = offsets[:-1][np.diff(offsets) > 0]
    kind = _KIND[raw]
    before = kind[:-1].copy()
    # U+00C0 to U+017F, two bytes each, are letters but for the signs of multiplication and division
    wide = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5))
    wide = wide[~((raw[wide] == 0xC3) & ((raw[wide + 1] == 0x97) | (raw[wide + 1] == 0xB7)))]
    before[wide[wide < len(before) - 1] + 1] = 1
    border = np.zeros(len(raw), bool)
    border[1:] = ((before == 1) | (before == 2)) & (kind[1:] > 0) & (before != kind[1:])
    border[at] = True
    for m in uncut.finditer(raw) if uncut else ():
        border[m.start() + 1 : m.end()] = False
    border[(begins - 1)[begins > 0]] &= kind[(begins - 1)[begins > 0]] > 0  # a space that ends a text begins nothing
    border[begins] = True
    return np.flatnonzero(border)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of ``flat[starts[r] : starts[r] + sizes[r]]`` over ``rows``, and each row's size."""
    n = sizes[rows]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[rows] - (ends - n), n) + np.arange(total)
    return flat[at], n


def _named(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every short chunk's bytes as three integers."""
    padded = np.append(raw, np.zeros(SHORT, np.uint8))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.empty((SHORT // 8, len(starts)), U64)
    full = U64(2**64 - 1)
    for k in range(SHORT // 8):
        lane = eights[starts + 8 * k].view("<u8")[:, 0] if len(starts) else np.empty(0, U64)
        held = np.clip(sizes - 8 * k, 0, 8)
        out[k] = np.where(held == 8, lane, lane & ~(full << (8 * np.minimum(held, 7)).astype(U64)))
    return out


class ChunkEncoder:
    """Ids of whole texts, from ``encode_distinct``: distinct chunks to their ids one after another and each one's number of ids.

    Strings that a tokenizer takes as one token before anything else are ``uncut``.
    """

    def __init__(self, encode_distinct: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT, uncut: list[str] | None = None):
        self.encode_distinct, self.kept = encode_distinct, kept
        self.uncut = re.compile(b"|".join(re.escape(u.encode()) for u in uncut)) if uncut else None
        self.keys = np.empty(0, U64)
        self.names = np.empty((SHORT // 8 + 1, 0), U64)  # the last lane is the size
        self.sizes = self.seen = np.empty(0, np.int32)
        self.flat = np.empty(0, np.int32)

    def forget(self) -> None:
        self._select(np.empty(0, np.int64))

    def _select(self, rows: np.ndarray) -> None:
        self.flat, sizes = gather(self.flat, np.cumsum(self.sizes, dtype=np.int64) - self.sizes, self.sizes, rows)
        self.keys, self.names, self.sizes, self.seen = self.keys[rows], self.names[:, rows], sizes, self.seen[rows]

    def _remember(self, keys: np.ndarray, names: np.ndarray, flat: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> None:
        """Past ``kept`` chunks, those met only once since the last time go, and if they are too few, all."""
        if len(self.keys) + len(keys) > self.kept:
            often = np.flatnonzero(self.seen > 1)
            self._select(often if len(often) + len(keys) <= self.kept // 2 else often[:0])
            self.seen = np.zeros(len(self.keys), np.int32)
            if len(keys) > self.kept:
                return
        self.flat = np.concatenate([self.flat, flat])
        self.keys, self.names = np.append(self.keys, keys), np.append(self.names, names, axis=1)
        self.sizes, self.seen = np.append(self.sizes, sizes.astype(np.int32)), np.append(self.seen, seen.astype(np.int32))
        self._select(np.argsort(self.keys, kind="stable"))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids (a null text has none)."""
        raw, offsets = text_buffer(column)
        starts = chunk_starts(raw, offsets, self.uncut)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(column), np.int64)
        ends = np.append(starts[1:], len(raw))
        sizes = ends - starts
        short = np.flatnonzero(sizes <= SHORT)
        names = np.concatenate([_named(raw, starts[short], sizes[short]), sizes[None, short].astype(U64)])
        keys = mix64(names[0] ^ mix64(names[1] ^ mix64(names[2] ^ mix64(names[3]))))
        keys, first, group = np.unique(keys, return_index=True, return_inverse=True)
        times = np.bincount(group, minlength=len(keys))
        distinct = names[:, first]
        alone = np.flatnonzero((distinct[:, group] != names).any(0))  # two names with one key
        # known chunks
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        held = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        known = held & (self.names[:, at] == distinct).all(0) if len(self.keys) else held
        self.seen[at[known]] += times[known]
        # the others, long chunks and the odd one out become strings
        new = np.flatnonzero(~known)
        rest = np.append(np.flatnonzero(sizes > SHORT), short[alone])
        body = raw.tobytes()
        number: dict[bytes, int] = {}
        where = [number.setdefault(body[a:b], len(number)) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        strings = [body[a:b].decode() for a, b in zip(starts[short[first[new]]].tolist(), ends[short[first[new]]].tolist(), strict=True)]
        strings += [chunk.decode() for chunk in number]
        flat, n = self.encode_distinct(strings) if strings else (np.empty(0, np.int32), np.empty(0, np.int64))
        # one table: known chunks, then the strings
        table, n_ids = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, n])
        row = np.empty(len(keys), np.int64)
        row[known], row[new] = at[known], len(self.keys) + np.arange(len(new))
        rows = np.empty(len(starts), np.int64)
        rows[short] = row[group]
        rows[rest] = len(self.keys) + len(new) + np.array(where, np.int64)
        ids, per_chunk = gather(table, np.cumsum(n_ids) - n_ids, n_ids, rows)
        if len(new):
            free = ~held[new]  # the others' keys stand for other names
            small, _ = gather(flat, np.cumsum(n) - n, n, np.flatnonzero(free))
            self._remember(keys[new][free], distinct[:, new][:, free], small, n[: len(new)][free], times[new][free])
        total = np.append(0, np.cumsum(per_chunk))
        border = np.searchsorted(starts, offsets)
        return ids, total[border[1:]] - total[border[:-1]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))


def pieces(chunk: str) -> tuple[str, ...] | None:
    """The pre-tokens of a chunk that is a word, or a word and one sign; None for other chunks."""
    body = chunk[1:] if chunk[0] == " " else chunk
    if body.isalpha():
        return (chunk,)
    if body[:-1].isalpha() and not (body[-1].isalnum() or body[-1].isspace()):
        return (chunk[:-1], body[-1])
    return None


def encode_pieces(chunks: list[str], cut: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks by way of their distinct pieces."""
    number: dict[str, int] = {}
    per_chunk, rows = [], []
    for chunk in chunks:
        parts = pieces(chunk) or cut(chunk)
        per_chunk.append(len(parts))
        rows += [number.setdefault(p, len(number)) for p in parts]
    flat, sizes = encode(list(number))
    ids, n = gather(flat, np.cumsum(sizes) - sizes, sizes, np.array(rows, np.int64))
    total, border = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(per_chunk))
    return ids, total[border[1:]] - total[border[:-1]]
