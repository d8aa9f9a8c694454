"""Token-array operators (labels, masks, weights) as higher-order Column code.

Token ids are an input column (``array<int>``): the sub-word tokeniser is a
per-row codec that runs where the model lives.  All searches are linear
folds (``aggregate``) over positions; random choices are seeded per row
with md5 so a recomputed task gives the same labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravel.functions.text import col_
from ravel.params import IGNORE_INDEX


def _int_array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def _matches_at(ids: Column, k: Column, seq: list[int]) -> Column:
    """ids[k : k+len(seq)] == seq, with k 0-based."""
    return F.slice(ids, k + 1, len(seq)) == _int_array(seq)


def unit_hash(*parts: Column | str) -> Column:
    """Deterministic u in [0, 1) from md5 of the parts (first 13 hex digits / 2^52)."""
    key = F.concat_ws(":", *[col_(p).cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _empty(t: str) -> Column:
    return F.array().cast(t)


def _positions(arr: Column) -> Column:
    """0..size-1 (empty for an empty array)."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(_empty("array<int>"))


# Lambdas below read only their own variables: an outer expression used
# inside a lambda is evaluated again for every element (and the optimizer
# inlines staged columns into lambdas), so outer arrays travel in the fold
# accumulator or as zip_with arguments.


def find_sublist_end(seq: Column | str, sub: list[int]) -> Column:
    """End index (0-based, exclusive) of the first occurrence of ``sub``, or -1."""
    s = col_(seq)
    m = len(sub)
    if m == 0:
        return F.when(s.isNotNull(), F.lit(0))
    init = F.struct(s.alias("a"), F.lit(-1).alias("found"))

    def step(acc, k):
        hit = (acc["found"] < 0) & (F.slice(acc["a"], k + 1, m) == _int_array(sub))
        return F.when(hit, F.struct(acc["a"].alias("a"), (k + m).alias("found"))).otherwise(acc)

    return F.aggregate(_positions(s), init, step)["found"]


def generated_token_count(ids: Column | str, input_len: Column | int, pad_id: int) -> Column:
    """Last non-pad position - input length + 1, floored at 0; 0 when all pad."""
    s = col_(ids)
    n = F.lit(input_len) if isinstance(input_len, int) else input_len
    last = F.array_max(F.transform(s, lambda x, i: F.when(x != pad_id, i)))
    return F.coalesce(F.greatest(F.lit(0), last - n + 1), F.lit(0))


def sft_labels(ids: Column | str, think_id: int, ignore: int = IGNORE_INDEX) -> Column:
    """Everything up to and including the first think token is ignored; null if no think token."""
    s = col_(ids)
    pos = F.array_position(s, think_id).cast("int")
    rest = F.slice(s, pos + 1, F.greatest(F.size(s) - pos, F.lit(0)))
    return F.when(pos > 0, F.concat(F.array_repeat(F.lit(ignore), pos), rest))


def apply_span_mask(labels: Column, spans: Column, ignore: int = IGNORE_INDEX) -> Column:
    """Set labels to ``ignore`` inside spans flagged ``m``.

    ``spans``: array<struct<s,l,m>> sorted by start, non-overlapping.  A
    flag array is built segment by segment, then zipped with the labels.
    """
    ends = F.transform(spans, lambda sp: sp["s"] + sp["l"])
    prev = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    segs = F.zip_with(
        spans, prev,
        lambda sp, pe: F.concat(F.array_repeat(F.lit(False), sp["s"] - pe), F.array_repeat(sp["m"], sp["l"])),
    )
    tail = F.array_repeat(F.lit(False), F.size(labels) - F.element_at(ends, -1))
    flags = F.concat(F.flatten(segs), tail)
    masked = F.zip_with(labels, flags, lambda x, f: F.when(f, F.lit(ignore)).otherwise(x))
    return F.when(F.size(spans) > 0, masked).otherwise(labels)


def step_number_spans(ids: Column | str, step_ids: list[int], colon_id: int) -> Column:
    """Spans ``(s, l)`` of step numbers: after each step prefix, up to the next colon token.

    Occurrences are taken left to right; the search for the next prefix
    starts at the colon that closed the previous number.  A prefix with no
    later colon ends the search.
    """
    s = col_(ids)
    m = len(step_ids)
    init = F.struct(
        s.alias("a"),
        F.lit(0).alias("search"),
        F.lit(-1).alias("pending"),
        _empty("array<struct<s:int,l:int>>").alias("spans"),
    )

    def state(acc, search, pending, spans):
        return F.struct(acc["a"].alias("a"), search.alias("search"), pending.alias("pending"), spans.alias("spans"))

    def step(acc, k):
        # one CASE over the accumulator fields only (no nested re-evaluation)
        closes = (acc["pending"] >= 0) & (k >= acc["pending"]) & (F.element_at(acc["a"], k + 1) == colon_id)
        prefix = F.slice(acc["a"], k + 1, m) == _int_array(step_ids)
        closed = F.concat(acc["spans"], F.array(F.struct(acc["pending"].alias("s"), (k - acc["pending"]).alias("l"))))
        opens = (acc["pending"] < 0) & (k >= acc["search"]) & prefix
        return (
            F.when(closes & prefix, state(acc, k, k + m, closed))
            .when(closes, state(acc, k, F.lit(-1), closed))
            .when(opens, state(acc, acc["search"], k + m, acc["spans"]))
            .otherwise(acc)
        )

    return F.aggregate(_positions(s), init, step)["spans"]


def mask_step_numbers(
    df: DataFrame,
    ids: str,
    labels: str,
    step_ids: list[int],
    colon_id: int,
    row_key: str,
    seed: int = 42,
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """``df`` with the number tokens of every step masked in ``labels``, except one step chosen at random (seeded per row).

    The spans are a column of their own, so the fold over the tokens runs once a row.
    """
    spanned = df.withColumn("_spans", step_number_spans(ids, step_ids, colon_id))
    n = F.size("_spans")
    keep = F.floor(unit_hash(F.lit(seed), F.col(row_key), F.lit("step")) * n).cast("int")
    flagged = F.zip_with(
        F.zip_with("_spans", _positions(F.col("_spans")), lambda sp, i: F.struct(sp["s"].alias("s"), sp["l"].alias("l"), i.alias("i"))),
        F.array_repeat(keep, n),
        lambda sp, kp: F.struct(sp["s"].alias("s"), sp["l"].alias("l"), (sp["i"] != kp).alias("m")),
    )
    marked = spanned.withColumn("_flagged", flagged)
    return marked.withColumn(labels, apply_span_mask(F.col(labels), F.col("_flagged"), ignore)).drop("_spans", "_flagged")


def word_spans(ids: Column | str, word_seqs: list[list[int]]) -> Column:
    """Greedy left-to-right, non-overlapping matches of the word token sequences.

    At each free position the first listed sequence that matches wins;
    duplicates of a sequence keep their first place; empty sequences are
    ignored.  Every token becomes one character (a blank, if no sequence has it) and a pattern with the
    sequences as its alternatives cuts the row into matches and single tokens, which is linear in the row's length.
    """
    s = col_(ids)
    seqs: list[list[int]] = []
    for w in word_seqs:
        if w and list(w) not in seqs:
            seqs.append(list(w))
    if not seqs:
        return F.when(s.isNotNull(), _empty("array<struct<s:int,l:int>>"))
    known = {x: _token_char(i) for i, x in enumerate(dict.fromkeys(x for q in seqs for x in q))}
    words = ["".join(known[x] for x in q) for q in seqs]
    chars = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    line = F.array_join(F.transform(s, lambda x: F.when(x.isin(list(known)), F.element_at(chars, x)).otherwise(" ")), "")
    parts = F.regexp_extract_all(line, F.lit("(?s)" + "|".join([*words, "."])), F.lit(0))

    def sizes(part: Column) -> Column:
        """A match's length at its first token, 0 at every other token."""
        n = F.length(part)
        return F.when(part.isin(words), F.concat(F.array(n), F.array_repeat(F.lit(0), n - 1))).otherwise(F.array(F.lit(0)))

    at = F.transform(F.flatten(F.transform(parts, sizes)), lambda n, k: F.struct(k.alias("s"), n.alias("l")))
    return F.filter(at, lambda h: h["l"] > 0)


def _token_char(i: int) -> str:
    """The i-th of the characters that stand for tokens (no ASCII, no surrogates)."""
    return chr(0x100 + i if i < 0xD700 else 0x10000 + i - 0xD700)


def mask_marker_words(
    df: DataFrame,
    ids: str,
    labels: str,
    word_seqs: list[list[int]],
    ratio: float,
    row_key: str,
    seed: int = 42,
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """``df`` with ``int(n * ratio)`` of the matched word spans masked in ``labels``, chosen at random (seeded per row)."""
    spanned = df.withColumn("_spans", word_spans(ids, word_seqs))
    n = F.size("_spans")
    key = F.array_repeat(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string")), n)
    keyed = F.zip_with(
        F.zip_with("_spans", _positions(F.col("_spans")), lambda sp, i: F.struct(sp["s"].alias("s"), sp["l"].alias("l"), i.alias("i"))),
        key,
        lambda sp, k: F.struct(
            F.md5(F.concat_ws(":", k, sp["i"].cast("string"))).alias("u"), sp["s"].alias("s"), sp["l"].alias("l")
        ),
    )
    chosen = F.slice(F.array_sort(keyed), 1, F.floor(n * F.lit(float(ratio))).cast("int"))
    ordered = F.array_sort(F.transform(chosen, lambda sp: F.struct(sp["s"].alias("s"), sp["l"].alias("l"), F.lit(True).alias("m"))))
    marked = spanned.withColumn("_flagged", ordered)
    return marked.withColumn(labels, apply_span_mask(F.col(labels), F.col("_flagged"), ignore)).drop("_spans", "_flagged")


def token_weights(labels: Column | str, end_think_id: int, response_weight: float = 0.3, ignore: int = IGNORE_INDEX) -> Column:
    """Per-token loss weights.

    Think part (first non-ignored label up to the end-think token): rising
    ``1 - cos(pi/2 * i/(L-1))``, 1.0 when L = 1; from the end-think token
    on: ``response_weight``; before the think part: 0.  When either marker
    is missing every weight is ``response_weight``.
    """
    lab = col_(labels)
    n = F.size(lab)
    start = F.array_position(F.transform(lab, lambda x: x != ignore), True).cast("int") - 1
    end = F.array_position(lab, end_think_id).cast("int") - 1
    length = end - start
    rw = F.lit(float(response_weight))
    ramp = (
        F.when(length > 1, F.zip_with(F.sequence(F.lit(0), length - 1), F.array_repeat(length - 1, length),
                                      lambda i, d: F.lit(1.0) - F.cos(F.lit(math.pi / 2) * i / d)))
        .when(length == 1, F.array(F.lit(1.0)))
        .otherwise(_empty("array<double>"))
    )
    body = F.concat(F.array_repeat(F.lit(0.0), F.least(start, end)), ramp, F.array_repeat(rw, n - end))
    return F.when(lab.isNull(), F.lit(None)).when((start < 0) | (end < 0), F.array_repeat(rw, n)).otherwise(body)


def left_pad(arr: Column | str, target_len: Column, pad_value: int) -> Column:
    a = col_(arr)
    k = F.greatest(target_len - F.size(a), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad_value), k), a)
