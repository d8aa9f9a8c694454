"""String helpers with Python ``str`` semantics, as JVM-side Column code.

Python and Java regexes differ in defaults; the flags used here close the
gaps that matter (Unicode ``\\s``/``\\w``/``\\b`` via ``(?U)``, ``.`` and
``$`` stopping only at ``\\n`` via ``(?d)``).  ``str.strip``/``str.split``
also treat U+001C..U+001F as whitespace, which Java's ``\\s`` does not.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, as a Java character class (with (?U)).
WS = r"[\s\x1c-\x1f]"
# Line boundaries of str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


# What Python's \\w is in Java: letters, all of category N and the underscore, but no combining marks.
_WORD_CHAR = r"[\p{L}\p{N}_]"
_ESCAPE = re.compile(r"\\(.)")


def py_pattern(pattern: str) -> str:
    """A Python pattern with ``\\s`` and ``\\b`` spelled out so that Java matches the same places (use with ``(?U)``).

    A border beside a literal letter needs a look at the other side only.
    """
    def spell(m: re.Match) -> str:
        if m[1] == "s":
            return WS
        if m[1] != "b":
            return m[0]
        if pattern[m.end() : m.end() + 1].isalnum():
            return f"(?<!{_WORD_CHAR})"
        if pattern[: m.start()][-1:].isalnum():
            return f"(?!{_WORD_CHAR})"
        return f"(?:(?<={_WORD_CHAR})(?!{_WORD_CHAR})|(?<!{_WORD_CHAR})(?={_WORD_CHAR}))"

    return _ESCAPE.sub(spell, pattern)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), rf"(?U)\A{WS}+|{WS}+\z", "")


def py_rstrip_chars(c: Column | str, chars: str) -> Column:
    """``str.rstrip(chars)`` for a set of literal characters."""
    klass = "".join("\\" + ch if not ch.isalnum() else ch for ch in chars)
    return F.regexp_replace(col_(c), rf"[{klass}]+\z", "")


def py_split_ws(c: Column | str) -> Column:
    """``str.split()``: words separated by whitespace runs; ``[]`` for blank text."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.split(s, rf"(?U){WS}+")
    )


def py_lines(c: Column | str) -> Column:
    """``str.splitlines()`` of text that was stripped first (no trailing break)."""
    return F.split(col_(c), LINE_BREAK)


def last_line(c: Column | str) -> Column:
    """Last element of ``s.strip().splitlines()``; null for blank text."""
    s = py_strip(c)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(F.element_at(py_lines(s), -1))


def count_literal(c: Column | str, needle: str) -> Column:
    """``str.count(needle)``: non-overlapping occurrences of a literal."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its top-level ``|``."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def required_literal(pattern: str) -> tuple[str, bool]:
    """(the longest text that every match of a pattern without top-level ``|`` holds, whether it is the whole pattern)."""
    runs, run, plain, i = [], "", True, 0
    while i < len(pattern):
        ch, step = pattern[i], 1
        if ch == "\\":
            ch, step = pattern[i + 1], 2
            literal = not ch.isalnum()
        else:
            literal = ch not in ".^$*+?{}[]()|"
        if ch in "([" and step == 1:  # groups and classes are skipped whole
            depth = 0
            while True:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] in "([":
                    depth += 1
                elif pattern[i] in ")]":
                    depth -= 1
                i += 1
                if depth == 0:
                    break
            step = 0
        if literal and pattern[i + step : i + step + 1] not in ("?", "*", "{"):
            run += ch
        else:
            plain = False
            runs.append(run)
            run = ""
        i += step
    return max([*runs, run], key=len), plain


def has_any(c: Column | str, patterns: tuple[str, ...] | list[str], flags: str) -> Column:
    """Any of the Python patterns occurs in the text, whatever the case; null counts as no.

    Derived from the one list by rule: a pattern without operators is a plain search, and the others
    run only where their longest literal occurs.  The text is lower-cased once (as the one element of an array).
    The dotless i and the long s are case forms of ``i`` and ``s`` to both regex engines.
    """
    def test(row: Column) -> Column:
        hits = []
        for pattern in (a for p in patterns for a in alternatives(p)):
            literal, plain = required_literal(pattern)
            found = row["low"].contains(literal.lower())
            hits.append(found if plain else found & row["raw"].rlike(py_pattern(f"(?{flags}){pattern}")))
        return reduce(lambda a, b: a | b, hits)

    row = F.struct(col_(c).alias("raw"), F.translate(F.lower(col_(c)), "ıſ", "is").alias("low"))
    return F.coalesce(F.exists(F.array(row), test), F.lit(False))


def strip_outer_tags(c: Column | str) -> Column:
    """Remove one leading ``<...>`` tag and one trailing ``<...>``/``</...>`` tag."""
    head = F.regexp_replace(col_(c), rf"(?U)\A{WS}*<[^>]+>{WS}*", "")
    return F.regexp_replace(head, rf"(?U){WS}*</?[^>]+>{WS}*\z", "")


def strip_named_tags(c: Column | str, tags: list[str] | tuple[str, ...]) -> Column:
    """Remove ``<tag ...>`` and ``</tag>`` for each listed tag (any case), keep content."""
    return reduce(
        lambda acc, tag: F.regexp_replace(acc, py_pattern(rf"(?iU)</?{tag}\b[^>]*>"), ""), tags, col_(c)
    )


def first_if_list(df_col_type, c: Column | str) -> Column:
    """A list-valued cell is replaced by its first element; scalars pass."""
    from pyspark.sql.types import ArrayType

    c = col_(c)
    if isinstance(df_col_type, ArrayType):
        return F.get(c, 0)
    return c


def normalized_key(c: Column | str) -> Column:
    """Duplicate key: ``text.strip().lower()``."""
    return F.lower(py_strip(c))
