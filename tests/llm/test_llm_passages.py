"""Passages of just over 50 words in unrelated documents: every one has a span."""

import random

import numpy as np

from ravel.llm import substrings
from test_llm_operators import frame, prose


def longest_span(passage, around):
    """Words of the longest run of chunks that two texts share, given what stands around a passage."""
    (_, keys, begun), (_, other, _) = (substrings.keyed_chunks(f"{left}{passage}{right}".encode()) for left, right in around)
    other, run, most = set(other), 0, 0
    for key, words in zip(keys, np.diff(begun).tolist()):
        run = run + words if key in other else 0
        most = max(most, run)
    return most


def test_no_passage_of_more_than_50_words_is_lost():
    rng = random.Random(51)
    makers = [lambda n: prose(rng, n), lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n)),
              lambda n: " ".join("x" * rng.randrange(1, 30) + rng.choice("éü,.") for _ in range(n)), lambda n: "same " * (n - 1) + "same"]
    for i in range(6000):
        passage = makers[i % 4](rng.randrange(51, 61))
        glue = "" if i % 3 == 0 else " "  # the passage may begin and end within words
        around = [(prose(rng, rng.randrange(1, 40)) + glue, glue + prose(rng, rng.randrange(1, 40))) for _ in range(2)]
        assert longest_span(passage, around) >= substrings.MIN_WORDS, (i, passage, around)


def test_short_passages_reach_the_table(spark):
    rng = random.Random(52)
    pairs = []
    for i in range(0, 3000, 2):
        passage = prose(rng, 51)
        pairs += [(j, f"{prose(rng, rng.randrange(1, 60))} {passage} {prose(rng, rng.randrange(1, 60))}") for j in (i, i + 1)]
    got = substrings.repeated_spans(frame(spark, pairs)).collect()
    assert {r.doc_id for r in got} == set(range(3000))
    assert {r.doc_id for r in got if r.dropped} == set(range(1, 3000, 2))
