"""Marker-word masks over token rows whose ids are word lengths, so that most words are markers."""

import pytest
from pyspark.sql import functions as F

from ravel.catalog import MASK_SEQS, QUERIES
from ravel.functions import tokens as TK
from ravel.params import MASK_WORDS


def greedy(ids, seqs):
    out, at = [], 0
    while at < len(ids):
        size = next((len(q) for q in seqs if ids[at : at + len(q)] == q), 0)
        out += [(at, size)] * (size > 0)
        at += size or 1
    return out


@pytest.mark.parametrize("name", ["mask_marker_words", "prepare_sft"])
def test_a_share_of_all_words_with_a_markers_length_is_masked(spark, tmp_path, name):
    texts = ["now we see that there is one more sum to add before the very last line", "so it goes " * 40, "", None]
    docs = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert MASK_SEQS == [[len(w)] if w not in ("Let", "Now") else [3, len(w) + 1] for w in MASK_WORDS]
    rows = {r.id: r.labels for r in QUERIES[name](spark, str(tmp_path)).collect()}
    thinks = {1: "\n\nBut then. Alternatively, no", 2: "\n\nHence"}
    for i, tail in thinks.items():
        think = (texts[i] + tail).split(" ")
        response = f"\n1. take the en case\n 2. then add\nSo \\boxed{{{'\\frac{1}{2}' if i % 2 else i}}}".split(" ")
        ids = [1, 2, 1000, *map(len, think), 1001, *map(len, response)]
        chosen = int(len(greedy(ids, MASK_SEQS)) * 0.3)
        assert len(rows[i]) == len(ids) and (i == 2 or chosen > 20)
        masked = [k for k, x in enumerate(rows[i]) if x == -100 and k > 2]
        assert all(x in (y, -100) for x, y in zip(rows[i], ids, strict=True)) and set(rows[i][:3]) == {-100}
        if name == "mask_marker_words":
            held = [(k, n) for k, n in greedy(ids, MASK_SEQS) if k in masked]
            assert {k + j for k, n in held for j in range(n)} >= set(masked) and len(held) <= chosen + 1


def test_word_spans_of_odd_rows(spark):
    rows = [(None,), ([],), ([7, None, 7, 8, 7],), ([8, 7, 7, 8, 8, 7, 8],)]
    seqs = [[7, 8], [8], [8, 7]] + [[9000 + i, 7] for i in range(9000)]  # more tokens than there are characters before line separators
    got = spark.createDataFrame(rows, "ids array<int>").select(TK.word_spans("ids", seqs).alias("s")).collect()
    found = [r.s and [(x.s, x.l) for x in r.s] for r in got]
    assert found == [None, [], [(2, 2)], [(0, 1), (2, 2), (4, 1), (5, 2)]]
    last = spark.range(1).select(TK.word_spans(F.array(F.lit(9000 + 8000), F.lit(7)), seqs).alias("s")).first().s
    assert [(x.s, x.l) for x in last] == [(0, 2)]
