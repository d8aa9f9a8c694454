"""Line dedup with repeated ids and clashing columns; the gear hash and the spans of substring dedup against plain Python."""

import random

import numpy as np

from ravel.llm import chunks, lines, substrings
from test_llm_operators import edge_pairs, frame, prose

LINE = "a line of forty characters and some more of them"


def test_a_line_counts_documents_and_not_rows(spark):
    few = [(1, LINE), (1, LINE), (1, LINE), (2, LINE), (2, f"{LINE}\n{LINE}"), (None, LINE), (None, LINE)]  # three documents
    assert {r.n_dropped for r in lines.line_digests(frame(spark, few)).collect()} == {0}
    many = few + [(3, LINE), (4, f"x\n  {LINE.upper()}")]
    got = sorted(((r.doc_id or 0), r.n_lines, r.n_dropped) for r in lines.line_digests(frame(spark, many)).collect())
    assert got == [(0, 1, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 1, 1), (4, 2, 0)]


def test_line_dedup_with_clashing_columns(spark):
    rows = [(i, f"{LINE}\nown {i}", i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block long, _BLOCK_ long")
    out = lines.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "_block", "_BLOCK_", "n_lines", "n_dropped"]
    assert {(r.doc_id, r["_block"], r["text"]) for r in out.collect()} == {(i, i, f"own {i}" if i < 5 else f"{LINE}\nown 5") for i in range(6)}


def test_gear_hash_by_definition():
    rng = random.Random(4)
    for n in (1, 2, 5, 11, 12, 13, 40, 300):
        raw = np.frombuffer(bytes(rng.randrange(256) for _ in range(n)), np.uint8)
        want = [sum(int(substrings._GEAR[raw[i - k]]) << k for k in range(min(i + 1, substrings.GEAR))) % 2**64 for i in range(n)]
        assert substrings.gear_hashes(raw).tolist() == want


def plain_spans(pairs):
    """The repeated spans by dictionaries; a document's rows are unique here."""
    held, rows = {}, {}
    for doc, text in pairs:
        if doc is None or not text:
            continue
        body = text.encode()
        cuts, keys, begun = substrings.keyed_chunks(body)
        points = [len(body[:c].decode()) for c in cuts.tolist()]
        rows[doc] = list(zip(keys, points, points[1:], np.diff(begun).tolist()))
        for key in keys:
            held.setdefault(key, set()).add(doc)
    out = []
    for doc, found in rows.items():
        run = []
        for key, a, b, words in [*found, (None, -1, -1, 0)]:
            if key is not None and len(held[key]) > 1 and (not run or run[-1][1] == a):
                run.append((a, b, words, min(held[key])))
                continue
            if sum(r[2] for r in run) >= substrings.MIN_WORDS:
                lost = sum(r[2] for r in run if r[3] != doc)
                out.append((doc, run[0][0], run[-1][1], sum(r[2] for r in run), lost, min(r[3] for r in run), lost > 0))
            run = [(a, b, words, min(held[key]))] if key is not None and len(held[key]) > 1 else []
    return sorted(out)


def test_spans_against_dictionaries(spark):
    rng = random.Random(8)
    shared = [prose(rng, rng.randrange(25, 90)) for _ in range(12)]
    pairs = [p for p in edge_pairs() if p[0] != 8]
    for i in range(20, 220):
        text = [prose(rng, rng.randrange(0, 60))]
        for s in rng.sample(shared, rng.randrange(3)):
            text += [s, prose(rng, rng.randrange(0, 20))]
        if i % 3 == 0:
            text.append("é " + shared[0] + " —")
        pairs.append((i, " ".join(text)))
    pairs += [(500, pairs[40][1]), (501, prose(rng, 9000) + " " + shared[1])]  # an exact copy, and a very long text
    names = ["doc_id", "start", "end", "n_words", "n_words_dropped", "owner_id", "dropped"]
    got = substrings.repeated_spans(frame(spark, pairs))
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == plain_spans(pairs)


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(9)
    text = prose(rng, 80)
    assert substrings.repeated_spans(frame(spark, [(1, text), (1, text), (None, text)])).count() == 0
    got = substrings.repeated_spans(frame(spark, [(1, text), (1, text), (2, text)])).collect()
    assert {(r.doc_id, r.dropped) for r in got} == {(1, False), (2, True)}


def test_chunks_are_cut_between_kinds_only():
    def cut(*texts):
        import pyarrow as pa

        raw, offsets = chunks.text_buffer(pa.array(texts, pa.string()))
        starts = chunks.chunk_starts(raw, offsets).tolist()
        return [raw[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(raw)])]

    assert cut("the cat, 12a b") == ["the", " cat", ",", " 12", "a", " b"]
    assert cut("wé. ×. x  y\n z", None, "", " ", "a ") == ["wé", ".", " ×.", " x  y\n z", " ", "a "]
    assert cut("a b é c") == ["a b é c"]  # wide white space somewhere: only ASCII neighbours decide
    assert "".join(cut("no 1, no 2", "don't stop!!")) == "no 1, no 2don't stop!!"


def test_the_store_of_chunks_is_bounded_and_exact():
    seen = []

    def encode(distinct):
        seen.extend(distinct)
        return np.array([ord(c) for d in distinct for c in d], np.int32), np.array([len(d) for d in distinct], np.int64)

    encoder = chunks.ChunkEncoder(encode, kept=300)
    rng = random.Random(6)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", "x" * 40, "a\x00", "a", f"w{rng.randrange(2000)}"]) for _ in range(50)) for _ in range(5)] + ["", None]
        ids, n = encoder.encode(texts)
        ends = np.cumsum(n)
        assert ["".join(map(chr, ids[e - k : e])) for e, k in zip(ends.tolist(), n.tolist())] == [t or "" for t in texts]
        assert len(encoder.keys) <= 300 and len(encoder.flat) == encoder.sizes.sum()
    assert seen.count(" the") < 60
