"""Whitening, WARC archives and the conversation trie against brute force, edge cases included."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from ravel.llm import archives, turns, whitening
from ravel.session import scratch_path

NAN, INF = float("nan"), float("inf")


# --- whitening -----------------------------------------------------------------------------------------------------


def vector_frame(spark, rows):
    """Vectors with further columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int")


def whitened(rows):
    """(n, deviations, whitened, explained) by a dense eigendecomposition."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    dev = [int(sum((n * c - t) ** 2 for c, t in zip(row, s))) for row in x]
    c = np.array((n * x - s) / n, np.float64)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, dev, c @ u / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def check_whitening(out, rows, k):
    n, dev, w, explained = whitened(rows)
    got = defaultdict(dict)
    for r in out.collect():
        got[r["vec_id"]][r["component"]] = r
    assert sorted(got) == sorted(i for i, _ in rows)
    for at, (i, _) in enumerate(rows):
        assert sorted(got[i]) == list(range(1, k + 1))
        for r in got[i].values():
            assert (r["n"], r["deviation"]) == (n, dev[at])
            assert r["identity_error"] < 1e-9 and abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
    for c in range(k):
        have = np.array([got[i][c + 1]["whitened"] for i, _ in rows])
        sign = np.sign(have @ w[:, c])
        assert np.abs(have * sign - w[:, c]).max() < 1e-8


def test_whitening_is_that_of_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24)) * np.linspace(1, 0.1, 24)
    rows = [(i, (base[i % 40] + 0.2 * rng.normal(size=24)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are one vector
    check_whitening(whitening.whiten(vector_frame(spark, rows)), rows, 8)


def test_whitening_of_few_dimensions_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, NAN, 2.0]), (53, [INF, 0.0, 0.0]), (54, [1.0, None, 2.0]), (55, [1.0, 2.0]), (56, [3e38, 0.0, 0.0])]
    out = whitening.whiten(vector_frame(spark, good[:10] + bad + good[10:]))
    check_whitening(out, good, 3)


def test_whitening_repeated_rows_null_ids_and_nothing(spark):
    rows = [(None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [0.25, 0.5])]
    out = whitening.whiten(vector_frame(spark, rows)).collect()
    assert sorted(((r["vec_id"] or -1), r["component"]) for r in out) == [(-1, 1), (-1, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert {r["n"] for r in out} == {4}
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(5)]):
        out = whitening.whiten(vector_frame(spark, rows))
        assert out.columns == columns and out.count() == 0


def test_whitening_leaves_out_components_without_variance(spark):
    rows = [(i, [float(i % 5), float(i % 5), 2.0, float(i % 3)]) for i in range(30)]
    out = whitening.whiten(vector_frame(spark, rows))
    assert sorted({r["component"] for r in out.collect()}) == [1, 2]


def test_deviation_is_exact_for_wide_numbers_and_null_beyond_a_long(spark):
    rows = [(i, [float(2**20 * (i + 1)), float(-i)]) for i in range(9)]
    n, dev, _, _ = whitened(rows)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vector_frame(spark, rows)).collect()}
    assert [got[i] for i in range(9)] == [d if d < 2**63 else None for d in dev] and None in got.values() and n == 9


@pytest.mark.parametrize("dim,wanted", [(1, 8), (5, 8), (9, 8), (40, 3), (200, 8)])
def test_jacobi_davidson_reaches_double_precision(dim, wanted):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(dim, dim))
    v = a @ a.T
    e, u = whitening.jacobi_davidson(lambda z: v @ z, dim, wanted)
    want = np.linalg.eigvalsh(v)[::-1][: min(dim, wanted)]
    assert np.abs(e - want).max() < 1e-13 * want[0] * dim
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-12 * want[0]


def test_jacobi_davidson_with_equal_and_zero_eigenvalues():
    for values in ([5.0] * 3 + [2.0] * 20, [4.0] + [0.0] * 30, [0.0] * 12, [3.0, 3.0, 1.0] + [1e-9] * 9):
        v = np.diag(values)
        e, u = whitening.jacobi_davidson(lambda z, v=v: v @ z, len(values), 8)
        assert np.allclose(e, sorted(values)[::-1][:8], atol=1e-12) and np.allclose(u.T @ u, np.eye(8), atol=1e-12)


def test_minres_solves_independent_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    b = np.hstack([rng.normal(size=(12, 3)), np.zeros((12, 1))])
    x = whitening.minres(lambda z: a @ z, b, 40, 1e-14)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 3].any()


# --- WARC ----------------------------------------------------------------------------------------------------------


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, digest string, n int")


def expected_pages(rows, least=0):
    top = defaultdict(lambda: None)
    for i, _, html in rows:
        if i is not None and (top[html or ""] is None or top[html or ""] < i):
            top[html or ""] = i
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        rep = top[html or ""] if len(body) >= least else None
        revisit = rep is not None and rep != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", rep if revisit else None))
    return sorted(out, key=repr)


PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/?a b\r\nX: y", "é漢\r\n\r\nWARC/1.1\r\n"),
         (None, "http://e/", "<p>one</p>"), (None, None, "alone"), (7, "http://f/", "x" * 300_000), (8, "", "\x00\x1c"), (2, "http://b/", "<p>one</p>"), (9, "http://g/", "long " * 900_000)]


def run_archives(spark, rows, **options):
    out = scratch_path(spark, "test-archives")
    archives.write_archives(page_frame(spark, rows), out, **options)
    return out


def test_archives_round_trip(spark):
    rows = PAGES + [(100 + i, f"http://copies/{i}", "the same page") for i in range(60)]
    out = run_archives(spark, rows)
    read = archives.read_records(archives.read_index(spark, out), out).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read), key=repr) == expected_pages(rows)
    html = {(i, u): h or "" for i, u, h in rows}
    for r in read:
        want = html[r["page_id"], r["url"]].encode() if r["record_type"] == "response" else b""
        assert bytes(r["payload"]) == want


def test_small_payloads_are_all_responses(spark):
    out = run_archives(spark, PAGES, least=5)
    read = archives.read_records(archives.read_index(spark, out), out, payload=False)
    assert read.columns == ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect()), key=repr)
    assert got == expected_pages(PAGES, 5) and {r[3] for r in got if r[0] in (3, 4)} == {"response"}


def warc_records(data):
    """Records of an uncompressed WARC stream, read by the rules of the format alone."""
    source, out = io.BytesIO(data), []
    while line := source.readline():
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := source.readline()) != b"\r\n":
            k, v = line[:-2].split(b": ", 1)
            fields[k] = v
        out.append((fields, source.read(int(fields[b"Content-Length"]))))
        assert source.read(4) == b"\r\n\r\n"
    return out


def test_archives_are_warc_files_with_a_gzip_member_a_record(spark):
    out = run_archives(spark, PAGES[:6], file_bytes=400)  # several files a task
    index = archives.read_index(spark, out).collect()
    fs, root = archives.folder(f"{out}/archives")
    found = []
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if not f.path.endswith(".warc.gz"):
            continue
        body = fs.open_input_file(f.path).read()
        records = warc_records(gzip.decompress(body))
        assert records[0][0][b"WARC-Type"] == b"warcinfo"
        name = f.path.rsplit("/", 1)[1]
        mine = sorted((r for r in index if r["file"] == name), key=lambda r: r["offset"])
        assert len(mine) == len(records) - 1
        for r, (fields, block) in zip(mine, records[1:]):
            alone = warc_records(gzip.decompress(body[r["offset"] : r["offset"] + r["length"]]))
            assert alone == [(fields, block)] and fields[b"WARC-Type"].decode() == r["record_type"]
            found.append((fields, block))
    assert len(found) == 6 and len({r["file"] for r in index}) > 1
    responses = {f[b"WARC-Record-ID"] for f, _ in found if f[b"WARC-Type"] == b"response"}
    revisits = [f for f, _ in found if f[b"WARC-Type"] == b"revisit"]
    assert revisits and all(f[b"WARC-Refers-To"] in responses for f in revisits)
    assert all(b"\r" not in f.get(b"WARC-Target-URI", b"") and b" " not in f.get(b"WARC-Target-URI", b"") for f, _ in found)


def test_selected_records_only(spark):
    out = run_archives(spark, [(i, f"http://host{i % 3}/{i}", f"page {i}") for i in range(200)])
    chosen = archives.read_index(spark, out).where(F.col("url").startswith("http://host1/"))
    for gap in (0, 1 << 20):
        read = archives.read_records(chosen, out, gap=gap).collect()
        assert {(r["page_id"], bytes(r["payload"]).decode()) for r in read} == {(i, f"page {i}") for i in range(200) if i % 3 == 1}


def test_byte_ranges_are_coalesced_by_gap_and_size():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 50), ("a", 150, 500), ("b", 650, 10)]
    assert list(archives.coalesced(rows, 60, 5)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(archives.coalesced(rows, 10_000, 1_000)) == [(0, 5), (5, 6)]
    assert list(archives.coalesced([], 10, 10)) == []


def test_damage_is_noticed(spark):
    body = archives.member(archives.pack_record(1, "http://a/", b"payload", None, False, archives.base32_sha1(b"payload")))
    assert archives.unpack_record(body)[1] == b"payload"
    for bad in (body[:-1], body[:40] + b"\x00" + body[41:], body + body, b""):
        with pytest.raises(ValueError):
            archives.unpack_record(bad)
    out = run_archives(spark, [(1, "http://a/", "text")])
    wrong = archives.read_index(spark, out).withColumn("payload_digest", F.lit("A" * 32))
    with pytest.raises(Exception, match="digest differs"):
        archives.read_records(wrong, out).collect()


def test_no_pages_no_archive(spark):
    out = run_archives(spark, [])
    assert archives.read_index(spark, out).count() == 0
    assert archives.read_records(archives.read_index(spark, out), out).count() == 0


# --- conversation trie ---------------------------------------------------------------------------------------------


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int")


def expected_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns_of = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns_of.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = turns_of.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        value = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += value
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check_trie(spark, rows):
    out = turns.conversation_trie(turn_frame(spark, rows))
    assert out.columns == TRIE
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected_trie(rows)


def test_trie_of_random_conversations(spark):
    rng = random.Random(2)
    words = ["", "yes", "no", "é漢", "go on"]
    rows = []
    for c in range(-12, 90):
        if c % 11 != 3:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randrange(1, 14))]
    rng.shuffle(rows)
    check_trie(spark, rows)


def test_trie_with_a_long_hot_conversation(spark):
    """One conversation has a third of all turns: many bands of bands."""
    rng = random.Random(3)
    rows = [(10, t, "user", rng.choice("ab")) for t in range(700)] + [(14, t, "user", "a") for t in range(64)] + [(13, t, "user", "a") for t in range(65)]
    rows += [(20 + c, t, "user", "a") for c in range(200) for t in range(1 + c % 9)]
    check_trie(spark, rows)


def test_trie_edge_cases(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 3, "user", "b"), (0, 3, "user", "b"), (1, 5, "", ""), (1, None, "user", None), (2, 0, "user", "long " * 100_000),
            (7, 1, "user", "x"), (-1, 0, "user", "x"), (2**40, 0, "user", "x")]
    check_trie(spark, rows)
    check_trie(spark, [(6, 0, "user", "the base is absent")])  # may be turnless: the root alone
    assert turns.conversation_trie(turn_frame(spark, [])).columns == TRIE
    for rows in ([], [(None, 0, "user", "x")]):
        assert turns.conversation_trie(turn_frame(spark, rows)).count() == 0


def test_trie_of_many_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1500) for t in range(9)]
    check_trie(spark, rows)
