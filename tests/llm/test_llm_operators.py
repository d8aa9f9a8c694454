"""The training-data operators against brute force on small tables, edge cases included."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ravel.llm import bpe, decontam, jaccard, lines, quality, secrets, substrings, toxicity, vectors, wavelet
from ravel.llm.common import connected_components, shingle_hashes
from ravel.llm.queries import table
from ravel.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_lines string, ids string, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, pairs):
    """Documents with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "x", None, None) for i, t in pairs], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def edge_pairs():
    return [(None, "a text without an id that is long enough to be kept as a line"), (1, None), (2, ""), (3, " \t\n "), (4, "one"),
            (5, "é" * 39), (6, "long " * 30_000), (7, "\x00\x1c  odd"), (8, "one"), (8, "one")]


def sets_of(pairs):
    out = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def joined(n, pairs):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(12)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (5, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = joined({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- line dedup ---------------------------------------------------------------


def brute_lines(pairs, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in pairs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-1 if i is None else i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in pairs:
        rows = (t or "").split("\n")
        stays = [x for x in rows if top.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        out.append((i, len(rows), len(rows) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    shared = [prose(rng, 9) for _ in range(30)] + ["É" * 45, "x" * 39, "y" * 40]
    pairs = edge_pairs()
    for i in range(20, 160):
        text = [prose(rng, rng.randrange(1, 14)) for _ in range(rng.randrange(5))]
        for s in rng.sample(shared, rng.randrange(5)):
            text += [rng.choice([s, s.upper().replace("É", "é") if s[0] == "É" else s.upper(), " \t" + s + "\x0b"])] * rng.choice([1, 2])
        if i % 3 == 0:
            text.append("the one line that a third of all documents has in common")
        pairs.append((i, "\n".join(text)))
    got = [tuple(r) for r in lines.line_digests(frame(spark, pairs)).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(pairs), key=repr)
    kept = lines.drop_repeated_lines(frame(spark, pairs))
    assert kept.columns == ["doc_id", "text", "ids", "n", "n_lines", "n_dropped"]
    assert lines.line_digests(frame(spark, [])).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        mph = lines.MinimalPerfectHash.load(*lines.MinimalPerfectHash.build(a, b).dump())
        assert sorted(mph.slot(a, b).tolist()) == list(range(n))


# ---- quality and toxicity -------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.predicted == rows.quality).mean()) > 0.93
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()
    odd = quality.score_quality(frame(spark, edge_pairs()), model).collect()
    assert len(odd) == len(edge_pairs()) and all(0 <= r.score <= 1 for r in odd)
    for r in odd:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = quality.score_quality(frame(spark, edge_pairs()), model, keep=True)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.score >= 0.3 for r in odd)
    assert quality.score_quality(frame(spark, []), model).count() == 0


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "some text"), (2, None)])
    model = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(docs, model).count() == 2


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "said").join(labels, "doc_id").where("held_out").toPandas()
    bad = rows[rows.toxic == 1]
    assert bad.said.mean() > 0.85 and rows[rows.toxic == 0].said.mean() < 0.02
    assert toxicity.score_toxicity(frame(spark, edge_pairs()), model).count() == len(edge_pairs())


def test_ordinal_grades():
    rng = random.Random(5)
    docs, grades = [], []
    for _ in range(900):
        g = rng.randrange(4)
        text = prose(rng, 12) + " mild" * (g >= 1) + " harsh" * (g >= 2) + " vile" * (g >= 3)
        docs.append(toxicity.features(text))
        grades.append(g)
    model = toxicity.OrdinalModel.fit(docs, np.array(grades))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) >= 0).all()
    severity = [model.above(d).sum() for d in docs]
    means = [np.mean([s for s, g in zip(severity, grades) if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] > 2 and means[0] < 0.5


# ---- substrings -----------------------------------------------------------------


def test_repeated_passages_are_found(spark):
    rng = random.Random(7)
    passage = [prose(rng, 51 + rng.randrange(30)) for _ in range(4)] + ["same " * 60]
    pairs, holders = edge_pairs()[:6], defaultdict(list)
    for i in range(20, 80):
        text = prose(rng, rng.randrange(5, 80))
        if i % 4 == 0:
            p = rng.randrange(5)
            holders[p].append(i)
            text += " " + passage[p] + " " + prose(rng, 30)
        pairs.append((i, text))
    got = substrings.repeated_spans(frame(spark, pairs)).collect()
    want = {i for v in holders.values() if len(v) > 1 for i in v}
    assert {r.doc_id for r in got} == want
    texts = dict(pairs)
    for r in got:
        assert 0 <= r.start < r.end <= len(texts[r.doc_id]) and r.dropped == (r.n_words_dropped > 0)
    firsts = {min(v) for v in holders.values() if len(v) > 1}
    assert not any(r.dropped for r in got if r.doc_id in firsts)
    assert substrings.repeated_spans(frame(spark, [])).count() == 0


def test_borders_resist_shifts():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh éß") for _ in range(4000)).encode()
    a = substrings.borders(np.frombuffer(text, np.uint8))
    b = substrings.borders(np.frombuffer(b"xyz " + text, np.uint8)) - 4
    assert len(set(a.tolist()) - set(b.tolist())) <= 2
    cuts = [0, *a.tolist()]
    assert b"".join(text[i:j] for i, j in zip(cuts, cuts[1:])) == text
    assert all(text[i:j].decode() for i, j in zip(cuts, cuts[1:]))


# ---- Jaccard join -----------------------------------------------------------------


def near_pairs(rng, base, copies, edits):
    words = base.split()
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("unit", [2048, 5])
def test_jaccard_groups(spark, unit):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += near_pairs(rng, prose(rng, 120), 40, 4)  # similarities on both sides of 0.8
    texts += near_pairs(rng, prose(rng, 60), 12, 2) + [texts[0]] * 3 + ["a b c", "A  b\tc", "a b d"]
    common = prose(rng, 60)
    texts += [common + " " + prose(rng, 25) for _ in range(15)]
    rng.shuffle(texts)
    pairs = edge_pairs()[1:-1] + list(enumerate(texts, 20))
    sets = sets_of(pairs)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = joined(ids, links)
    got = jaccard.near_duplicate_groups(frame(spark, pairs), unit=unit).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_jaccard_edges(spark):
    got = jaccard.near_duplicate_groups(frame(spark, edge_pairs())).collect()
    assert len(got) == len(edge_pairs())
    assert [r.component_id for r in got if r.doc_id == 8] == [4, 4] and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicate_groups(frame(spark, [])).count() == 0
    kept = jaccard.keep_one_of_each_group(frame(spark, edge_pairs()))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_bitmap_bound():
    rng = random.Random(4)
    for _ in range(200):
        a = np.unique(shingle_hashes(prose(rng, rng.randrange(5, 300)).encode()))
        b = np.unique(np.concatenate([a[: rng.randrange(len(a) + 1)], shingle_hashes(prose(rng, rng.randrange(5, 300)).encode())]))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.fold(x, width) ^ jaccard.fold(y, width)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) // 2


# ---- decontamination ----------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, rng.randrange(1, 60))) for k in range(60)] + [(60, None), (61, ""), (None, prose(rng, 20)), (62, "one")]
    pairs = edge_pairs()
    for i in range(20, 90):
        text = prose(rng, rng.randrange(20, 400)).split()
        if i % 2:
            words = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(3)):  # some stay above 80%, some don't
                words[rng.randrange(len(words))] = "other"
            at = rng.randrange(len(text))
            text[at:at] = words
        pairs.append((i, " ".join(text).upper() if i % 7 == 0 else " ".join(text)))
    want = []
    for i, t in pairs:
        held = sets_of([(i, t)])[i]
        for k, text in items:
            own = sets_of([(k, text)])[k]
            if own and 10 * len(own & held) >= 8 * len(own):
                want.append((i, k, len(own & held), len(own)))
    schema = "item_id long, text string"
    docs, tests = frame(spark, pairs), spark.createDataFrame(items, schema)
    for block_chars in (decontam.BLOCK_CHARS, 2000):
        got = [tuple(r)[:4] for r in decontam.contaminated_documents(docs, tests, block_chars=block_chars).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        clean = decontam.drop_contaminated(docs, tests, block_chars=block_chars)
        assert clean.columns == docs.columns and clean.count() == len(pairs) - sum(1 for i, t in pairs if any(
            own and 10 * len(own & sets_of([(i, t)])[i]) >= 8 * len(own) for own in (sets_of([(k, x)])[k] for k, x in items)))
    assert decontam.contaminated_documents(docs, spark.createDataFrame([], schema)).count() == 0


# ---- secrets ---------------------------------------------------------------------------


def test_base_secrets():
    text = 'é Password: "abcdefgh1" TOKEN=short api-key=x apikey = 12345678, AKIAABCDEFGHIJKL AKIASHORT ' + "ab" * 16 + " " + "0f" * 15
    got = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.base_spans(text)]
    assert got == [("assign", 'Password: "abcdefgh1'), ("assign", "apikey = 12345678"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "ab" * 16)]
    assert secrets.base_spans('password="secret: abcdefgh') == []  # the failing match has used up the second name
    assert secrets.base_spans("toKen=abcdefgh1") == []  # letters in either case means ASCII letters


def test_secret_network_and_digests(spark):
    rng = random.Random(17)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    pairs = edge_pairs()
    for i in range(20, 500):
        text = prose(rng, 20)
        if i % 3 == 0:
            text += f' token = "{token(40)}" ' + prose(rng, 5)
        if i % 3 == 1:
            text += f" mail{i}.example-site{i}.com/index.html " + prose(rng, 5)
        pairs.append((i, text))
    hidden = "Auth: " + "".join(rng.choice("0123456789abcdef") for _ in range(28))
    net = secrets.fit_secrets(frame(spark, pairs))  # fitted without the hidden one, which has no label of a secret
    assert net.threshold < 1
    pairs.append((999, hidden))
    docs = frame(spark, pairs)
    rows = {r.doc_id: r for r in secrets.secret_digests(secrets.find_secrets(docs, net)).collect()}
    assert "net:6:34" in rows[999].spans
    texts = dict(pairs)
    for i, r in rows.items():
        base = secrets.base_spans(texts[i] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said
    assert sum("net" in r.spans for i, r in rows.items() if i and 20 <= i < 500 and i % 3 == 1) < 8
    plain = secrets.fit_secrets(frame(spark, [(1, "nothing here"), (2, None)]))
    assert plain.threshold == 1.0


# ---- vectors ------------------------------------------------------------------------------


def test_e8_decoder():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (300, 8))
    p = vectors.nearest_e8(x)
    half = p[:, :1] % 1
    assert np.allclose(p % 1, half) and np.allclose(p.sum(1) % 2, 0)
    best = ((x - p) ** 2).sum(1)
    for r in vectors._ROOTS:  # no neighbouring lattice point is nearer
        assert (((x - p - r) ** 2).sum(1) >= best - 1e-9).all()


@pytest.mark.parametrize("unit", [4096, 7])
def test_near_vectors(spark, unit):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for group in range(30):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 25)):
            rows.append((i, (centre + rng.normal(0, 0.13, 24)).astype(np.float32).tolist(), int(group % 3)))
            i += 1
    rows += [(i, rows[0][1], rows[0][2]), (i + 1, rows[0][1], None), (i + 2, None, 1), (i + 3, [0.0] * 24, 1), (i + 4, [float("nan")] * 24, 1),
             (i + 5, [1.0, None] * 12, 1), (i + 6, [], 1), (i + 7, [1.0, 2.0], 1), (i + 8, [1e300] * 2, 1), (i + 9, [2.0, 2.0], 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), unit=unit).collect()}
    ok = {v: (np.array(e, float) / np.linalg.norm(np.array(e, float) / max(abs(x) for x in e)) / max(abs(x) for x in e), lab) for v, e, lab in rows
          if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    links = {(a, b) for a, (x, s) in ok.items() for b, (y, t) in ok.items() if a != b and s == t and len(x) == len(y) and x @ y >= 0.93}
    n = {v: sum(1 for a, _ in links if a == v) for v, _, _ in rows}
    found = sum(got[v].n_links for v in got)
    assert all(got[v].n_links <= n[v] for v in got) and found >= 0.9 * len(links) and len(links) > 500
    want = joined([v for v, _, _ in rows], links)
    assert sum(got[v].component_id != want[v] for v in got) <= 0.02 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(rows)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# ---- tokens -------------------------------------------------------------------------------------


def odd_texts(rng, n):
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "1", "23", "...", "%%%", "\x1c", "\x85", " ", "\xa0", "日本", "🙂", "the ", "ing", "aaaa", "    ", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(19)
    texts = odd_texts(rng, 800) + ["a" * 5000, " " * 3000, "ab" * 3000, "".join(rng.choice("abcdef") for _ in range(20_000)), "日" * 900]
    pairs = edge_pairs() + list(enumerate(texts, 20))
    rows = bpe.encode_documents(frame(spark, pairs))
    assert rows.columns == ["doc_id", "text", "n_lines", "n", "ids"]
    for r in bpe.decode_documents(rows).collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.encoding_digests(rows).collect()}
    want = library.encode_ordinary(texts[0])
    assert digests[20].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, [])).count() == 0


def test_rank_bitmap():
    rng, queue, held = random.Random(1), bpe.RankBitmap(50_000), set()
    for _ in range(3000):
        n = rng.randrange(50_000)
        if rng.random() < 0.6:
            queue.add(n)
            held.add(n)
        else:
            queue.discard(n)
            held.discard(n)
        assert queue.first() == min(held, default=-1)


def test_token_shards(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(wavelet.TOKENIZER))
    pairs = [p for p in edge_pairs()[:-1]] + list(enumerate(odd_texts(random.Random(23), 400), 20))
    random.Random(1).shuffle(pairs)
    out = scratch_path(spark, "shards")
    wavelet.write_token_shards(frame(spark, pairs), out, shard_tokens=700, partition_chars=20_000)
    got = {r.doc_id: r for r in wavelet.read_token_shards(spark, out).collect()}
    start = 0
    for i, t in sorted(pairs, key=lambda p: -1 if p[0] is None else p[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = scratch_path(spark, "shards")
    wavelet.write_token_shards(frame(spark, []), empty)
    assert wavelet.read_token_shards(spark, empty).count() == 0


@pytest.mark.parametrize("n,alphabet", [(0, 3), (1, 1), (700, 1), (3000, 41)])
def test_wavelet_matrix(n, alphabet):
    rng = np.random.default_rng(n)
    seq = rng.integers(0, 50_000, alphabet)[rng.integers(0, alphabet, n)].astype(np.int32)
    _, _, m = wavelet.open_shard(wavelet.pack_shard([1], np.array([n]), seq))
    assert (m.all() == seq).all() and m.count(50_001) == 0
    if n:
        at = rng.integers(0, n, 60)
        assert (m.access(at) == seq[at]).all()
        for x in seq[at[:6]].tolist():
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert m.count(x, lo, hi) == (seq[lo:hi] == x).sum()
            places = np.flatnonzero(seq == x)
            assert [m.select(x, k) for k in (0, len(places) - 1, len(places))] == [places[0], places[-1], -1]
