"""Secret scans: values read from end to end, every candidate, base spans against a scan by hand."""

import random
import time

import numpy as np

from ravel.llm import secrets
from test_llm_operators import frame


def test_the_middle_of_a_long_value_is_read(spark):
    net = secrets.SecretNet()  # says yes where a value has one of the signs + / =
    net.w = [np.zeros_like(w) for w in net.w]
    net.w[0][secrets.KERNEL // 2 * secrets._CLASSES + 6, 0] = 10
    net.w[2][2 * secrets.FILTERS] = 10
    net.w[3][0], net.threshold = -50, 0.5
    values = {1: "a1" + "q" * 60 + "+/+/" + "w" * 300 + "9z", 2: "a1" + "q" * 360 + "9z", 3: "a1" + "q" * 17 + "+" + "w" * 21, 4: "z" * 500 + "7" + "=", 5: ""}
    found = secrets.find_secrets(frame(spark, [(i, f"see {v} there") for i, v in values.items()]), net).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found} == {
        i: [("net", 4, 4 + len(v))] if i in (1, 3, 4) else [] for i, v in values.items()}


def test_windows_cover_every_character():
    for size in [*range(1, 200), 1001]:
        at = secrets.offsets(size)
        assert {i for a in at for i in range(a, min(size, a + secrets.VALUE))} == set(range(size)) and min(at) == 0


VALUE_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def run_of(text, at, signs):
    end = at
    while end < len(text) and text[end] in signs:
        end += 1
    return end


def by_hand(text):
    """The base spans, read character by character without patterns."""
    out, at = [], 0
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        end = at + 1
        for name in NAMES:
            if lower.startswith(name, at):
                i = at + len(name)
                i += text[i : i + 1] in ("'", '"')
                i = run_of(text, i, " ")
                if text[i : i + 1] in (":", "="):
                    i = run_of(text, i + 1, " ")
                    i += text[i : i + 1] in ("'", '"')
                    stop = run_of(text, i, VALUE_CHARS)
                    if stop > i:
                        end = stop
                        if stop - i >= 8:
                            out.append((at, 0, stop))
                break
        at = end
    for kind, head, signs, least in ((1, "AKIA", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", frozenset("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            stop = run_of(text, at + len(head), signs) if text.startswith(head, at) else at
            if stop > at + len(head):
                if stop - at >= least:
                    out.append((at, kind, stop))
                at = stop
            else:
                at += 1
    return sorted(out)


def test_base_spans_by_hand():
    rng = random.Random(3)
    parts = [*NAMES, "Api_Key", "SECRET", "to\u212aen", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "ABCDEF12", "a1b2c3d4", "0123456789abcdef", "z", "-", "\u00e9", "\n", "x.y/z+"]
    seen = 0
    for _ in range(12_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        seen += bool(by_hand(text))
        assert secrets.base_spans(text) == by_hand(text), text
    assert seen > 1000


def test_every_run_is_a_candidate():
    text = "pwd is Xk9!mQ2@vL then Bearer abcdefghijklmnopqrstuvwxyzABCD short1 token=abcdefgh1~tail~of~it"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b in secrets.candidates(text, base)] == ["Xk9!mQ2@vL", "abcdefghijklmnopqrstuvwxyzABCD", "~tail~of~it"]
    assert secrets.candidates("", []) == [] and secrets.candidates("a" * 7, []) == []


def test_windows_against_slices():
    text = "\u00e9\U0001f600ab key: Xk9!mQ2@vL and " + "q7" * 60 + " end"
    values = [(0, 3), (9, 19), (24, 144), (145, len(text))]
    x, counts = secrets.views(text, values)
    assert counts.tolist() == [len(secrets.offsets(b - a)) for a, b in values]
    rows = iter(x)
    for a, b in values:
        for at in secrets.offsets(b - a):
            parts = (text[max(0, a - secrets.CONTEXT) : a].rjust(secrets.CONTEXT, "\0"), text[a + at : min(b, a + at + secrets.VALUE)].ljust(secrets.VALUE, "\0"),
                     text[b : b + secrets.CONTEXT].ljust(secrets.CONTEXT, "\0"))
            assert next(rows).tolist() == [secrets._CLASS[min(ord(c), 256)] for c in "".join(parts)]


def test_looked_up_convolution():
    net, rng = secrets.SecretNet(), np.random.default_rng(1)
    net.w[1] = rng.normal(0, 0.1, secrets.FILTERS)
    x = rng.integers(0, secrets._CLASSES, (700, secrets._WIDTH)).astype(np.uint8)
    assert np.allclose(net.logits(x), net._forward(x)[3], atol=1e-4) and len(net.logits(x[:0])) == 0


def test_a_text_full_of_assignments_takes_seconds(spark):
    text = "password = abcdefgh12 Zk9!mQ2@vL " * 30_000
    began = time.monotonic()
    base = secrets.base_spans(text)
    found = secrets.candidates(text, base)
    assert (len(base), len(found)) == (30_000, 30_000) and time.monotonic() - began < 20


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    net = secrets.SecretNet()
    rows = [(None, "secret: abcdefgh1"), (1, None), (1, ""), (2, "token=12345678"), (2, "token=12345678")]
    docs = frame(spark, rows).selectExpr("*", "1 as spans", "2 as kind", "3 as r")
    found = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.find_secrets(docs, net).collect()]
    assert sorted(found, key=str) == sorted([(None, [("assign", 0, 17)]), (1, []), (1, []), (2, [("assign", 0, 14)]), (2, [("assign", 0, 14)])], key=str)
    empty = docs.where("doc_id = 77")
    assert secrets.find_secrets(empty, secrets.fit_secrets(empty)).count() == 0 and secrets.fit_secrets(docs).threshold <= 1


def test_the_fit_does_not_depend_on_the_partitions(spark):
    rng = random.Random(5)
    pairs = [(i, f"plainwords number{i}x9 token={rng.getrandbits(60):x}00 " * 3) for i in range(60)]
    one, many = (secrets.fit_secrets(frame(spark, pairs).repartition(n), train_findings=20) for n in (1, 7))
    assert one.threshold == many.threshold < 1 and all((a == b).all() for a, b in zip(one.w, many.w, strict=True))


def test_every_finding_of_every_document_is_learnt_from(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(i, f"plainwords follow number{i}x9 token={rng.getrandbits(60):x}00 here") for i in range(50)] + [(None, "continuous lines")] * 2
    seen = []
    solve, calibrate = secrets.SecretNet.solve, secrets.SecretNet.calibrate
    monkeypatch.setattr(secrets.SecretNet, "solve", lambda net, products, counts: (seen.append(counts.tolist()), solve(net, products, counts)))
    monkeypatch.setattr(secrets.SecretNet, "calibrate", lambda net, z, t, n: (seen.append([int(n[t == 0].sum()), int(n[t > 0].sum())]), calibrate(net, z, t, n)))
    net = secrets.fit_secrets(frame(spark, pairs), train_findings=3)
    want = np.zeros(secrets.FOUND, int)
    for _, text in pairs:
        want += np.bincount(secrets.findings(text)[1], minlength=secrets.FOUND)
    (words, runs, found), (others, more) = seen
    assert [words + runs + others, found + more] == [want[:2].sum(), want[2]] and more and others and net.threshold < 1


def test_secrets_of_one_document_serve_for_fit_and_calibration(spark):
    pairs = [(1, "secret: Zk9mQ2vL77aab1 and plainwords follow number1x92")]
    assert secrets.fit_secrets(frame(spark, pairs)).threshold <= 1


def test_closed_form_is_the_weighted_least_squares_fit():
    rng, net = np.random.default_rng(4), secrets.SecretNet()
    x, kind = rng.integers(0, secrets._CLASSES, (400, secrets._WIDTH)).astype(np.uint8), np.repeat([0, 1, 2], [300, 80, 20])
    g = net.grains(x)
    net.solve(np.array([g[kind == k].T @ g[kind == k] for k in range(3)]), np.bincount(kind))
    share = np.array([0.25 / 300, 0.25 / 80, 0.5 / 20])[kind] ** 0.5
    a, y = g / secrets.GRAIN, np.where(kind == 2, 1.0, -1.0)
    ridge = np.eye(a.shape[1])[:-1] * 1e-5**0.5
    want = np.linalg.lstsq(np.concatenate([a * share[:, None], ridge]), np.append(y * share, np.zeros(len(ridge))), rcond=None)[0]
    assert np.allclose(np.append(net.w[2], net.w[3]), want, atol=1e-6)
