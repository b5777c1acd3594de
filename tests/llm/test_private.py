import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1]))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_match_plain_regular_expressions():
    rng = random.Random(1)
    pieces = ["a", "é", "@", "@", ".", "..", "-", "+", "+1", " ", "(", ")", "0", "12", "255", "256", "007", "x@y.z", "a.b@c-d.e.f", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "+49 (30) 123456", "%_", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@a" * 100_000, "+1" + " " * 200_000, "a@b" + ".c" * 100_000):
        pii.base_spans(text)


def test_gradients():
    """Of all weights, against differences; and of the chain, against all tag sequences."""
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.integers(40, 60, (5, 3)), np.array([[0, 1, 2], [1, 2, 2], [2, 0, 0], [0, 3, 5], [3, 4, 6]])
    _, grads = model.gradients(x, y)
    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "x":
                at = (at[0], int(x[1, 1]), at[2])
            before, out = w[at], []
            for d in (1e-3, -1e-3):
                w[at] = before + d
                out.append(model.gradients(x, y)[0])
            w[at] = before
            assert grads[name][at] == pytest.approx((out[0] - out[1]) / 2e-3, rel=2e-2, abs=2e-4), name
    e = model.scores(x)[0]
    tags, sure = model.decode(x)
    best = {}
    for code in range(9**5):
        path = [code // 9**k % 9 for k in range(5)]
        if all(pii._ALLOWED[a, b] for a, b in zip(path, path[1:], strict=False)):
            score = sum(e[k, 0, t] for k, t in enumerate(path)) + sum(model.w["step"][a, b] for a, b in zip(path, path[1:], strict=False))
            best[tuple(path)] = score
    assert tuple(tags[0]) == max(best, key=best.get)
    total = sum(np.exp(s) for s in best.values())
    assert sure[0] == pytest.approx([sum(np.exp(s) for p, s in best.items() if p[k] == t) / total for k, t in enumerate(tags[0])], rel=1e-3)


def test_windows_cover_what_opens_the_gate():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["x" * rng.randint(1, 150), "7", "@", " dot ", "(at)"]) for _ in range(rng.randint(0, 12)))
        starts = pii.window_starts(text)
        assert starts == sorted(set(starts))
        for m in pii._gate.finditer(text):
            for a in range(max(0, m.start() - pii.STRIDE), min(len(text), m.end() + pii.STRIDE)):
                assert any(s <= a < s + pii.WINDOW for s in starts)
        # a span of up to STRIDE characters around a digit is whole in some window
        for m in re.finditer("7", text):
            for a in range(max(0, m.start() - pii.STRIDE + 1), m.start() + 1):
                b = min(len(text), a + pii.STRIDE)
                assert any(s <= a and b <= s + pii.WINDOW for s in starts)


class _Ascii(pii.Tagger):
    """Takes every run of ASCII characters for an address."""

    def read(self, x, sizes):
        e = np.zeros((*x.shape, pii.TAGS), np.float32)
        plain = x < 128
        e[..., 0] = np.where(plain, -9, 9)
        e[..., 1:3] = np.where(plain, 9, -9)[..., None]
        e[..., 3:] = -99
        return e


def test_every_position_is_read():
    """Also where no digit, sign or bracket stands, and spans beyond what windows share, wherever the windows' edges fall."""
    step = np.zeros((pii.TAGS, pii.TAGS), np.float32)
    step[1:, 1] = -9
    model = _Ascii({"step": step})
    for address in ("jane at example.com", "a" * 40 + " at " + "b" * 40 + ".com", "a" * 2000 + " at " + "b" * 1700 + ".com"):
        for lead in [*range(0, pii.WINDOW + 60, 37), *range(pii.WINDOW - 130, pii.WINDOW), 5 * pii.WINDOW]:
            text = "é" * lead + address + "é" * 1000
            assert pii.spans_of([text, "", text[: lead + len(address)]], model) == [[("email", lead, lead + len(address), False)], [], [("email", lead, lead + len(address), False)]]
    text = "one 1.2.3.4 two " * 200
    covered = {p for s in pii.window_starts(text) for p in range(s, min(s + pii.WINDOW, len(text)))}
    assert covered == set(range(len(text))) and pii.window_starts("") == []


def test_what_ends_the_search_for_a_wider_window():
    """A part of something plausible never does."""
    writer = pii._Writer(5)
    for kind in pii.KINDS:
        for _ in range(150):
            text = getattr(writer, kind)()
            if pii.plausible(kind, text):
                for a in range(len(text)):
                    for b in range(a + 1, len(text) + 1):
                        assert pii._may_grow(kind, text[a:b]), (kind, text, text[a:b])
    assert not pii._may_grow("email", "it it it it") and not pii._may_grow("phone", "1 2 3 4 5 " * 4)


def test_reading_is_the_same_in_any_company():
    """Padded windows are read as alone, by the same scores as in training; texts don't touch each other."""
    rng, model = np.random.default_rng(4), pii.Tagger.fresh(np.random.default_rng(1))
    rows = [rng.integers(32, 131, n).astype(np.int64) for n in (40, 33, 7, 1)]
    rows = [np.where(r == pii._PAD, 65, r) for r in rows]
    sizes = np.array([len(r) for r in rows])
    e = model.read(pii._columns(rows, 40), sizes)
    tags = model.paths(e, sizes)
    sure = model.marginals(e, tags, sizes)
    for k, row in enumerate(rows):
        alone = model.scores(row[:, None])[0]
        np.testing.assert_allclose(e[: len(row), k], alone[:, 0], atol=1e-4)
        path, of_path = model.decode(row[:, None])
        assert (tags[k, : len(row)] == path[0]).all() and not tags[k, len(row) :].any()
        np.testing.assert_allclose(sure[k, : len(row)], of_path[0], atol=1e-4)


def test_batches_are_decoded_together():
    """Each position is read in batches that fit the cache; the short steps of Viterbi take many batches at once, and find the same."""
    read, followed = [], []

    class Counted(pii.Tagger):
        def read(self, x, sizes):
            read.append(sizes.tolist())
            return super().read(x, sizes)

        def _follow(self, best, sizes):
            followed.append(len(sizes))
            return super()._follow(best, sizes)

    w = pii.Tagger.fresh(np.random.default_rng(2)).w
    texts = [pii._Writer(k).window(n)[0] for k, n in enumerate([2500, 1, 30, 1100, *range(100, 400, 7)])]
    apart = [pii.spans_of([t], Counted(w)) for t in texts]
    read.clear()
    followed.clear()
    assert [[s] for s in pii.spans_of(texts, Counted(w), at_once=4)] == apart
    windows = [min(pii.WINDOW, len(t) - s) for t in texts for s in pii.window_starts(t)]
    assert max(map(len, read)) <= 4 and sorted(n for part in read for n in part)[-len(windows) :] == sorted(windows)
    assert len(followed) <= len(read) / 4 and sum(followed) == sum(map(len, read))


def test_runs_of_tags():
    rng = np.random.default_rng(6)
    for _ in range(200):
        tags = np.zeros((3, 12), np.int8)
        for row in tags:
            # any start is a cut one
            row[0] = rng.integers(0, pii.TAGS)
            for k in range(1, 12):
                row[k] = rng.choice(np.flatnonzero(pii._ALLOWED[row[k - 1]]))
        expected = []
        for r, row in enumerate(tags.tolist()):
            for k, t in enumerate(row):
                if t and (t % 2 or k == 0):
                    end = next((j for j in range(k + 1, 12) if not row[j] or row[j] % 2), 12)
                    expected.append((r, k, end, (t - 1) // 2, t % 2 == 1))
        assert list(pii._runs(tags)) == expected


def test_best_spans_without_overlaps():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(rng.random(), a, a + rng.randint(1, 6), rng.randint(0, 3)) for a in (rng.randint(0, 15) for _ in range(rng.randint(0, 9)))]
        weight = {s[1:]: max(x[0] for x in spans if x[1:] == s[1:]) for s in spans}

        def most(k, end, order=sorted(weight, key=lambda s: s[0])):
            if k == len(order):
                return 0.0
            rest = most(k + 1, end)
            return max(rest, weight[order[k]] + most(k + 1, order[k][1])) if order[k][0] >= end else rest

        got = pii._apart(spans)
        assert all(a[1] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:], strict=False))
        assert sum(weight[s] for s in got) == pytest.approx(most(0, 0))


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_unseen_windows_and_hand_written_texts(model):
    writer, found, right, labelled = pii._Writer(12345), 0, 0, 0
    texts, truth = [], []
    for _ in range(600):
        text, spans = writer.window(pii.WINDOW)
        whole = [(pii.KINDS[k], a, b) for k, a, b in spans if a > 0 and b < pii.WINDOW and pii.plausible(pii.KINDS[k], text[a:b])]
        texts.append(text)
        truth.append(set(whole))
    for spans, whole, text in zip(pii.spans_of(texts, model), truth, texts, strict=True):
        inner = {(k, a, b) for k, a, b, _ in spans if a > 0 and b < len(text)}
        found += len(inner)
        right += len(inner & whole)
        labelled += len(whole)
    assert right >= 0.9 * labelled and right >= 0.9 * found
    hand = {
        "please mail jane at example dot com soon": ["jane at example dot com"],
        "call (743) 555-3824 today": ["(743) 555-3824"],
        "the host 10[.]20[.]30[.]4 is down": ["10[.]20[.]30[.]4"],
        "paid with 4111.1111.1111.1111 at noon": ["4111.1111.1111.1111"],
        "write to jane.doe@example.com, ring +1 (743) 555-3824": ["jane.doe@example.com", "+1 (743) 555-3824"],
        "on 2020-10-12 at 10:30 we met 12 people": [],
        "a polka dot dress at home": [],
        'token = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"': [],
        "it costs $1,299.00 or 15% less": [],
    }
    for text, expected in hand.items():
        assert [text[a:b] for _, a, b, _ in pii.spans_of([text], model)[0]] == expected


def test_spelled_out_addresses_without_signs(model):
    prose = "the quick brown fox jumps over a lazy dog and then it sleeps near the old river bank. "
    for n in (0, 1, 4, 9, 30):
        for private in ("jane at example.com", "jane [  at  ] example.com"):
            text = prose * n + "please write to " + private + " soon. " + prose * n
            assert [text[a:b] for _, a, b, _ in pii.spans_of([text], model)[0]] == [private]
    texts = [prose * k + pii._Writer(k).window(50 * k)[0] for k in range(1, 30)] + ["", "7"]
    together = pii.spans_of(texts, model, at_once=7)
    assert together == [pii.spans_of([t], model)[0] for t in texts] and any(together)


def test_private_data_in_tables(spark, docs, no_docs, documents, model):
    private = "mail a.b@c.de or jane at example dot com, card 4111-1111-1111-1111."
    long = "wörd " * 30_000 + private + " wörd" * 10_000
    rows = [*[(d[0], d[1]) for d in documents], (700, private), (700, private), (701, long), (702, "é" * 10 + " 10.0.0.256 +1 234 567 89")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_spans", "kind", "start", "at")})
    got = pii.find_private(df)
    assert got.columns == [*df.columns, "__spans"]
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    for r in rows_out:
        assert [(s.kind, s.start, s.stop) for s in r["__spans"] if s.base] == brute(r.text)
        if r.doc_id == 701:
            assert "jane at example dot com" in [r.text[s.start : s.stop] for s in r["__spans"]]
    masked = pii.mask_private(df)
    assert masked.columns == df.columns
    out = {r.doc_id: r.text for r in masked.collect() if r.doc_id is not None}
    assert out[700] == "mail [email] or [email], card [card]." and out[701] == "wörd " * 30_000 + out[700] + " wörd" * 10_000
    assert out[0] is None and out[1] == "" and out[702].endswith("10.0.0.256 [phone]")
    assert pii.find_private(no_docs).collect() == []
