import random
import re
from collections import Counter, defaultdict

import llm_fixtures
import pytest
from pyspark.sql import functions as F

from wavelake.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(documents):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in documents:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, total


def brute(documents, least, top):
    f, total = counted(documents)
    out = []
    for lang, n in total.items():
        g = f[lang]
        found = {p: a for p, a in g.items() if a >= least and " " in p}
        inside = defaultdict(int)
        for p, a in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i : i + k])
                    inside[q] = max(inside[q], a)
        rows = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1000 * a * n // (g[" ".join(w[:k])] * g[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if inside[p] < a:
                rows.append((-score, -a, p.encode(), p, g[" ".join(w[:k])], g[" ".join(w[k:])]))
        out += [(lang, rank, p, -a, left, right, n, -score) for rank, (score, a, _, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def cases(rng):
    vocabulary = [llm_fixtures.sentence(rng, 1) for _ in range(30)] + ["É", "über", "w" * 80, "#*"]
    phrase = "one long phrase of many words that comes again"

    def text(n):
        out = []
        for _ in range(n):
            out.append(phrase if rng.random() < 0.03 else rng.choice(vocabulary[: rng.choice([4, 12, 34])]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]))
        return "".join(out)

    documents = [(k, text(rng.choice([3, 30, 300])), rng.choice(["en", "fr", None])) for k in range(80)]
    documents += [documents[2], documents[3], (None, documents[4][1].upper(), "und"), (None, None, "en"), (200, "", None), (201, " . ", "de"), (202, text(6000), "de"), (203, "a b\x0bc\rd", "x")]
    return documents


def frame(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("mine") for c in ("row", "fp", "n", "k", "phrase", "a")}).repartition(4)


@pytest.mark.parametrize("bits", [64, 9])
def test_phrases_match_brute_force(spark, monkeypatch, bits):
    """Also with fingerprints so short that most stand for several phrases, and with little held in memory."""
    documents = cases(random.Random(8))
    monkeypatch.setattr(co, "HELD", 1 << 20 if bits == 64 else 500)
    df = frame(spark, documents)
    f, total = counted(documents)
    got = Counter((r["lang"], r["k"], r["phrase"], r["n"]) for r in co.frequent_phrases(df, 20, bits=bits).collect())
    expected = Counter((lang, p.count(" ") + 1, p, a) for lang, g in f.items() for p, a in g.items() if a >= 20)
    expected += Counter((lang, 0, "", n) for lang, n in total.items() if n >= 20)
    assert got == expected
    for least, top in ((20, 2000), (8, 7)):
        out = co.collocations(df, least, top, bits=bits)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == brute(documents, least, top)


def test_no_phrases(spark, no_docs):
    assert co.collocations(no_docs).collect() == []
    assert co.collocations(spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], "doc_id long, text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    rows = [("en", 0, "", big), ("en", 1, "a", 10**12 + 1), ("en", 1, "b", 10**12 + 7), ("en", 2, "a b", 10**12)]
    monkeypatch.setattr(co, "frequent_phrases", lambda docs, *_: docs.sparkSession.createDataFrame(rows, "lang string, k int, phrase string, n long"))
    got = co.collocations(spark.range(1).withColumn("text", F.lit("")), 100).collect()
    assert [r.score for r in got] == [1000 * 10**12 * big // ((10**12 + 1) * (10**12 + 7))]
