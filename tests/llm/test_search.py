import math
import random
import re
from collections import Counter, defaultdict

import llm_fixtures
import numpy as np
from pyspark.sql import functions as F

from wavelake.llm import lexical

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(documents, items, top):
    held = [(d[0], Counter(terms(d[1]))) for d in documents]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in held:
            n = sum(c.values())
            m = 25 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def cases(rng):
    vocabulary = [llm_fixtures.sentence(rng, 1) for _ in range(150)] + ["é", "Ünï", "x" * 90]
    draw = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 153])]) for _ in range(n))
    documents = [(k, draw(rng.choice([1, 5, 40, 400]))) for k in range(250)]
    documents += [documents[3], documents[4], (900, documents[5][1].upper()), (None, documents[5][1]), (None, documents[6][1]), (901, None), (902, ""), (903, "--- ,,"), (904, draw(20_000))]
    shared = draw(12)
    items = [(k, draw(rng.choice([1, 8, 30])) + (" " + shared if k % 2 else "")) for k in range(30)]
    items += [items[0], (0, "other text of an id " + shared), (50, None), (51, " . "), (52, "nothing of this occursanywhere"), (None, draw(5)), (53, (vocabulary[1] + ",") * 37 + vocabulary[2])]
    return documents, items


def test_ranked_search_matches_brute_force(spark):
    documents, items = cases(random.Random(3))
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("doc", "n", "terms", "score", "item", "rank")}).repartition(5)
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "term", "symbol")})
    for top, block in ((10, lexical.BLOCK_SYMBOLS), (3, 250)):
        got = lexical.rank_documents(docs, table, top, block_symbols=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute(documents, items, top)


def test_ranked_search_of_empty_tables(spark, no_docs):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert lexical.rank_documents(no_docs, items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []
    assert lexical.rank_documents(docs, items.where("item_id = 2")).collect() == []
    # a term that all documents hold weighs something while ln((2N + 2) / (2N + 1)) is 0.001 or more
    assert [tuple(r) for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1, 2 * 287 * (10**9 // 1800))]


def test_shared_sums_are_formed_once(spark):
    items = [(k, t) for k in range(40) for t in [*range(20), 100 + k]]
    symbols = spark.createDataFrame(items, "item long, symbol long")
    left, nodes = lexical.mine_shared(symbols)
    held, nodes = defaultdict(list), nodes.collect()
    for r in left.collect():
        held[r["item"]].append(r.symbol)
    assert len(nodes) == len({r.symbol for r in nodes}) == 19
    assert all(len(v) == 2 for v in held.values())
    parts = {r.symbol: (r.a, r.b) for r in nodes}

    def flat(s):
        return flat(parts[s][0]) + flat(parts[s][1]) if s in parts else [s]

    assert all(sorted(x for s in v for x in flat(s)) == [*range(20), 100 + k] for k, v in held.items())


def test_a_pair_may_be_made_in_two_rounds(spark):
    """The pair (3, 4) loses to the more frequent (2, 3) where an item holds both."""
    items = [(k, s) for k in range(6) for s in (1, 2, 3)] + [(k, s) for k in range(6, 9) for s in (3, 4)] + [(9, s) for s in (1, 2, 3, 4)]
    left, nodes = lexical.mine_shared(spark.createDataFrame(items, "item long, symbol long"))
    rows = spark.createDataFrame([(s, s, 0) for s in (1, 2, 3, 4)], "symbol long, term long, bit int").collect()
    twice = nodes.collect() + [r for r in nodes.collect()]
    later = [r.__class__(level=r.level + 10, symbol=r.symbol, a=r.a, b=r.b) for r in nodes.collect()]
    for extra in (nodes.collect(), twice[: len(twice) // 2] + later):
        graph = lexical.SharingGraph(rows, extra, left.collect())
        scores = graph.scores(np.array([[1], [10], [100], [1000]], np.int64))
        assert dict(zip(graph.items.tolist(), scores[:, 0].tolist(), strict=True)) == {k: 111 if k < 6 else 1100 if k < 9 else 1111 for k in range(10)}
