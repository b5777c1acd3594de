import itertools
import random
import re
import time
from collections import Counter, defaultdict

import llm_fixtures
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelake.llm import decontam, htmltext, licenses, mixing, quality, toxicity, urlfilter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing ---


def waterfill(sizes, share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, active = {}, share * sum(sizes.values()), set(order)
    while active:
        level = left / sum(weight[s] for s in active)
        above = {s for s in active if level * weight[s] > cap * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in active}
            break
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        active -= above
    return target


def test_mix(spark, docs, documents):
    rng = random.Random(0)
    more = documents + [(100 + k, llm_fixtures.sentence(rng, rng.choice([3, 40, 200])), "en", rng.choice(["a", "b", "c", "d", "e", None])) for k in range(400)]
    df = llm_fixtures.frame(spark, more)
    got = mixing.mix(df, bucket_docs=40).collect()
    sizes = Counter()
    for _, t, _, s in more:
        sizes[s] += len(words(t))
    target = waterfill(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, len(words(t)), sizes[s]) for i, t, _, s in more)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] + 60 for s in target)
    # the rates meet the targets themselves, and tilt with size
    rated = defaultdict(float)
    for r in got:
        rated[r.source] += r.rate * r.size
    assert all(rated[s] == pytest.approx(target[s], rel=1e-6) for s in target)
    again = mixing.mix(df.repartition(5), bucket_docs=40).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mix_of_nothing(spark, no_docs, docs):
    assert mixing.mix(no_docs).collect() == []
    blank = docs.where("doc_id < 3").withColumn("text", F.lit(" "))
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


# --- decontamination ---


def brute_overlap(text, item):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    a, b = tokens(text), tokens(item)
    if len(b) < decontam.MIN_WORDS:
        return False
    size = min(decontam.WINDOW, len(b))
    for shift in range(-len(b) + size, len(a) - size + 1):
        same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
        for k in range(len(b) - size + 1):
            if 0 <= k + shift and k + size + shift <= len(a) and sum(same[k : k + size]) >= decontam.needed(size):
                return True
    return False


def test_masks_miss_no_allowed_window():
    for size in range(decontam.MIN_WORDS, decontam.WINDOW + 1):
        for bad in itertools.combinations(range(size), size - decontam.needed(size)):
            assert any(not any(s + o in bad for o in mask) for mask in decontam.MASKS for s in range(size - mask[-1])), (size, bad)


def test_decontamination(spark, documents):
    rng = random.Random(7)
    items = [(k, llm_fixtures.sentence(rng, n)) for k, n in enumerate((13, 15, 20, 30, 45))] + [(9, "too short an item"), (10, None), (11, "")]
    planted = list(documents)
    for k, (_, item) in enumerate(items[:5]):
        w = item.split()
        for j, hurt in enumerate(([], [0], [2, 9], [1, 7, 12], [1, 5, 8, 11], list(range(0, len(w), 3)))):
            v = [x if p not in hurt else "other" for p, x in enumerate(w)]
            planted.append((1000 + 10 * k + j, llm_fixtures.sentence(rng, 12) + " " + ", ".join(v).upper() + " " + llm_fixtures.sentence(rng, 9), "en", "a"))
        planted.append((2000 + k, " ".join(w[3:]), "en", "a"))
        planted.append((3000 + k, " ".join(w[:12]) + " and nothing else of it", "en", "a"))
    planted.append((None, "start " + items[3][1], "en", "a"))
    df = llm_fixtures.frame(spark, planted)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, *_ in planted:
        held = [k for k, item in items if brute_overlap(t, item)]
        want[i, bool(held), len(held), min(held, default=-1)] += 1
    got = decontam.find_contaminated(df, benchmark).collect()
    assert Counter((r.doc_id, r.contaminated, r.n_items, r.first_item) for r in got) == want
    kept = decontam.decontaminate(df, benchmark)
    assert kept.columns == df.columns and kept.count() == sum(n for (_, bad, *_), n in want.items() if not bad)
    assert decontam.find_contaminated(df, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.find_contaminated(df.limit(0), benchmark).count() == 0


def test_short_items_are_held_word_for_word(spark):
    rng = random.Random(8)
    items = [(n, llm_fixtures.sentence(rng, n)) for n in (1, 2, 5, 8, 12)] + [(20, "Qx, rz?"), (30, None)]
    docs = [(100, "all qx: RZ here"), (101, "qx and rz"), (102, "only qx"), (103, "qx rz"), (104, None)]
    for n, item in items[:5]:
        w = item.split()
        docs += [(n, llm_fixtures.sentence(rng, 9) + " " + item.upper() + " zz end"), (40 + n, item), (60 + n, " ".join([*w[:-1], "other"]))]
    tokens = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))) + " "
    want = {}
    for i, t in docs:
        held = [k for k, item in items if item and tokens(item) in tokens(t)]
        want[i] = (bool(held), len(held), min(held, default=-1))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.find_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in got} == want
    assert all(want[i][0] for i in (1, 5, 8, 12, 45, 100, 103)) and not any(want[i][0] for i in (101, 102, 104))


# --- quality ---


def test_quality_counts(docs, documents, no_docs):
    got = Counter(tuple(r)[:8] for r in quality.score_quality(docs).collect())
    want = Counter()
    for i, t, *_ in documents:
        w = words(t)
        lines = [l for l in (t or "").split("\n") if words(l)]
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert got == want
    assert quality.score_quality(no_docs).collect() == []


def test_quality_adapts_to_each_group(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        source = "code" if k % 2 else "prose"
        text = llm_fixtures.sentence(rng, 60)
        if source == "code":
            text = text.replace(" ", " | ")
        rows.append((k, text, "en", source))
    rows += [(1000 + k, llm_fixtures.sentence(rng, 60).replace(" ", " | "), "en", "prose") for k in range(20)]
    rows += [(2000 + k, llm_fixtures.sentence(rng, 60), "en", "rare") for k in range(5)]
    rows += [(3000, llm_fixtures.sentence(rng, 60).replace(" ", "$$$$$$$$$ "), None, None)]
    kept = {r.doc_id: r.kept for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(600)) and not any(kept[1000 + k] for k in range(20)) and all(kept[2000 + k] for k in range(5))
    assert not kept[3000]


def test_quality_thresholds_of_small_groups_agree_with_sql(spark, tmp_path):
    """With a small ``min_docs`` most bounds are those of one (lang, source)."""
    import duckdb

    from wavelake.llm import queries

    rng = random.Random(9)
    rows = []
    for k in range(400):
        text = llm_fixtures.sentence(rng, rng.randint(5, 60))
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])
        text = text.replace(" ", " # ") if source == "b" or k % 40 == 0 else text
        rows.append((k, text if k % 50 else None, lang, source))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path)
    df = spark.read.parquet(path)
    for min_docs in (5, 45, 10_000):
        got = {tuple(r) for r in quality.score_quality(df, min_docs=min_docs).select("doc_id", "n_words", "n_symbols", "base_failed", "kept").collect()}
        with duckdb.connect() as db:
            db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
            want = set(db.sql(f"SELECT doc_id, n_words, n_symbols, base_failed, kept FROM ({queries.quality_sql(min_docs)})").fetchall())
        assert got == want and len({k for *_, k in got}) == 2


# --- urls ---


def test_url_rules(spark):
    urls = [
        ("http://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        ("https://x.net/fr/#a", "x.net", "/fr/", "net/fr/", "block"),
        ("https://x.net?/fr/", "x.net", "", None, None),
        ("http://x.com", "x.com", "", None, None),
        ("no scheme.net/fr/", "", "", None, None),
        (None, "", "", None, None),
        ("a://b.net/es/c://d.net/fr/", "b.net", "/es/c://d.net/fr/", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(k, u[0], None) for k, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("score", F.lit(2))
    got = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict is None or got[k].verdict == verdict
    assert got[7].verdict == "allow"
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []
    assert {r.rule for r in urlfilter.filter_urls(pages, ()).collect()} == {None}


def test_many_rules_and_their_ties(spark):
    """2,000 rules as a table, against a scan of all of them; repeated rows and a long page."""
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(2000)] + [("a", "/xx", "block"), ("a.a", "", "allow"), ("b", "/y", "allow"), ("b", "/y", "block")]
    urls = [(rng.choice(hosts) + "." + rng.choice(hosts), rng.choice(paths) + rng.choice(paths)) for _ in range(300)] + [("a.a", "/xx"), ("b", "/y"), ("c.b", "/y")]
    rows = [(k, f"http://{h}{p}", None) for k, (h, p) in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows[:50] + [(9000, "http://zz.d/x", "<a href=//q.d/>" * 200_000)], "page_id long, url string, html string").withColumn("rule", F.lit("mine"))
    want = {}
    for k, (h, p) in enumerate(urls):
        fit = [(len(rh) + len(rp), len(rh), rh + rp, v) for rh, rp, v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        want[k] = max(fit)[2:] if fit else (None, None)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urlfilter.filter_urls(pages, table).collect()
    assert len(got) == len(rows) + 51 and {r.page_id for r in got} == {*range(len(rows)), 9000}
    assert all(r.rule == want[r.page_id][0] and (r.rule is None or r.verdict == want[r.page_id][1]) for r in got if r.page_id < 9000)
    assert sum(v is not None for _, v in want.values()) > 200


def test_trust_spreads_over_links(spark):
    def page(k, host, *targets):
        return k, f"http://{host}/x", "".join(f"<a HREF='http://{t}/y'>z</a>" for t in targets)

    rows = [page(1, "good.com", "near.org", "far.org"), page(2, "near.org", "far.org"), page(3, "fan.org", "bad.net"), page(4, "bad.net", "near.org"), page(5, "alone.org"), page(6, "second.org", "fan.org", "fan.org", "fan.org", "good.com"), (7, "http://loop.org/x", "<a href=//bad.net/y>z</a>"), page(8, "bad.net", "loop.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = (("com", "/", "allow"), ("bad.net", "/", "block"))
    got = {r.host: r for r in urlfilter.filter_urls(pages, rules).collect()}
    with pytest.raises(RuntimeError):
        urlfilter.filter_urls(pages, rules, max_rounds=3)

    def rank(edges, seed):
        hosts = sorted({h for e in edges for h in e[:2]} | {seed})
        at = {h: k for k, h in enumerate(hosts)}
        m = np.zeros((len(hosts),) * 2)
        for a, b, n in edges:
            m[at[b], at[a]] += n
        m = m / np.maximum(1, m.sum(axis=0))
        start = np.eye(len(hosts))[at[seed]]
        v = start
        for _ in range(300):
            v = 0.15 * start + 0.85 * m @ v
        return dict(zip(hosts, v))

    edges = Counter((u.split("/")[2], t) for _, u, h in rows for t in re.findall(r"//([^/]+)/y", h) if t != u.split('/')[2])
    edges = [(a, b, n) for (a, b), n in edges.items()]
    trust, distrust = rank(edges, "good.com"), rank([(b, a, n) for a, b, n in edges], "bad.net")
    for h, r in got.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=7e-6) and r.distrust == pytest.approx(distrust.get(h, 0), abs=7e-6)
    assert {h: r.verdict for h, r in got.items()} == {"good.com": "allow", "near.org": "allow", "fan.org": "block", "bad.net": "block", "alone.org": "allow", "second.org": "block", "loop.org": "block"}


# --- licences ---


def test_licenses(spark, no_docs):
    mit = dict(licenses.KNOWN)
    text = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [
        (0, "Copyright (c) 2020 Someone\n\n" + text.replace(" ", "  ").replace("sublicense", "sub-licence").replace(".", " .")),
        (1, text + " And more."),
        (2, "some words\n// Released under the mit LICENCE!\nCopyright: me\nSPDX-License-Identifier: MIT"),
        (3, None),
        (4, ""),
        (5, "Copyright me"),
        (6, text),
        (6, text),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine")).withColumn("digest", F.lit(1))
    got = [(r.doc_id, r.license, r.n_notices, r.notice_licenses) for r in licenses.scan_licenses(df).collect()]
    found = {g[0]: g[1:] for g in got}
    assert len(got) == 8 and mit
    assert found[0][0] == found[6][0] == "MIT" and found[1][0] == "" and found[2] == ("", 2, "MIT")
    assert found[3] == found[4] == found[5] == ("", 0, "")
    assert licenses.scan_licenses(no_docs).collect() == []


def test_whole_licenses_in_disguise(spark, documents):
    """Every known text, as a whole and wrapped inside a longer one, in other case, spelling and layout."""
    rng = random.Random(2)
    rows, whole = [], {}
    for k, (name, text) in enumerate(licenses.KNOWN):
        w = re.sub(r"(?<![\w/])license\b", "licence", text).replace("noninfringement", "non-infringement").split()
        w = [x.upper() if rng.random() < 0.3 else x for x in w]
        lines, at = [], 0
        while at < len(w):
            n = rng.randint(6, 12)
            lines.append("  # " + " ".join(w[at : at + n]))
            at += n
        rows.append((k, f"Copyright (C) 20{k:02d} J. Doe\n\n" + "\n".join(lines) + "\n(c) the others"))
        rows.append((100 + k, text.replace(" ", "\t ") + "\nAnd a line of its own."))
        whole[k] = name
    one = [k for k, (_, t) in enumerate(licenses.KNOWN) if len(t.split()) <= 18]
    for k in one:
        w = licenses.KNOWN[k][1].split()
        cut = max(1, len(w) // 3)
        rows.append((200 + k, "Some text first.\n" + " ".join(w[:cut]) + "\n" + " ".join(w[cut:]) + "\nand after."))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for name, text in sorted(licenses.KNOWN):
        first.setdefault(" ".join(re.findall("[a-z0-9]+", text.lower())), name)
    for k, name in whole.items():
        assert got[k].license == name or got[k].license in first.values() and got[k].license < name, name
        assert got[100 + k].license == ""
    assert all(licenses.KNOWN[k][0] in got[200 + k].notice_licenses.split(",") for k in one)
    table = spark.createDataFrame([("Mine", "You may do what you like."), ("Other", "You may do, what you LIKE"), (None, None)], "license string, text string")
    mine = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame([(1, "you may do\nwhat you like"), (2, "you may")], "doc_id long, text string"), table).collect()}
    assert mine == {1: "Mine", 2: ""}


def test_licenses_inside_long_texts(spark):
    """Notices of any number of lines are found inside a text of 10,000 lines, in time that grows with the lines."""
    rng = random.Random(4)
    notices = [(n, t) for n, t in licenses.KNOWN if t.count("\n") >= 2]
    lines = [llm_fixtures.sentence(rng, rng.randint(1, 12)) for _ in range(10_000)]
    for k, (_, t) in enumerate(notices):
        lines[200 * k + 7 : 200 * k + 7] = ("// " + t.replace("\n", "\n// ")).split("\n")
    table = spark.createDataFrame([("One", "grant"), ("Two", "grant it"), ("Long", "grant it " + " ".join(f"w{k}" for k in range(900)))], "license string, text string")
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:3])), (3, "x\ngrant\nit w0 w1\n(c) me\nGRANT"), (4, "grant it\n" + "\n".join(f"w{k}!" for k in range(900)) + "\nmore")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].n_notices >= len(notices) and set(got[1].notice_licenses.split(",")) == {n for n, _ in notices}
    assert got[2].n_notices == got[3].n_notices == 0
    took = []
    for n in (1, 4):
        start = time.perf_counter()
        licenses.scan_licenses(spark.createDataFrame([(1, "\n".join(lines * n))], "doc_id long, text string")).collect()
        took.append(time.perf_counter() - start)
    assert took[1] < 2.5 * took[0] + 2
    got = {r.doc_id: (r.n_notices, r.notice_licenses) for r in licenses.scan_licenses(df, table).collect()}
    assert got[2] == (0, "") and got[3] == (2, "One,Two") and got[4] == (1, "Long")


# --- html ---


def test_main_text(spark):
    body = "<p>The first paragraph has several words in it, and a <a href='/x'>link</a> too.</p><p>A second&nbsp;paragraph &amp; more,\n with text.<p>Third one, unclosed."
    article = "<html><head><title>T</title><style>p{}</style><script>var x='</p><p>not me</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><article><h1>A title of words</h1>" + body + "</article><footer>&copy; someone</footer></body></html>"
    pages = [(0, "u", article), (1, None, None), (2, "u", ""), (3, "u", "<nav><a href='/'>Home</a></nav>"), (0, "u", article)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(-1))
    got = [tuple(r)[:4] for r in htmltext.extract_main_text(df).collect()]
    want = "A title of words\n\nThe first paragraph has several words in it, and a link too.\n\nA second paragraph & more, with text.\n\nThird one, unclosed."
    assert sorted(got, key=str) == sorted([(0, "u", want, len(want))] * 2 + [(1, None, "", 0), (2, "u", "", 0), (3, "u", "", 0)], key=str)
    assert htmltext.extract_main_text(df.limit(0)).collect() == []


def test_raw_elements_without_an_end_cut_no_page():
    texts = lambda page: [b[0] for b in htmltext.blocks(page)]
    for tag in ('<svg viewBox="0 0 1 1"/>', "<iframe src='x' />", "<object/>", "<math/>", "<noscript>", "<template>", "<canvas>", "<iframe src=x>", "<svg>"):
        assert texts(f"<p>one</p>{tag}<p>two</p><p>three</p>") == ["one", "two", "three"], tag
    assert texts('<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>') == ["one", "two", "three"]
    assert texts("<p>one</p><iframe src=http://x/>no</iframe><p>two</p>") == ["one", "two"]
    for tag in ("script", "style"):
        assert texts(f"<p>one</p><{tag}>var x<p>two</p>") == ["one"]
        assert texts(f"<p>one</p><{tag}>var x</{tag}><p>two</p>") == ["one", "two"]


def test_malformed_and_deep_pages_take_linear_time():
    """Sizes at which anything quadratic would take minutes."""
    import time

    deep = "<div class='a b'>x" * 50_000
    pages = ["<a " * 300_000, "<a \"' > " * 100_000, deep, deep + "</p>" * 100_000, "<p>y</b></i></q></span></em>" * 50_000, "<svg>" * 200_000, "<!-- " * 200_000, "<" * 500_000, "<p title='" * 100_000 + ">"]
    for page in pages:
        start = time.perf_counter()
        found = htmltext.blocks(page)
        assert time.perf_counter() - start < 8, page[:20]
        htmltext.vectors([found])
    assert len(htmltext.blocks(deep)) == 50_000


def test_paths_are_the_open_elements():
    """Running sums equal those of the tokens of all open elements."""
    page = "<body><div class='a b'><p>one<div id=c><ul><li>two<li>three</ul></div></em></div></section><p class=a>four<table><tr><td>five</table>six"
    want = [
        ("one", "body div .a .b p leaf:p"), ("two", "body div .a .b .c ul li leaf:li"), ("three", "body div .a .b .c ul li leaf:li"),
        ("four", "body p .a leaf:p"), ("five", "body table tr td leaf:td"), ("six", "body leaf:body"),
    ]
    got = htmltext.blocks(page)
    assert [b[0] for b in got] == [t for t, _ in want]
    for (_, vector, _), (text, tokens) in zip(got, want):
        sums = np.zeros(htmltext._PATH)
        for token in set(tokens.split()):
            slot, sign = htmltext._slot(token)
            sums[slot] += sign
        assert (vector == sums).all(), text


def test_main_text_of_pages_written_by_hand(spark):
    """Pages in shapes of their own, not made by the training pages' rules."""
    news = """<!doctype html><html><head><title>Town paper</title><meta name=x content="a > b"></head><body class="home">
    <div id="cookie-banner"><span>We use cookies.</span> <button>OK</button></div>
    <header class="top"><a href="/"><img src=l.png></a><nav><a href="/a">News</a> <a href="/b">Sport</a></nav></header>
    <div class="page"><main><article class="story"><h1>The bridge is open again</h1>
    <p>After two years of work the old bridge over the river was opened on Monday, and many people came to walk across it.</p>
    <p>The mayor thanked all who had helped. &ldquo;It was hard,&rdquo; she said, &ldquo;but we are glad that it is done.&rdquo;</p>
    <p>Cars may cross from Friday on; until then the road stays closed to all traffic but buses and bicycles.</p></article></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Rain again</a></li><li><a href="/2">New school</a></li></ul></aside></div>
    <section class="comments"><h3>2 comments</h3><div class="comment"><b>ann</b> says: <p>I walked over it today, and it is very fine.</p></div></section>
    <footer class="site-footer"><p>&copy; 2021 Town paper. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>"""
    got = htmltext.extract_main_text(spark.createDataFrame([(1, "u", news)], "page_id long, url string, html string")).first()
    want = [
        "The bridge is open again",
        "After two years of work the old bridge over the river was opened on Monday, and many people came to walk across it.",
        "The mayor thanked all who had helped. “It was hard,” she said, “but we are glad that it is done.”",
        "Cars may cross from Friday on; until then the road stays closed to all traffic but buses and bicycles.",
    ]
    assert got.text == "\n\n".join(want)


def test_labeller_on_unseen_pages():
    rng = np.random.default_rng(1234)
    made = [htmltext.training_page(rng) for _ in range(150)]
    parsed = [htmltext.blocks(p) for p, _ in made]
    keep = [k for k in range(len(made)) if len(parsed[k]) == len(made[k][1])]
    x, bounds = htmltext.vectors([parsed[k] for k in keep])
    truth = np.array([v for k in keep for v in made[k][1]])
    assert (htmltext.trained().label(x, bounds) == truth).mean() > 0.98


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = htmltext.Labeller({k: v.astype(np.float64) for k, v in htmltext.Labeller.fresh(rng).w.items()})
    x, mask, y = rng.normal(size=(5, 3, htmltext._SIZE)), np.ones((5, 3)), (rng.random((5, 3)) < 0.5).astype(float)
    mask[3:, 1] = 0
    _, grads = model.gradients(x, mask, y)
    for name, spot in (("wx_f", (3, 5)), ("wh_b", (2, 40)), ("out", (7,)), ("bias", (0,))):
        old = model.w[name][spot]
        losses = []
        for step in (1e-3, -1e-3):
            model.w[name][spot] = old + step
            losses.append(model.gradients(x, mask, y)[0])
        model.w[name][spot] = old
        assert grads[name][spot] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


# --- toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    insults = ["zorgle", "blicket", "fropish"]
    rows, labels = [], []
    for k in range(900):
        w = llm_fixtures.sentence(rng, rng.choice([12, 60])).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "s", "er"]))
        # toxic rows name one group more often than clean ones do
        if rng.random() < (0.8 if bad else 0.1):
            w.insert(rng.randrange(len(w)), "women")
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    labels += [(None, 1, 1), (5000, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    scored, model = toxicity.score_toxicity(docs, labels)
    rows = scored.select("doc_id", "_toxicity", toxicity.held_out(F.col("doc_id")).alias("held")).toPandas()
    held = rows[rows.held]
    assert 200 < len(held) < 400
    assert ((held._toxicity >= 0.7) == (held.doc_id % 4 == 0)).mean() > 0.97
    assert len(model.features) <= toxicity.MAX_FEATURES + 200


def test_scores_agree_with_a_plain_scorer(labelled, docs, documents):
    """Word by word and prefix by prefix in plain Python, for texts of all kinds."""
    from wavelake.llm import arrowtext

    train_docs, labels = labelled
    model = toxicity.train(train_docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    of = lambda b: int(arrowtext.Words(pa.array([b.decode("latin-1")]), letters=True).hashes[0]) if b.isascii() else None
    texts = [r.text for r in train_docs.limit(40).collect()] + ["", "zorgle ZORGLES, fropisher! zorgle", "a b", "naming women here; naming men there"]
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got):
        found = set()
        for w in re.findall(r"[0-9a-z]+", text.lower()):
            found.add(of(w.encode()))
            for n in toxicity.PREFIXES:
                if len(w) > n:
                    found.add(int(arrowtext.mix(np.array([of(w[:n].encode())], np.uint64) ^ np.uint64(0x51ED270B))[0]))
        z = model.bias + sum(weight.get(f, 0.0) for f in found)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), text


def test_swaps_of_labelled_texts_are_counted(labelled):
    """The fixture's labelled texts name groups, so the penalty meets real rows."""
    docs, labels = labelled
    named = docs.where(F.col("text").rlike(r"\bwomen\b") & ~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") < 900)).count()
    # a random word may be a term as well
    assert named > 100 and 0 <= toxicity.train(docs, labels).swaps - 3 * named < 30


def test_naming_a_group_changes_little(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    free = toxicity.train(docs, labels, penalty=0.0)
    text = lambda t: pa.array([t])
    for t in ("{} live in this town", "a long story about {}"):
        a, b = (model.scores(text(t.format(g)))[0] for g in ("women", "men"))
        assert abs(a - b) < 0.1 and max(a, b) < 0.5
    bad = "what a zorgle of {}"
    gap = [abs(m.scores(text(bad.format("women")))[0] - m.scores(text(bad.format("men")))[0]) for m in (model, free)]
    assert gap[0] < 0.7 * gap[1] and model.scores(text(bad.format("men")))[0] > 0.5


def test_toxicity_edge_cases(spark, docs, no_docs, labelled):
    _, labels = labelled
    scored, _ = toxicity.score_toxicity(docs, labels)
    assert scored.columns == [*docs.columns, "__toxicity"]
    got = scored.select("doc_id", "text", "_Toxicity", "__toxicity").collect()
    assert len(got) == docs.count() and all(0 <= r["__toxicity"] <= 1 and r["_Toxicity"] == "mine-_Toxicity" for r in got)
    assert len({r["__toxicity"] for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.score_toxicity(no_docs, labels)[0].collect() == []
    scored, model = toxicity.score_toxicity(docs, labels.limit(0))
    assert {r["__toxicity"] for r in scored.collect()} == {0.0} and len(model.features) == 0
    import zlib

    for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
