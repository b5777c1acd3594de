import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import CLASHES
from wavelake.llm import arrowtext, linededup, minhash, substring, twice

ENDS = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_agree_with_the_words():
    texts = ["a bb  ccc\n", None, "", "É x\x0b y", "bb É", "a b a"]
    w = arrowtext.Words(pa.array(texts))
    found = [[w.raw[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.offs, w.offs[1:])]
    assert found == [words(t) for t in texts]
    by_word = {}
    for s, e, h in zip(w.starts, w.ends, w.hashes):
        assert by_word.setdefault(w.raw[s:e].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    upper = arrowtext.Words(pa.array(["Aé, bÉ1"]), lower=True, letters=True)
    assert upper.counts.tolist() == [2] and (upper.hashes == arrowtext.Words(pa.array(["aé bÉ1"]), letters=True).hashes).all()


def test_regular_words_have_fingerprints_of_their_own():
    """Texts on which polynomial hashes modulo 2**64 collide."""
    a = "a"
    b = "b"
    for _ in range(11):
        a, b = a + b, b + a
    w = arrowtext.Words(pa.array([f"{a} {b}"]))
    assert w.hashes[0] != w.hashes[1]


def test_slices_cut_no_text():
    texts = ["x" * 400_000, "", None, "y" * 10, "z" * 300_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [t for part in arrowtext.slices(batch) for t in part.column("text").to_pylist()] == texts


def test_twice_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(-(2**62), 2**62, 4000)
    repeated = values[:700]
    rows = [(int(v),) for v in [*values, *repeated]]
    df = spark.createDataFrame(rows, "h long").repartition(7)
    filt = twice.twice_filter_of(df, lambda b: iter([b.column(0).to_numpy()]), twice.bits_for(4000))
    assert twice.contains(filt, repeated).all()
    assert twice.contains(filt, values[700:]).mean() < 0.05
    assert not twice.twice_filter_of(df.limit(0), lambda b: iter([b.column(0).to_numpy()]), 1 << 16).any()


def test_line_dedup(docs, documents):
    key = lambda l: l.strip(ENDS).translate(FOLD)
    holders = defaultdict(set)
    for i, t, *_ in documents:
        for l in (t or "").split("\n"):
            if len(key(l)) >= 40:
                holders[key(l)].add(i)
    keeper = {k: max(i for i in s if i is not None) for k, s in holders.items() if len(s) >= 5}
    assert keeper
    want = Counter()
    for i, t, *_ in documents:
        lines = (t or "").split("\n")
        kept = [l for l in lines if keeper.get(key(l), i) == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines"]
    got = out.collect()
    assert Counter((r.doc_id, r["__lines"].n_lines, r["__lines"].n_dropped, r.text or "") for r in got) == want
    assert all(r[c] == f"mine-{c}" for r in got for c in CLASHES)


def brute_components(rows, percent):
    sets = []
    for i, t, *_ in rows:
        w = [x.translate(FOLD) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = {i: i for i, *_ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a, (i, *_) in enumerate(rows):
            for b, (j, *_) in enumerate(rows[:a]):
                if i is None or j is None or label[i] == label[j] or not sets[a]:
                    continue
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sets, label


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, documents, percent):
    sets, label = brute_components(documents, percent)
    want = Counter((i, len(s), label.get(i), i is None or label[i] == i) for (i, *_), s in zip(documents, sets))
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, percent=percent).collect())
    assert got == want
    assert len(set(label.values())) < len(label)


def test_near_duplicates_of_a_large_group(spark):
    """A hub of many edited copies: one component, though not all copies are alike."""
    import random

    from llm_fixtures import edited, sentence

    rng = random.Random(1)
    base = sentence(rng, 200)
    rows = [(i, edited(rng, base, 90) if i != 150 else base) for i in range(300)] + [(900 + i, sentence(rng, 200)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[900 + i] == 900 + i for i in range(50))


def test_near_duplicates_of_copies_that_only_match_their_original(spark):
    """1,000 copies with edits at random places; the original lies in the middle of the ids."""
    import random

    rng = random.Random(4)
    base = [f"w{k}" for k in range(304)]
    rows = []
    for i in range(1001):
        w = list(base)
        for k, at in enumerate(rng.sample(range(6, 298), 4) if i != 500 else []):
            w[at] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    sets, _ = brute_components([rows[0], rows[1], rows[500]], 85)
    like = lambda a, b: len(a & b) / len(a | b)
    assert like(sets[0], sets[2]) >= 0.85 > like(sets[0], sets[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert len(got) == 1001 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("percent, sizes", [(85, ((7, 6), (10, 9), (20, 17))), (80, ((5, 4), (10, 8), (20, 16), (40, 32)))])
def test_near_duplicates_of_short_texts_at_the_threshold(spark, percent, sizes):
    rows = []
    for n, m in sizes:
        for _ in range(120):
            w = [f"v{len(rows)}_{k}" for k in range(n + 4)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: m + 4]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    sets, _ = brute_components(rows[:2], percent)
    assert [len(s) for s in sets] == list(sizes[0]) and got == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_among_form_letters(spark):
    """300 letters of one form: any two are just not alike, but 150 planted pairs share four more edits."""
    import random

    rng = random.Random(11)
    form = [f"w{k}" for k in range(1600)]
    rows, sets = [], []
    for i in range(150):
        shared = rng.sample(range(6, 1590), 4)
        for j in (2 * i, 2 * i + 1):
            w = list(form)
            for at in shared:
                w[at] = f"s{i}"
            for at in rng.sample([x for x in range(6, 1590) if all(abs(x - y) > 5 for y in shared)], 12):
                w[at] = f"x{j}"
            rows.append((j * 3 + 7, " ".join(w)))
            sets.append({hash(tuple(w[k : k + 5])) for k in range(1596)})
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert all(linked(a, b) == (k // 2 == j // 2) for k, a in enumerate(sets) for j, b in enumerate(sets[:k]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {i: i - 3 * ((i - 7) // 3 % 2) for i, _ in rows}


def test_splitting_finds_all_links_of_a_family(spark, monkeypatch):
    """Clusters are split over and over, and compared in small blocks; all links are found."""
    import random

    monkeypatch.setattr(minhash, "FEW", 0.5)
    monkeypatch.setattr(minhash, "LARGE", 15)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 200)
    rng = random.Random(6)
    rows = []
    for f in range(3):
        form = [f"f{f}w{k}" for k in range(60)]
        for i in range(45):
            w = list(form)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(60)] = f"e{f}_{rng.randrange(40)}"
            rows.append((1000 * f + i, " ".join(w[rng.randrange(3) :])))
    rng.shuffle(rows)
    for percent in (80, 60):
        _, label = brute_components(rows, percent)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        assert got == label


def test_near_duplicates_of_ids_near_the_limits(spark):
    import random

    from llm_fixtures import edited, sentence

    rng = random.Random(8)
    base = sentence(rng, 150)
    ids = [2**63 - 1 - 7 * k for k in range(40)] + [-(2**63) + 5 * k for k in range(40)]
    rows = [(i, edited(rng, base, 120)) for i in ids]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: -(2**63) for i in ids}


def test_registers_estimate_similarity():
    """Within the allowed deviation for sets of all sizes, and right on average."""
    rng = np.random.default_rng(3)
    for size in (8, 40, 150, 1200):
        errors = []
        for share in (0.5, 0.8, 0.95):
            for _ in range(40):
                pool = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                n = int(len(pool) * share)
                a = np.sort(pool)
                b = np.sort(np.concatenate([rng.permutation(pool)[:n], rng.integers(0, 2**63, len(pool) - n).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
                x, y = (pa.array([minhash.registers(s).tobytes()]) for s in (a, b))
                found = minhash._shared_registers.func(x, y).to_pylist()[0]
                truth = n / (2 * len(pool) - n)
                chance = minhash._COLLISIONS / 2**minhash.MANTISSA / 4 * found["filled"]
                error = (found["equal"] - chance) / (found["filled"] - chance) - truth
                errors.append(error)
                assert abs(error) <= minhash.SIGMAS * (truth * (1 - truth) / found["filled"]) ** 0.5
        assert abs(np.mean(errors)) < 0.03


def brute_substrings(rows, window):
    count = Counter()
    for _, t, *_ in rows:
        w = words(t)
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("full", [False, True])
def test_substring_dedup(docs, documents, full, monkeypatch):
    """The same result where the filters are full and let everything through."""
    if full:
        ones = np.full(1 << 13, 255, np.uint8)
        monkeypatch.setattr(substring, "_member_bits", lambda *args: ones)
        monkeypatch.setattr(twice, "twice_filter_of", lambda *args: ones)
    got = Counter(tuple(r) for r in substring.dedup_substrings(docs).collect())
    want = brute_substrings(documents, 35)
    assert got == want and sum(n for _, _, n, _ in want) > 500


def test_equal_windows_have_equal_anchors():
    """Windows with the same words are found under one name, whatever surrounds them."""
    rng = np.random.default_rng(4)
    for trial in range(30):
        vocabulary = int(rng.integers(2, 60))
        shared = [f"w{k}" for k in rng.integers(0, vocabulary, int(rng.integers(35, 120)))]
        texts = [" ".join([f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(0, 50))] + shared + [f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(0, 50))]) for _ in range(4)]
        w = arrowtext.Words(pa.array(texts))
        occ = substring.Occurrences(w, 35)
        names = {}
        covered = 0
        for name, a, b in zip(occ.name, occ.first, occ.last):
            for k in range(a, b + 1):
                covered += 1
                assert names.setdefault(w.hashes[k : k + 35].tobytes(), name) == name
        assert covered == len(arrowtext.window_starts(w.offs, 35))


def test_empty_tables(no_docs):
    assert linededup.dedup_lines(no_docs).collect() == []
    assert minhash.near_duplicates(no_docs).collect() == []
    assert substring.dedup_substrings(no_docs).collect() == []


def test_queries_digest(spark, documents, tmp_path):
    from wavelake.llm import queries

    spark.createDataFrame(documents[:12], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, empty in (("op7_line_dedup", ""), ("op3_substring_dedup", "")):
        rows = {r.doc_id: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(rows) == 12 and rows[0].kept_sha256 == hashlib.sha256(empty.encode()).hexdigest()
