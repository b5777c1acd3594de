"""Toxicity by a counterfactual-regularised classifier.

Features are the words of a text (runs of letters and digits, A-Z lower-cased) and
their first 3 to 8 bytes, each as present or absent, so one insult in a very long
text still counts and inflected forms share their stem.  A logistic model is fitted
on a bounded sample of labelled rows:

1. At most ``MAX_ROWS`` labelled rows of each class are drawn by hash (the bound on
   what is fitted and on what reaches the driver).
2. Spark counts for every feature in how many sampled rows of each class it occurs;
   the ``MAX_FEATURES`` whose rates differ most beyond chance stay.
3. Every sampled text that names an identity group also yields counterfactuals, the
   same text with the term swapped for another group's; the loss penalises the
   squared difference of their scores before the logistic function.  Identity terms and their swaps are always
   among the features, and neutral sentences that only name a group are added as
   label 0, so that naming a group can't raise a score by itself.
4. A feature's value is the absolute logarithm of its rates' ratio in the two classes, so that rare but
   telling words gain weight from few rows.  Classes weigh the same in the loss; the intercept is then moved so that
   texts which are as likely of either class get the score ``CUT``.
5. The model (``MAX_FEATURES`` weights at most) is broadcast and scores every whole
   text in one pass.

Edge cases: null, empty and blank texts have no features and get the score of the
intercept; rows without doc_id are scored but never learned from;
labels that are null or belong to no text are left out; repeated rows are scored
alike; with no labels of one class every score is 0; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wavelake.llm import arrowtext
from wavelake.llm.storage import fresh

MAX_ROWS = 4000
MAX_FEATURES = 4096
MIN_ROWS = 2
#: Weight of the counterfactual term against the mean logistic loss.
PENALTY = 1.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: The score at which texts count as toxic.
CUT = 0.7

#: Terms that name groups, each list with terms that swap for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "transgender", "bisexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Sentences that are neutral about the group they name.
NEUTRAL = ("{} live in this town", "a story about {} and their work", "many {} came to the meeting", "{}")


def _features(words: arrowtext.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix, repeats included."""
    doc, length = words.doc, words.ends - words.starts
    docs, found = [doc], [words.hashes]
    for n in PREFIXES:
        long = length > n
        h = words.bytes_hash(words.starts[long], words.starts[long] + n)
        docs.append(doc[long])
        found.append(arrowtext.mix(h ^ np.uint64(0x51ED270B)))
    return np.concatenate(docs), np.concatenate(found)


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    docs, found = _features(arrowtext.Words(column, lower=True, letters=True))
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    first = np.ones(len(docs), bool)
    first[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    return docs[first], found[first]


class _Lookup:
    """Positions of features in a sorted list, with a small table in front."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.front = np.zeros(1 << 16, bool)
        self.front[(known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        docs, found = _features(arrowtext.Words(column, lower=True, letters=True))
        if not len(self.known):
            return docs[:0], np.zeros(0, np.int64)
        maybe = self.front[(found & np.uint64(0xFFFF)).astype(np.int64)]
        docs, found = docs[maybe], found[maybe]
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hit = self.known[at] == found
        pairs = np.unique(docs[hit].astype(np.int64) * len(self.known) + at[hit])
        return pairs // len(self.known), pairs % len(self.known)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrowtext.slices(batch):
            docs, found = _distinct(part.column("text"))
            bad = part.column("label").to_numpy(zero_copy_only=False)[docs].astype(np.int64)
            feature, at = np.unique(found, return_inverse=True)
            n1 = np.bincount(at, weights=bad, minlength=len(feature)).astype(np.int64)
            n0 = np.bincount(at, minlength=len(feature)).astype(np.int64) - n1
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n1), pa.array(n0)], ["feature", "n1", "n0"])


_SWAPS = {t: [o for o in group if o != t] for group in IDENTITY_TERMS for t in group}
_TERM = re.compile(r"(?<![^\W_])(" + "|".join(sorted(_SWAPS, key=len, reverse=True)) + r")(?![^\W_])")


def swapped(text: str) -> list[str]:
    """The text once for every identity term in it and every term that may stand for it."""
    text = text.lower()
    terms = sorted({m[1] for m in _TERM.finditer(text)})
    return [re.sub(rf"(?<![^\W_]){t}(?![^\W_])", o, text) for t in terms for o in _SWAPS[t]]


def _term_features() -> np.ndarray:
    """The features of all identity terms."""
    return np.unique(_distinct(pa.array(sorted(_SWAPS)))[1])


class Model:
    """A sparse logistic model over hashed features; ``swaps``: how many counterfactuals came from labelled texts."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, swaps: int = 0):
        self.features, self.weights, self.bias, self.swaps = features, weights, bias, swaps

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(len(column))
        docs, at = _Lookup(self.features)(column)
        z = np.full(len(column), self.bias)
        np.add.at(z, docs, self.weights[at])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _fit(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, pairs: list[tuple[list, list]], size: int, penalty: float, l2: float, steps: int, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic loss with balanced classes + l2 + penalty * (difference of swapped logits)**2, by Adam."""
    w, b = np.zeros(size), 0.0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    prior = -1.0
    left = [(k, c) for k, (a, _) in enumerate(pairs) for c in a]
    right = [(k, c) for k, (_, a) in enumerate(pairs) for c in a]
    lr_, lc = (np.array([x[i] for x in left], np.int64) for i in (0, 1))
    rr, rc = (np.array([x[i] for x in right], np.int64) for i in (0, 1))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        full = w * scale
        p = sig(b + np.bincount(rows, weights=full[cols], minlength=len(labels)))
        g = weight * (p - labels)
        gw = np.bincount(cols, weights=g[rows], minlength=size)
        gb = g.sum() + 0.01 * (b - prior)
        if pairs:
            n = len(pairs)
            d = 2 * penalty / n * (np.bincount(lr_, weights=full[lc], minlength=n) - np.bincount(rr, weights=full[rc], minlength=n))
            gw += np.bincount(lc, weights=d[lr_], minlength=size) - np.bincount(rc, weights=d[rr], minlength=size)
        grad = np.append(gw * scale + l2 * w, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS, penalty: float = PENALTY, l2: float = 1e-4, steps: int = 600) -> Model:
    """Fit on rows whose ``crc32(doc_id as text) mod 3`` is not 1."""
    mine = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mine = mine.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = [mine.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (1, 0)]
    chosen = [(r.doc_id, r.label) for d in drawn for r in d.collect()]
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    if len({k for _, k in chosen}) < 2:
        return empty
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "l_id bigint, label int"))
    slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("l_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = slim.join(wanted, "l_id").select("l_id", "text", "label")
    n1, n0 = sum(k for _, k in chosen), sum(1 - k for _, k in chosen)

    counts = sample.select("text", "label").mapInArrow(_count_features, "feature bigint, n1 bigint, n0 bigint")
    counts = counts.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= MIN_ROWS)
    rate = (F.col("n1") + F.col("n0")) / F.lit(float(n1 + n0))
    z = (F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))) / F.sqrt(rate * (F.lit(1.0 + 1e-9) - rate) * F.lit(1.0 / n1 + 1.0 / n0))
    best = counts.where(F.abs(z) >= 3.0).orderBy(F.desc(F.abs(z)), "feature").limit(MAX_FEATURES).select("feature", "n1", "n0").collect()
    ratio = {np.int64(r.feature).view(np.uint64): abs(np.log((r.n1 + 0.5) / (n1 + 1)) - np.log((r.n0 + 0.5) / (n0 + 1))) for r in best}
    known = np.unique(np.concatenate([np.array(list(ratio), np.uint64), _term_features()]))
    scale = np.array([ratio.get(f, 1.0) for f in known])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Lookup(known)

        def lists(column: pa.Array) -> list[list[int]]:
            rows, cols = find(column)
            cut = np.searchsorted(rows, np.arange(len(column) + 1))
            return [cols[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)]

        for batch in batches:
            for part in arrowtext.slices(batch):
                other = [swapped(t) for t in part.column("text").to_pylist()]
                flat = lists(pa.array([t for texts in other for t in texts], pa.string()))
                ends = np.cumsum([len(texts) for texts in other])
                other = [flat[e - len(texts) : e] for e, texts in zip(ends, other, strict=True)]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("l_id"), part.column("label"), pa.array(lists(part.column("text")), kind), pa.array(other, pa.list_(kind))], ["l_id", "label", "at", "other"])

    found = sample.mapInArrow(sparse, "l_id bigint, label int, at array<int>, other array<array<int>>").collect()
    rows = sorted((r.l_id, r.label, list(r["at"]), [list(x) for x in r["other"]]) for r in found)
    if len({r[1] for r in rows}) < 2:
        return empty

    swaps = sum(len(others) for *_, others in rows)
    find = _Lookup(known)
    single = lambda t: find(pa.array([t]))[1].tolist()
    neutral = [f.format(t) for group in IDENTITY_TERMS for t in group for f in NEUTRAL]
    rows += [(-1 - k, 0, single(t), [single(o) for o in swapped(t)]) for k, t in enumerate(neutral)]
    pairs = [(at, other) for _, _, at, others in rows for other in others]
    r = np.repeat(np.arange(len(rows)), [len(x[2]) for x in rows])
    c = np.array([x for row in rows for x in row[2]], np.int64)
    w, b = _fit(r, c, np.array([x[1] for x in rows], float), pairs, len(known), penalty, l2, steps, scale)
    return Model(known, w, b + float(np.log(CUT / (1 - CUT))), swaps)


def held_out(doc_id: Column) -> Column:
    """The rows that no label may be learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scorer(spark, model: Model) -> Callable[[Column], Column]:
    """A column function from text to score; the model is broadcast."""
    held = spark.sparkContext.broadcast((model.features, model.weights, model.bias))

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        model = Model(*held.value)
        out = []
        for part in arrowtext.slices(pa.RecordBatch.from_arrays([text], ["text"])):
            out.append(model.scores(part.column("text")))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> tuple[DataFrame, Model]:
    """``docs`` with a last column ``_toxicity`` from 0 to 1 (more underscores if it has that name), and the model."""
    model = train(docs, labels, text=text, doc_id=doc_id, **options)
    score = scorer(docs.sparkSession, model)
    return docs.withColumn(fresh(docs, "_toxicity"), score(F.coalesce(F.col(f"`{text}`"), F.lit("")))), model
