"""Quality rules with thresholds that follow each language and source.

One pass over the texts counts words, symbols, repeated lines and words in
repeated 5-word windows.  Ratios of these go into a mergeable quantile sketch: a
histogram of logarithmic bins (relative error ``ACCURACY``) for every (lang,
source), which is a plain grouped count, so sketches of parts add up to the sketch
of the whole.  From its quartiles come bounds ``q25 - K * spread`` and
``q75 + K * spread`` with ``spread = max(q75 - q25, slack)``: quartiles don't move
with up to a quarter of bad rows, and the slack keeps constant ratios from
rejecting all that differs.  Quartiles of few documents say little, so a (lang, source) of fewer than
``min_docs`` documents takes the merged sketch of its language, a rare language that of all documents.
The bounds are joined back and filter the documents that the base rules let pass.

Edge cases: null, empty and blank texts have no words and fail; null languages and
sources are groups of their own; rows that fail the base rules still count in the
sketches, except those without words; repeated rows are judged alike, and so are ties (a ratio equal
to its bound is kept); very long texts are counted whole; an empty
table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm import arrowtext
from wavelake.llm.storage import materialize, scratch

ACCURACY = 0.01
MIN_DOCS = 100
K = 10.0
#: The least spread of each ratio.
SLACK = {"word_length": 0.3, "symbol_ratio": 0.03, "dup_line_ratio": 0.04, "repeat_ratio": 0.02}
#: Ratios of which small values are bad as well.
TWO_SIDED = ("word_length",)

_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_ZERO_BIN = -1000
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated_words(words: arrowtext.Words, size: int = 5) -> np.ndarray:
    """For each text the words inside windows that occur twice or more in it."""
    at = arrowtext.window_starts(words.offs, size)
    h = arrowtext.range_hash(words.hashes, at, at + size)
    own = arrowtext.mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    _, back, n = np.unique(h ^ own, return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return _per_text((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.offs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrowtext.slices(batch):
            words = arrowtext.Words(part.column("text"))
            raw, bounds = words.raw, words.bounds
            letters = ((raw & 0xC0) != 0x80) & ~arrowtext._SPACE[raw]
            lines, dups = [], []
            for d in range(part.num_rows):
                full = [x for x in raw[bounds[d] : bounds[d + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                lines.append(len(full))
                dups.append(len(full) - len(set(full)))
            found = [words.counts, _per_text(letters.astype(np.int64), bounds), _per_text(_SYMBOL[raw], bounds), lines, dups, _repeated_words(words)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc", "lang", "source")] + [pa.array(x, pa.int64()) for x in found], ["doc", "lang", "source", *_COUNTS])


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {"word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words")}


def _bin(value: Column) -> Column:
    return F.when(value > 1e-8, F.ceil(F.ln(value) / F.lit(math.log(_GAMMA)))).otherwise(F.lit(_ZERO_BIN)).cast("int")


def _bounds(sketch: DataFrame, keys: list[str], tag: str, min_docs: int) -> DataFrame:
    """``keys`` with one struct of bounds, for groups of ``min_docs`` documents."""
    quartiles = sketch.groupBy(*keys, "ratio").agg(F.sum("n").alias("docs"), F.percentile("bin", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    value = lambda k: F.pow(F.lit(_GAMMA), F.get(F.col("q"), k))
    slack = F.element_at(F.create_map(*[x for r, s in SLACK.items() for x in (F.lit(r), F.lit(s))]), F.col("ratio"))
    spread = F.lit(K) * F.greatest(value(1) - value(0), slack)
    each = quartiles.where(F.col("docs") >= min_docs).select(*keys, "ratio", (value(0) - spread).alias("lo"), (value(1) + spread).alias("hi"))
    flat = [F.max(F.when(F.col("ratio") == r, F.col(side))).alias(f"{r}_{side}") for r in SLACK for side in ("lo", "hi")]
    wide = each.groupBy(*keys).agg(*flat) if keys else each.agg(*flat)
    return wide.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], F.struct(*[f"{r}_{s}" for r in SLACK for s in ("lo", "hi")]).alias(tag))


def score_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``."""
    with scratch(docs.sparkSession) as keep:
        slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
        counts = slim.mapInArrow(_count, "doc bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
        counts = keep(counts, "counts")
        entries = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _bin(v).alias("bin")) for r, v in _ratios().items()])).alias("e")
        sketch = counts.where(F.col("n_words") > 0).select("lang", "source", entries).groupBy("lang", "source", "e.ratio", "e.bin").agg(F.count(F.lit(1)).alias("n"))
        sketch = materialize(sketch, "sketch")
        fine, by_lang = _bounds(sketch, ["lang", "source"], "fine", min_docs), _bounds(sketch, ["lang"], "coarse", min_docs)
        overall = _bounds(sketch, [], "all", min_docs).first()["all"].asDict()
        overall = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in overall.items()])
        groups = sketch.select("lang", "source").distinct()
        groups = groups.join(fine, F.col("lang").eqNullSafe(F.col("fine_lang")) & F.col("source").eqNullSafe(F.col("fine_source")), "left")
        groups = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("coarse_lang")), "left")
        groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.coalesce(F.col("fine"), F.col("coarse"), overall).alias("bounds"))
        groups = keep(groups, "thresholds")

    joined = counts.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = F.lit(False)
    for r, v in _ratios().items():
        odd = odd | F.coalesce(v > F.col(f"bounds.{r}_hi"), F.lit(False))
        if r in TWO_SIDED:
            odd = odd | F.coalesce(v < F.col(f"bounds.{r}_lo"), F.lit(False))
    return joined.select(F.col("doc").alias("doc_id"), *_COUNTS, failed.alias("base_failed"), (~failed & ~odd).alias("kept"))
