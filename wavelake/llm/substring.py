"""Exact substring dedup by recompression.

A window is ``window`` successive words ``[^\\x20\\x09-\\x0D]+`` of one document.
Every word inside a window whose word sequence also starts anywhere else, in the
same document or another, is removed; all windows are judged on the input.

Recompression renames a text in rounds: maximal runs of one symbol, then pairs of a
"left" and a "right" symbol, become one symbol each.  A name is a fingerprint of
what it replaces and a symbol's side is a bit of its name, so names are global
without any exchange, and equal substrings get equal symbols except near their
ends.  How near is known: each symbol carries its context, the words that settled
that it is there.  A window that contains a symbol's whole context shows the same
symbol at the same place wherever else it occurs.  A window's anchor is, of the
highest level that has such symbols (level 0, the words, always has),
the one whose name hashes lowest; equal windows have equal anchors.  Windows next to each other mostly
share one, and an anchor with its run of windows is an *occurrence*.  It is named by the
words of the anchor's context.

1. A pass over the texts counts the names of all occurrences; those that
   occur twice or more are *repeated*.
2. A second pass joins the occurrences with the repeated names, each with a
   fingerprint of all words that its windows cover (its span).  Spans that occur twice or
   more repeat as a whole.
3. A name with different spans (at the ends of shared passages and around edits) may
   still have windows in common.  For such names all single spans and one holder of
   each repeated span are listed with their texts, which give the 128-bit fingerprints of
   only their windows; those that occur twice or more repeat.
4. The ranges found go back to their texts.

The plan is the same for every size of input: counts are partial aggregations, the joins
are between tables that Spark can split, and joins alone decide.  In front of each join a Bloom
filter of bounded size (``twice.MAX_BITS``) drops most rows that the join would drop
anyway; the more there is, the more rows it lets through.

Edge cases: null, empty and blank texts have no words and lose none; texts shorter
than a window lose none; repeated rows lose everything that is at least a window
long; rows are told apart by id and text, so missing or repeated ids don't mix
texts; very long texts are read whole; of equal passages none is kept, so there are no ties; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wavelake.llm import arrowtext, twice
from wavelake.llm.storage import arrow_rows, materialize, scratch

WINDOW = 35
#: More rounds give longer symbols, of which a window contains fewer.
ROUNDS = ("run", *["pair"] * 6)


def _run_round(sym, doc, lo, hi, bounds):
    """Name maximal runs; whether a run ends there is settled by both neighbours."""
    n = len(sym)
    edge = np.ones(n, bool)
    edge[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    count = (last - first + 1).astype(np.uint64)
    name = np.where(count > 1, arrowtext.mix(sym[first] ^ (count * np.uint64(0xA24BAED4963EE407))), sym[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    has_before = (first > 0) & (doc[before] == doc[first])
    has_after = (last + 1 < n) & (doc[after] == doc[first])
    new_lo = np.where(has_before, lo[before], bounds[doc[first]] - 1)
    new_hi = np.where(has_after, hi[after], bounds[doc[first] + 1])
    return name, doc[first], new_lo, new_hi


def _pair_round(sym, doc, lo, hi, bounds, salt):
    """Name pairs (left, right); sides are disjoint, so pairs never overlap."""
    right = (sym * np.uint64(salt | 1)) >> np.uint64(63) == 1
    same = doc[1:] == doc[:-1]
    pair = np.zeros(len(sym), bool)
    pair[:-1] = ~right[:-1] & right[1:] & same
    first = np.flatnonzero(pair)
    name, new_lo, new_hi = sym.copy(), lo.copy(), hi.copy()
    name[first] = arrowtext.mix((sym[first] + np.uint64(salt)) ^ (sym[first + 1] * np.uint64(0xD6E8FEB86659FD93)))
    new_hi[first] = hi[first + 1]
    # a lone left symbol depends on what follows, a lone right one on what precedes
    has_next, has_prev = np.append(same, False), np.insert(same, 0, False)
    left = ~right & ~pair
    k = np.flatnonzero(left & has_next)
    new_hi[k] = hi[k + 1]
    k = np.flatnonzero(left & ~has_next)
    new_hi[k] = bounds[doc[k] + 1]
    k = np.flatnonzero(right & has_prev)
    new_lo[k] = lo[k - 1]
    k = np.flatnonzero(right & ~has_prev)
    new_lo[k] = bounds[doc[k]] - 1
    keep = np.ones(len(sym), bool)
    keep[first + 1] = False
    return name[keep], doc[keep], new_lo[keep], new_hi[keep]


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first position of the least value in each range ``[a, b)``."""
    best = np.arange(len(order))
    out = a.copy()
    width = np.maximum(b - a, 1)
    step = 1
    while True:
        here = (width >= step) & (width < 2 * step)
        x, y = best[a[here]], best[b[here] - step]
        out[here] = np.where(order[x] <= order[y], x, y)
        if not (width >= 2 * step).any():
            return out
        x, y = best[:-step], best[step:]
        best = np.where(order[x] <= order[y], x, y)
        step *= 2


class Occurrences:
    """The anchors of a slice of texts with their runs of windows.

    ``name``, ``first`` and ``last``: anchor and first and last window start (word
    positions in the slice); ``doc``: the text.
    """

    def __init__(self, words: arrowtext.Words, window: int):
        sym, doc, bounds = words.hashes, words.doc, words.offs
        lo = hi = np.arange(len(sym))
        levels = [(sym, lo, hi)]
        with np.errstate(over="ignore"):
            for k, kind in enumerate(ROUNDS):
                if not len(sym):
                    break
                if kind == "run":
                    sym, doc, lo, hi = _run_round(sym, doc, lo, hi, bounds)
                else:
                    sym, doc, lo, hi = _pair_round(sym, doc, lo, hi, bounds, 0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
                levels.append((sym, lo, hi))
        starts = arrowtext.window_starts(bounds, window)
        name = np.zeros(len(starts), np.uint64)
        anchor = np.full(len(starts), -1)
        todo = np.arange(len(starts))
        base = 0
        for k in range(len(levels) - 1, -1, -1):
            sym, lo, hi = levels[k]
            if len(todo) and len(sym):
                a = np.searchsorted(lo, starts[todo])
                b = np.searchsorted(hi, starts[todo] + window)
                fits = b > a
                got = todo[fits]
                j = _least(arrowtext.mix(sym + np.uint64(k)), a[fits], b[fits])
                name[got] = arrowtext.mix(arrowtext.range_hash(words.hashes, lo[j], hi[j] + 1) + np.uint64(k))
                anchor[got] = base + j
                todo = todo[~fits]
            base += len(sym)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(starts))[: len(at)] - 1
        self.name, self.first, self.last = name[at], starts[at], starts[end]
        self.doc = np.searchsorted(bounds, self.first, "right") - 1


def _names(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch):
                name, n = np.unique(Occurrences(arrowtext.Words(part.column("text")), window).name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], ["name", "n"])

    return run


def _spans(held, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for part in arrowtext.slices(batch):
                words = arrowtext.Words(part.column("text"))
                occ = Occurrences(words, window)
                hit = np.flatnonzero(twice.contains(filt, occ.name))
                first, last, doc = occ.first[hit], occ.last[hit], occ.doc[hit]
                span = arrowtext.range_hash(words.hashes, first, last + window, seed=77)
                key = part.column("key").to_numpy()[doc]
                at = (first - words.offs[doc]).astype(np.int32)
                arrays = [pa.array(occ.name[hit].view(np.int64)), pa.array(span.view(np.int64)), pa.array(key), pa.array(at), pa.array((last - first + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "span", "key", "at", "windows"])

    return run


def _fingerprints(words: arrowtext.Words, first: np.ndarray, last: np.ndarray, doc: np.ndarray, keys: np.ndarray, window: int) -> pa.RecordBatch:
    """128-bit fingerprints of the windows of some runs."""
    size = last - first + 1
    ends = np.cumsum(size)
    w = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)
    doc = np.repeat(doc, size)
    h1 = arrowtext.range_hash(words.hashes, w, w + window)
    h2 = arrowtext.range_hash(words.hashes, w, w + window, seed=991)
    arrays = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(keys[doc]), pa.array((w - words.offs[doc]).astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "key", "at"])


def _listed_windows(window: int):
    """Windows of the runs that a text is listed with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch):
                words = arrowtext.Words(part.column("text"))
                lists = part.column("runs")
                at, n = (lists.flatten().field(c).to_numpy() for c in (0, 1))
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                first = words.offs[doc] + at
                yield _fingerprints(words, first, first + n - 1, doc, part.column("key").to_numpy(), window)

    return run


_KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("text", StringType())])


@F.arrow_udf(_KEPT)
def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for t, a, b in zip(text, starts.to_pylist(), ends.to_pylist(), strict=True):
        words = t.as_py().encode().split()
        n_words.append(len(words))
        if a:
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            stay = np.cumsum(cover)[:-1] == 0
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "text"])


def _uncut(spark, filt: np.ndarray):
    """The same for texts that lose no word; null for those that may be in the filter."""
    held = spark.sparkContext.broadcast(filt.tobytes())

    @F.arrow_udf(_KEPT)
    def uncut(key: pa.Array, text: pa.Array) -> pa.Array:
        maybe = twice.contains(np.frombuffer(held.value, np.uint8), key.to_numpy(zero_copy_only=False))
        n_words, kept = [], []
        for t, skip in zip(text, maybe.tolist(), strict=True):
            words = [] if skip else t.as_py().encode().split()
            n_words.append(len(words))
            kept.append(b" ".join(words).decode())
        arrays = [pa.array(n_words, pa.int64()), pa.array([0] * len(kept), pa.int64()), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(arrays, ["n_words", "n_removed", "text"], mask=pa.array(maybe))

    return uncut.asNondeterministic()  # evaluated once, not again in the filter below


def _member_bits(table: DataFrame, column: str, max_bits: int) -> np.ndarray:
    """A Bloom filter of a bigint column."""
    bits = min(max_bits, twice.bits_for(table.count()))
    return twice.member_filter_of(table.select(column), lambda batch: iter([batch.column(0).to_numpy()]), bits)


def repeated_ranges(texts: DataFrame, window: int = WINDOW, max_bits: int = twice.MAX_BITS) -> DataFrame:
    """``(key, start, end)``: word ranges inside repeated windows of ``texts (key, text)``; they may overlap."""
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(_names(window), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    repeated = materialize(counts.where(F.col("n") > 1).select("name"), "repeated_names")
    held = spark.sparkContext.broadcast(_member_bits(repeated, "name", max_bits).tobytes())
    occ = texts.mapInArrow(_spans(held, window), "name bigint, span bigint, key bigint, at int, windows int")
    occ = materialize(occ.join(repeated, "name", "left_semi"), "occurrences")

    spans = materialize(occ.groupBy("name", "span").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("holder")), "spans")
    mixed = materialize(spans.groupBy("name").agg(F.count(F.lit(1)).alias("spans")).where(F.col("spans") > 1).select("name", F.lit(True).alias("mixed")), "mixed")
    marked = spans.join(mixed, "name", "left").select("name", "span", (F.col("n") > 1).alias("whole"), F.when(F.col("mixed"), F.when(F.col("n") > 1, F.col("holder"))).alias("holder"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
    marked = marked.where(F.col("whole") | F.col("mixed"))
    found = occ.join(marked, ["name", "span"]).select("key", "at", "windows", "whole", (F.col("mixed") & (~F.col("whole") | (F.col("key") == F.col("holder")))).alias("open"))
    found = materialize(found, "settled")
    whole = found.where("whole").select("key", F.col("at").alias("start"), (F.col("at") + F.col("windows") + F.lit(window - 1)).alias("end"))

    runs = found.where("open").groupBy("key").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))
    runs = materialize(runs, "open_runs")
    listed = texts.where(twice.suspects(spark, _member_bits(runs, "key", max_bits))("key")).join(runs, "key")
    wins = materialize(listed.mapInArrow(_listed_windows(window), "h1 bigint, h2 bigint, key bigint, at int"), "windows")
    suspect = twice.suspects(spark, twice.twice_filter_of(wins.select("h1"), _column, min(max_bits, twice.bits_for(wins.count()))))
    likely = wins.where(suspect(F.col("h1")))
    twice_or_more = likely.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    twice_or_more = materialize(twice_or_more, "repeated_windows")
    single = likely.join(twice_or_more, ["h1", "h2"]).select("key", F.col("at").alias("start"), (F.col("at") + F.lit(window)).alias("end"))
    return whole.union(single)


def _column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", max_bits: int = twice.MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, text`` (kept words, one space between)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    with arrow_rows(spark, 1000), scratch(spark) as keep:
        ranges = repeated_ranges(rows.select("key", "text"), window, max_bits)
        lists = ranges.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("r")).select(F.col("key").alias("r_key"), "r")
        lists = keep(lists, "ranges")
    # only texts that may lose words are shuffled to their ranges
    filt = _member_bits(lists, "r_key", max_bits)
    listed = rows.where(twice.suspects(spark, filt)("key")).join(lists, F.col("key") == F.col("r_key"), "left")
    kept = listed.select("doc_id", _cut("text", F.col("r.start"), F.col("r.end")).alias("k"))
    other = rows.select("doc_id", _uncut(spark, filt)("key", "text").alias("k")).where(F.col("k").isNotNull())
    return kept.unionByName(other).select("doc_id", "k.n_words", "k.n_removed", "k.text")
