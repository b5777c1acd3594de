"""Benchmark decontamination with spaced seeds.

Words are runs of letters and digits, A-Z lower-cased; punctuation is ignored.  A
document holds a benchmark item if, for some alignment of the two, ``L`` successive
aligned words agree in at least ``PERCENT`` percent of the positions, with ``L`` the
smaller of ``WINDOW`` and the item's length.  Up to 3 of 20 words may be
substituted.  Items of fewer than ``MIN_WORDS`` words must agree in every word.

1. Every position of an item gives one hash for each mask of ``MASKS`` (the words
   that the mask looks at).  A mask ignores some positions, so that substitutions
   there don't matter.  The three masks together miss no window with the
   substitutions allowed; a test goes through all of them.  A shorter item gives one
   hash of all its words; texts are hashed in windows of every length that such items have.
2. A Bloom filter of the items' hashes (bounded by ``twice.MAX_BITS``) is broadcast.
   One pass over the texts keeps the stretches around positions whose hash it may
   hold, with the stretch's word fingerprints.
3. Hits are joined with the items' hashes, reduced to distinct alignments, and each
   alignment is verified word by word around the hit.

Edge cases: null, empty and blank texts hold nothing; repeated rows are judged
alike; rows without doc_id are judged too; an empty benchmark leaves all documents
clean; of several items the first by id and the largest overlap are reported; very long texts are read whole;
other columns pass through ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from wavelake.llm import arrowtext, twice
from wavelake.llm.storage import fresh, materialize, scratch

WINDOW = 20
PERCENT = 85
MIN_WORDS = 13
#: Offsets of the words that each mask looks at.
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 3, 6, 8, 9, 10), (0, 1, 6, 7, 9, 10, 11))


def needed(length: int) -> int:
    """Words that must agree in a window of ``length``."""
    return length if length < MIN_WORDS else -(-PERCENT * length // 100)


def whole(length: int) -> tuple[tuple[int, ...], ...]:
    """The only mask of an item of fewer than ``MIN_WORDS`` words: all of them."""
    return (tuple(range(length)),)


def seed_hashes(hashes: np.ndarray, offs: np.ndarray, masks: tuple[tuple[int, ...], ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the positions where it fits and their hashes."""
    for k, mask in enumerate(masks):
        if mask not in MASKS:
            k = len(MASKS) + len(mask)
        at = arrowtext.window_starts(offs, mask[-1] + 1)
        h = np.full(len(at), arrowtext.mix(np.array([k + 1], np.uint64))[0])
        for o in mask:
            h = arrowtext.mix(h ^ hashes[at + o])
        yield at, h


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrowtext.slices(batch):
            words = arrowtext.Words(part.column("text"), lower=True, letters=True)
            rows = []
            for d, item in enumerate(part.column("item_id").to_pylist()):
                own = words.hashes[words.offs[d] : words.offs[d + 1]]
                if not len(own):
                    continue
                masks = MASKS if len(own) >= MIN_WORDS else whole(len(own))
                seeds = [(int(x), int(a)) for at, h in seed_hashes(own, np.array([0, len(own)]), masks) for a, x in zip(at, h.view(np.int64), strict=True)]
                rows.append({"item": item, "words": own.view(np.int64).tolist(), "hashes": [s[0] for s in seeds], "at": [s[1] for s in seeds]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ITEM)


_ITEM = pa.schema([("item", pa.int64()), ("words", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _stretches(held, short: list[int]):
    """Texts to stretches of words around possible hits; ``short``: the lengths of items below ``MIN_WORDS``."""
    masks = (*MASKS, *(m for n in short for m in whole(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for part in arrowtext.slices(batch):
                words = arrowtext.Words(part.column("text"), lower=True, letters=True)
                found = []
                for at, h in seed_hashes(words.hashes, words.offs, masks):
                    hit = twice.contains(filt, h)
                    found.append((at[hit], h[hit]))
                at, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                doc = np.searchsorted(words.offs, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > WINDOW)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                lo = np.maximum(words.offs[doc[first]], at[first] - WINDOW)
                hi = np.minimum(words.offs[doc[first] + 1], at[last] + MASKS[-1][-1] + 1 + WINDOW)
                keys = part.column("key").to_numpy()[doc[first]]
                rows = [
                    {"key": int(k), "start": int(a - words.offs[d]), "words": words.hashes[a:b].view(np.int64).tolist(), "hashes": h[i : j + 1].view(np.int64).tolist(), "at": (at[i : j + 1] - a).tolist()}
                    for k, d, a, b, i, j in zip(keys, doc[first], lo, hi, first, last, strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_STRETCH)

    return run


_STRETCH = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


@F.arrow_udf(IntegerType())
def _best_overlap(stretch: pa.Array, item: pa.Array, shift: pa.Array) -> pa.Array:
    """The most agreeing words of a window of the item when word 0 lies at ``shift``; 0 if too few."""
    out = []
    for a, b, s in zip(stretch, item, shift.to_pylist(), strict=True):
        text, mine = a.values.to_numpy(), b.values.to_numpy()
        size = min(WINDOW, len(mine))
        lo, hi = max(0, -s), min(len(mine), len(text) - s)
        if hi - lo < size:
            out.append(0)
            continue
        same = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(text[lo + s : hi + s] == mine[lo:hi], out=same[1:])
        best = int((same[size:] - same[:-size]).max())
        out.append(best if best >= needed(size) else 0)
    return pa.array(out, pa.int32())


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows are told apart by id and text, so that repeated or missing ids don't mix texts."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(key, item, overlap)`` for every benchmark item that a row of ``docs`` holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = materialize(items.mapInArrow(_items, "item bigint, words array<bigint>, hashes array<bigint>, at array<int>"), "items")
    number = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    short = [r[0] for r in items.where(F.size("words") < MIN_WORDS).groupBy(F.size("words")).agg(F.lit(1)).collect()]
    filt = twice.member_filter(items, F.col("hashes"), twice.bits_for(4 * number))
    held = spark.sparkContext.broadcast(filt.tobytes())

    slim = docs.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = slim.mapInArrow(_stretches(held, short), "key bigint, start int, words array<bigint>, hashes array<bigint>, at array<int>")
    found = materialize(found.withColumn("stretch", F.xxhash64("key", "start")), "stretches")
    hits = found.select("stretch", F.explode(F.arrays_zip("hashes", "at")).alias("h")).select("stretch", F.col("h.hashes").alias("hash"), F.col("h.at").alias("at"))
    seeds = items.select("item", F.explode(F.arrays_zip("hashes", "at")).alias("h")).select("item", F.col("h.hashes").alias("hash"), F.col("h.at").alias("item_at"))
    seeds = materialize(seeds, "seeds")
    aligned = hits.join(seeds, "hash").select("stretch", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    aligned = materialize(aligned.groupBy("stretch", "item", "shift").agg(F.lit(1).alias("one")).drop("one"), "alignments")
    full = aligned.join(found.select("stretch", "key", F.col("words").alias("text_words")), "stretch").join(items.select("item", F.col("words").alias("item_words")), "item")
    checked = full.select("key", "item", _best_overlap("text_words", "item_words", "shift").alias("overlap")).where(F.col("overlap") > 0)
    return checked.groupBy("key", "item").agg(F.max("overlap").alias("overlap"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, first_item (none: -1), overlap_words``."""
    with scratch(docs.sparkSession) as keep:
        per_row = overlaps(docs, benchmark, text, doc_id).groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item"), F.max("overlap").alias("overlap_words"))
        per_row = keep(per_row, "contaminated")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"))
    joined = rows.join(per_row, "key", "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("first_item", F.lit(-1)).alias("first_item"), F.coalesce("overlap_words", F.lit(0)).cast("int").alias("overlap_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    name = fresh(docs, "bad_key")
    with scratch(docs.sparkSession) as keep:
        bad = keep(overlaps(docs, benchmark, text, doc_id).select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.join(bad, row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")) == F.col(name), "left_anti")
