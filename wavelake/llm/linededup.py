"""Line dedup with two Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least ``min_chars`` code points that at least
``min_docs`` documents hold lose all their lines except those in the largest
doc_id that holds them.

1. Each task puts its long lines' hashes into a once- and a twice-filter
   (``twice``); merged, the twice-filter is broadcast (its size is bounded).
2. Only lines that the twice-filter suspects are shuffled, as 128-bit key digests:
   first to one row for each (key, document), then to a count and the largest
   doc_id for each key.  Both are partial aggregations, so a line that a third of
   all documents hold is one row a task.
3. The lines to drop go back to their rows.  Only rows that lose lines (and those that a
   bounded Bloom filter takes for one) are shuffled; the others pass in one scan.

Edge cases: a null or empty text is one empty line; a text without repeated lines
is returned as it is; rows that share a doc_id are one document; rows without a
doc_id count together as one document and never are the largest; repeated rows lose the
same lines; very long texts are rows like others; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from wavelake.llm import arrowtext, twice
from wavelake.llm.storage import fresh, materialize, scratch

_ENDS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """``lower`` is right for ASCII alone and much cheaper than ``translate``."""
    bare = F.btrim(line, F.lit(_ENDS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(key: Column, half: int) -> Column:
    return F.xxhash64(F.lit(half), key)


@F.arrow_udf(ArrayType(BooleanType()))
def _stays(hashes: pa.Array, dropped: pa.Array) -> pa.Array:
    """For each line of each text whether its hash is not among the dropped ones of the text."""

    def keyed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists), dtype=np.uint64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        values = lists.flatten()
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        found = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).view(np.uint64)
        return np.where(known, arrowtext.mix(found) + row * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)), known

    have, known = keyed(hashes)
    gone, _ = keyed(dropped)
    stay = ~(known & np.isin(have, gone))
    offs = np.zeros(len(hashes) + 1, np.int32)
    np.cumsum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False), out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(stay))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines dropped from its text.

    Adds a last column, ``_lines`` (with more underscores if ``docs`` has that name): a struct of
    ``n_lines`` (before dropping) and ``n_dropped``.  The columns of ``docs`` stay as they are.
    """
    spark = docs.sparkSession
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    row = F.xxhash64(d, F.coalesce(t, F.lit("")))
    counts = fresh(docs, "_lines")
    with scratch(spark) as keep:
        keys = F.filter(F.transform(_lines(t), line_key), lambda k: F.length(k) >= min_chars)
        slim = docs.select(d.alias("doc"), row.alias("row"), keys.alias("keys"))
        hashes = F.array_distinct(F.transform("keys", lambda k: _digest(k, 1)))
        bits = twice.bits_for(16 * docs.count())
        suspect = twice.suspect_flags(spark, twice.twice_filter(slim, hashes, bits))

        flagged = slim.withColumn("flags", suspect(F.transform("keys", lambda k: _digest(k, 1))))
        kept = F.filter(F.col("keys"), lambda k, i: F.get(F.col("flags"), i))
        pairs = F.array_distinct(F.transform(kept, lambda k: F.struct(_digest(k, 1).alias("h1"), _digest(k, 2).alias("h2"))))
        seen = flagged.select("doc", "row", F.explode(pairs).alias("k")).select("k.h1", "k.h2", "doc", "row")
        seen = materialize(seen.groupBy("h1", "h2", "doc", "row").agg(F.lit(1).alias("one")).drop("one"), "line_holders")
        common = seen.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        common = materialize(common.where(F.col("n") >= min_docs).drop("n"), "common_lines")
        drops = seen.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
        drops = keep(drops.groupBy("row").agg(F.collect_set("h1").alias("drop")), "dropped_lines")
        losing = twice.member_filter_of(drops.select("row"), lambda batch: iter([batch.column(0).to_numpy()]), twice.bits_for(drops.count()))
    may_lose = twice.suspects(spark, losing)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("old"), row.alias("row"))
    touched = packed.where(may_lose("row")).join(drops, "row", "left").withColumn("lines", _lines(F.col("old").getField(text)))
    long_hash = F.transform("lines", lambda l: F.when(F.length(line_key(l)) >= min_chars, _digest(line_key(l), 1)))
    touched = touched.withColumn("stay", _stays(long_hash, F.coalesce("drop", F.array().cast("array<bigint>"))))
    rest = F.filter("lines", lambda l, i: F.get(F.col("stay"), i))
    touched = touched.withColumn("rest", F.when(F.col("drop").isNotNull(), rest)).withColumn("n", F.size("lines").cast("long"))
    old = lambda c: F.col("old").getField(c)
    new = F.when(F.col("rest").isNull(), old(text)).otherwise(F.array_join("rest", "\n"))
    both = lambda n, gone: F.struct(n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped")).alias(counts)
    touched = touched.select(*[(new if c == text else old(c)).alias(c) for c in docs.columns], both(F.col("n"), F.coalesce(F.col("n") - F.size("rest"), F.lit(0))))
    n_lines = F.size(_lines(t))
    other = docs.where(~may_lose(row)).select(*[F.col(f"`{c}`") for c in docs.columns], both(n_lines, F.lit(0)))
    return touched.unionByName(other)
