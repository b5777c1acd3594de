"""Mixing sources to target weights by entropy balancing.

Sources, in code-point order with null last, weigh ``weights`` in turn and share
``share`` times all words.  A source's target stops at ``cap`` times its size;
what is above goes to the others by weight.

A document's rate solves, for its source, the entropy balancing problem with the
bounds [0, cap]: among the rates whose words add up to the target it is the one
closest in entropy to the uniform rate.  Its dual has one variable a source and
the rates are exponentially tilted: ``rate / (cap - rate) = exp(lam * z)`` with
``z`` the document's size over its source's mean size.  The dual is convex; all
sources take safeguarded Newton steps together, each step one aggregation of a
(source, size) histogram.

Rounding: rows that agree in doc_id, source and size can't be told apart and are one
entry with a count.  Within buckets of about ``bucket_docs`` entries of one source, from
large to small, an entry gets its rates' whole part, and so many copies more as
bring the bucket's words closest to their sum of rates; the rows of an entry share its
copies as evenly as whole numbers allow.  A bucket misses its sum
by no more than about half its smallest document, and no group grows with a source or with a
doc_id that many rows have (or lack).

Edge cases: null or blank texts have size 0, rate 1 and no words taken; a null
source is a source of its own; without words all targets are 0; repeated rows are
documents of their own; rows without doc_id are mixed like others; an empty table
gives an empty result; very long texts are counted whole; other columns are not read, whatever
their names.  Buckets and ties depend on doc_id and size alone, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm.storage import materialize, scratch

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of one entry that are made at once.
_RUN = 1000


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``(source, source_size)`` with ``target``: min(cap * size, level * weight).

    The level is the fixed point of resharing what capped sources leave; only its
    two sums come to the driver.
    """
    # numbered within ranges of sources, then moved on by the sizes of the ranges before
    order = F.col("source").asc_nulls_last()
    ranges = materialize(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "source_ranges")
    ends = F.sum("n").over(Window.orderBy("range"))
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (ends - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    ranked = materialize(ranges.join(before, "range").withColumn("weight", weight).drop("range", "before"), "source_weights")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    above = F.lit(False)
    while True:
        full, rest = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not rest or (total - full) / rest <= level:
            break
        level = (total - full) / rest
        above = F.lit(level) * F.col("weight") > cap * F.col("source_size")
    target = F.when(above, cap * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * z))))


def tilts(histogram: DataFrame, goals: DataFrame, cap: float, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """``goals`` with the dual variable ``lam`` of each source (null where the target is the cap)."""
    mean = histogram.groupBy(F.col("source").alias("m_source")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    open_ = goals.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    state = open_.join(mean, F.col("source").eqNullSafe(F.col("m_source")), "left").drop("m_source")
    state = materialize(state.select("*", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("miss")), "tilt_0")
    hist = histogram.select(F.col("source").alias("h_source"), "size", "n")
    for k in range(rounds):
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), z, cap)
        words = F.col("size") * F.col("n")
        sums = (
            state.join(hist, F.col("source").eqNullSafe(F.col("h_source")))
            .groupBy("source", "source_size", "target", "mean", "lam", "lo", "hi")
            .agg(F.sum(words * r).alias("got"), F.sum(words * r * (F.lit(1.0) - r / cap) * z).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        sums = sums.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        halved = F.when(F.col("lo").isNull(), F.col("hi") * 2 - F.abs(F.col("hi")) * 2 - 1).when(F.col("hi").isNull(), F.abs(F.col("lo")) * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton) < 1e6)
        step = F.when(newton.isNotNull() & inside, newton).otherwise(halved)
        miss = F.abs(F.col("got") - F.col("target")) / F.col("target")
        done = miss <= tolerance
        state = sums.select("source", "source_size", "target", "mean", F.when(done, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", miss.alias("miss"))
        state = materialize(state, f"tilt_{k + 1}")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
    else:
        if rounds and (state.agg(F.max("miss")).first()[0] or 0.0) > 1e3 * tolerance:
            raise RuntimeError(f"rates still miss their targets after {rounds} rounds")
    return state.select(F.col("source").alias("t_source"), "mean", "lam")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    bucket_docs: int = 500,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    by_entry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    ``by_entry``: one row for all documents with the same doc_id, source and size instead, with their
    number ``n`` and the ``total`` of their copies.
    """
    with scratch(docs.sparkSession) as keep:
        return _mix(docs, weights, share, cap, bucket_docs, text, doc_id, source, by_entry, keep)


def _mix(docs: DataFrame, weights: Sequence[float], share: float, cap: int, bucket_docs: int, text: str, doc_id: str, source: str, by_entry: bool, keep) -> DataFrame:
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    sized = keep(sized, "sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size_histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(per_source, weights, share, cap)
    tilt = tilts(histogram, goals, cap)
    full = goals.join(tilt, F.col("source").eqNullSafe(F.col("t_source")), "left")
    full = full.join(per_source.select(F.col("source").alias("p_source"), "docs"), F.col("source").eqNullSafe(F.col("p_source")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_docs))
    full = keep(full.select(F.col("source").alias("g_source"), "source_size", "target", "mean", "lam", buckets.cast("int").alias("buckets")), "source_tilts")

    entries = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNotNull(), _rate(F.col("lam"), z, cap)).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    rated = entries.join(full, F.col("source").eqNullSafe(F.col("g_source")))
    rated = rated.select("doc_id", "source", "size", "n", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "size"), F.col("buckets")).cast("int").alias("bucket"))

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        owed, total = 0.0, []
        for size, n, r in zip(group["size"].to_numpy(), group["n"].to_numpy(), group["rate"].to_numpy(), strict=True):
            whole = min(cap, math.floor(r))
            owed += (r - whole) * size * n
            more = 0
            if whole < cap and size:
                more = int(min(n, max(0, math.ceil(owed / size - 0.5))))
                owed -= more * size
            total.append(whole * n + more)
        return group.assign(total=total)[["doc_id", "source", "size", "n", "source_size", "target", "rate", "total"]]

    kinds = ", ".join(f"{c} {t}" for c, t in [("doc_id", docs.schema[doc_id].dataType.simpleString()), ("source", "string"), ("size", "bigint"), ("n", "bigint"), ("source_size", "bigint"), ("target", "double"), ("rate", "double"), ("total", "bigint")])
    shared = rated.groupBy("source", "bucket").applyInPandas(rounded, kinds)
    if by_entry:
        return shared
    # an entry's rows in runs of bounded length; long entries are dealt out before they become rows
    runs = shared.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _RUN))))
    spread = runs.where(F.col("n") > _RUN).repartition("doc_id", "source", "size", "run")
    runs = runs.where(F.col("n") <= _RUN).unionByName(spread)
    first = F.col("run") * _RUN
    each = runs.withColumn("k", F.explode(F.sequence(first, F.least(first + _RUN, F.col("n")) - 1)))
    copies = F.floor(F.col("total") / F.col("n")) + F.when(F.col("k") < F.col("total") % F.col("n"), 1).otherwise(0)
    return each.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
