"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct ``shingle`` word shingles (A-Z lower-cased
words ``[^\\x20\\x09-\\x0D]+``).  Two documents are linked when
``100 * |A & B| >= percent * |A | B|``; a document's component is the smallest
doc_id that links reach.

1. One pass over the texts makes a sketch of ``REGISTERS`` buckets: the top bits
   of a shingle's fingerprint choose its bucket, and of the bucket's smallest rest
   only the number of leading zeros (6 bits) and the next ``MANTISSA`` bits are
   kept.  For banding alone, empty buckets take the next filled bucket's register.  The
   pass also makes a 128-bit digest of the whole set.
2. Documents with equal sets form a class; only one of each class goes on.
3. Bands of ``ROWS`` successive registers are grouped by plain aggregation.  Each
   member of a band bucket is paired with the bucket's smallest doc_id: as many
   pairs as members, whatever the bucket's size.  Links that these pairs confirm
   give first components.
4. What is still apart in a bucket is settled exactly.  Where few pairs are left, they
   are all compared.  Other buckets are merged into clusters.  The members of a cluster
   of up to ``LARGE`` documents are compared block by block: a row holds the full sets of
   two blocks of bounded size, and one matrix product gives all intersections; only links
   between different components come out.  Larger clusters are first split by *differences*
   (``_split``) into narrower groups.
5. A pair is verified only if its Jaccard estimate over the buckets that either set
   fills, corrected for the register collisions that ``n``, ``m`` and the mantissa lead
   one to expect, is within ``SIGMAS`` standard deviations of the threshold; it is then
   confirmed on the full sets.
6. Components: every vertex takes the least label around it, and the label of its
   label, until nothing changes; labels are a written table after each round.

Splitting by differences: let ``T`` be the shingles that more than half of a cluster's
documents hold.  A document lacks ``r`` of them and has ``x`` others; those ``r + x``
shingles are its differences and ``w = 100 * r + percent * x`` its weight.  Two documents
with ``s`` differences in common are linked exactly if
``(100 + percent) * s >= w1 + w2 - (100 - percent) * |T|``.  So one whose weight and the
cluster's least weight leave the right side at or below 0 is linked with that lightest document,
and all others need at least ``s`` differences in common with whatever they are linked
with.  As in any prefix filter, it is enough to look at all but the ``s - 1`` most
frequent differences of each: those who share one form a new, narrower group.  A group holds
at most half of its cluster, and large groups are split again by their own common
shingles.

Bucket keys, clusters and classes may be hot: they are only aggregated with partial
aggregation or joined between tables that Spark can split.

Edge cases: null, empty or blank texts have the empty set, are linked with nothing
and are their own component; a text of fewer words than a shingle has one shingle,
the whole sequence; repeated rows share a class; rows with one doc_id are one
vertex; rows without doc_id are never linked (component null) and are kept; of equally
near documents the smallest doc_id names the component; very long texts are read whole (one text
is the least that a task holds); an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wavelake.llm import arrowtext, twice
from wavelake.llm.storage import arrow_rows, materialize, scratch

REGISTERS = 128
MANTISSA = 10
ROWS = 5
BANDS = REGISTERS // ROWS
#: How far an estimate may lie below the threshold, in its standard deviations at the threshold.
SIGMAS = 6
#: Groups with at most so many pairs per member left are settled pair by pair.
FEW = 4
#: Clusters of more documents are split by differences; smaller ones are compared in blocks.
LARGE = 1 << 14
#: The shingles of a block, where each document counts ``BLOCK_ITEMS / 2048`` more.
BLOCK_ITEMS = 1 << 20
#: The register of a bucket that no shingle fills.
EMPTY = 0xFFFF

_BUCKET_BITS = REGISTERS.bit_length() - 1
#: Expected register collisions of sets of n and m items, in units of
#: REGISTERS * 2**-MANTISSA * n * m / (n + m)**2 (published constant times four).
_COLLISIONS = 4 * 0.169919487159739093975315012348630288992889


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted array of distinct fingerprints, as uint16; ``EMPTY`` where none falls."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)
    first = np.searchsorted(shingles, edges)
    bucket = np.append(first[1:], len(shingles)) > first
    rest = (shingles[np.minimum(first, len(shingles) - 1)] << np.uint64(_BUCKET_BITS)) | np.uint64(1 << (_BUCKET_BITS - 1))
    zeros = 63 - np.floor(np.log2(rest.astype(np.longdouble))).astype(np.int64)
    mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    reg = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return np.where(bucket, reg, np.uint16(EMPTY))


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One key for each band; empty buckets take the next filled bucket's register."""
    filled = np.flatnonzero(reg != EMPTY)
    reg = reg[filled[np.searchsorted(filled, np.arange(REGISTERS)) % len(filled)]]
    used = arrowtext.mix(reg[: BANDS * ROWS].astype(np.uint64) + np.uint64(1)).reshape(BANDS, ROWS)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = salt
    for j in range(ROWS):
        key = arrowtext.mix(key ^ (used[:, j] * np.uint64(2 * j + 3)))
    return key


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch):
                sets = arrowtext.shingle_sets(arrowtext.Words(part.column("text"), lower=True), shingle)
                d1, d2, regs, keys = [], [], [], []
                for s in sets:
                    if len(s):
                        with np.errstate(over="ignore"):
                            d1.append(int(np.bitwise_xor.reduce(arrowtext.mix(s)).view(np.int64)))
                            d2.append(int(np.add.reduce(arrowtext.mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
                        r = registers(s)
                        regs.append(r.tobytes())
                        keys.append(band_keys(r).view(np.int64))
                    else:
                        d1.append(0)
                        d2.append(0)
                        regs.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc", "n", "d1", "d2", "regs", "bands"],
                )

    return run


def _sets(shingle: int, held):
    """Full sets of the documents that a Bloom filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(twice.contains(filt, batch.column("doc").to_numpy())))
            for part in arrowtext.slices(batch):
                sets = arrowtext.shingle_sets(arrowtext.Words(part.column("text"), lower=True), shingle)
                offs = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offs[1:])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["doc", "items"])

    return run


_SHARED = StructType([StructField("equal", IntegerType()), StructField("filled", IntegerType())])


@F.arrow_udf(_SHARED)
def _shared_registers(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many buckets either sketch fills, and how many of these have equal registers."""
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
    filled = (left != EMPTY) | (right != EMPTY)
    counts = [(filled & (left == right)).sum(axis=1), filled.sum(axis=1)]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int32), pa.int32()) for c in counts], ["equal", "filled"])


def estimate(equal: Column, filled: Column, n: Column, m: Column) -> Column:
    """Jaccard from the equal ones of ``filled`` registers, less the collisions to expect."""
    by_chance = F.lit(_COLLISIONS / 2**MANTISSA) * filled * n.cast("double") * m / ((n + m).cast("double") * (n + m))
    return (equal - by_chance) / (filled - by_chance)


class _Verifier:
    """Confirms candidate pairs ``(a, b)``, a < b, of class representatives."""

    def __init__(self, texts: DataFrame, classes: DataFrame, shingle: int, percent: int):
        self.texts, self.classes, self.shingle, self.percent = texts, classes, shingle, percent
        self.round = 0

    def sets(self, docs: DataFrame, name: str) -> DataFrame:
        """``(doc, items)``: the full sets of the documents that ``docs (doc)`` names, and of a few more.

        A bounded Bloom filter chooses the texts, which so are not shuffled; users join the sets by ``doc``.
        """
        wanted = materialize(docs.groupBy("doc").agg(F.lit(1).alias("one")).drop("one"), f"{name}_wanted")
        filt = twice.member_filter_of(wanted, lambda batch: iter([batch.column(0).to_numpy()]), twice.bits_for(wanted.count()))
        held = docs.sparkSession.sparkContext.broadcast(filt.tobytes())
        found = self.texts.where(F.col("doc").isNotNull()).mapInArrow(_sets(self.shingle, held), "doc bigint, items array<bigint>")
        return materialize(found, name)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked."""
        self.round += 1
        side = lambda x: self.classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        pairs = materialize(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), f"pairs_{self.round}")
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        near = near.withColumn("r", _shared_registers("regs_a", "regs_b"))
        p = self.percent / 100
        slack = F.lit(SIGMAS * math.sqrt(p * (1 - p))) / F.sqrt("r.filled")
        near = near.where(estimate(F.col("r.equal"), F.col("r.filled"), F.col("n_a"), F.col("n_b")) >= F.lit(p) - slack)
        near = materialize(near.select("a", "b", "n_a", "n_b"), f"near_{self.round}")
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("doc")), f"sets_{self.round}")
        full = near.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("items_a")), "a")
        full = full.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("items_b")), "b")
        both = F.size(F.array_intersect("items_a", "items_b"))
        either = F.size("items_a") + F.size("items_b") - both
        return full.where(100 * both.cast("long") >= self.percent * either.cast("long")).select("a", "b")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """``(vertex, label)`` for every vertex of ``links (a, b)``; label: the least vertex reachable."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}_edges")
    labels = materialize(edges.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}_0")
    k = 0
    while True:
        k += 1
        none = F.lit(None).cast("bigint").alias("old")
        around = edges.join(labels, F.col("a") == F.col("vertex")).select(F.col("b").alias("vertex"), "label", none)
        jump = labels.select(F.col("vertex").alias("v"), F.col("label").alias("via"))
        jump = jump.join(labels.select(F.col("vertex").alias("via"), F.col("label")), "via").select(F.col("v").alias("vertex"), "label", none)
        own = labels.select("vertex", "label", F.col("label").alias("old"))
        least = around.union(jump).union(own).groupBy("vertex").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        least = materialize(least, f"{name}_{k}")
        labels = least.select("vertex", "label")
        if least.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``labels`` with more ``links``: components are only sought among the labels that these connect."""
    of = lambda x: labels.select(F.col("vertex").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    more = components(ends.where(F.col("a") != F.col("b")), name)
    old = labels.join(more.select(F.col("vertex").alias("label"), F.col("label").alias("new")), "label", "left").select("vertex", F.coalesce("new", "label").alias("label"))
    return materialize(old.unionByName(more).groupBy("vertex").agg(F.min("label").alias("label")), f"{name}_joined")


def _split(rows: DataFrame, verify: _Verifier, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with each cluster's lightest document, and narrower groups ``(key, rep, n)``.

    ``rows (key, rep, n, label)``: the documents of each cluster.
    """
    p = verify.percent
    sets = verify.sets(rows.select(F.col("rep").alias("doc")), f"{name}_sets")
    each = rows.join(sets.withColumnRenamed("doc", "rep"), "rep")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    held = each.select("key", F.explode("items").alias("item")).groupBy("key", "item").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    held = materialize(held.join(sizes, "key"), f"{name}_held")
    common = held.where(2 * F.col("held") > F.col("size")).groupBy("key").agg(F.collect_list("item").alias("common"))
    each = each.join(common, "key", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    entry = lambda gone: lambda i: F.struct(i.alias("item"), F.lit(gone).alias("gone"))
    lacks, has = F.array_except("common", "items"), F.array_except("items", "common")
    diffs = each.select(
        "key", "rep", "n", "label", (100 * F.size(lacks).cast("long") + p * F.size(has).cast("long")).alias("w"),
        ((100 - p) * F.size("common").cast("long")).alias("free"), F.concat(F.transform(lacks, entry(True)), F.transform(has, entry(False))).alias("diffs"),
    )
    diffs = materialize(diffs, f"{name}_diffs")
    light = materialize(diffs.groupBy("key").agg(F.min(F.struct("w", "rep", "label")).alias("light")), f"{name}_light")
    diffs = diffs.join(light, "key").withColumn("over", F.col("w") + F.col("light.w") - F.col("free"))
    pairs = diffs.where((F.col("over") <= 0) & (F.col("label") != F.col("light.label"))).select(F.least("rep", "light.rep").alias("a"), F.greatest("rep", "light.rep").alias("b"))

    shared = F.greatest(F.lit(1), F.ceil(F.col("over") / (100 + p)))
    entries = diffs.select("key", "rep", "n", (F.size("diffs") - shared + 1).cast("int").alias("prefix"), F.explode("diffs").alias("d")).where(F.col("prefix") > 0)
    entries = entries.select("key", "rep", "n", "prefix", "d.item", "d.gone").join(held, ["key", "item"], "left")
    often = F.coalesce(F.when(F.col("gone"), F.col("size") - F.col("held")).otherwise(F.col("held")), F.lit(1))
    ranked = entries.groupBy("key", "rep").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.array_sort(F.collect_list(F.struct(often.alias("often"), "item", "gone"))).alias("d"))
    prefix = F.filter(F.slice("d", F.lit(1), F.col("prefix")), lambda d: d["often"] > 1)
    narrow = ranked.select("key", "rep", "n", F.explode(prefix).alias("d")).select(F.xxhash64("key", "d.item", "d.gone").alias("key"), "rep", "n")
    return pairs, materialize(narrow, f"{name}_narrow")


def _block_links(percent: int):
    """``(label, root)`` of the components that links between documents of two blocks make one."""

    def compare(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        labels, sizes, flat, row = [], [], [], []
        for side in (left, right):
            labels.append(side.field("label").to_numpy())
            lists = side.field("items")
            sizes.append(lists.value_lengths().to_numpy())
            flat.append(lists.flatten().to_numpy())
            row.append(np.repeat(np.arange(len(side)), sizes[-1]))
        common = np.intersect1d(*flat)
        both = np.zeros((len(left), len(right)), np.float32)
        at = [np.minimum(np.searchsorted(common, f), max(0, len(common) - 1)) for f in flat]
        hit = [common[a] == f for a, f in zip(at, flat, strict=True)] if len(common) else [np.zeros(len(f), bool) for f in flat]
        at, row = ([x[h] for x, h in zip(xs, hit, strict=True)] for xs in (at, row))
        for k in range(0, len(common), 4096):
            held = []
            for side in range(2):
                inside = (at[side] >= k) & (at[side] < k + 4096)
                m = np.zeros((len(labels[side]), min(4096, len(common) - k)), np.float32)
                m[row[side][inside], at[side][inside] - k] = 1
                held.append(m)
            both += held[0] @ held[1].T
        # a cheap bound on all pairs, then the exact test in whole numbers
        least = percent / (100 + percent) * (sizes[0][:, None] + sizes[1][None, :].astype(float))
        i, j = np.nonzero((both >= least - 0.5) & (labels[0][:, None] != labels[1][None, :]))
        linked = 100 * both[i, j].astype(np.int64) >= percent * (sizes[0][i].astype(np.int64) + sizes[1][j] - both[i, j].astype(np.int64))
        names = np.unique(np.concatenate(labels))
        x, y = (np.searchsorted(names, side) for side in (labels[0][i[linked]], labels[1][j[linked]]))
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(root)))
        return names[moved], names[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = compare(*(batch.column(c)[k].values for c in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

    return run


def _compare_blocks(rows: DataFrame, verify: _Verifier, name: str) -> DataFrame:
    """Links between components within clusters ``rows (key, rep, n, label)`` of bounded size."""
    before = Window.partitionBy("key").orderBy("label", "rep").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("n") + BLOCK_ITEMS // 2048
    placed = rows.withColumn("block", F.floor(F.coalesce(F.sum(weight).over(before), F.lit(0)) / BLOCK_ITEMS).cast("int"))
    whole = F.sum(weight).over(Window.partitionBy("key"))
    placed = materialize(placed.select("key", "rep", "label", "block", (whole > BLOCK_ITEMS).alias("several")), f"{name}_placed")
    ends = placed.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = ends.select("key", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    # blocks are ordered by label, so equal ends mean that both hold the same one component
    met = ends.join(other, "key").where((F.col("block") <= F.col("block_b")) & ((F.col("low") != F.col("high_b")) | (F.col("high") != F.col("low_b"))))
    met = materialize(met.select("key", "block", "block_b"), f"{name}_met")
    sets = verify.sets(placed.select(F.col("rep").alias("doc")), f"{name}_sets").withColumnRenamed("doc", "rep")
    blocks = placed.join(sets, "rep").groupBy("key", "block", "several").agg(F.collect_list(F.struct("rep", "label", "items")).alias("docs"), (F.min("label") != F.max("label")).alias("mixed"))
    with arrow_rows(rows.sparkSession, 1):
        blocks = materialize(blocks, f"{name}_blocks")
        # a block meets itself where it is; only clusters of several blocks are shuffled
        own = blocks.where("mixed").select(F.col("docs").alias("docs_a"), F.col("docs").alias("docs_b"))
        cross = met.where(F.col("block") < F.col("block_b"))
        several = blocks.where(F.col("several"))
        left = several.select("key", "block", F.col("docs").alias("docs_a"))
        right = several.select("key", F.col("block").alias("block_b"), F.col("docs").alias("docs_b"))
        both = cross.join(left, ["key", "block"]).join(right, ["key", "block_b"]).select("docs_a", "docs_b")
        return materialize(own.union(both).mapInArrow(_block_links(verify.percent), "a bigint, b bigint"), f"{name}_links")


def _settle(rows: DataFrame, labels: DataFrame, verify: _Verifier) -> DataFrame:
    """Labels of ``labels`` and of all links within groups: ``rows (key, rep, n)`` are the members of each."""
    k = 0
    while True:
        k += 1
        of = labels.select(F.col("vertex").alias("rep"), F.col("label").alias("found"))
        rows = materialize(rows.join(of, "rep", "left").select("key", "rep", "n", F.coalesce("found", "rep").alias("label")), f"groups_{k}")
        same = F.bit_xor(F.xxhash64("rep")).alias("same")
        groups = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("own"), same)
        sizes = groups.groupBy("key").agg(F.sum("own").alias("size"), F.sum(F.col("own") * F.col("own")).alias("within"), F.bit_xor("same").alias("same"))
        sizes = sizes.where(F.col("size") * F.col("size") > F.col("within"))
        # of groups with the same members one is enough
        sizes = sizes.groupBy("size", "within", "same").agg(F.min("key").alias("key"))
        many = (F.col("size") * F.col("size") - F.col("within") > 2 * FEW * F.col("size")).alias("many")
        sizes = materialize(sizes.select("key", "size", many), f"mixed_{k}")
        kinds = {r["many"] for r in sizes.select("many").distinct().collect()}
        if not kinds:
            return labels
        rows = materialize(rows.join(sizes, "key"), f"apart_{k}")
        few = rows.where(~F.col("many"))
        b = few.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
        near = 100 * F.least("n", "n_b") >= verify.percent * F.greatest("n", "n_b")
        pairs = few.join(b, "key").where((F.col("rep") < F.col("b")) & (F.col("label") != F.col("label_b")) & near).select(F.col("rep").alias("a"), "b")
        found = verify.links(pairs)
        more = None
        if True in kinds:
            many = rows.where("many").select("key", "rep", "n", "label", "size")
            if k == 1:
                # a document is in many buckets but in one cluster
                star = many.join(many.groupBy("key").agg(F.min("rep").alias("low")), "key").groupBy("rep", "low").agg(F.lit(1).alias("one"))
                # one edge for each document, and the few different pairs of smallest members that documents connect
                least = star.groupBy("rep").agg(F.min("low").alias("least"))
                lows = star.join(least, "rep").where(F.col("low") != F.col("least")).select(F.col("low").alias("a"), F.col("least").alias("b")).distinct()
                cluster = components(least.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(lows), "clusters").select(F.col("vertex").alias("rep"), F.col("label").alias("key"))
                sizes = cluster.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
                many = many.groupBy("rep", "n", "label").agg(F.lit(1).alias("one")).join(cluster.join(sizes, "key"), "rep").select("key", "rep", "n", "label", "size")
                many = materialize(many, "cluster_members")
            found = found.union(_compare_blocks(many.where(F.col("size") <= LARGE).drop("size"), verify, f"blocks_{k}"))
            large = many.where(F.col("size") > LARGE).drop("size")
            if not large.isEmpty():
                direct, more = _split(large, verify, f"split_{k}")
                found = found.union(verify.links(direct))
        labels = joined(labels, materialize(found, f"settled_links_{k}"), f"settled_{k}")
        if more is None:
            return labels
        rows = more


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    with scratch(docs.sparkSession) as keep, arrow_rows(docs.sparkSession, 2000):
        return _near_duplicates(docs, shingle, percent, text, doc_id, keep)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, text: str, doc_id: str, keep) -> DataFrame:
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    sketch = texts.mapInArrow(_sketches(shingle), "doc bigint, n bigint, d1 bigint, d2 bigint, regs binary, bands array<bigint>")
    sketch = materialize(sketch, "sketches")
    slim = keep(sketch.select("doc", "n", "d1", "d2"), "sizes")
    real = sketch.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = real.groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep"), F.max("regs").alias("regs"), F.max("bands").alias("bands"))
    classes = materialize(classes, "classes")

    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(F.col("low") != F.col("high"))
    buckets = materialize(buckets.select("key", "low"), "buckets")
    shared = materialize(rows.join(buckets, "key").select("key", "rep", "n", "low"), "shared")
    verify = _Verifier(texts, classes, shingle, percent)
    first = verify.links(shared.where(F.col("low") != F.col("rep")).select(F.col("low").alias("a"), F.col("rep").alias("b")))
    # a doc_id with several texts links their classes
    twin = real.groupBy("doc").agg(F.min("d1").alias("x1"), F.max("d1").alias("y1")).where(F.col("x1") != F.col("y1"))
    twin_links = (
        sketch.join(twin.select("doc"), "doc", "left_semi").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"])
        .where(F.col("doc") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    )
    links = materialize(first.union(twin_links), "links")
    labels = _settle(shared.select("key", "rep", "n"), components(links), verify)

    named = classes.select("d1", "d2", "n", "rep").join(labels.withColumnRenamed("vertex", "rep"), "rep", "left")
    named = keep(named.select("d1", "d2", "n", F.coalesce("label", "rep").alias("label")), "class_labels")
    out = slim.join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("label", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
