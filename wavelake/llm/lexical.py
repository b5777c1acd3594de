"""Ranked lexical search of many queries at once, by shared partial scores.

Every item is a query; a document's score for it is the sum of its terms' impacts, all in integers.
Items share terms and whole sets of terms, so sums of shared sets are formed once a document:

1. **Mining.**  An item is a sequence of symbols, one for each power of two in a term's number of
   repeats, the symbols that most items hold first.  In rounds, pairs of neighbouring symbols that two or more
   items hold become one new symbol (of overlapping pairs the more frequent one), as Spark jobs over all items.  The symbols form
   a graph in which each node is the sum of two others, down to terms.
2. **Postings.**  One scan of the texts keeps, for each document, its length and the counts of the terms that
   some item holds.  Document frequencies come from these.
3. **Scores.**  Tasks take the postings in runs of bounded size, compute one row of impacts for each term and
   one accumulator row for each node of the graph, level by level, each once however many items share it; an item is the sum of the
   few symbols left of it.  A task keeps the ``top`` best documents of each item; they are merged in two
   steps, by parts of the tasks first.

What is sent to the tasks is bounded: items are handled in blocks of about ``block_symbols`` symbols, each block with
a scan of its own.  Terms are compared by 64-bit fingerprints.

Edge cases: null, empty and term-free texts count nowhere; an item without terms has no rows; equal rows of items
are one item, rows that share an id but not a text are ranked one by one under that id; repeated rows of documents are
documents of their own; equal scores rank by ascending doc_id, rows without one last; very long
texts are read whole; empty tables give an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm import arrowtext
from wavelake.llm.storage import materialize, scratch

#: Symbols of the items that are scored in one scan.
BLOCK_SYMBOLS = 200_000
#: Accumulators that a task holds at once (8 bytes each).
CELLS = 1 << 21
#: Parts of the tasks in the first merge.
PARTS = 64


def _term_counts(words: arrowtext.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of every distinct term of every text, by text."""
    order = np.lexsort((words.hashes, words.doc))
    doc, term = words.doc[order], words.hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A symbol for each bit of a term's count."""
    for batch in batches:
        for part in arrowtext.slices(batch):
            doc, term, n = _term_counts(arrowtext.Words(part.column("text"), lower=True, letters=True))
            for bit in range(int(n.max(initial=0)).bit_length()):
                has = (n >> bit) & 1 == 1
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(doc[has])), pa.array(term[has].view(np.int64)), pa.array(np.full(has.sum(), bit, np.int32))], ["item", "term", "bit"])


def mine_shared(symbols: DataFrame, keep=materialize) -> tuple[DataFrame, DataFrame | None]:
    """What is left of ``(item, symbol)`` once shared pairs are symbols of their own, and these: ``(level, symbol, a, b)``."""
    common = symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "symbol"))
    left = materialize(symbols.join(common, "symbol").select("item", rank.alias("pos"), "symbol"), "symbols")
    made, level = None, 0
    order = Window.partitionBy("item").orderBy("pos")
    while True:
        pairs = left.withColumn("b", F.lead("symbol").over(order))
        shared = pairs.where(F.col("b").isNotNull()).groupBy(F.col("symbol").alias("a"), F.col("b").alias("with")).agg(F.count(F.lit(1)).alias("n"))
        shared = materialize(shared.where(F.col("n") > 1).withColumn("new", F.xxhash64(F.lit("pair"), "a", "with")), "pairs")
        if shared.isEmpty():
            return keep(left.select("item", "symbol"), "left"), made
        level += 1
        offers = pairs.join(shared, (F.col("symbol") == F.col("a")) & (F.col("b") == F.col("with")), "left").select("item", "pos", "symbol", "b", "new", F.when(F.col("new").isNotNull(), F.struct("n", "new")).alias("weight"))
        before, after = F.lag("weight").over(order), F.lead("weight").over(order)
        wins = F.col("new").isNotNull() & (before.isNull() | (F.col("weight") > before)) & (after.isNull() | (F.col("weight") > after))
        chosen = materialize(offers.withColumn("wins", wins), "chosen")
        nodes = chosen.where("wins").select(F.lit(level).alias("level"), F.col("new").alias("symbol"), F.col("symbol").alias("a"), "b").distinct()
        made = keep(nodes if made is None else made.union(nodes), "nodes")
        gone = F.coalesce(F.lag("wins").over(order), F.lit(False))
        left = materialize(chosen.withColumn("gone", gone).where(~F.col("gone")).select("item", "pos", F.when(F.col("wins"), F.col("new")).otherwise(F.col("symbol")).alias("symbol")), "symbols")


class SharingGraph:
    """One block's items as sums over a graph of shared sums; rows of accumulators are numbered terms first."""

    def __init__(self, leaves: list, nodes: list, left: list):
        self.vocabulary = np.unique(np.array([r.term for r in leaves], np.int64).view(np.uint64))
        self.term = np.searchsorted(self.vocabulary, np.array([r.term for r in leaves], np.int64).view(np.uint64))
        self.bit = np.array([r.bit for r in leaves], np.int64)
        number = {r.symbol: k for k, r in enumerate(leaves)}
        self.levels = []
        for level in sorted({r.level for r in nodes}):
            # a pair that lost to another in some item may be made in a later round as well
            here = [r for r in nodes if r.level == level and r.symbol not in number]
            if not here:
                continue
            self.levels.append((np.array([number[r.a] for r in here]), np.array([number[r.b] for r in here])))
            number |= {r.symbol: len(number) + k for k, r in enumerate(here)}
        self.size = len(number)
        own = sorted((r.item, number[r.symbol]) for r in left)
        self.items = np.array(sorted({item for item, _ in own}), np.int64)
        self.parts = np.array([k for _, k in own], np.int64)
        self.offsets = np.searchsorted(np.array([item for item, _ in own], np.int64), self.items)

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """(items, documents) from (terms, documents)."""
        held = np.empty((self.size, impacts.shape[1]), np.int64)
        done = len(self.term)
        held[:done] = impacts[self.term] << self.bit[:, None]
        for a, b in self.levels:
            np.add(held[a], held[b], out=held[done : done + len(a)])
            done += len(a)
        out = np.empty((len(self.items), impacts.shape[1]), np.int64)
        step = max(1, 2 * CELLS // max(1, impacts.shape[1] * max(1, len(self.parts) // max(1, len(self.items)))))
        ends = np.append(self.offsets, len(self.parts))
        for k in range(0, len(self.items), step):
            some = slice(k, min(k + step, len(self.items)))
            first = ends[k]
            out[some] = np.add.reduceat(held[self.parts[first : ends[some.stop]]], self.offsets[some] - first, axis=0)
        return out


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part in arrowtext.slices(batch):
                words = arrowtext.Words(part.column("text"), lower=True, letters=True)
                at = np.minimum(np.searchsorted(known, words.hashes), max(0, len(known) - 1))
                hit = np.flatnonzero(known[at] == words.hashes) if len(known) else np.zeros(0, np.int64)
                # text and term as one number: both are small
                pair, n = np.unique(words.doc[hit] * len(known) + at[hit], return_counts=True)
                doc, term = np.divmod(pair, max(1, len(known)))
                offs = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(v.astype(np.int32))) for v in (term, n)]
                out = pa.RecordBatch.from_arrays([part.column("doc"), pa.array(words.counts.astype(np.int64)), *lists], ["doc", "n", "terms", "counts"])
                yield out.filter(pa.array(words.counts > 0))

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return run


class _Best:
    """The best documents of each item so far: by score, then id; no id is last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score, self.doc, self.null = np.zeros((items, top), np.int64), np.zeros((items, top), np.int64), np.ones((items, top), bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        bar = np.maximum(self.score[:, -1], 1)
        for k in np.flatnonzero(scores.max(axis=1, initial=0) >= bar):
            at = np.flatnonzero(scores[k] >= bar[k])
            score = np.concatenate([self.score[k], scores[k, at]])
            docs, nulls = np.concatenate([self.doc[k], doc[at]]), np.concatenate([self.null[k], null[at]])
            best = np.lexsort((docs, nulls, -score))[: self.top]
            self.score[k], self.doc[k], self.null[k] = score[best], docs[best], nulls[best]


def _ranked(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight, n_docs, length = shared.value
        best = _Best(len(graph.items), top)
        most = max(1, CELLS // max(1, graph.size + len(graph.vocabulary)))
        for whole in batches:
            for k in range(0, whole.num_rows, most):
                batch = whole.slice(k, most)
                terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(terms.offsets.to_numpy())
                n = batch.column("n").to_numpy(zero_copy_only=False)
                m = 25 + (75 * n * n_docs) // length
                column, row = np.repeat(np.arange(batch.num_rows), sizes), terms.flatten().to_numpy(zero_copy_only=False)
                impacts = np.zeros((len(graph.vocabulary), batch.num_rows), np.int64)
                impacts[row, column] = weight[row] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[column]))
                ids = batch.column("doc")
                best.add(graph.scores(impacts), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        item, place = np.nonzero(best.score > 0)
        ids = pa.array(best.doc[item, place], mask=best.null[item, place])
        part = np.full(len(item), TaskContext.get().partitionId() % PARTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(graph.items[item]), pa.array(part), pa.array(best.score[item, place]), ids], ["item", "part", "score", "doc"])

    return run


def _blocks(symbols: DataFrame, block_symbols: int) -> int:
    """Blocks such that none is over twice ``block_symbols``, unless one item alone is."""
    per_item = symbols.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = per_item.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(1, -(-total[1] // block_symbols))
    while blocks < total[0]:
        largest = per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if largest <= max(2 * block_symbols, total[2]):
            break
        blocks *= 2
    return blocks


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_symbols: int = BLOCK_SYMBOLS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents with a score above 0.

    With N documents of L terms in all, a term held by df of them weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``; found tf times in a
    document of n terms it adds its weight times ``10^9 tf div (1000 tf + 8m)``, ``m = 25 + (75 n N) div L``, for each time that the item holds it.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(f"`{item_id}`"), F.col(f"`{item_text}`"))
    slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    with scratch(spark) as keep:
        asked = materialize(items.select(F.col(f"`{item_id}`").alias("item_id"), key.alias("item"), F.col(f"`{item_text}`").alias("text")).distinct(), "items")
        names = keep(asked.select("item", "item_id"), "names")
        found = asked.select("item", "text").mapInArrow(_symbols, "item bigint, term bigint, bit int")
        symbols = materialize(found.withColumn("symbol", F.xxhash64("term", "bit")), "terms")
        blocks, ranked = _blocks(symbols, block_symbols), []
        for block in range(blocks):
            mine = symbols if blocks == 1 else symbols.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
            left, nodes = mine_shared(mine.select("item", "symbol"), materialize)
            graph = SharingGraph(mine.select("symbol", "term", "bit").distinct().collect(), nodes.collect() if nodes is not None else [], left.collect())
            vocabulary = spark.sparkContext.broadcast(graph.vocabulary)
            postings = materialize(slim.mapInArrow(_postings(vocabulary), "doc bigint, n bigint, terms array<int>, counts array<int>"), "postings")
            n_docs, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(graph.vocabulary), np.int64)
            counted = postings.select("terms").mapInArrow(_frequencies(len(df)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
            for r in counted.collect():
                df[r.term] = r.df
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            shared = spark.sparkContext.broadcast((graph, weight, int(n_docs), int(length)))
            each = postings.where(F.size("terms") > 0).mapInArrow(_ranked(shared, top), "item bigint, part int, score bigint, doc bigint")
            best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc")))
            some = each.withColumn("rank", best("item", "part")).where(F.col("rank") <= top)
            ranked.append(keep(some.withColumn("rank", best("item")).where(F.col("rank") <= top).select("item", "rank", "doc", "score"), "ranked"))
    out = ranked[0]
    for more in ranked[1:]:
        out = out.union(more)
    return out.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
