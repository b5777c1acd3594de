"""Phrase collocations by rolling fingerprints.

Texts are cut into pieces at sentence marks and line ends, pieces into words.  Prefix sums of a polynomial
(numpy, for a run of texts at once) give the fingerprint of any n-gram by one subtraction; the language is part of it.

1. **Counts.**  Three scans count the fingerprints of single words, of pairs, and of three to five words.
   Each task sums its own; the shuffle gets rows of a fingerprint, its count and one number that holds a pointer to a
   row with an occurrence and a second, independent fingerprint (32 bits each).  A phrase is as frequent
   as its parts at most, so a scan counts only n-grams whose words (or pairs of words) the scan before found often
   enough, by a Bloom filter of bounded size; beyond its load more n-grams are counted, with the same results.
2. **Texts.**  Pointers of what is frequent meet the rows they name, of which a Bloom filter lets few through; there the phrase
   is found by its fingerprints and cut from the text.
3. **Collisions.**  A fingerprint whose second one differs among its occurrences stands for several phrases; these are
   counted by their text in another scan, which is left out if there is none.
4. **Scores.**  Cuts, parts and containing phrases are joins over the table of frequent phrases, in exact decimals.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count each time; very
long texts and words are handled whole; ties follow the order stated at ``collocations``; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.llm import arrowtext, twice
from wavelake.llm.storage import materialize, scratch

LONGEST = 5
#: Distinct fingerprints that a task holds before it passes them on.
HELD = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_CUT = _SEPARATOR.copy()
_CUT[[0x20, 0x09]] = True
_LOW = np.uint64(0xFFFFFFFF)
#: The phrase without words: its count is the number of words of a language.
_NONE = np.uint64(0x5851F42D4C957F2D)


class _Grams:
    """The n-grams of a run of texts."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        self.words = arrowtext.Words(batch.column("text"), lower=True, cuts=_CUT)
        self.mask = np.uint64((1 << bits) - 1)
        langs = batch.column("lang").dictionary_encode()
        named = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()]
        self.lang = np.array(named, np.uint64)[langs.indices.to_numpy()] if named else np.zeros(0, np.uint64)
        self.doc = self.words.doc
        marks = np.cumsum(_SEPARATOR[self.words.raw])
        # pieces of one run have ascending numbers, and those of different texts differ
        self.piece = (marks[self.words.starts] if len(marks) else np.zeros(0, np.int64)) + self.doc
        self._checks: np.ndarray | None = None

    def starts(self, n: int) -> np.ndarray:
        """Words at which n-grams inside a piece start."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with words: their numbers, the fingerprint of the phrase without words, and how many words."""
        n = np.diff(self.words.offs)
        full = np.flatnonzero(n)
        return full, arrowtext.mix(self.lang[full] ^ _NONE) & self.mask, n[full].astype(np.int64)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return arrowtext.mix(arrowtext.range_hash(self.words.hashes, at, at + n) ^ self.lang[self.doc[at]]) & self.mask

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        if self._checks is None:
            self._checks = self.words.checks
        return arrowtext.mix(arrowtext.range_hash(self._checks, at, at + n, seed=1) + self.lang[self.doc[at]])

    def text(self, at: int, n: int) -> str:
        words = self.words
        return " ".join(words.data[words.starts[k] : words.ends[k]].tobytes().decode() for k in range(at, at + n))

    def hits(self, at: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
        """Which starts of n-grams pass a filter, as marks of all words (and some more)."""
        known = np.zeros(len(self.piece) + LONGEST, bool)
        known[at] = twice.contains(frequent, self.fingerprints(at, n))
        return known

    def longer(self, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts) of the n-grams of three words and more all of whose pairs of neighbours are marked."""
        run = pairs[: len(self.piece)]
        for n in range(3, LONGEST + 1):
            run = run & pairs[n - 2 : n - 2 + len(run)]
            yield n, np.flatnonzero(run)

    def candidates(self, level: int, frequent: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts) of the n-grams to count; ``frequent`` is the filter of the level before."""
        if level == 1:
            yield 1, self.starts(1)
        elif level == 2:
            known, at = self.hits(self.starts(1), 1, frequent), self.starts(2)
            yield 2, at[known[at] & known[at + 1]]
        else:
            yield from self.longer(self.hits(self.starts(2), 2, frequent))


def _groups(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by fingerprint, and where each one starts in it."""
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    return order, np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Fingerprints, counts, and pointers with the second fingerprint; a fingerprint with two of these gets two rows."""
    fp, n, about = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, at = _groups(fp)
    if not len(at):
        return fp, n, about
    fp, n, about = fp[order], n[order], about[order]
    check = about & _LOW
    lo, hi = np.minimum.reduceat(check, at), np.maximum.reduceat(check, at)
    row = about[at] & ~_LOW
    two = np.flatnonzero(lo != hi)
    return np.concatenate([fp[at], fp[at][two]]), np.concatenate([np.add.reduceat(n, at), np.zeros(len(two), np.int64)]), np.concatenate([row | lo, (row | hi)[two]])


def _merged(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """A task's parts as one row for each fingerprint, or a few where they are more than it may hold."""

    def rows(columns):
        for k in range(0, len(columns[0]), 1 << 16):
            some = [x[k : k + (1 << 16)] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in some], ["fp", "n", "about"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > HELD:
            held = [_added(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield from rows(held[0])
                held, size = [], 0
    if held:
        yield from rows(_added(held))


def _counted(level: int, frequent, bits: int):
    def parts(batches):
        known = np.frombuffer(frequent.value, np.uint8) if frequent is not None else None
        for batch in batches:
            for part in arrowtext.slices(batch):
                grams = _Grams(part, bits)
                row = part.column("row").to_numpy().view(np.uint64) << np.uint64(32)
                if level == 1:
                    full, fp, n = grams.totals()
                    yield _added([(fp, n, row[full] | (grams.lang[full] & _LOW))])
                for n, at in grams.candidates(level, known):
                    yield _added([(grams.fingerprints(at, n), np.ones(len(at), np.int64), row[grams.doc[at]] | (grams.checks(at, n) & _LOW))])

    return lambda batches: _merged(parts(batches))


def _cut_out(bits: int):
    """The phrases of a text that have one of the fingerprints asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                grams = _Grams(one, bits)
                fp, n, check = (x.to_numpy() for x in one.column("wanted").flatten().flatten())
                # both fingerprints as one number
                keys = arrowtext.mix(fp.view(np.uint64)) + check.view(np.uint64)
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                out = []

                def asked(fp, check, keys=keys):
                    own = arrowtext.mix(fp) + (check & _LOW)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    return at, keys[at] == own

                full, fp, _ = grams.totals()
                at, hit = asked(fp, grams.lang[full])
                out += [(0, "", n[k]) for k in at[hit]]
                for size in range(1, LONGEST + 1):
                    starts = grams.starts(size)
                    at, hit = asked(grams.fingerprints(starts, size), grams.checks(starts, size))
                    for k, first in zip(*np.unique(at[hit], return_index=True), strict=True):
                        out.append((size, grams.text(int(starts[hit][first]), size), n[k]))
                if out:
                    size, phrase, count = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one.column("lang")[0].as_py()] * len(out), pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(np.array(count, np.int64))], ["lang", "k", "phrase", "n"])

    return run


def _recounted(clashes, bits: int):
    """The n-grams of some fingerprints by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(clashes.value, np.uint8)
        for batch in batches:
            for part in arrowtext.slices(batch):
                grams, lang = _Grams(part, bits), part.column("lang").to_pylist()
                found: dict[tuple, int] = {}
                for d in np.flatnonzero(np.diff(grams.words.offs)):
                    found[lang[d], 0, ""] = found.get((lang[d], 0, ""), 0) + int(grams.words.counts[d])
                for n in range(1, LONGEST + 1):
                    at = grams.starts(n)
                    for k in at[twice.contains(wanted, grams.fingerprints(at, n))]:
                        key = (lang[grams.doc[k]], n, grams.text(int(k), n))
                        found[key] = found.get(key, 0) + 1
                if found:
                    lang_of, size, phrase = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(lang_of, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "k", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", bits: int = 64) -> DataFrame:
    """``lang, k, phrase, n``: all phrases of ``k`` = 1 to 5 words that occur ``least`` times or more in a language.

    Also one row of ``k`` = 0 for each language of as many words: their number.  ``bits`` is the width of fingerprints.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(t.alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.xxhash64(F.col(f"`{doc_id}`"), t, F.coalesce(F.col(f"`{lang}`"), F.lit("und"))).bitwiseAND(F.lit((1 << 32) - 1)).alias("row"))
    with scratch(docs.sparkSession) as keep:
        filt, found = None, None
        for level in (1, 2, 3):
            rows = slim.mapInArrow(_counted(level, filt, bits), "fp bigint, n bigint, about bigint")
            # tasks have added up their own, so rows are dealt out as they are
            check = F.col("about").bitwiseAND(F.lit((1 << 32) - 1))
            total = rows.repartition("fp").groupBy("fp").agg(F.sum("n").alias("n"), F.min(check).alias("lo"), F.max(check).alias("hi"), F.first("about").alias("about"))
            total = total.where(F.col("n") >= least).select("fp", "n", F.shiftrightunsigned("about", 32).alias("row"), F.col("lo").alias("check"), (F.col("lo") != F.col("hi")).alias("clash"))
            total = materialize(total, f"frequent_{level}")
            found = total if found is None else found.union(total)
            if level < 3:
                filt = _filter(total.select("fp"))
        phrases = _texts(slim, found.where(~F.col("clash")), bits)
        if not found.where("clash").isEmpty():
            clashes = _filter(found.where("clash").select("fp"))
            again = slim.mapInArrow(_recounted(clashes, bits), "lang string, k int, phrase string, n bigint")
            again = again.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            # a phrase that passes the filter by chance was found above, with the same count
            phrases = phrases.union(again)
        return keep(phrases.groupBy("lang", "k", "phrase").agg(F.max("n").alias("n")), "phrases")


def _filter(hashes: DataFrame):
    """A Bloom filter of a column, sent to the tasks."""
    filt = twice.member_filter_of(hashes, lambda batch: iter([batch.column(0).to_numpy()]), twice.bits_for(hashes.count()))
    return hashes.sparkSession.sparkContext.broadcast(filt.tobytes())


def _texts(slim: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """The phrases that the pointers of fingerprints name."""
    wanted = materialize(found.groupBy(F.col("row").alias("at")).agg(F.collect_list(F.struct("fp", "n", "check")).alias("wanted")), "pointers")
    filt = twice.member_filter_of(wanted.select("at"), lambda batch: iter([batch.column(0).to_numpy()]), twice.bits_for(wanted.count()))
    named = slim.where(twice.suspects(slim.sparkSession, filt)("row")).join(wanted, F.col("row") == F.col("at"))
    return named.select("text", "lang", "wanted").mapInArrow(_cut_out(bits), "lang string, k int, phrase string, n bigint")


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, then ``a``, both falling, then phrase.

    A phrase of 2 to 5 words occurs ``a`` times; of its cuts into two parts that occur ``l`` and ``r`` times the one with the lowest
    score ``1000 a n div (l r)`` counts, the first of equal ones.  Phrases inside a longer one that is as frequent are left out.
    """
    with scratch(docs.sparkSession) as keep:
        phrases = frequent_phrases(docs, least, text, doc_id, lang, bits)
        words = phrases.where("k = 0").select("lang", F.col("n").alias("total"))
        found = phrases.where("k >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
        part = lambda name: phrases.where("k >= 1").select("lang", F.col("phrase").alias(name), F.col("n").alias(name[0]))
        joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
        cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
        cuts = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).join(words, "lang")
        for c in ("a", "l", "r", "total"):
            cuts = cuts.withColumn(f"d_{c}", _decimal(c))
        cuts = cuts.withColumn("score", F.expr("(1000 * d_a * d_total) div (d_l * d_r)"))
        scored = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", F.col("total").alias("n"), "score"), F.struct("score", "k")).alias("c")).select("lang", "phrase", "c.*")
        size = F.size("w")
        inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
        inside = found.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
        best = scored.join(inside, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("a")))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        return keep(best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
