"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.decontam import decontaminate
from wavelake.llm.linededup import dedup_lines
from wavelake.llm.minhash import near_duplicates
from wavelake.llm.mixing import mix
from wavelake.llm.storage import fresh, materialize, scratch
from wavelake.llm.toxicity import scorer, train

#: Documents with at least this score are rejected.
TOXIC = 0.7


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts have the score of the classifier's intercept; repeated rows go or stay together;
    an empty table gives an empty result; columns keep their names and values.
    """
    score = scorer(spark, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.coalesce("text", F.lit(""))) < TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all but one document; ``n_chars`` follows the new text.

    Null texts stay null, texts without common lines as they are; rows without doc_id count as one document;
    an empty table gives an empty result; columns keep their names.
    """
    out = dedup_lines(docs)
    length = F.when(F.col(f"`{out.columns[-1]}`.n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8) stays, that of the smallest doc_id.

    Texts without words and rows without doc_id stay; rows that share a doc_id go or stay together;
    an empty table gives an empty result; columns keep their names and values.
    """
    name = fresh(docs, "gone")
    with scratch(spark) as keep:
        gone = near_duplicates(docs, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
        gone = keep(gone, "near_duplicates")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts stay, and so do all rows if the benchmark is empty; repeated rows go or stay together;
    columns keep their names and values.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the columns of ``docs``, ``mix_size``, ``mix_target`` and ``mix_copy``.

    Rows equal in all columns are one entry and share its copies.  Where ``docs`` has one of the new names (as after an
    earlier run) the new column gets an underscore more.  Null texts and sources, empty tables: as for ``mix``.
    """
    name = fresh(docs, "mix_id")
    new = [fresh(docs, c) for c in ("mix_size", "mix_target", "mix_copy")]
    keyed = docs.select("*", F.xxhash64(*_columns(docs)).alias(name))
    with scratch(spark) as keep:
        taken = mix(keyed, doc_id=name, by_entry=True).where(F.col("total") > 0)
        taken = keep(taken.select(F.col("doc_id").alias("key"), "n", "size", "target", "total"), "mix")
    rows = keyed.select(F.struct(*_columns(docs)).alias("doc"), F.col(name).alias("key"))
    single = rows.join(taken.where(F.col("n") == 1), "key").select("doc", "size", "target", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total"))).alias("copy"))
    # of rows that occur more than once, one stands for all; their copies are dealt out in runs of bounded length
    many = taken.where(F.col("n") > 1)
    one = rows.join(many.select("key"), "key", "left_semi").groupBy("key").agg(F.first("doc").alias("doc"))
    runs = many.select("key", "size", "target", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / 1000))).alias("run"))
    runs = runs.repartition("key", "run").join(one, "key")
    copies = F.sequence(F.col("run") * 1000 + 1, F.least(F.col("run") * 1000 + 1000, F.col("total")))
    out = single.union(runs.select("doc", "size", "target", F.explode(copies).alias("copy")))
    added = [F.col(c).alias(n) for c, n in zip(("size", "target", "copy"), new, strict=True)]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], *added)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Toxicity scores and tilted rates have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for k, (name, stage) in enumerate(STAGES[:-1], 2):
            # only the table that the last stage reads outlives the others
            write = keep if k == len(STAGES) else materialize
            docs = write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
