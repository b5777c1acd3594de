"""Tables between jobs (``wavelake.sources.written``), column names and Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from wavelake.sources.written import materialize, scratch, shared_dir

__all__ = ["arrow_rows", "fresh", "materialize", "scratch", "shared_dir"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, as Spark compares names (without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside pass at most ``rows`` rows to Python at once; texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
