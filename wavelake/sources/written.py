"""Tables between jobs.

A lost executor takes its shuffle files and cached blocks along, so results that
several jobs read, and the state of iterations, are written as Parquet under the
shared folder named by ``spark.checkpoint.dir``.  Reading them back also cuts
the lineage.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables written so far in each open ``scratch``, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if Spark runs in one process.

    On a cluster, the driver and the executors have no local folder in common, so there the
    setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="wavelake-")
    return _own["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wavelake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are dropped at the end, except those that ``keep`` writes for the result."""
    kept: list[str] = []

    def keep(df: DataFrame, name: str = "kept") -> DataFrame:
        out = materialize(df, name)
        kept.append(_open[-1].pop())
        return out

    _open.append([])
    try:
        yield keep
    finally:
        gone = _open.pop()
        if _open:
            _open[-1].extend(kept)
        drop(spark, gone)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, in whatever file system they are."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
