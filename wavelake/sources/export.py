"""Exports: wide trace tables, CSV folders and the record of parameters.

A wide table of few regions has a column for each (``wide_traces``).  For any number of them ``wide_rows`` makes a
frame one row with an array of cells, whose plan doesn't grow with the regions, and ``write_wide`` the CSV from it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_traces(traces: DataFrame, roi_ids: Sequence[int], signals: dict[str, str], labels: dict[int, str] | None = None, frame_interval: float | None = None, frame: str = "t") -> DataFrame:
    """One row per frame and one column ``<label>_<suffix>`` per region and signal.

    ``signals`` maps column suffixes (``F``, ``dFF``, ``smoothed``) to trace columns.  The
    regions are given, so the pivot needs no extra pass; labels may repeat in the input
    but not in a table, so later ones get their id appended.
    """
    if not roi_ids:
        raise ValueError("no traces to export")
    names, used = {}, set()
    for k in roi_ids:
        name = (labels or {}).get(k) or f"roi_{k}"
        names[k] = f"{name}_{k}" if name in used else name
        used.add(names[k])
    cells = [F.max(F.when(F.col("roi_id") == k, F.col(c))).alias(f"{names[k]}_{s}") for k in roi_ids for s, c in signals.items()]
    wide = traces.where(F.col("roi_id").isin(list(roi_ids))).groupBy(F.col(frame).alias("frame")).agg(*cells)
    if not frame_interval:
        return wide
    return wide.select("frame", (F.col("frame") * F.lit(frame_interval)).alias("seconds"), *wide.columns[1:])


def wide_columns(traces: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """``(roi_id, place, name)``: the regions in order; a label that an earlier region has gets the id appended."""
    ids = traces.select("roi_id").distinct()
    given = traces.sparkSession.createDataFrame(list((labels or {}).items()) or [(0, None)], f"roi_id {traces.schema['roi_id'].dataType.simpleString()}, label string")
    named = ids.join(given, "roi_id", "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("roi_"), F.col("roi_id").cast("string"))))
    again = F.row_number().over(Window.partitionBy("label").orderBy("roi_id")) > 1
    name = F.when(again, F.concat_ws("_", "label", "roi_id")).otherwise(F.col("label"))
    # ids and names alone, one row a region
    return named.select("roi_id", (F.row_number().over(Window.orderBy("roi_id")) - 1).alias("place"), name.alias("name"))


def wide_rows(traces: DataFrame, signals: dict[str, str], columns: DataFrame, frame: str = "t") -> DataFrame:
    """``(frame, cells)``: an ``array<double>`` in the order of ``columns``, a region's signals side by side; null where there is no value."""
    n = columns.count() * len(signals)
    cells = F.array(*[F.struct((F.col("place") * len(signals) + k).alias("at"), F.col(c).cast("double").alias("v")) for k, c in enumerate(signals.values())])
    each = traces.join(columns.select("roi_id", "place"), "roi_id").select(F.col(frame).alias("frame"), F.explode(cells).alias("cell"))
    held = each.groupBy("frame").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    # a cell brings the empty ones since the one before it along
    nothing = lambda k: F.array_repeat(F.lit(None).cast("double"), k.cast("int"))
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["at"]).otherwise(-1)
    full = F.flatten(F.transform("cells", lambda c, i: F.concat(nothing(c["at"] - before(i) - 1), F.array(c["v"]))))
    return held.select("frame", F.concat(full, nothing(F.lit(n - 1) - F.element_at("cells", -1)["at"])).alias("cells"))


def write_wide(traces: DataFrame, path: str, signals: dict[str, str], labels: dict[int, str] | None = None, frame_interval: float | None = None, frame: str = "t") -> None:
    """A CSV folder ordered by frame, with the header of ``wide_traces`` in every file, for any number of regions.

    Only the names of the columns pass the driver; a cell without a value is empty.
    """
    columns = wide_columns(traces, labels)
    names = [f"{r.name}_{suffix}" for r in columns.orderBy("place").select("name").collect() for suffix in signals]
    if not names:
        raise ValueError("no traces to export")
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s
    header = ",".join(["frame", *(["seconds"] if frame_interval else []), *map(quoted, names)])
    cells = F.array_join(F.transform("cells", lambda v: F.coalesce(v.cast("string"), F.lit(""))), ",")
    seconds = [(F.col("frame") * F.lit(frame_interval)).cast("string")] if frame_interval else []
    lines = wide_rows(traces, signals, columns, frame).orderBy("frame").select(F.concat_ws(",", F.col("frame").cast("string"), *seconds, cells).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = batch.column(0)
            if first and len(lines):
                lines, first = pa.concat_arrays([pa.array([header], lines.type), lines]), False
            yield pa.RecordBatch.from_arrays([lines], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def write_csv(wide: DataFrame, path: str) -> None:
    """A CSV folder ordered by frame."""
    wide.orderBy("frame").write.mode("overwrite").option("header", True).csv(path)


def write_record(record: dict[str, Any], path: str, spark) -> None:
    """The parameters of an analysis as one JSON text, written through Spark to any file system."""
    text = json.dumps(record, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
