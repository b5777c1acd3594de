"""Traces and movies from event and order tables.

Schemas: traces ``(roi_id, t, raw)``, movies ``(t, y, x, v)``, both with further
key columns (such as a recording id) where a caller has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake.functions import align

#: The movie's grid: months from January 1995, order lines, supplier residues.
MOVIE_SHAPE = (83, 7, 16)


def traces_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per user: the values in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # named before the window, so that later windows of a trace reuse its partitioning
    events = events.select(F.col("user_id").alias("roi_id"), "ts", "event_id", F.col("value").alias("raw"))
    order = Window.partitionBy("roi_id").orderBy("ts", "event_id")
    return events.select("roi_id", (F.row_number().over(order) - 1).alias("t"), "raw")


def rois_of_traces(traces: DataFrame) -> DataFrame:
    """A centre for every trace, on a grid of 15 columns."""
    ids = traces.select("roi_id").distinct()
    return ids.select("roi_id", F.floor(F.col("roi_id") / 15).cast("double").alias("cy"), F.pmod("roi_id", F.lit(15)).cast("double").alias("cx"))


def grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Every ``(t, y, x)`` of a movie shape."""
    t, y, x = shape
    cell = F.col("id")
    return spark.range(t * y * x).select((F.floor(cell / (y * x))).cast("int").alias("t"), F.pmod(F.floor(cell / x), F.lit(y)).cast("int").alias("y"), F.pmod(cell, F.lit(x)).cast("int").alias("x"))


def movie_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities shipped by month, line number and supplier residue; empty cells are 0."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = lines.groupBy(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("t"),
        (F.col("l_linenumber") - 1).cast("int").alias("y"),
        F.pmod("l_suppkey", F.lit(16)).cast("int").alias("x"),
    ).agg(F.sum("l_quantity").alias("s"))
    return grid(spark, MOVIE_SHAPE).join(sums, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("s", F.lit(0.0)).alias("v"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(recording, rows)``: blocks of 64 vectors of 64 numbers."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    row = F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vectors.groupBy(F.floor(F.col("vec_id") / 64).alias("recording")).agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") == 64)


def _smoothed(rows) -> np.ndarray:
    image = np.stack([np.asarray(v, float) for v in rows])
    for _ in range(6):
        image = sum(np.roll(image, d, axis) for axis in (0, 1) for d in (-1, 0, 1)) / 6
    return 100 + 500 * image


def drifting_frames(spark: SparkSession, sf_dir: str, n_frames: int = 3) -> DataFrame:
    """Recordings cut from embedding blocks: ``(recording, t, height, width, px)``.

    Smoothed, an image is seen through a window of 48 x 48 that moves
    against the content, by ``recording % 5 - 2`` columns and ``recording % 3 - 1`` rows a frame.
    """

    @F.pandas_udf("array<array<double>>")
    def views(block: pd.Series, recording: pd.Series) -> pd.Series:
        out = []
        for rows, r in zip(block, recording, strict=True):
            image = _smoothed(rows)
            dy, dx = int(r) % 3 - 1, int(r) % 5 - 2
            cuts = [(8 - dy * t, 8 - dx * t) for t in range(n_frames)]
            out.append([image[y : y + 48, x : x + 48].ravel().tolist() for y, x in cuts])
        return pd.Series(out)

    seen = _images(spark, sf_dir).select("recording", F.posexplode(views("rows.v", "recording")).alias("t", "px"))
    return seen.select("recording", "t", F.lit(48).alias("height"), F.lit(48).alias("width"), "px")


def turning_frames(spark: SparkSession, sf_dir: str, n_frames: int = 3, sheared: bool = False) -> DataFrame:
    """The same window with sub-pixel motion about its centre, interpolated by cubic splines.

    A frame shifts the content by ``t * (recording % 3 - 1) / 2`` rows and ``t * (recording % 5 - 2) / 4`` columns and
    turns it by ``t * (recording % 4 - 1.5)`` degrees; ``sheared``: instead of turning, it maps (x, y) to
    ``((1 + 0.02 t) x + 0.02 t (recording % 3 - 1) y, y)``.
    """

    @F.pandas_udf("array<array<double>>")
    def views(block: pd.Series, recording: pd.Series) -> pd.Series:
        yy, xx = (v.ravel() for v in np.mgrid[0:48, 0:48].astype(float))
        out = []
        for rows, r in zip(block, recording, strict=True):
            coefficients, cuts = align.spline_coefficients(_smoothed(rows)), []
            for t in range(n_frames):
                angle = np.radians(t * (int(r) % 4 - 1.5))
                linear = np.array([[1 + 0.02 * t, 0.02 * t * (int(r) % 3 - 1)], [0, 1]]) if sheared else np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                shift = np.array([[t * (int(r) % 5 - 2) / 4], [t * (int(r) % 3 - 1) / 2]])
                x, y = np.linalg.solve(linear, np.stack([xx, yy]) - 23.5 - shift) + 23.5
                cuts.append(align.sample(coefficients, y + 8, x + 8).tolist())
            out.append(cuts)
        return pd.Series(out)

    seen = _images(spark, sf_dir).select("recording", F.posexplode(views("rows.v", "recording")).alias("t", "px"))
    return seen.select("recording", "t", F.lit(48).alias("height"), F.lit(48).alias("width"), "px")


#: What ``bent_frames`` plants in a frame: pixels by which x and y change at the corners, besides the shift.
BEND_X, BEND_Y = 0.25, -0.5


def bent_frames(spark: SparkSession, sf_dir: str, n_frames: int = 3) -> DataFrame:
    """The same window under bilinear maps about its centre: with X, Y from there, the content of (X, Y) of frame 0 is at
    ``(X + t ((recording % 5 - 2) / 4 + BEND_X X Y / 23.5^2), Y + t ((recording % 3 - 1) / 2 + BEND_Y X Y / 23.5^2))``.
    """

    @F.pandas_udf("array<array<double>>")
    def views(block: pd.Series, recording: pd.Series) -> pd.Series:
        yy, xx = (v.ravel() for v in np.mgrid[0:48, 0:48].astype(float))
        out = []
        for rows, r in zip(block, recording, strict=True):
            coefficients, cuts = align.spline_coefficients(_smoothed(rows)), []
            for t in range(n_frames):
                dx, dy = t * (int(r) % 5 - 2) / 4, t * (int(r) % 3 - 1) / 2
                x, y = xx - 23.5, yy - 23.5
                for _ in range(40):  # where a pixel's content comes from
                    bend = x * y / 23.5**2
                    x, y = xx - 23.5 - dx - t * BEND_X * bend, yy - 23.5 - dy - t * BEND_Y * bend
                cuts.append(align.sample(coefficients, y + 31.5, x + 31.5).tolist())
            out.append(cuts)
        return pd.Series(out)

    seen = _images(spark, sf_dir).select("recording", F.posexplode(views("rows.v", "recording")).alias("t", "px"))
    return seen.select("recording", "t", F.lit(48).alias("height"), F.lit(48).alias("width"), "px")
