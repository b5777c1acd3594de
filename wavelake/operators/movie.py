"""Selection, down-sampling and projections of movies ``(by..., t, y, x, v)``.

The order of import steps is fixed: channel, time crop, time average, window, stride.
Filters are plain predicates on ``t``, ``y`` and ``x``, so they reach a Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.operators.traces import window_of


def select_channel(pixels: DataFrame, channel: int = 0) -> DataFrame:
    return pixels.where(F.col("c") == channel).drop("c")


def crop_time(movie: DataFrame, start: int = 0, end: int | None = None, n_frames: int | None = None) -> DataFrame:
    """Frames ``[start, end)``, renumbered from 0; an end beyond the movie is clamped.

    Negative bounds count from the end of the ``n_frames`` frames, which must then be known.
    """
    if n_frames is not None:
        start, end, _ = slice(start, end).indices(n_frames)
    start, end = window_of((start, end if end is not None else 2**31 - 1), "time crop")
    return movie.where((F.col("t") >= start) & (F.col("t") < end)).withColumn("t", F.col("t") - start)


def average_time(movie: DataFrame, step: int, n_frames: int, integer: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Means of blocks of ``step`` frames; a last partial block is dropped.

    ``integer``: the recording holds integers, so means are cut towards zero.
    """
    if step <= 1:
        return movie
    mean = F.avg("v")
    if integer:
        mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("double")
    whole = movie.where(F.col("t") < n_frames // step * step)
    return whole.groupBy(*by, F.floor(F.col("t") / step).cast("int").alias("t"), "y", "x").agg(mean.alias("v"))


def crop_space(movie: DataFrame, window: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of ``(y0, y1, x0, x1)``, renumbered from 0."""
    y0, y1, x0, x1 = window
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return movie.where(inside).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def stride_space(movie: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel in both directions, from the corner."""
    if step <= 1:
        return movie
    kept = movie.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return kept.withColumn("y", F.floor(F.col("y") / step).cast("int")).withColumn("x", F.floor(F.col("x") / step).cast("int"))


def import_movie(movie: DataFrame, n_frames: int, start: int = 0, end: int | None = None, temporal_step: int = 1, spatial_step: int = 1, spatial_window: tuple[int, int, int, int] | None = None, channel: int | None = None, integer: bool = False) -> DataFrame:
    """All import steps in their fixed order."""
    if channel is not None:
        movie = select_channel(movie, channel)
    start, last, _ = slice(start, end).indices(n_frames)
    movie = average_time(crop_time(movie, start, max(start, last)), temporal_step, max(0, last - start), integer)
    if spatial_window is not None:
        movie = crop_space(movie, spatial_window)
    return stride_space(movie, spatial_step)


def max_projection(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The largest relative rise of each pixel over its first frame."""
    first = F.min_by("v", "t")
    return movie.groupBy(*by, "y", "x").agg(((F.max("v") - first) / (first + F.lit(1e-12))).alias("rise"))


def intensity_levels(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Display levels of the first frame: minimum and 99th percentile, at least 1 apart where they coincide."""
    first = movie.where(F.col("t") == 0).groupBy(*by).agg(F.min("v").alias("lo"), F.percentile("v", F.lit(0.99)).alias("p99"))
    return first.select(*by, "lo", F.when(F.col("p99") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("p99")).alias("hi"))


def mean_frame(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean over time of each pixel."""
    return movie.groupBy(*by, "y", "x").agg(F.avg("v").alias("v"))


def rescaled(native: Column, step: int) -> Column:
    """A calibration after down-sampling; null stays null."""
    return native * F.lit(step)


def to_frames(movie: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per frame: ``(by..., t, height, width, px)``, pixels in row-major order."""
    cell = F.struct((F.col("y") * width + F.col("x")).alias("at"), F.col("v").cast("double").alias("v"))
    whole = movie.groupBy(*by, "t").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return whole.select(*by, "t", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("cells.v").alias("px"))


def to_pixels(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The inverse of ``to_frames``."""
    flat = frames.select(*by, "t", "width", F.posexplode("px").alias("at", "v"))
    return flat.select(*by, "t", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"), "v")


def frame_counts(movie: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the number of frames of each recording."""
    return movie.withColumn("n_frames", F.max("t").over(Window.partitionBy(*by)) + 1)
