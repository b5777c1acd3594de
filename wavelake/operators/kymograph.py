"""Kymographs: the intensity along a path over time.

The path is a handful of points and is sampled on the driver.  Every sample becomes a
few (pixel, weight) rows; the movie meets them in an equi-join on the pixel, and the
weighted values are summed per position and frame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelake.operators.traces import window_of


def resample_path(points: Sequence[tuple[float, float]], step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions every ``step`` along a polyline, both ends included, and their arc lengths."""
    p = np.asarray(points, float)
    if p.ndim != 2 or p.shape[1] != 2 or len(p) < 2:
        raise ValueError("a path needs at least two (y, x) points")
    if step <= 0:
        raise ValueError(f"step must be positive: {step}")
    p = p[np.insert(np.any(p[1:] != p[:-1], axis=1), 0, True)]
    arc = np.insert(np.cumsum(np.hypot(*(p[1:] - p[:-1]).T)), 0, 0.0)
    if arc[-1] < 1e-9:
        raise ValueError("the path has no length")
    at = step * np.arange(int(np.ceil(arc[-1] / step)) + 1)
    at = np.append(at[at < arc[-1] - 1e-9], arc[-1])
    return np.stack([np.interp(at, arc, p[:, c]) for c in (0, 1)], axis=1), at


def path_weights(points: Sequence[tuple[float, float]], height: int, width: int, across: int = 1, step: float = 1.0) -> list[tuple[int, float, int, int, float]]:
    """``(pos, distance, y, x, weight)``: bilinear weights, averaged over ``across`` samples along the normal.

    Samples outside the frame read the nearest border pixel.
    """
    at, arc = resample_path(points, step)
    slope = np.gradient(at, axis=0)
    length = np.hypot(slope[:, 0], slope[:, 1])
    slope = slope / np.where(length == 0, 1.0, length)[:, None]
    n = max(1, int(across))
    rows: dict[tuple[int, int, int], float] = {}
    for k in range(n):
        off = k - (n - 1) / 2.0
        ys = np.clip(at[:, 0] + off * slope[:, 1], 0, height - 1)
        xs = np.clip(at[:, 1] - off * slope[:, 0], 0, width - 1)
        for pos, (y, x) in enumerate(zip(ys, xs, strict=True)):
            y0, x0 = int(y), int(x)
            for yy, wy in ((y0, 1 - (y - y0)), (min(y0 + 1, height - 1), y - y0)):
                for xx, wx in ((x0, 1 - (x - x0)), (min(x0 + 1, width - 1), x - x0)):
                    rows[pos, yy, xx] = rows.get((pos, yy, xx), 0.0) + float(wy * wx) / n
    return [(pos, float(arc[pos]), y, x, w) for (pos, y, x), w in sorted(rows.items()) if w]


def weights_table(spark: SparkSession, rows: list[tuple[int, float, int, int, float]]) -> DataFrame:
    """The weights as a small table."""
    return spark.createDataFrame(rows, "pos int, distance double, y int, x int, w double")


def kymograph(movie: DataFrame, points: Sequence[tuple[float, float]], height: int, width: int, across: int = 1, step: float = 1.0, baseline: tuple[int, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., pos, distance, t, value)``.

    ``baseline``: values relative to each position's mean over these frames; 0 where that mean is 0.
    """
    weights = weights_table(movie.sparkSession, path_weights(points, height, width, across, step))
    joined = movie.join(weights, ["y", "x"])
    rows = joined.groupBy(*by, "pos", "distance", "t").agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    if baseline is None:
        return rows
    start, end = window_of(baseline, "baseline")
    if end <= start:
        raise ValueError(f"baseline {baseline} selects no frames")
    f0 = F.avg(F.when((F.col("t") >= start) & (F.col("t") < end), F.col("value"))).over(Window.partitionBy(*by, "pos"))
    rows = rows.withColumn("f0", f0)
    change = F.when(F.col("f0") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("f0")) / F.when(F.col("f0") != 0, F.col("f0")))
    return rows.select(*by, "pos", "distance", "t", change.alias("value"))


def display_extent(rows: DataFrame, crop_start: int = 0, pixel_size: float | None = None, frame_interval: float | None = None) -> DataFrame:
    """Distances and times in the units a plot shows."""
    return rows.select("*", ((F.col("t") + crop_start) * F.lit(frame_interval or 1.0)).alias("shown_time"), (F.col("distance") * F.lit(pixel_size or 1.0)).alias("shown_distance"))
