"""Normalising and smoothing of traces.

A trace is the rows of one key (``by``), numbered ``t = 0, 1, ...`` without gaps.  Baselines
shuffle once, on the trace's key.  Slopes, smoothing and moving means cut traces into blocks of time that carry the
samples they need of their neighbours, so one long trace spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Frames of the default baseline.
DEFAULT_FRAMES = 10
#: Samples of a block of time.
TOGETHER = 8192


def float_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with the IEEE results for a zero denominator."""
    special = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, special).otherwise(a / F.when(b != 0, b))


def window_of(region: tuple[int, int], what: str = "region") -> tuple[int, int]:
    """A half-open window of frames, counted from 0."""
    start, end = int(region[0]), int(region[1])
    if start < 0 or end < 0:
        raise ValueError(f"{what} must not be negative: {region}")
    return start, end


def delta_f(traces: DataFrame, n: int | None = None, region: tuple[int, int] | None = None, by: Sequence[str] = ("roi_id",), value: str = "raw") -> DataFrame:
    """Adds ``dff = (F - F0) / F0``; F0 is the mean of the first ``n`` frames or of a region.

    Without either, the first 10 frames or all of a shorter trace.  A zero F0 gives
    inf or NaN, an empty region null.
    """
    if n is not None and region is not None:
        raise ValueError("give n or region, not both")
    if n is not None and n < 1:
        raise ValueError(f"n must be at least 1: {n}")
    start, end = window_of(region) if region is not None else (0, n if n is not None else DEFAULT_FRAMES)
    inside = (F.col("t") >= start) & (F.col("t") < end)
    f0 = F.avg(F.when(inside, F.col(value).cast("double"))).over(Window.partitionBy(*by))
    return traces.withColumn("f0", f0).withColumn("dff", float_ratio(F.col(value) - F.col("f0"), F.col("f0")))


def delta_first_frame(traces: DataFrame, by: Sequence[str] = ("roi_id",), value: str = "raw") -> DataFrame:
    """Adds the display form of dff, against the first frame; 0 where that is 0."""
    f0 = F.min(F.when(F.col("t") == 0, F.col(value))).over(Window.partitionBy(*by))
    return traces.withColumn("f0", f0).withColumn("dff", F.when(F.col("f0") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("f0")) / F.when(F.col("f0") != 0, F.col("f0"))))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight), cut at four sigma."""
    if sigma < 0:
        raise ValueError(f"sigma must not be negative: {sigma}")
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) if sigma else 1.0 for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(raw)) for k, w in enumerate(raw)]


def smooth_gaussian(traces: DataFrame, sigma: float, by: Sequence[str] = ("roi_id",), value: str = "dff", together: int = TOGETHER) -> DataFrame:
    """``(by..., t, value, smoothed)``: Gaussian smoothing with the trace mirrored at its ends.

    A band join in blocks: every sample goes to the blocks whose samples it reaches, at its own place and at its mirror images.
    """
    kernel = gaussian_kernel(sigma)
    reach = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel])
    rows = traces.select(*by, F.col("t").cast("bigint").alias("t"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*by).agg((F.max("t") + 1).alias("n"))
    rows = rows.join(sizes, list(by)) if by else rows.join(sizes, F.lit(True))
    n, t = F.col("n"), F.col("t")
    # the mirrored trace repeats every 2n samples
    periods = F.sequence(-F.ceil((n + reach) / (2 * n)), F.ceil((n + reach) / (2 * n)))
    places = F.flatten(F.transform(periods, lambda p: F.array(t + p * 2 * n, 2 * n - 1 - t + p * 2 * n)))
    places = F.when((t >= reach) & (t < n - reach), F.array(t)).otherwise(F.filter(places, lambda q: (q >= -reach) & (q < n + reach)))
    block = lambda q: F.greatest(F.lit(0), F.least(F.floor(q / together), F.floor((n - 1) / together)))
    placed = rows.select(*by, "n", "v", F.explode(places).alias("q"))
    placed = placed.select(*by, "n", "v", "q", F.explode(F.sequence(block(F.col("q") - reach), block(F.col("q") + reach))).alias("block"))
    whole = placed.groupBy(*by, "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("q", "v"))).alias("s"))
    # the values as an array of their own: taking them from the structs at every tap would copy the block
    start = F.col("block") * together
    own = F.sequence(start, F.least(start + together, n) - 1)
    whole = whole.select(*by, own.alias("own"), (start - reach).alias("from"), F.transform("s", lambda e: e["v"]).alias("v"))
    at = lambda q: F.get("v", (q - F.col("from")).cast("int"))
    blurred = F.transform("own", lambda q: F.struct(q.cast(traces.schema["t"].dataType).alias("t"), at(q).alias(value), F.aggregate(taps, F.lit(0.0), lambda acc, tap: acc + tap["w"] * at(q + tap["k"])).alias("smoothed")))
    return whole.select(*by, F.inline(blurred))


def _blocks(frames: DataFrame, n: int, by: Sequence[str], together: int) -> tuple[DataFrame, WindowSpec, int]:
    """Rows copied to every block of time that has a window with them, the window of ``n`` frames around each, and its frames before it."""
    before, after = -(-n // 2) - 1, n // 2
    block = lambda t: F.floor(t / together)
    copies = frames.select("*", F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("t") - after)), block(F.col("t") + before))).alias("_block"))
    return copies, Window.partitionBy(*by, "_block").orderBy("t").rowsBetween(-before, after), before


def _own(copies: DataFrame, together: int) -> DataFrame:
    return copies.where(F.col("_block") == F.floor(F.col("t") / together)).drop("_block")


def gradient(traces: DataFrame, by: Sequence[str] = ("roi_id",), value: str = "raw", together: int = TOGETHER) -> DataFrame:
    """Adds ``slope``: central differences, one-sided at the ends; null for a single frame."""
    copies, _, _ = _blocks(traces, 3, by, together)
    order = Window.partitionBy(*by, "_block").orderBy("t")
    v, before, after = F.col(value), F.lag(value).over(order), F.lead(value).over(order)
    slope = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    return _own(copies.withColumn("slope", slope), together)


def running_mean(frames: DataFrame, n: int, by: Sequence[str], value: str = "v", together: int = TOGETHER) -> DataFrame:
    """Adds ``mean``: a moving mean of ``n`` frames, the ends repeated; always over n."""
    copies, order, before = _blocks(frames, n, by, together)
    missing_before = F.greatest(F.lit(0), F.lit(before) - F.col("t"))
    missing_after = F.lit(n) - F.count(F.lit(1)).over(order) - missing_before
    total = F.sum(value).over(order) + missing_before * F.first(value).over(order) + missing_after * F.last(value).over(order)
    return _own(copies.withColumn("mean", total / n), together)


def running_all(frames: DataFrame, n: int, by: Sequence[str], value: str = "inside", together: int = TOGETHER) -> DataFrame:
    """Adds ``all_inside``: whether a pixel is inside in every frame of ``running_mean``'s window; the ends repeat."""
    copies, order, _ = _blocks(frames, n, by, together)
    return _own(copies.withColumn("all_inside", F.bool_and(value).over(order)), together)


def label_of(label: Column, roi_id: Column) -> Column:
    """The given label, or ``roi_<id>``."""
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("roi_"), roi_id.cast("string")))


def crop(traces: DataFrame, start: int, end: int) -> DataFrame:
    """Frames of a window renumbered from 0; ``frame`` keeps the recording's number."""
    start, end = window_of((start, end), "crop")
    if end <= start:
        raise ValueError(f"empty crop [{start}, {end})")
    return traces.where((F.col("t") >= start) & (F.col("t") < end)).withColumn("frame", F.col("t")).withColumn("t", F.col("t") - start)


def with_seconds(traces: DataFrame, frame_interval: float | None) -> DataFrame:
    """Adds ``seconds``; null without a calibration."""
    return traces.withColumn("seconds", F.col("t") * F.lit(frame_interval).cast("double") if frame_interval else F.lit(None).cast("double"))


def choose_signal(columns: Sequence[str], signal: str) -> str:
    """The column an analysis reads: the one asked for, or ``raw`` where it is missing."""
    return signal if signal in ("smoothed", "dff") and signal in columns else "raw"
