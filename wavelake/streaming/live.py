"""Region traces of a running recording with Structured Streaming.

An addition to the batch operators: pixels arrive as ``(recording, t, y, x, v, at)``, where ``at`` is the
event time of the frame, the same for all its pixels; masks are a static table, and means per region and frame come out once
the watermark has passed a frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_traces(pixels: DataFrame, mask: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """``(recording, roi_id, t, at, raw)``; pixels later than ``lateness`` are dropped."""
    inside = pixels.withWatermark("at", lateness).join(mask, ["y", "x"])
    return inside.groupBy("recording", "roi_id", "t", "at").agg(F.avg("v").alias("raw"))


def live_dff(traces: DataFrame, n: int = 10) -> DataFrame:
    """dF/F against the mean of each trace's first ``n`` frames, as soon as these are in; a zero mean gives inf or null.

    The state of a trace is the sum and count of its baseline and the frames that wait for it,
    ``n`` at most.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, count, waiting = state.get if state.exists else (0.0, 0, [])
        waiting = list(waiting)
        for batch in batches:
            rows = batch.sort_values("t")
            base = rows[rows["t"] < n]
            total, count = total + float(base["raw"].sum()), count + len(base)
            waiting += list(zip(rows["t"].tolist(), rows["raw"].tolist(), strict=True))
        if count >= n and waiting:
            f0 = np.float64(total / count)
            with np.errstate(divide="ignore", invalid="ignore"):
                dff = (np.array([v for _, v in waiting]) - f0) / f0
            yield pd.DataFrame({"recording": key[0], "roi_id": key[1], "t": [t for t, _ in waiting], "dff": dff})
            waiting = []
        state.update((total, count, [(int(t), float(v)) for t, v in waiting]))

    return traces.groupBy("recording", "roi_id").applyInPandasWithState(
        run, "recording string, roi_id long, t long, dff double", "total double, count long, waiting array<struct<t:long,v:double>>", "append", GroupStateTimeout.NoTimeout
    )
