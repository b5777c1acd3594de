"""Motion correction over frames ``(by..., t, height, width, px)``.

Frames are independent rows: every estimate is one call of a numpy kernel on one frame
and its reference, so recordings of any length spread over the cluster.  What looks at neighbouring frames
works on blocks of time with the frames that they need of the next ones.  Only the
product along frames of the ``previous`` mode is ordered; it is a scan in blocks over the nine numbers
of each frame's matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wavelake.functions import align
from wavelake.sources.written import materialize

REFERENCES = ("first", "mean", "previous")
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
_DOUBLES = ArrayType(DoubleType())
#: Frames of a block of time, and matrices of a block of the scan.
FRAMES_TOGETHER, STEPS_TOGETHER = 64, 4096


def reference_frames(frames: DataFrame, reference: str = "mean", by: Sequence[str] = (), n_frames: int = 1) -> DataFrame:
    """``(by..., ref)``: the mean over time, or that of the first ``n_frames`` frames."""
    if reference not in REFERENCES:
        raise ValueError(f"unknown reference {reference!r}, expected one of {REFERENCES}")
    if reference != "mean":
        if n_frames == 1:
            return frames.where(F.col("t") == 0).select(*by, F.col("px").alias("ref"))
        frames = frames.where(F.col("t") < n_frames)
    cells = frames.select(*by, F.posexplode("px").alias("at", "v")).groupBy(*by, "at").agg(F.avg("v").alias("v"))
    whole = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))
    return whole.select(*by, F.col("c.v").alias("ref"))


def reference_masks(masks: DataFrame, reference: str = "mean", by: Sequence[str] = (), n_frames: int = 1) -> DataFrame:
    """``(by..., ref_mask)``: what all frames that make the reference let take part."""
    if reference == "first":
        masks = masks.where(F.col("t") < n_frames)
    cells = masks.select(*by, F.posexplode("mask").alias("at", "v")).groupBy(*by, "at").agg(F.bool_and("v").alias("v"))
    whole = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))
    return whole.select(*by, F.col("c.v").alias("ref_mask"))


#: ``register`` knows it, but not by name: its transforms are eight coefficients, no matrices.
_BILINEAR = "eight coefficients"


def _estimator(model: str):
    identity = [0.0, 1, 0, 0, 0, 0, 1, 0] if model == _BILINEAR else IDENTITY
    fit = align.register_bilinear if model == _BILINEAR else lambda ref, px, *masks: align.register(ref, px, model, *masks)

    @F.pandas_udf(_DOUBLES)
    def estimate(px: pd.Series, ref: pd.Series, height: pd.Series, width: pd.Series, mask: pd.Series, ref_mask: pd.Series) -> pd.Series:
        out = []
        for p, r, h, w, m, rm in zip(px, ref, height, width, mask, ref_mask, strict=True):
            if r is None:
                out.append(identity)
                continue
            inside, before = (None if x is None else np.asarray(x, bool).reshape(h, w) for x in (m, rm))
            found = fit(np.asarray(r).reshape(h, w), np.asarray(p).reshape(h, w), before, inside)
            out.append(found.ravel().tolist())
        return pd.Series(out)

    return estimate


def _around(frames: DataFrame, column: str, n: int, by: Sequence[str], together: int) -> tuple[DataFrame, int]:
    """Each frame with ``near``, the list of the values of a window of ``n`` frames around it (shorter at the ends), and the window's frames before it.

    A frame goes to every block of time that has a window with it.
    """
    before, after = -(-n // 2) - 1, n // 2
    block = lambda t: F.floor(t / together)
    blocks = F.sequence(block(F.greatest(F.lit(0), F.col("t") - after)), block(F.col("t") + before))
    copies = frames.select("*", F.explode(blocks).alias("block"))
    near = F.collect_list(column).over(Window.partitionBy(*by, "block").orderBy("t").rowsBetween(-before, after))
    return copies.withColumn("near", near).where(F.col("block") == block(F.col("t"))).drop("block"), before


def average_frames(frames: DataFrame, n: int, by: Sequence[str] = (), together: int = FRAMES_TOGETHER) -> DataFrame:
    """Frames as the mean of ``n`` around each, the first and last repeated beyond the ends."""
    near, before = _around(frames, "px", n, by, together)
    head = F.greatest(F.lit(0), F.lit(before) - F.col("t"))
    tail = F.lit(n) - F.size("near") - head
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    ends = F.zip_with(F.get("near", F.lit(0)), F.element_at("near", -1), lambda x, y: x * head + y * tail)
    total = F.aggregate("near", ends, plus)
    return near.withColumn("px", F.transform(total, lambda v: v / n)).drop("near")


def common_masks(masks: DataFrame, n: int, by: Sequence[str] = (), together: int = FRAMES_TOGETHER) -> DataFrame:
    """Masks of each frame: what takes part in all frames of the window of ``average_frames``."""
    near, _ = _around(masks, "mask", n, by, together)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x & y)
    return near.withColumn("mask", F.aggregate("near", F.get("near", F.lit(0)), both)).drop("near")


def register(
    frames: DataFrame,
    reference: str = "first",
    model: str = "affine",
    by: Sequence[str] = (),
    mask: DataFrame | None = None,
    n_frames: int = 1,
    frame_masks: DataFrame | None = None,
    moving_average: int = 1,
) -> DataFrame:
    """``(by..., t, m)``: one matrix per frame against its recording's reference.

    ``first`` is the mean of the first ``n_frames`` frames.  ``mask (by..., mask array<boolean>)`` marks the
    pixels that may take part in all frames, ``frame_masks (by..., t, mask)`` those of each frame; an averaged
    reference then lets take part what all averaged frames do, and ``previous`` what the frame before does.
    Frame 0 gets the identity, except with the mean of all frames.

    With a ``moving_average`` of two frames or more, the frames are first averaged over a window of as many (and take part where
    all of them do), frame 0 is registered too, and with ``previous`` its reference is the last frame.
    """
    if moving_average < 1:
        raise ValueError(f"moving_average must be at least 1: {moving_average}")
    if model not in align.MODELS and model != _BILINEAR:
        raise ValueError(f"unknown model {model!r}")
    if mask is not None and frame_masks is not None:
        raise ValueError("give one mask for all frames or one for each, not both")
    none = F.lit(None).cast("array<boolean>")
    if moving_average > 1:
        frames = average_frames(frames, moving_average, by)
        frame_masks = common_masks(frame_masks, moving_average, by) if frame_masks is not None else None
    if frame_masks is not None:
        frames = frames.join(frame_masks.select(*by, "t", "mask"), [*by, "t"], "left")
    else:
        frames = frames.withColumn("mask", none)
    if reference == "previous":
        earlier = frames.select(*by, (F.col("t") + 1).alias("t"), F.col("px").alias("ref"), F.col("mask").alias("ref_mask"))
        if moving_average > 1:
            n = frames.groupBy(*by).agg((F.max("t") + 1).alias("n_frames"))
            earlier = earlier.join(n, list(by)) if by else earlier.join(n, F.lit(True))
            earlier = earlier.withColumn("t", F.col("t") % F.col("n_frames")).drop("n_frames")
        paired = frames.join(earlier, [*by, "t"], "left")
    else:
        refs = reference_frames(frames, reference, by, n_frames)
        paired = frames.join(refs, list(by)) if by else frames.join(refs, F.lit(True))
        if reference == "first" and moving_average == 1:
            paired = paired.withColumn("ref", F.when(F.col("t") > 0, F.col("ref")))
        if frame_masks is None:
            paired = paired.withColumn("ref_mask", none)
        else:
            shared = reference_masks(frame_masks, reference, by, n_frames)
            paired = paired.join(shared, list(by), "left") if by else paired.join(shared, F.lit(True), "left")
    if mask is not None:
        mask = mask.select(*by, F.col("mask").alias("all_mask"))
        paired = paired.drop("mask", "ref_mask")
        paired = paired.join(mask, list(by), "left") if by else paired.join(mask, F.lit(True), "left")
        paired = paired.withColumn("mask", F.col("all_mask")).withColumn("ref_mask", F.col("all_mask"))
    found = paired.select(*by, "t", _estimator(model)("px", "ref", "height", "width", "mask", "ref_mask").alias("m"))
    if reference != "previous":
        return found
    # the scan reads the estimates more than once
    return chain(materialize(found, "steps"), by)


def register_bilinear(frames: DataFrame, reference: str = "first", by: Sequence[str] = (), **options) -> DataFrame:
    """``(by..., t, m)`` as ``register``, with ``m`` the eight coefficients of 1, x, y and xy for x, then for y.

    Such maps have no products of the same kind, so ``previous`` raises an error.
    """
    if reference == "previous":
        raise ValueError("bilinear transforms can't be chained; use the reference first or mean")
    return register(frames, reference, _BILINEAR, by, **options)


def _times(a: str, b: str) -> Column:
    """The product of two 3x3 matrices in rows of nine."""
    cell = lambda m, r, c: F.get(m, F.lit(3 * r + c))
    return F.array(*[sum((cell(a, r, k) * cell(b, k, c) for k in range(1, 3)), cell(a, r, 0) * cell(b, 0, c)) for r in range(3) for c in range(3)])


def chain(steps: DataFrame, by: Sequence[str] = (), together: int = STEPS_TOGETHER) -> DataFrame:
    """Products ``M_t @ ... @ M_0`` of each recording's frame-to-frame matrices, in order.

    A scan in three steps: products within blocks of ``together`` frames, products of the blocks before each one, and both
    multiplied; the second is such a scan of its own as long as it has several blocks, so no task sees more than one block.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        total, out = np.eye(3), []
        for m in group["m"]:
            total = np.asarray(m).reshape(3, 3) @ total
            out.append(total.ravel().tolist())
        return group.assign(m=out)

    rows = steps.select(*by, F.col("t").cast("bigint").alias("t"), "m", F.floor(F.col("t") / together).alias("block"))
    last = rows.agg(F.max("block")).first()[0]
    own = rows.groupBy(*by, "block").applyInPandas(run, rows.schema)
    if last:
        own = materialize(own, "products")
        ends = own.groupBy(*by, "block").agg(F.max_by("m", "t").alias("m"))
        before = chain(ends.select(*by, F.col("block").alias("t"), "m"), by, together)
        before = before.select(*by, (F.col("t") + 1).alias("block"), F.col("m").alias("before"))
        own = own.join(before, [*by, "block"], "left").withColumn("m", F.when(F.col("before").isNull(), F.col("m")).otherwise(_times("m", "before")))
    return own.select(*by, F.col("t").cast(steps.schema["t"].dataType).alias("t"), "m")


@F.pandas_udf(_DOUBLES)
def _warped(px: pd.Series, height: pd.Series, width: pd.Series, m: pd.Series) -> pd.Series:
    rows = zip(px, height, width, m, strict=True)
    warped = lambda image, k: align.warp_bilinear(image, k) if len(k) == 8 else align.warp(image, np.asarray(k).reshape(3, 3))
    return pd.Series([list(p) if k is None else warped(np.asarray(p).reshape(h, w), k).ravel().tolist() for p, h, w, k in rows])


def stabilise(frames: DataFrame, transforms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frames warped back by their matrices or bilinear coefficients; frames without one stay."""
    joined = frames.join(transforms, [*by, "t"], "left")
    return joined.select(*by, "t", "height", "width", _warped("px", "height", "width", "m").alias("px"))


def crop_boxes(frames: DataFrame, leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per frame and leaf box: ``(by..., leaf_id, t, height, width, px)`` of the box."""
    joined = frames.join(leaves, list(by)) if by else frames.join(leaves, F.lit(True))
    line = lambda y: F.slice("px", y * F.col("width") + F.col("x0") + 1, F.col("x1") - F.col("x0"))
    cut = F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), line))
    # in two steps: inside a lambda, "width" would mean the new column
    boxes = joined.withColumn("box", cut)
    return boxes.select(*by, "leaf_id", "t", (F.col("y1") - F.col("y0")).alias("height"), (F.col("x1") - F.col("x0")).alias("width"), F.col("box").alias("px"))


def register_leaves(frames: DataFrame, leaves: DataFrame, reference: str = "mean", model: str = "affine", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., leaf_id, t, m)``: every box is registered on its own.

    If leaves have a ``mask_polygon``, only pixels inside it take part; without a usable one all do.
    """
    from wavelake.operators.regions import leaf_mask_arrays

    keys = (*by, "leaf_id")
    masks = leaf_mask_arrays(leaves, by) if "mask_polygon" in leaves.columns else None
    return register(crop_boxes(frames, leaves.select(*keys, "y0", "y1", "x0", "x1"), by), reference, model, keys, masks)


def stabilise_leaves(frames: DataFrame, leaves: DataFrame, transforms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of the movie with every box stabilised; raw outside, the last box where they overlap."""
    from wavelake.operators.movie import to_pixels
    from wavelake.operators.regions import composite

    boxes = stabilise(crop_boxes(frames, leaves, by).join(transforms.select(*by, "leaf_id").distinct(), [*by, "leaf_id"]), transforms, (*by, "leaf_id"))
    cells = to_pixels(boxes, (*by, "leaf_id")).join(leaves.select(*by, "leaf_id", "y0", "x0"), [*by, "leaf_id"])
    placed = cells.select(*by, "leaf_id", "t", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "v")
    return composite(to_pixels(frames, by), placed, by)
