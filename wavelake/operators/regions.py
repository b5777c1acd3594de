"""Regions of interest: masks, traces, leaf boxes and motion.

A mask is a table ``(by..., roi_id, y, x)`` that each region writes for its own bounding
box, so pixels meet regions in an equi-join on their position instead of a test of
every pixel against every region.  ``rois`` has ``(roi_id, cy, cx, size, shape, vertices)``
with shape ``circle``, ``square`` or ``polygon`` and vertices as structs of y and x.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps the crossing test finite on level edges, as the original formula does.
_EDGE = 1e-12
VERTICES = "array<struct<y:double,x:double>>"


def edges_of(vertices: Column) -> Column:
    """(vertex, previous vertex) for every vertex, the first following the last."""
    n = F.size(vertices)
    return F.transform(vertices, lambda v, i: F.struct(v.alias("a"), F.get(vertices, F.pmod(i - 1, n)).alias("b")))


def in_polygon(y: Column, x: Column, vertices: Column) -> Column:
    """Even-odd test; the quotient is only taken on edges that the point's row straddles."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(straddles, b["y"] - a["y"] + F.lit(_EDGE)) + a["x"]
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(edges_of(vertices), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def polygon_centroid(vertices: Column) -> Column:
    """Struct (y, x): area-weighted, or the vertices' mean where the area vanishes."""

    def total(term) -> Column:
        return F.aggregate(edges_of(vertices), F.lit(0.0), lambda s, e: s + term(e["b"], e["a"]))

    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area2 = total(cross)
    mean = lambda c: F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[c]) / F.size(vertices)
    flat = F.abs(area2) < 1e-9
    centre = lambda c: F.when(flat, mean(c)).otherwise(total(lambda a, b: (a[c] + b[c]) * cross(a, b)) / (3.0 * F.when(~flat, area2)))
    return F.struct(centre("y").alias("y"), centre("x").alias("x"))


def _bounds(shape: Column, axis: str, limit: int) -> tuple[Column, Column]:
    """First and last row or column that a region can touch, inside the frame."""
    centre, reach = F.col(f"c{axis}"), F.col("size")
    ends = F.transform("vertices", lambda v: v[axis])
    low = F.when(shape == "polygon", F.array_min(ends)).otherwise(centre - reach)
    high = F.when(shape == "polygon", F.array_max(ends)).otherwise(centre + reach)
    return F.greatest(F.lit(0), F.floor(low).cast("int")), F.least(F.lit(limit - 1), F.ceil(high).cast("int"))


def roi_mask(rois: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., roi_id, y, x)`` for the pixels of every region; circles and squares include their rim."""
    shape = F.col("shape")
    y0, y1 = _bounds(shape, "y", height)
    x0, x1 = _bounds(shape, "x", width)
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    cells = rois.withColumn("y", F.explode(span(y0, y1))).withColumn("x", F.explode(span(x0, x1)))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    inside = (
        F.when(shape == "circle", dy * dy + dx * dx <= F.col("size") * F.col("size"))
        .when(shape == "square", (F.abs(dy) <= F.col("size")) & (F.abs(dx) <= F.col("size")))
        .when(shape == "polygon", (F.size("vertices") >= 3) & in_polygon(F.col("y").cast("double"), F.col("x").cast("double"), F.col("vertices")))
    )
    return cells.where(inside).select(*by, "roi_id", "y", "x")


def roi_traces(movie: DataFrame, rois: DataFrame, n_frames: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., roi_id, t, raw)``: the mean of each region's pixels; 0 for a region without pixels."""
    mask = roi_mask(rois, height, width, by)
    means = movie.join(mask, [*by, "y", "x"]).groupBy(*by, "roi_id", "t").agg(F.avg("v").alias("raw"))
    every = rois.select(*by, "roi_id", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("t"))
    return every.join(means, [*by, "roi_id", "t"], "left").select(*by, "roi_id", "t", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def map_point(y: Column, x: Column, m: Column, oy: Column, ox: Column) -> tuple[Column, Column]:
    """A point under a 3x3 matrix (row-major, acting on (x, y, 1)) about an origin."""
    at = lambda k: F.get(m, F.lit(k))
    px, py = x - ox, y - oy
    return at(3) * px + at(4) * py + at(5) + oy, at(0) * px + at(1) * py + at(2) + ox


def move_rois(rois: DataFrame, transforms: DataFrame, n_frames: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per region and frame, moved by the frame's transform.

    Polygons move all vertices and take a new centre; circles and squares move only their
    centre.  Frames without a transform stay.  ``rois`` may carry an origin ``(oy, ox)``.
    """
    for c in ("oy", "ox"):
        if c not in rois.columns:
            rois = rois.withColumn(c, F.lit(0.0))
    every = rois.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    every = every.join(transforms.select(*by, "t", "m"), [*by, "t"], "left")
    m, oy, ox = F.col("m"), F.col("oy"), F.col("ox")

    def moved(v: Column) -> Column:
        y, x = map_point(v["y"], v["x"], m, oy, ox)
        return F.struct(y.alias("y"), x.alias("x"))

    polygon = F.col("shape") == "polygon"
    every = every.withColumn("vertices", F.when(m.isNotNull() & polygon, F.transform("vertices", moved)).otherwise(F.col("vertices")))
    cy, cx = map_point(F.col("cy"), F.col("cx"), m, oy, ox)
    centre = F.when(polygon, polygon_centroid(F.col("vertices"))).otherwise(F.struct(cy.alias("y"), cx.alias("x")))
    every = every.withColumn("centre", F.when(m.isNotNull(), centre))
    return every.withColumn("cy", F.coalesce("centre.y", "cy")).withColumn("cx", F.coalesce("centre.x", "cx")).drop("centre", "m")


def tracked_traces(movie: DataFrame, rois: DataFrame, transforms: DataFrame, n_frames: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Traces of regions that follow their transforms over the raw pixels; 0 while out of view.

    Keys that the movie lacks (as a leaf box) come from the regions alone.
    """
    moved = move_rois(rois, transforms, n_frames, by)
    mask = roi_mask(moved, height, width, (*by, "t"))
    means = movie.join(mask, [*(b for b in by if b in movie.columns), "t", "y", "x"]).groupBy(*by, "roi_id", "t").agg(F.avg("v").alias("raw"))
    every = moved.select(*by, "roi_id", "t")
    return every.join(means, [*by, "roi_id", "t"], "left").select(*by, "roi_id", "t", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def assign_leaves(rois: DataFrame, leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``leaf_id``: the first leaf box ``(y0, y1, x0, x1)`` that holds the centre, or null.

    Boxes are listed per recording; the join is on the recording, and only where there is none
    do the few boxes go to every region.
    """
    boxes = leaves.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("leaf_id", "y0", "y1", "x0", "x1"))).alias("boxes"))
    full = rois.join(boxes, list(by), "left") if by else rois.join(F.broadcast(boxes), F.lit(True), "left")
    holds = F.filter("boxes", lambda b: (F.col("cy") >= b["y0"]) & (F.col("cy") < b["y1"]) & (F.col("cx") >= b["x0"]) & (F.col("cx") < b["x1"]))
    return full.withColumn("leaf_id", F.get(holds, F.lit(0))["leaf_id"]).drop("boxes")


def leaf_mask(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., leaf_id, y, x)`` in box coordinates of leaves whose outline selects pixels; others use all pixels."""
    shifted = F.transform("mask_polygon", lambda v: F.struct((v["y"] - F.col("y0")).alias("y"), (v["x"] - F.col("x0")).alias("x")))
    cells = leaves.where(F.size("mask_polygon") >= 3).withColumn("vertices", shifted)
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("y1") - F.col("y0") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("x1") - F.col("x0") - 1)))
    return cells.where(in_polygon(F.col("y").cast("double"), F.col("x").cast("double"), F.col("vertices"))).select(*by, "leaf_id", "y", "x")


def leaf_mask_arrays(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., leaf_id, mask array<boolean>)`` in row-major order, for the leaves that ``leaf_mask`` has."""
    inside = leaf_mask(leaves, by).groupBy(*by, "leaf_id", "y").agg(F.collect_set("x").alias("xs"))
    rows = leaves.select(*by, "leaf_id", F.col("x0").alias("x0_"), F.col("x1").alias("x1_"), F.explode(F.sequence(F.lit(0), F.col("y1") - F.col("y0") - 1)).alias("y"))
    rows = rows.join(inside, [*by, "leaf_id", "y"], "left")
    line = F.transform(F.sequence(F.lit(0), F.col("x1_") - F.col("x0_") - 1), lambda x: F.coalesce(F.array_contains("xs", x), F.lit(False)))
    whole = rows.groupBy(*by, "leaf_id").agg(F.array_sort(F.collect_list(F.struct("y", line.alias("line")))).alias("lines"), F.count("xs").alias("n"))
    return whole.where(F.col("n") > 0).select(*by, "leaf_id", F.flatten(F.col("lines.line")).alias("mask"))


def composite(movie: DataFrame, warped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The movie with leaf boxes replaced by ``warped (by..., leaf_id, t, y, x, v)``; the last box wins."""
    last = warped.groupBy(*by, "t", "y", "x").agg(F.max(F.struct("leaf_id", F.col("v"))).alias("w"))
    return movie.join(last, [*by, "t", "y", "x"], "left").select(*by, "t", "y", "x", F.coalesce("w.v", F.col("v").cast("double")).alias("v"))


def drift_flags(transforms: DataFrame, leaves: DataFrame, frac: float = 0.25) -> DataFrame:
    """``(leaf_id, t)`` of frames that shift by more than ``frac`` of the box's smaller side."""
    joined = transforms.join(leaves.select("leaf_id", "y0", "y1", "x0", "x1"), "leaf_id")
    limit = F.lit(frac) * F.least(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return joined.where(F.hypot("dx", "dy") > limit).select("leaf_id", "t")


def matrix_to_rigid(m: Column) -> Column:
    """Struct (dy, dx, theta in degrees) of a 3x3 matrix."""
    at = lambda k: F.get(m, F.lit(k))
    return F.struct(at(5).alias("dy"), at(2).alias("dx"), F.degrees(F.atan2(at(3), at(0))).alias("theta"))


def rigid_to_matrix(dy: Column, dx: Column, theta: Column) -> Column:
    """The 3x3 matrix of a shift and a rotation about the origin."""
    c, s, zero, one = F.cos(F.radians(theta)), F.sin(F.radians(theta)), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, dx, s, c, dy, zero, zero, one)
