"""A recording with its regions, registration, traces and analyses.

A thin facade over the operators: it holds lazy DataFrames and parameters, remembers
which results depend on what, and drops them when that changes.  What registration finds is
written once (under ``spark.checkpoint.dir``), since every later analysis reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions import units
from wavelake.operators import kymograph as kymo
from wavelake.operators import motion, movie, onset, propagation, regions, traces
from wavelake.sources import export, tiff
from wavelake.sources.written import materialize

#: Analyses by name: (shape, function); see ``register_analysis``.
ANALYSES: dict[str, tuple[str, Callable[..., Any]]] = {}
SHAPES = ("roi", "dataset", "geometry")


def register_analysis(name: str, shape: str, function: Callable[..., Any]) -> None:
    """Make ``function`` callable as ``Recording.run(name)``.

    ``shape`` says what it gets: ``roi`` the traces; ``dataset`` the traces and the table of regions;
    ``geometry`` the working pixels and the path or region that the caller gives.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}, expected one of {SHAPES}")
    ANALYSES[name] = (shape, function)


@dataclass
class Recording:
    """``pixels (t, y, x, v)`` of one movie and what is measured on it.

    ``revision`` counts changes of data, regions, registration, crop and calibration.
    """

    pixels: DataFrame
    n_frames: int
    height: int
    width: int
    pixel_size: float | None = None
    frame_interval: float | None = None
    rois: list[dict[str, Any]] = field(default_factory=list)
    leaves: list[dict[str, Any]] = field(default_factory=list)
    events: list[tuple[int, str]] = field(default_factory=list)
    window: tuple[int, int] | None = None
    transforms: DataFrame | None = None
    registered: DataFrame | None = None
    drift: DataFrame | None = None
    references: DataFrame | None = None
    track_motion: bool = False
    mode: str = "none"
    model: str | None = None
    signals: DataFrame | None = None
    sigma: float | None = None
    analyses: dict[str, Any] = field(default_factory=dict)
    revision: int = 0

    def _changed(self) -> None:
        self.signals, self.sigma = None, None
        self.analyses = {}
        self.revision += 1

    # --- calibration and events ---

    def set_frame_interval(self, seconds: float | None) -> None:
        self.frame_interval = units.positive_number(seconds)
        self.revision += 1

    def set_pixel_size(self, micrometres: float | None) -> None:
        self.pixel_size = units.positive_number(micrometres)
        self.revision += 1

    def add_event(self, frame: int, label: str) -> None:
        self.events.append((int(frame), label))

    # --- regions ---

    def add_roi(self, cy: float, cx: float, size: float, shape: str = "circle", label: str = "") -> int:
        if shape not in ("circle", "square"):
            raise ValueError(f"unknown shape {shape!r}")
        return self._add({"cy": float(cy), "cx": float(cx), "size": float(size), "shape": shape, "label": label, "vertices": None})

    def add_polygon(self, vertices: list[tuple[float, float]], label: str = "") -> int:
        points = [{"y": float(y), "x": float(x)} for y, x in vertices]
        one = self.pixels.sparkSession.createDataFrame([(points,)], f"v {regions.VERTICES}")
        centre = one.select(regions.polygon_centroid(F.col("v")).alias("c")).first()["c"]
        return self._add({"cy": centre["y"], "cx": centre["x"], "size": 0.0, "shape": "polygon", "label": label, "vertices": points})

    def _add(self, roi: dict[str, Any]) -> int:
        self.rois.append({"roi_id": len(self.rois)} | roi)
        self._changed()
        return len(self.rois) - 1

    def roi_table(self) -> DataFrame:
        names = ("roi_id", "cy", "cx", "size", "shape", "label", "vertices")
        schema = f"roi_id int, cy double, cx double, size double, shape string, label string, vertices {regions.VERTICES}"
        return self.pixels.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in self.rois], schema)

    def add_leaf(self, box: tuple[int, int, int, int], outline: list[tuple[float, float]] | None = None, label: str = "") -> int:
        if outline is not None and len(outline) < 3:
            raise ValueError("an outline needs at least three points")
        y0, y1, x0, x1 = box
        points = [{"y": float(y), "x": float(x)} for y, x in outline] if outline else None
        self.leaves.append({"leaf_id": len(self.leaves), "y0": y0, "y1": y1, "x0": x0, "x1": x1, "label": label, "mask_polygon": points})
        self.revision += 1
        return len(self.leaves) - 1

    def set_leaf_outline(self, leaf: int, outline: list[tuple[float, float]] | None) -> None:
        """Give a leaf an outline, or take it away (``None``); later registrations use it."""
        if outline is not None and len(outline) < 3:
            raise ValueError("an outline needs at least three points")
        self.leaves[leaf]["mask_polygon"] = [{"y": float(y), "x": float(x)} for y, x in outline] if outline is not None else None
        self.revision += 1

    def clear_leaf_outline(self, leaf: int) -> None:
        self.set_leaf_outline(leaf, None)

    def leaf_table(self) -> DataFrame:
        names = ("leaf_id", "y0", "y1", "x0", "x1", "label", "mask_polygon")
        schema = f"leaf_id int, y0 int, y1 int, x0 int, x1 int, label string, mask_polygon {regions.VERTICES}"
        return self.pixels.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in self.leaves], schema)

    # --- registration ---

    def frames(self) -> DataFrame:
        return movie.to_frames(self.pixels, self.height, self.width)

    def register(self, mode: str = "whole_frame", reference: str = "first", apply: bool = True, model: str = "affine") -> None:
        """Estimate motion; ``apply`` warps the movie, otherwise regions follow it.

        Per leaf, outlines limit what takes part; ``drift`` then lists the frames in which a leaf
        moves far, and ``references`` holds what each leaf was registered to.
        """
        self._need_data()
        self.transforms = self.registered = self.drift = self.references = None
        self.mode, self.model, self.track_motion = mode, None if mode == "none" else model, False
        if mode == "whole_frame":
            self.transforms = materialize(motion.register(self.frames(), reference, model), "transforms")
            if apply:
                self.registered = materialize(movie.to_pixels(motion.stabilise(self.frames(), self.transforms)), "registered")
        elif mode == "per_leaf":
            if not self.leaves:
                raise ValueError("per-leaf registration needs leaf boxes")
            leaves = self.leaf_table()
            boxes = leaves.drop("mask_polygon", "label")
            self.transforms = materialize(motion.register_leaves(self.frames(), leaves, reference, model), "transforms")
            moves = self.transforms.select("leaf_id", "t", regions.matrix_to_rigid(F.col("m")).alias("r")).select("leaf_id", "t", "r.dy", "r.dx")
            self.drift = regions.drift_flags(moves, boxes)
            if reference != "previous":
                self.references = motion.reference_frames(motion.crop_boxes(self.frames(), boxes), reference, ("leaf_id",))
            if apply:
                self.registered = materialize(motion.stabilise_leaves(self.frames(), boxes, self.transforms), "registered")
        elif mode != "none":
            raise ValueError(f"unknown registration mode {mode!r}")
        self.track_motion = self.transforms is not None and not apply
        self._changed()

    def _need_data(self) -> None:
        if self.pixels is None:
            raise RuntimeError("no recording is loaded")

    # --- traces ---

    def working(self) -> DataFrame:
        return self.registered if self.registered is not None else self.pixels

    def set_crop(self, start: int, end: int) -> None:
        start, end = max(0, start), min(self.n_frames, end)
        if end <= start:
            raise ValueError(f"empty crop [{start}, {end})")
        self.window = None if (start, end) == (0, self.n_frames) else (start, end)
        self._changed()

    def _cropped(self, frames: DataFrame) -> tuple[DataFrame, int]:
        start, end = self.window or (0, self.n_frames)
        return movie.crop_time(frames, start, end), end - start

    def traces(self) -> DataFrame:
        """``(roi_id, label, t, raw, dff[, smoothed])``, with the default baseline until another is set."""
        self._need_data()
        if self.signals is None:
            cropped, n = self._cropped(self.working())
            rois = self.roi_table()
            if self.track_motion:
                moves, _ = self._cropped(self.transforms)
                if self.mode == "per_leaf":
                    raw = self._leaf_traces(cropped, rois, moves, n)
                else:
                    raw = regions.tracked_traces(cropped, rois, moves, n, self.height, self.width)
            else:
                raw = regions.roi_traces(cropped, rois, n, self.height, self.width)
            named = rois.select("roi_id", traces.label_of(F.col("label"), F.col("roi_id")).alias("label"))
            self.signals = traces.delta_f(raw.join(named, "roi_id").select("roi_id", "label", "t", "raw")).drop("f0")
        return self.signals

    def _leaf_traces(self, cropped: DataFrame, rois: DataFrame, moves: DataFrame, n: int) -> DataFrame:
        """Regions inside a leaf box follow it; the others stay."""
        boxes = self.leaf_table()
        assigned = regions.assign_leaves(rois, boxes)
        held = assigned.where(F.col("leaf_id").isNotNull()).join(boxes.select("leaf_id", F.col("y0").cast("double").alias("oy"), F.col("x0").cast("double").alias("ox")), "leaf_id")
        free = assigned.where(F.col("leaf_id").isNull()).drop("leaf_id")
        tracked = regions.tracked_traces(cropped, held, moves, n, self.height, self.width, ("leaf_id",))
        return tracked.drop("leaf_id").unionByName(regions.roi_traces(cropped, free, n, self.height, self.width))

    def compute_dff(self, n: int | None = None, region: tuple[int, int] | None = None) -> DataFrame:
        self.signals = traces.delta_f(self.traces(), n=n, region=region).drop("f0")
        return self.signals

    def smooth(self, sigma: float) -> DataFrame:
        smoothed = traces.smooth_gaussian(self.traces(), sigma).select("roi_id", "t", "smoothed")
        self.signals, self.sigma = self.traces().drop("smoothed").join(smoothed, ["roi_id", "t"]), sigma
        return self.signals

    # --- analyses ---

    def propagation(self, signal: str = "dff", direction_mode: str = "roi_line", **detector) -> dict[str, DataFrame]:
        value = traces.choose_signal(self.traces().columns, signal)
        onsets = onset.onset_time(self.traces(), value=value, **detector)
        points = propagation.responding(onsets, self.roi_table().select("roi_id", "cy", "cx"))
        result = {"onsets": onsets, "source": propagation.source_roi(points), "pairwise": propagation.pairwise_speeds(points), "fit": propagation.fit(points, direction_mode)}
        self.analyses["propagation"] = result
        return result

    def onset_heatmap(self, bin_size: int = 1, **detector) -> DataFrame:
        return onset.onset_map(self._cropped(self.working())[0], self.height, self.width, bin_size, **detector)

    def kymograph(self, path: list[tuple[float, float]], **options) -> DataFrame:
        self.analyses["kymograph"] = kymo.kymograph(self._cropped(self.working())[0], path, self.height, self.width, **options)
        return self.analyses["kymograph"]

    def max_projection(self) -> DataFrame:
        return movie.max_projection(self.working())

    def displayed(self, smoothed: bool = True, dff: bool = True) -> DataFrame:
        """``(roi_id, label, t, shown)``: of the signals that are switched on and there, smoothed before dff before raw."""
        have = self.traces()
        name = "smoothed" if smoothed and "smoothed" in have.columns else "dff" if dff else "raw"
        return have.select("roi_id", "label", "t", F.col(name).cast("double").alias("shown"))

    def propagation_summary(self, direction_mode: str = "roi_line", **options) -> DataFrame:
        """``(k, line)``: what propagation found, as text lines in the best units that are known."""
        result = self.propagation(direction_mode=direction_mode, **options)
        scaled = units.speed_units(F.lit(self.pixel_size).cast("double"), F.lit(self.frame_interval).cast("double"))
        scale, time = (self.frame_interval, "s") if self.frame_interval else (1.0, "frames")
        names = self.roi_table().select("roi_id", traces.label_of(F.col("label"), F.col("roi_id")).alias("label"))
        start = (self.window or (0, 0))[0]
        fit = result["fit"].select(F.inline(F.array(
            F.struct(F.lit(0).alias("k"), F.format_string("speed: %.2f %s", F.col("speed") * scaled["factor"], scaled["unit"]).alias("line")),
            F.struct(F.lit(1).alias("k"), F.format_string("direction (dy, dx): (%.3f, %.3f)", "dir_y", "dir_x").alias("line")),
        )))
        mode = self.pixels.sparkSession.range(1).select(F.lit(2).alias("k"), F.lit(f"direction mode: {direction_mode}").alias("line"))
        source = result["source"].join(names, F.col("source_roi") == F.col("roi_id")).select(F.lit(3).alias("k"), F.concat(F.lit("source (earliest): "), "label").alias("line"))
        at = F.when(F.col("onset").isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f", (F.col("onset") + start) * scale))
        onsets = result["onsets"].join(names, "roi_id").select((F.col("roi_id") + 4).cast("int").alias("k"), F.concat(F.lit(f"onset ({time}) "), "label", F.lit(": "), at).alias("line"))
        return fit.union(mode).union(source).union(onsets).orderBy("k")

    def run(self, name: str, *given, **options) -> Any:
        """A registered analysis; its result is kept under its name."""
        shape, function = ANALYSES[name]
        first = {"roi": lambda: (self.traces(),), "dataset": lambda: (self.traces(), self.roi_table()), "geometry": lambda: (self._cropped(self.working())[0],)}[shape]()
        self.analyses[name] = function(*first, *given, **options)
        return self.analyses[name]

    # --- exports ---

    def export_traces(self, path: str) -> None:
        """A CSV folder: one row per frame, numbered as in the whole recording where it is cropped."""
        have = self.traces()
        start = (self.window or (0, 0))[0]
        names = {"F": "raw", "dFF": "dff"} | ({"smoothed": "smoothed"} if "smoothed" in have.columns else {})
        labels = {r["roi_id"]: r["label"] for r in self.rois}
        export.write_wide(have.withColumn("frame", F.col("t") + start), path, names, labels, self.frame_interval, frame="frame")

    def export_stack(self, path: str) -> None:
        """The working movie as one local TIFF."""
        tiff.write_movie(movie.to_frames(self.working(), self.height, self.width), path)

    def export_record(self, path: str) -> None:
        export.write_record(self.record(), path, self.pixels.sparkSession)

    def export_all(self, folder: str) -> None:
        """Traces (if there are regions), movie and parameters below one folder."""
        self._need_data()
        if self.rois:
            self.export_traces(f"{folder}/traces.csv")
        self.export_record(f"{folder}/parameters.json")
        self.export_stack(f"{folder}/movie.tif")

    def apply(self, analysis: Callable[[DataFrame, DataFrame], Any]) -> Any:
        """A custom analysis of the traces and the raw pixels; its result is not kept."""
        return analysis(self.traces(), self.pixels)

    def record(self) -> dict[str, Any]:
        """The parameters that made the results."""
        return {
            "shape": [self.n_frames, self.height, self.width], "pixel_size": self.pixel_size, "frame_interval": self.frame_interval,
            "crop": list(self.window) if self.window else None, "rois": self.rois, "leaves": self.leaves, "events": self.events,
            "registration": {"mode": self.mode, "model": self.model, "track_motion": self.track_motion}, "sigma": self.sigma, "analyses": sorted(self.analyses),
        }
