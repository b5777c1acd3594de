"""Named queries over the shared tables, each with its SQL equivalent.

Traces come from ``events`` (one per user) and movies from ``lineitem``; regions, leaf
boxes, paths and transforms are small literal tables.  Floats are rounded to six places,
since the order of summation differs between engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions import units
from wavelake.operators import kymograph as kymo
from wavelake.operators import movie as mv
from wavelake.operators import motion, onset, propagation, regions, traces
from wavelake.sources import export, tables

T, H, W = tables.MOVIE_SHAPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """``ints``: columns that the SQL makes 32-bit integers; all queries return 64-bit ones."""
    if sql is not None and ints:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ints)}) FROM ({sql})"

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(c: Column | str, places: int) -> Column:
    """Rounding as the SQL does it: the scaled double goes to the next whole number, halves away from zero.

    ``F.round`` with places rounds the decimal digits, which differs where scaling meets a half (4.045312499999999).
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0**places)
    return F.round(c * scale) / scale


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _round(c, 6) for c in columns})


# --- tables in SQL ------------------------------------------------------------

_TR = """tr AS (
  SELECT user_id AS roi_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS raw
  FROM events)"""
_MV = f"""mv AS (
  SELECT g.t, g.y, g.x, coalesce(s.v, 0.0) AS v
  FROM (SELECT t, y, x FROM range({T}) a(t), range({H}) b(y), range({W}) c(x)) g
  LEFT JOIN (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, l_linenumber - 1 AS y, l_suppkey % 16 AS x, sum(l_quantity) AS v
             FROM lineitem GROUP BY 1, 2, 3) s ON s.t = g.t AND s.y = g.y AND s.x = g.x)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {a} < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END ELSE ({a}) / {b} END"


# --- traces ---------------------------------------------------------------------


def _dff_sql(inside: str) -> str:
    return f"""WITH {_TR}, b AS (SELECT *, avg(CASE WHEN {inside} THEN raw END) OVER (PARTITION BY roi_id) AS f0 FROM tr)
SELECT roi_id, t, raw, round({_ratio("raw - f0", "f0")}, 6) AS dff FROM b"""


def _dff(spark: SparkSession, sf_dir: str, **baseline) -> DataFrame:
    return _rounded(traces.delta_f(tables.traces_from_events(spark, sf_dir), **baseline).select("roi_id", "t", "raw", "dff"), "dff")


@_query(_dff_sql("t < 10"))
def dff_default(spark, sf_dir):
    return _dff(spark, sf_dir)


@_query(_dff_sql("t < 5"))
def dff_first_n(spark, sf_dir):
    return _dff(spark, sf_dir, n=5)


@_query(_dff_sql("t >= 10 AND t < 20"))
def dff_region(spark, sf_dir):
    return _dff(spark, sf_dir, region=(10, 20))


@_query(f"""WITH {_TR}, b AS (SELECT *, first_value(raw) OVER (PARTITION BY roi_id ORDER BY t) AS f0 FROM tr)
SELECT roi_id, t, round(CASE WHEN f0 = 0 THEN 0.0 ELSE (raw - f0) / f0 END, 6) AS dff FROM b""")
def dff_first_frame(spark, sf_dir):
    return _rounded(traces.delta_first_frame(tables.traces_from_events(spark, sf_dir)).select("roi_id", "t", "dff"), "dff")


_KERNEL = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in traces.gaussian_kernel(2.0))


@_query(f"""WITH {_TR}, b AS (SELECT *, avg(CASE WHEN t < 10 THEN raw END) OVER (PARTITION BY roi_id) AS f0 FROM tr),
d AS (SELECT roi_id, t, {_ratio("raw - f0", "f0")} AS dff, count(*) OVER (PARTITION BY roi_id) AS n FROM b),
k AS (SELECT * FROM (VALUES {_KERNEL}) k(k, w)),
e AS (SELECT d.roi_id, d.t, w, ((d.t + k) % (2 * n) + 2 * n) % (2 * n) AS q, n FROM d, k)
SELECT e.roi_id, e.t, round(sum(w * d.dff), 6) AS smoothed
FROM e JOIN d ON d.roi_id = e.roi_id AND d.t = CASE WHEN q < e.n THEN q ELSE 2 * e.n - 1 - q END
GROUP BY e.roi_id, e.t""")
def smooth_gaussian(spark, sf_dir):
    dff = traces.delta_f(tables.traces_from_events(spark, sf_dir))
    return _rounded(traces.smooth_gaussian(dff, 2.0).select("roi_id", "t", "smoothed"), "smoothed")


_GRADIENT = """CASE WHEN lag(raw) OVER o IS NULL THEN lead(raw) OVER o - raw WHEN lead(raw) OVER o IS NULL THEN raw - lag(raw) OVER o
  ELSE (lead(raw) OVER o - lag(raw) OVER o) / 2 END"""


@_query(f"WITH {_TR} SELECT roi_id, t, round({_GRADIENT}, 6) AS slope FROM tr WINDOW o AS (PARTITION BY roi_id ORDER BY t)")
def trace_gradient(spark, sf_dir):
    return _rounded(traces.gradient(tables.traces_from_events(spark, sf_dir)).select("roi_id", "t", "slope"), "slope")


@_query(f"""WITH {_MV}, o AS (SELECT unnest([-1, 0, 1, 2]) AS d),
e AS (SELECT mv.t, y, x, least(greatest(mv.t + d, 0), {T - 1}) AS s FROM mv, o)
SELECT e.t, e.y, e.x, round(sum(v) / 4, 6) AS mean FROM e JOIN mv ON mv.t = e.s AND mv.y = e.y AND mv.x = e.x GROUP BY e.t, e.y, e.x""")
def running_mean(spark, sf_dir):
    movie = tables.movie_from_lineitem(spark, sf_dir)
    return _rounded(traces.running_mean(movie, 4, ("y", "x")).select("t", "y", "x", "mean"), "mean")


@_query(f"WITH {_TR} SELECT roi_id, 'roi_' || roi_id AS label, t - 5 AS t, t AS frame, round((t - 5) * 0.25, 6) AS seconds, raw FROM tr WHERE t >= 5 AND t < 30")
def cropped_seconds(spark, sf_dir):
    cut = traces.with_seconds(traces.crop(tables.traces_from_events(spark, sf_dir), 5, 30), 0.25)
    label = traces.label_of(F.lit(None).cast("string"), F.col("roi_id")).alias("label")
    return _rounded(cut.select("roi_id", label, "t", "frame", "seconds", "raw"), "seconds")


# --- onsets ---------------------------------------------------------------------


def _onset_sql(source: str, keys: str, value: str, threshold: str, start: int = 0, y: str | None = None) -> str:
    """Threshold crossing; ``threshold`` aggregates the level ``lv`` of a key."""
    y = y or value
    return f"""WITH {source}, s AS (SELECT {keys}, t, {y} AS lv, count(*) OVER (PARTITION BY {keys}) AS n FROM tr WINDOW o AS (PARTITION BY {keys} ORDER BY t)),
p AS (SELECT *, lag(lv) OVER (PARTITION BY {keys} ORDER BY t) AS b4, t < greatest(1, n // 10) AS early FROM s),
b AS (SELECT {keys}, {threshold} AS th FROM p GROUP BY {keys}),
c AS (SELECT p.*, th FROM p JOIN b USING ({keys}) WHERE t >= {start} AND lv >= th),
f AS (SELECT {keys}, min(t) AS t FROM c GROUP BY {keys}),
r AS (SELECT {keys}, CASE WHEN c.t = {start} OR lv = b4 THEN CAST(c.t AS DOUBLE) ELSE c.t - 1 + (th - b4) / (lv - b4) END AS onset FROM c JOIN f USING ({keys}, t))
SELECT {keys}, round(onset, 6) AS onset FROM b LEFT JOIN r USING ({keys})"""


_FRACTION = "CASE WHEN max(lv) > min(lv) THEN least(min(lv) + 0.5 * (max(lv) - min(lv)), max(lv)) END"
_STD = "avg(lv) FILTER (WHERE early) + 1.5 * stddev_pop(lv) FILTER (WHERE early)"
_SLOPE = "avg(lv) FILTER (WHERE early) + 1.0 * stddev_pop(lv) FILTER (WHERE early) + 0.5"
_AFTER = "CASE WHEN max(lv) > avg(lv) FILTER (WHERE t < 10) THEN least(avg(lv) FILTER (WHERE t < 10) + 0.8 * (max(lv) - avg(lv) FILTER (WHERE t < 10)), max(lv)) END"
_EMPTY = "CASE WHEN max(lv) > coalesce(avg(lv) FILTER (WHERE t >= 12 AND t < 12), min(lv)) THEN least(min(lv) + 0.5 * (max(lv) - min(lv)), max(lv)) END"


def _onsets(spark: SparkSession, sf_dir: str, **detector) -> DataFrame:
    return _rounded(onset.onset_time(tables.traces_from_events(spark, sf_dir), **detector), "onset")


@_query(_onset_sql(_TR, "roi_id", "raw", _FRACTION))
def onset_fraction(spark, sf_dir):
    return _onsets(spark, sf_dir)


@_query(_onset_sql(_TR, "roi_id", "raw", _STD))
def onset_std(spark, sf_dir):
    return _onsets(spark, sf_dir, method="std", k=1.5)


@_query(_onset_sql(_TR, "roi_id", "raw", _SLOPE, y=_GRADIENT))
def onset_derivative(spark, sf_dir):
    return _onsets(spark, sf_dir, method="derivative", k=1.0, d=0.5)


@_query(_onset_sql(_TR, "roi_id", "raw", _AFTER, start=10))
def onset_after_baseline(spark, sf_dir):
    return _onsets(spark, sf_dir, frac=0.8, baseline_region=(0, 10))


@_query(_onset_sql(_TR, "roi_id", "raw", _EMPTY, start=12))
def onset_empty_region(spark, sf_dir):
    return _onsets(spark, sf_dir, baseline_region=(12, 12))


_PIXELS = _MV + ", tr AS (SELECT * FROM mv)"
_BINNED = _MV + ", tr AS (SELECT t, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM mv WHERE y < 6 GROUP BY ALL)"


@_query(_onset_sql(_PIXELS, "y, x", "v", _FRACTION))
def onset_map(spark, sf_dir):
    return _rounded(onset.onset_map(tables.movie_from_lineitem(spark, sf_dir), H, W), "onset")


@_query(_onset_sql(_BINNED, "y, x", "v", _FRACTION))
def onset_map_binned(spark, sf_dir):
    return _rounded(onset.onset_map(tables.movie_from_lineitem(spark, sf_dir), H, W, bin_size=2), "onset")


# --- propagation ------------------------------------------------------------------

_POINTS = f"""WITH {_TR}, lim AS (SELECT roi_id, min(raw) AS lo, max(raw) AS hi FROM tr GROUP BY roi_id),
p AS (SELECT tr.*, lag(raw) OVER (PARTITION BY roi_id ORDER BY t) AS b4 FROM tr),
c AS (SELECT p.*, least(lo + 0.5 * (hi - lo), hi) AS th FROM p JOIN lim USING (roi_id) WHERE hi > lo AND raw >= least(lo + 0.5 * (hi - lo), hi)),
f AS (SELECT roi_id, min(t) AS t FROM c GROUP BY roi_id),
pt AS (SELECT roi_id, CASE WHEN c.t = 0 OR raw = b4 THEN CAST(c.t AS DOUBLE) ELSE c.t - 1 + (th - b4) / (raw - b4) END AS onset,
              CAST(roi_id // 15 AS DOUBLE) AS cy, CAST(roi_id % 15 AS DOUBLE) AS cx FROM c JOIN f USING (roi_id, t))"""
_MOMENTS = """m AS (SELECT count(*) AS n, avg(cx) AS mx, avg(cy) AS my, avg(onset) AS mt, var_pop(cx) AS sxx, var_pop(cy) AS syy, covar_pop(cx, cy) AS sxy,
       covar_pop(cx, onset) AS sxt, covar_pop(cy, onset) AS syt FROM pt)"""
_LINE = f"""{_MOMENTS}, a AS (SELECT *, sin(0.5 * atan2(2 * sxy, sxx - syy)) AS dy, cos(0.5 * atan2(2 * sxy, sxx - syy)) AS dx FROM m),
l AS (SELECT *, (dy * syt + dx * sxt) / (dy * dy * syy + 2 * dy * dx * sxy + dx * dx * sxx) AS slope FROM a),
fit AS (SELECT n, 1 / abs(slope) AS speed, sign(slope) * dy AS dir_y, sign(slope) * dx AS dir_x FROM l)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.traces_from_events(spark, sf_dir)
    return propagation.responding(onset.onset_time(found), tables.rois_of_traces(found))


@_query(f"{_POINTS} SELECT roi_id AS source_roi, round(onset, 6) AS source_onset FROM pt ORDER BY onset, roi_id LIMIT 1")
def propagation_source(spark, sf_dir):
    return _rounded(propagation.source_roi(_points(spark, sf_dir)), "source_onset")


@_query(f"""{_POINTS} SELECT a.roi_id AS i, b.roi_id AS j, round(sqrt((b.cy - a.cy) * (b.cy - a.cy) + (b.cx - a.cx) * (b.cx - a.cx)), 6) AS distance,
round(b.onset - a.onset, 6) AS delta_t,
CASE WHEN b.onset = a.onset THEN CAST('Infinity' AS DOUBLE)
     ELSE round(sqrt((b.cy - a.cy) * (b.cy - a.cy) + (b.cx - a.cx) * (b.cx - a.cx)) / abs(b.onset - a.onset), 3) END AS speed_px_per_frame
FROM pt a JOIN pt b ON a.roi_id < b.roi_id""")
def propagation_pairwise(spark, sf_dir):
    pairs = _rounded(propagation.pairwise_speeds(_points(spark, sf_dir)), "distance", "delta_t")
    return pairs.withColumn("speed_px_per_frame", _round("speed_px_per_frame", 3))


@_query(f"{_POINTS}, {_LINE} SELECT n, round(speed, 4) AS speed, round(dir_y, 6) AS dir_y, round(dir_x, 6) AS dir_x FROM fit")
def propagation_line(spark, sf_dir):
    return _rounded(propagation.line_fit(_points(spark, sf_dir)), "dir_y", "dir_x").withColumn("speed", _round("speed", 4))


@_query(f"""{_POINTS}, {_MOMENTS}, g AS (SELECT n, (syy * sxt - sxy * syt) / (sxx * syy - sxy * sxy) AS a, (sxx * syt - sxy * sxt) / (sxx * syy - sxy * sxy) AS b FROM m)
SELECT n, round(1 / sqrt(a * a + b * b), 4) AS speed, round(b / sqrt(a * a + b * b), 6) AS dir_y, round(a / sqrt(a * a + b * b), 6) AS dir_x FROM g""")
def propagation_plane(spark, sf_dir):
    return _rounded(propagation.fit(_points(spark, sf_dir), "auto"), "dir_y", "dir_x").withColumn("speed", _round("speed", 4))


@_query(f"""{_POINTS}, {_LINE}, s AS (SELECT onset AS t0, cy AS y0, cx AS x0 FROM pt ORDER BY onset, roi_id LIMIT 1),
d AS (SELECT onset - t0 AS delay, (cy - y0) * dir_y + (cx - x0) * dir_x AS r, speed FROM pt, s, fit)
SELECT count(*) AS n, round(1 - sum((delay - r / speed) * (delay - r / speed)) / (var_pop(delay) * count(*)), 6) AS r2 FROM d""")
def propagation_r2(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _rounded(propagation.delay_r2(points, propagation.line_fit(points)), "r2")


# --- movies -----------------------------------------------------------------------


@_query(f"""WITH {_MV}, a AS (SELECT (t - 5) // 3 AS t, y, x, avg(v) AS v FROM mv WHERE t >= 5 AND t < 74 GROUP BY 1, 2, 3),
w AS (SELECT t, y - 1 AS y, x - 2 AS x, v FROM a WHERE y >= 1 AND y < 7 AND x >= 2 AND x < 16)
SELECT t, y // 2 AS y, x // 2 AS x, trunc(v) AS v FROM w WHERE y % 2 = 0 AND x % 2 = 0""")
def import_downsample(spark, sf_dir):
    movie = tables.movie_from_lineitem(spark, sf_dir)
    return mv.import_movie(movie, T, start=5, end=75, temporal_step=3, spatial_step=2, spatial_window=(1, 7, 2, 16), integer=True)


@_query(f"WITH {_MV} SELECT t // 4 AS t, y, x, round(avg(v), 6) AS v FROM mv WHERE t < 80 GROUP BY 1, 2, 3")
def temporal_average(spark, sf_dir):
    return _rounded(mv.average_time(tables.movie_from_lineitem(spark, sf_dir), 4, T), "v")


@_query(f"WITH {_MV} SELECT t, y // 3 AS y, x // 3 AS x, v FROM mv WHERE y % 3 = 0 AND x % 3 = 0")
def spatial_stride(spark, sf_dir):
    return mv.stride_space(tables.movie_from_lineitem(spark, sf_dir), 3)


@_query("SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, l_linenumber - 1 AS y, l_suppkey % 16 AS x, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3", ints=("y",))
def channel_select(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    channel = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("t")
    pixels = lines.select(month, channel.alias("c"), (F.col("l_linenumber") - 1).alias("y"), F.pmod("l_suppkey", F.lit(16)).alias("x"), "l_quantity")
    return mv.select_channel(pixels, 2).groupBy("t", "y", "x").agg(F.sum("l_quantity").alias("v"))


@_query(f"WITH {_MV} SELECT y, x, round((max(v) - arg_min(v, t)) / (arg_min(v, t) + 1e-12), 4) AS rise FROM mv GROUP BY y, x")
def max_projection(spark, sf_dir):
    return mv.max_projection(tables.movie_from_lineitem(spark, sf_dir)).withColumn("rise", _round("rise", 4))


@_query(f"WITH {_MV}, q AS (SELECT min(v) AS lo, quantile_cont(v, 0.99) AS p FROM mv WHERE t = 0) SELECT round(lo, 6) AS lo, round(CASE WHEN p <= lo THEN lo + 1 ELSE p END, 6) AS hi FROM q")
def intensity_levels(spark, sf_dir):
    return _rounded(mv.intensity_levels(tables.movie_from_lineitem(spark, sf_dir)), "lo", "hi")


@_query(f"WITH {_MV} SELECT y, x, round(avg(v), 6) AS v FROM mv GROUP BY y, x")
def reference_mean(spark, sf_dir):
    return _rounded(mv.mean_frame(tables.movie_from_lineitem(spark, sf_dir)), "v")


@_query(f"WITH {_MV} SELECT t, y, x, v FROM mv")
def frame_round_trip(spark, sf_dir):
    return mv.to_pixels(mv.to_frames(tables.movie_from_lineitem(spark, sf_dir), H, W))


# --- regions ------------------------------------------------------------------------

_POLYGON = ((0.5, 1.5), (5.5, 3.0), (4.0, 12.5), (1.0, 9.0))
_ROIS = (
    (0, 3.0, 4.0, 2.5, "circle", None),
    (1, 2.0, 11.0, 1.5, "square", None),
    (2, 0.0, 0.0, 0.0, "polygon", _POLYGON),
    (3, 30.0, 30.0, 1.0, "circle", None),
)


def _rois(spark: SparkSession, *shapes: str) -> DataFrame:
    rows = [(i, cy, cx, size, shape, [{"y": y, "x": x} for y, x in v] if v else None) for i, cy, cx, size, shape, v in _ROIS if not shapes or shape in shapes]
    return spark.createDataFrame(rows, f"roi_id int, cy double, cx double, size double, shape string, vertices {regions.VERTICES}")


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_POLYGON, _POLYGON[-1:] + _POLYGON[:-1], strict=True))
_GRID = f"g AS (SELECT y, x FROM range({H}) a(y), range({W}) b(x))"
_INSIDE = f"""e AS (SELECT * FROM (VALUES {_EDGES}) e(ay, ax, py, px)),
poly AS (SELECT y, x FROM g, e GROUP BY y, x HAVING sum(CASE WHEN (ay > y) <> (py > y) AND x < (px - ax) * (y - ay) / (py - ay + 1e-12) + ax THEN 1 ELSE 0 END) % 2 = 1)"""
_MASK = f"""{_GRID}, {_INSIDE}, mask AS (
  SELECT 0 AS roi_id, y, x FROM g WHERE (y - 3.0) * (y - 3.0) + (x - 4.0) * (x - 4.0) <= 6.25
  UNION ALL SELECT 1, y, x FROM g WHERE abs(y - 2.0) <= 1.5 AND abs(x - 11.0) <= 1.5
  UNION ALL SELECT 2, y, x FROM poly)"""


def _mask_sums(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    mask = regions.roi_mask(_rois(spark, shape), H, W)
    return _rounded(tables.movie_from_lineitem(spark, sf_dir).join(mask, ["y", "x"]).groupBy("roi_id", "y", "x").agg(F.sum("v").alias("total")), "total")


def _mask_sql(roi: int) -> str:
    return f"WITH {_MV}, {_MASK} SELECT roi_id, mask.y, mask.x, round(sum(v), 6) AS total FROM mask JOIN mv ON mv.y = mask.y AND mv.x = mask.x WHERE roi_id = {roi} GROUP BY ALL"


@_query(_mask_sql(0), ints=("roi_id",))
def roi_circle(spark, sf_dir):
    return _mask_sums(spark, sf_dir, "circle")


@_query(_mask_sql(1), ints=("roi_id",))
def roi_square(spark, sf_dir):
    return _mask_sums(spark, sf_dir, "square")


@_query(_mask_sql(2), ints=("roi_id",))
def roi_polygon(spark, sf_dir):
    return _mask_sums(spark, sf_dir, "polygon")


@_query(f"""WITH {_TR}, v AS (SELECT roi_id, t, raw AS y, 1.5 * t + raw * t AS x, count(*) OVER (PARTITION BY roi_id) AS n FROM tr),
e AS (SELECT a.roi_id, a.y AS ay, a.x AS ax, b.y AS py, b.x AS px FROM v a JOIN v b ON a.roi_id = b.roi_id AND b.t = (a.t + a.n - 1) % a.n),
s AS (SELECT roi_id, sum(px * ay - ax * py) AS a2, avg(ay) AS my, avg(ax) AS mx, sum((py + ay) * (px * ay - ax * py)) AS sy, sum((px + ax) * (px * ay - ax * py)) AS sx FROM e GROUP BY roi_id)
SELECT roi_id, round(CASE WHEN abs(a2) < 1e-9 THEN my ELSE sy / (3 * a2) END, 4) AS y, round(CASE WHEN abs(a2) < 1e-9 THEN mx ELSE sx / (3 * a2) END, 4) AS x FROM s""")
def roi_centroid(spark, sf_dir):
    """Every trace read as a polygon of all its points."""
    found = tables.traces_from_events(spark, sf_dir)
    vertex = F.struct("t", F.col("raw").alias("y"), (F.lit(1.5) * F.col("t") + F.col("raw") * F.col("t")).alias("x"))
    shapes = found.groupBy("roi_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    vertices = F.transform("v", lambda v: F.struct(v["y"].alias("y"), v["x"].alias("x")))
    centre = regions.polygon_centroid(F.col("vertices"))
    return shapes.select("roi_id", vertices.alias("vertices")).select("roi_id", centre.alias("c")).select("roi_id", _round("c.y", 4).alias("y"), _round("c.x", 4).alias("x"))


@_query(f"""WITH {_MV}, {_MASK}, means AS (SELECT roi_id, t, avg(v) AS raw FROM mask JOIN mv ON mv.y = mask.y AND mv.x = mask.x GROUP BY roi_id, t)
SELECT r AS roi_id, f.t, round(coalesce(raw, 0.0), 6) AS raw FROM range(4) a(r) CROSS JOIN range({T}) f(t) LEFT JOIN means ON means.roi_id = r AND means.t = f.t""")
def roi_traces(spark, sf_dir):
    return _rounded(regions.roi_traces(tables.movie_from_lineitem(spark, sf_dir), _rois(spark), T, H, W), "raw")


_LEAVES = ((0, 0, 4, 0, 8), (1, 2, 7, 6, 16))


def _leaves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_LEAVES), "leaf_id int, y0 int, y1 int, x0 int, x1 int")


@_query(f"""WITH {_TR}, c AS (SELECT DISTINCT roi_id, CAST(roi_id // 15 AS DOUBLE) AS cy, CAST(roi_id % 15 AS DOUBLE) AS cx FROM tr),
l AS (SELECT * FROM (VALUES {", ".join(map(str, _LEAVES))}) l(leaf_id, y0, y1, x0, x1))
SELECT roi_id, coalesce(min(leaf_id), -1) AS leaf_id FROM c LEFT JOIN l ON cy >= y0 AND cy < y1 AND cx >= x0 AND cx < x1 GROUP BY roi_id""", ints=("leaf_id",))
def leaf_assign(spark, sf_dir):
    rois = tables.rois_of_traces(tables.traces_from_events(spark, sf_dir))
    return regions.assign_leaves(rois, _leaves(spark)).select("roi_id", F.coalesce("leaf_id", F.lit(-1)).alias("leaf_id"))


def _shift(t: Column) -> tuple[Column, Column]:
    """The frame's whole-pixel motion in the fixtures below."""
    return F.pmod(t, F.lit(3)) - 1, F.pmod(t, F.lit(5)) - 2


@_query(f"""WITH {_MV}, l AS (SELECT * FROM (VALUES {", ".join(map(str, _LEAVES))}) l(leaf_id, y0, y1, x0, x1)),
w AS (SELECT leaf_id, d.t, d.y, d.x, CASE WHEN d.y + d.t % 3 - 1 BETWEEN y0 AND y1 - 1 AND d.x + d.t % 5 - 2 BETWEEN x0 AND x1 - 1 THEN s.v ELSE 0.0 END AS v
      FROM mv d JOIN l ON d.y >= y0 AND d.y < y1 AND d.x >= x0 AND d.x < x1 LEFT JOIN mv s ON s.t = d.t AND s.y = d.y + d.t % 3 - 1 AND s.x = d.x + d.t % 5 - 2),
last AS (SELECT t, y, x, arg_max(coalesce(v, 0.0), leaf_id) AS v FROM w GROUP BY t, y, x)
SELECT mv.t, mv.y, mv.x, coalesce(last.v, mv.v) AS v FROM mv LEFT JOIN last ON last.t = mv.t AND last.y = mv.y AND last.x = mv.x""")
def leaf_composite(spark, sf_dir):
    movie = tables.movie_from_lineitem(spark, sf_dir)
    dy, dx = _shift(F.col("t"))
    boxes = _leaves(spark).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    inside = movie.select("t", "y", "x").join(F.broadcast(boxes), ["y", "x"])
    inside = inside.withColumn("sy", F.col("y") + dy).withColumn("sx", F.col("x") + dx)
    source = movie.select("t", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    fits = (F.col("sy") >= F.col("y0")) & (F.col("sy") < F.col("y1")) & (F.col("sx") >= F.col("x0")) & (F.col("sx") < F.col("x1"))
    warped = inside.join(source, ["t", "sy", "sx"], "left").select("leaf_id", "t", "y", "x", F.when(fits, F.col("v")).otherwise(F.lit(0.0)).alias("v"))
    return regions.composite(movie, warped)


@_query(f"""WITH {_TR}, d AS (SELECT roi_id % 2 AS leaf_id, t, max(raw) / 10 AS dy, min(raw) / 20 AS dx FROM tr GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES {", ".join(map(str, _LEAVES))}) l(leaf_id, y0, y1, x0, x1))
SELECT d.leaf_id, t FROM d JOIN l ON l.leaf_id = d.leaf_id WHERE sqrt(dy * dy + dx * dx) > 0.25 * least(y1 - y0, x1 - x0)""")
def drift_flags(spark, sf_dir):
    found = tables.traces_from_events(spark, sf_dir)
    moves = found.groupBy(F.pmod("roi_id", F.lit(2)).cast("int").alias("leaf_id"), "t").agg((F.max("raw") / 10).alias("dy"), (F.min("raw") / 20).alias("dx"))
    return regions.drift_flags(moves, _leaves(spark))


@_query(f"""WITH {_MV}, {_GRID}, c AS (SELECT t, 3.0 + t % 3 - 1 AS cy, 7.0 + t % 5 - 2 AS cx FROM range({T}) a(t)),
m AS (SELECT c.t, avg(v) AS raw FROM c JOIN mv ON mv.t = c.t AND (y - cy) * (y - cy) + (x - cx) * (x - cx) <= 4.0 GROUP BY c.t)
SELECT 0 AS roi_id, c.t, round(coalesce(raw, 0.0), 6) AS raw FROM c LEFT JOIN m ON m.t = c.t""", ints=("roi_id",))
def tracked_traces(spark, sf_dir):
    rois = spark.createDataFrame([(0, 3.0, 7.0, 2.0, "circle", None)], f"roi_id int, cy double, cx double, size double, shape string, vertices {regions.VERTICES}")
    t = F.col("id").cast("int")
    dy, dx = _shift(t)
    moves = spark.range(T).select(t.alias("t"), regions.rigid_to_matrix(dy.cast("double"), dx.cast("double"), F.lit(0.0)).alias("m"))
    return _rounded(regions.tracked_traces(tables.movie_from_lineitem(spark, sf_dir), rois, moves, T, H, W), "raw")


@_query(f"WITH {_TR} SELECT roi_id, t, round(raw, 6) AS dy, round(raw / 2, 6) AS dx, round(CAST(t % 90 AS DOUBLE), 6) AS theta FROM tr")
def matrix_round_trip(spark, sf_dir):
    found = tables.traces_from_events(spark, sf_dir)
    m = regions.rigid_to_matrix(F.col("raw"), F.col("raw") / 2, (F.col("t") % 90).cast("double"))
    back = found.select("roi_id", "t", regions.matrix_to_rigid(m).alias("r"))
    return _rounded(back.select("roi_id", "t", "r.dy", "r.dx", "r.theta"), "dy", "dx", "theta")


# --- kymographs -----------------------------------------------------------------------

_PATH = ((1.0, 1.0), (3.5, 6.0), (3.5, 6.0), (5.0, 14.5))


def _kymo_sql(across: int, step: float, baseline: bool = False) -> str:
    rows = ", ".join(f"({p}, CAST({d!r} AS DOUBLE), {y}, {x}, CAST({w!r} AS DOUBLE))" for p, d, y, x, w in kymo.path_weights(_PATH, H, W, across, step))
    base = f"WITH {_MV}, k AS (SELECT * FROM (VALUES {rows}) k(pos, distance, y, x, w)), r AS (SELECT pos, distance, t, sum(w * v) AS value FROM k JOIN mv ON mv.y = k.y AND mv.x = k.x GROUP BY ALL)"
    if not baseline:
        return f"{base} SELECT pos, round(distance, 6) AS distance, t, round(value, 6) AS value FROM r"
    return f"""{base}, b AS (SELECT *, avg(CASE WHEN t < 12 THEN value END) OVER (PARTITION BY pos) AS f0 FROM r)
SELECT pos, round(distance, 6) AS distance, t, round(CASE WHEN f0 = 0 THEN 0.0 ELSE (value - f0) / f0 END, 6) AS value FROM b"""


def _kymo(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _rounded(kymo.kymograph(tables.movie_from_lineitem(spark, sf_dir), _PATH, H, W, **options), "distance", "value")


@_query(_kymo_sql(1, 1.0), ints=("pos",))
def kymograph(spark, sf_dir):
    return _kymo(spark, sf_dir)


@_query(_kymo_sql(3, 0.75), ints=("pos",))
def kymograph_wide(spark, sf_dir):
    return _kymo(spark, sf_dir, across=3, step=0.75)


@_query(_kymo_sql(1, 1.0, baseline=True), ints=("pos",))
def kymograph_dff(spark, sf_dir):
    return _kymo(spark, sf_dir, baseline=(0, 12))


# --- export and units ---------------------------------------------------------------


@_query(f"""WITH {_TR}, d AS (SELECT *, avg(CASE WHEN t < 10 THEN raw END) OVER (PARTITION BY roi_id) AS f0 FROM tr),
g AS (SELECT frame, roi_id FROM (SELECT DISTINCT t AS frame FROM tr), (SELECT DISTINCT roi_id FROM tr))
SELECT g.frame, round(g.frame * CAST(0.5 AS DOUBLE), 6) AS seconds, g.roi_id, raw AS f, round({_ratio("raw - f0", "f0")}, 6) AS dff
FROM g LEFT JOIN d ON d.t = g.frame AND d.roi_id = g.roi_id""")
def traces_wide(spark, sf_dir):
    """The wide export of all traces, read back cell by cell."""
    found = traces.delta_f(tables.traces_from_events(spark, sf_dir))
    columns = export.wide_columns(found)
    wide = export.wide_rows(found, {"F": "raw", "dFF": "dff"}, columns)
    cells = wide.select("frame", F.posexplode("cells").alias("at", "v"))
    cells = cells.groupBy("frame", F.floor(F.col("at") / 2).alias("place")).agg(*[F.max(F.when(F.col("at") % 2 == k, F.col("v"))).alias(c) for k, c in enumerate(("f", "dff"))])
    read = cells.join(columns, "place").select("frame", (F.col("frame") * 0.5).alias("seconds"), "roi_id", "f", "dff")
    return _rounded(read, "seconds", "dff")


@_query(f"{_POINTS}, {_LINE} SELECT round(speed, 4) AS px_per_frame, round(speed * 0.65 / 0.25, 3) AS um_per_s, 'µm/s' AS unit FROM fit")
def speed_units(spark, sf_dir):
    scaled = units.speed_units(F.lit(0.65), F.lit(0.25))
    fit = propagation.line_fit(_points(spark, sf_dir))
    return fit.select(_round("speed", 4).alias("px_per_frame"), _round(F.col("speed") * scaled["factor"], 3).alias("um_per_s"), scaled["unit"].alias("unit"))


#: Spellings of all known units, and some that are none, with the expected factors.
_UNITS = [(u, f) for u, f in units.LENGTHS_UM.items()] + [(f" {u.upper()} ", f) for u, f in units.LENGTHS_UM.items() if u.isascii()] + [("μm", 1.0), ("furlong", None), ("pixel", None), ("", None)]
_UNIT_ROWS = ", ".join(f"({k}, {'NULL' if f is None else f'CAST({f!r} AS DOUBLE)'})" for k, (_, f) in enumerate(_UNITS))


@_query(f"""WITH u AS (SELECT * FROM (VALUES {_UNIT_ROWS}) u(k, f))
SELECT p_partkey, round(p_retailprice * f, 3) AS um FROM part JOIN u ON k = p_partkey % {len(_UNITS)}""")
def unit_factors(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    unit = F.get(F.array(*[F.lit(u) for u, _ in _UNITS]), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    return part.select("p_partkey", _round(units.positive(F.col("p_retailprice")) * units.factor(unit, units.LENGTHS_UM), 3).alias("um"))


@_query("SELECT p_partkey, CASE WHEN v >= 5 * p THEN 5 * p WHEN v >= 2 * p THEN 2 * p ELSE p END AS bar FROM (SELECT p_partkey, p_retailprice / 5 AS v, pow(10.0, floor(log10(p_retailprice / 5))) AS p FROM part)")
def scale_bar(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", units.scale_bar(F.col("p_retailprice")).alias("bar"))


# --- registration ---------------------------------------------------------------------

_SHIFTS = """SELECT recording, t, round(CAST(t * (recording % 3 - 1) AS DOUBLE), 1) AS dy, round(CAST(t * (recording % 5 - 2) AS DOUBLE), 1) AS dx
FROM (SELECT vec_id // 64 AS recording FROM embeddings GROUP BY 1 HAVING count(*) = 64), range(3) r(t)"""


def _shifts(found: DataFrame) -> DataFrame:
    """Shifts of the window's centre, to a tenth of a pixel."""
    y, x = regions.map_point(F.lit(23.5), F.lit(23.5), F.col("m"), F.lit(0.0), F.lit(0.0))
    tenth = lambda c: (F.round(c, 1) + F.lit(0.0))
    return found.select("recording", "t", tenth(y - 23.5).alias("dy"), tenth(x - 23.5).alias("dx"))


@_query(_SHIFTS)
def register_translation(spark, sf_dir):
    return _shifts(motion.register(tables.drifting_frames(spark, sf_dir), "first", "translation", ("recording",)))


@_query(_SHIFTS)
def register_affine(spark, sf_dir):
    return _shifts(motion.register(tables.drifting_frames(spark, sf_dir), "first", "affine", ("recording",)))


@_query(_SHIFTS)
def register_previous(spark, sf_dir):
    return _shifts(motion.register(tables.drifting_frames(spark, sf_dir), "previous", "rigid_body", ("recording",)))


@_query("""SELECT recording, t, round(CAST(recording % 3 - 1 AS DOUBLE), 1) AS dy, round(CAST(recording % 5 - 2 AS DOUBLE), 1) AS dx
FROM (SELECT vec_id // 64 AS recording FROM embeddings GROUP BY 1 HAVING count(*) = 64), (VALUES (2), (3)) r(t)""", ints=("t",))
def register_moving_average(spark, sf_dir):
    """Steps between means of three frames, of those whose window is whole; the means blur, but move as the frames do."""
    frames = tables.drifting_frames(spark, sf_dir, 5)
    found = motion.register(frames, "previous", "translation", ("recording",), moving_average=3)
    at = lambda k: F.get("m", F.lit(k))
    moves = found.select("recording", "t", at(5).alias("y"), at(2).alias("x"))
    before = moves.select("recording", (F.col("t") + 1).alias("t"), F.col("y").alias("y0"), F.col("x").alias("x0"))
    steps = moves.join(before, ["recording", "t"]).where(F.col("t").isin(2, 3))
    return steps.select("recording", "t", (F.round(F.col("y") - F.col("y0"), 1) + F.lit(0.0)).alias("dy"), (F.round(F.col("x") - F.col("x0"), 1) + F.lit(0.0)).alias("dx"))


@_query("SELECT vec_id // 64 AS recording, true AS steadier FROM embeddings GROUP BY 1 HAVING count(*) = 64")
def stabilised_frames(spark, sf_dir):
    """Whether warping brings the inner pixels closer to the first frame (or nothing moved)."""
    frames = tables.drifting_frames(spark, sf_dir)
    found = motion.register(frames, "first", "affine", ("recording",))

    def inner(df: DataFrame, name: str) -> DataFrame:
        px = mv.to_pixels(df, ("recording",)).where(F.col("y").between(8, 39) & F.col("x").between(8, 39))
        return px.select("recording", "t", "y", "x", F.col("v").alias(name))

    first = inner(frames.where(F.col("t") == 0), "first").drop("t")
    both = inner(frames, "before").join(inner(motion.stabilise(frames, found, ("recording",)), "after"), ["recording", "t", "y", "x"]).join(first, ["recording", "y", "x"])
    error = lambda c: F.avg((F.col(c) - F.col("first")) ** 2)
    sums = both.groupBy("recording").agg(error("before").alias("before"), error("after").alias("after"))
    return sums.select("recording", (F.col("after") <= F.lit(0.1) * F.col("before") + 1e-6).alias("steadier"))


@_query(f"""WITH {_MV} SELECT d.t, d.y, d.x, round(coalesce(s.v, 0.0), 2) AS v
FROM mv d LEFT JOIN mv s ON s.t = d.t AND s.y = d.y + d.t % 3 - 1 AND s.x = d.x + d.t % 5 - 2""")
def warp_whole_pixels(spark, sf_dir):
    """Warping by whole pixels moves values and leaves 0 where nothing comes from."""
    frames = mv.to_frames(tables.movie_from_lineitem(spark, sf_dir), H, W)
    dy, dx = _shift(F.col("t"))
    moves = frames.select("t", regions.rigid_to_matrix(dy.cast("double"), dx.cast("double"), F.lit(0.0)).alias("m"))
    moved = mv.to_pixels(motion.stabilise(frames, moves))
    return moved.select("t", "y", "x", (F.round("v", 2) + F.lit(0.0)).alias("v"))


_RECORDINGS = "(SELECT vec_id // 64 AS r FROM embeddings GROUP BY 1 HAVING count(*) = 64), range(3) f(t)"


def _hundredth(c: Column) -> Column:
    return F.round(c, 2) + F.lit(0.0)


def _twentieth(c: Column) -> Column:
    return F.round(F.round(c * 20) / 20, 2) + F.lit(0.0)


@_query(f"""SELECT r AS recording, t, round(CAST(t * (r % 3 - 1) AS DOUBLE) / 2, 2) + 0.0 AS dy, round(CAST(t * (r % 5 - 2) AS DOUBLE) / 4, 2) + 0.0 AS dx,
round(t * (r % 4 - CAST(1.5 AS DOUBLE)), 2) + 0.0 AS theta FROM {_RECORDINGS}""")
def register_rotated(spark, sf_dir):
    """Sub-pixel shifts to a fortieth and angles to a twentieth of a degree either way."""
    found = motion.register(tables.turning_frames(spark, sf_dir), "first", "rigid_body", ("recording",))
    y, x = regions.map_point(F.lit(23.5), F.lit(23.5), F.col("m"), F.lit(0.0), F.lit(0.0))
    return found.select("recording", "t", _twentieth(y - 23.5).alias("dy"), _twentieth(x - 23.5).alias("dx"), (F.round(regions.matrix_to_rigid(F.col("m"))["theta"], 1) + F.lit(0.0)).alias("theta"))


@_query(f"""SELECT r AS recording, t, round(CAST(t * (r % 3 - 1) AS DOUBLE) / 2, 2) + 0.0 AS dy, round(CAST(t * (r % 5 - 2) AS DOUBLE) / 4, 2) + 0.0 AS dx,
round(1 + CAST(0.02 AS DOUBLE) * t, 2) + 0.0 AS xx, round(CAST(0.02 AS DOUBLE) * t * (r % 3 - 1), 2) + 0.0 AS xy, CAST(0 AS DOUBLE) AS yx, CAST(1 AS DOUBLE) AS yy FROM {_RECORDINGS}""")
def register_sheared(spark, sf_dir):
    """Sub-pixel shifts to a fortieth either way, with a stretch and a shear to half a hundredth."""
    found = motion.register(tables.turning_frames(spark, sf_dir, sheared=True), "first", "affine", ("recording",))
    y, x = regions.map_point(F.lit(23.5), F.lit(23.5), F.col("m"), F.lit(0.0), F.lit(0.0))
    entries = [_hundredth(F.get("m", F.lit(k))).alias(n) for k, n in ((0, "xx"), (1, "xy"), (3, "yx"), (4, "yy"))]
    return found.select("recording", "t", _twentieth(y - 23.5).alias("dy"), _twentieth(x - 23.5).alias("dx"), *entries)


_CORNERS = ((0.0, 0.0, 1), (47.0, 0.0, -1), (0.0, 47.0, -1), (47.0, 47.0, 1), (23.5, 23.5, 0))


@_query(f"""SELECT r AS recording, t, x, y, t * (CAST(r % 5 - 2 AS DOUBLE) / 4 + CAST({tables.BEND_X} AS DOUBLE) * bend) + 0.0 AS dx, t * (CAST(r % 3 - 1 AS DOUBLE) / 2 + CAST({tables.BEND_Y} AS DOUBLE) * bend) + 0.0 AS dy
FROM {_RECORDINGS}, (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, bend FROM (VALUES {", ".join(map(str, _CORNERS))}) p(x, y, bend))""")
def register_bilinear(spark, sf_dir):
    """Shifts of the window's corners and centre to a fortieth of a pixel either way; its rim, where content comes from outside, takes no part."""
    frames = tables.bent_frames(spark, sf_dir)
    inner = [5 <= y < 43 and 5 <= x < 43 for y in range(48) for x in range(48)]
    mask = frames.select("recording").distinct().withColumn("mask", F.array(*map(F.lit, inner)))
    found = motion.register_bilinear(frames, "first", ("recording",), mask=mask)
    points = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y, _ in _CORNERS]))
    at = found.select("recording", "t", "m", points.alias("p")).select("recording", "t", "m", "p.*")
    mapped = lambda k: F.get("m", F.lit(k)) + F.get("m", F.lit(k + 1)) * F.col("x") + F.get("m", F.lit(k + 2)) * F.col("y") + F.get("m", F.lit(k + 3)) * F.col("x") * F.col("y")
    return at.select("recording", "t", "x", "y", _twentieth(mapped(0) - F.col("x")).alias("dx"), _twentieth(mapped(4) - F.col("y")).alias("dy"))


#: The upper leaf's outline leaves out a still decoy in its right half; the lower one has no outline.
_OUTLINED = ((0, 2, 24, 2, 46, ((0.0, 0.0), (0.0, 30.0), (26.0, 30.0), (26.0, 0.0))), (1, 26, 46, 4, 44, None))


@_query(f"""SELECT leaf_id, r AS recording, t, round(CAST(t * (r % 3 - 1) AS DOUBLE), 1) + 0.0 AS dy, round(CAST(t * (r % 5 - 2) AS DOUBLE), 1) + 0.0 AS dx,
abs(t * (r % 3 - 1)) * abs(t * (r % 3 - 1)) + abs(t * (r % 5 - 2)) * abs(t * (r % 5 - 2)) > 16 AS far
FROM {_RECORDINGS}, (VALUES (0), (1)) l(leaf_id)""", ints=("leaf_id",))
def register_leaf_masked(spark, sf_dir):
    """Leaf boxes registered on their own; a bright square that stands still lies outside the outline of one of them."""
    frames = tables.drifting_frames(spark, sf_dir)
    spot = lambda i: (F.floor(i / 48).between(6, 18)) & ((i % 48).between(34, 43))
    frames = frames.withColumn("px", F.transform("px", lambda v, i: F.when(spot(i), 2000.0 + 10 * (i % 7)).otherwise(v)))
    schema = f"leaf_id int, y0 int, y1 int, x0 int, x1 int, mask_polygon {regions.VERTICES}"
    one = spark.createDataFrame([(*b, [{"y": y, "x": x} for y, x in v] if v else None) for *b, v in _OUTLINED], schema)
    leaves = frames.select("recording").distinct().join(one, F.lit(True))
    found = motion.register_leaves(frames, leaves, "first", "translation", ("recording",))
    tenth = lambda c: F.round(F.get("m", F.lit(c)), 1) + F.lit(0.0)
    moves = found.select("recording", "leaf_id", "t", tenth(5).alias("dy"), tenth(2).alias("dx"))
    return moves.withColumn("far", F.hypot("dy", "dx") > 4)
