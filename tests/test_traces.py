import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import onset, propagation, traces


def table(spark, *signals):
    rows = [(r, t, float(v)) for r, s in enumerate(signals) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "roi_id int, t int, raw double")


def column(df, name, key="roi_id"):
    out = {}
    for r in df.orderBy(key, "t").collect():
        out.setdefault(r[key], []).append(r[name])
    return out


def step(onset_at, n=60, tau=1.5):
    return 1 / (1 + np.exp(-(np.arange(n) - onset_at) / tau))


def test_default_baseline_is_the_first_ten_frames_or_all(spark):
    rng = np.random.default_rng(0)
    long, short = rng.normal(100, 1, 50), [1.0, 2, 3, 4]
    got = column(traces.delta_f(table(spark, long, short)), "dff")
    assert np.allclose(got[0], long / long[:10].mean() - 1)
    assert np.allclose(got[1], np.array(short) / 2.5 - 1)


def test_baselines_and_zero_denominators(spark):
    t = table(spark, [0.0, 0, 3, -2], [2.0, 4, 6, 8])
    got = column(traces.delta_f(t, n=2), "dff")
    assert math.isnan(got[0][0]) and got[0][2] == math.inf and got[0][3] == -math.inf
    assert np.allclose(column(traces.delta_f(t, region=(1, 3)), "dff")[1], np.array([2, 4, 6, 8]) / 5 - 1)
    assert column(traces.delta_first_frame(t), "dff")[0] == [0, 0, 0, 0]
    assert set(column(traces.delta_f(t, region=(9, 12)), "dff")[1]) == {None}
    for bad in ({"n": 0}, {"n": 1, "region": (0, 1)}, {"region": (-1, 2)}):
        with pytest.raises(ValueError):
            traces.delta_f(t, **bad)


def test_smoothing_mirrors_the_ends(spark):
    rng = np.random.default_rng(1)
    signal = rng.normal(0, 1, 23)
    for sigma in (0.0, 1.0, 2.5, 8.0):
        kernel = np.array([w for _, w in traces.gaussian_kernel(sigma)])
        radius = len(kernel) // 2
        want = np.convolve(np.pad(signal, radius, mode="symmetric") if radius <= 23 else np.pad(signal, radius, mode="symmetric"), kernel, "valid")
        got = column(traces.smooth_gaussian(table(spark, signal), sigma, value="raw"), "smoothed")[0]
        assert np.allclose(got, want)
        # blocks shorter than the kernel, and traces shorter than it
        cut = traces.smooth_gaussian(table(spark, signal, signal[:1], signal[:5]), sigma, value="raw", together=4)
        assert cut.schema["t"].dataType.simpleString() == "int"
        got = column(cut, "smoothed")
        for k, n in enumerate((23, 1, 5)):
            assert np.allclose(got[k], np.convolve(np.pad(signal[:n], radius, mode="symmetric"), kernel, "valid"))
    with pytest.raises(ValueError):
        traces.gaussian_kernel(-1)


def test_gradient_and_running_mean(spark):
    s = [1.0, 4, 9, 16, 20]
    assert np.allclose(column(traces.gradient(table(spark, s)), "slope")[0], np.gradient(s))
    assert column(traces.gradient(table(spark, [3.0])), "slope")[0] == [None]
    cut = column(traces.gradient(table(spark, s, s[:8], s[:9]), together=4), "slope")
    assert all(np.allclose(cut[k], np.gradient(s[:n])) for k, n in enumerate((len(s), 8, 9)))
    for n in (1, 2, 3, 4):
        before, after = -(-n // 2) - 1, n // 2
        padded = np.pad(s, (before, after), mode="edge")
        want = [padded[k : k + n].mean() for k in range(5)]
        for together in (2, traces.TOGETHER):
            assert np.allclose(column(traces.running_mean(table(spark, s), n, ("roi_id",), "raw", together), "mean")[0], want)
            inside = table(spark, s).withColumn("inside", F.col("raw") != 9)
            kept = [all(v != 9 for v in padded[k : k + n]) for k in range(5)]
            assert column(traces.running_all(inside, n, ("roi_id",), together=together), "all_inside")[0] == kept


def test_crop_labels_seconds(spark):
    cut = traces.with_seconds(traces.crop(table(spark, range(10)), 3, 6), 0.5)
    assert [(r.t, r.frame, r.seconds) for r in cut.orderBy("t").collect()] == [(0, 3, 0), (1, 4, 0.5), (2, 5, 1.0)]
    assert traces.with_seconds(cut, None).first().seconds is None
    with pytest.raises(ValueError):
        traces.crop(table(spark, [1]), 4, 4)
    assert traces.choose_signal(["raw", "dff"], "smoothed") == "raw"


def onsets(spark, signal, **detector):
    return onset.onset_time(table(spark, signal), **detector).first().onset


def reference_onset(sig, method="fraction_of_max", frac=0.5, k=3.0, d=0.0, region=None):
    """An independent scan over frames."""
    sig = np.asarray(sig, float)
    if method == "derivative":
        if len(sig) < 2:
            return None
        sig = np.gradient(sig)
    base = sig[region[0] : region[1]] if region else sig[:0]
    if method == "fraction_of_max":
        low = base.mean() if len(base) else sig.min()
        if sig.max() <= low:
            return None
        limit = min(low + frac * (sig.max() - low), sig.max())
    else:
        if not len(base):
            base = sig[: max(1, len(sig) // 10)]
        limit = base.mean() + k * base.std() + (d if method == "derivative" else 0)
    first = region[1] if region else 0
    for j in range(first, len(sig)):
        if sig[j] >= limit:
            if j == first or sig[j] == sig[j - 1]:
                return float(j)
            return j - 1 + (limit - sig[j - 1]) / (sig[j] - sig[j - 1])
    return None


def test_onset_known_answers(spark):
    assert abs(onsets(spark, step(18)) - 18) < 0.5
    assert onsets(spark, [0, 1, 2, 5, 3, 2], frac=1.0) == 3
    assert onsets(spark, np.zeros(40)) is None
    ramp = np.linspace(0, 10, 100)
    assert onsets(spark, ramp, baseline_region=(80, 90)) > onsets(spark, ramp, baseline_region=(0, 10))
    artefact = np.where(np.arange(60) < 5, 10.0, np.where(np.arange(60) >= 40, 10.0, 0.0))
    assert onsets(spark, artefact, baseline_region=(10, 30)) == pytest.approx(39.5)
    jump = np.where(np.arange(60) >= 30, 5.0, 0.0)
    assert 27 <= onsets(spark, jump, method="derivative", d=0.5, baseline_region=(0, 20)) <= 30
    assert onsets(spark, ramp, baseline_region=(0, 100)) is None
    with pytest.raises(ValueError):
        onsets(spark, ramp, method="peak")


def test_onsets_equal_an_independent_scan(spark):
    rng = np.random.default_rng(2)
    signals = [rng.normal(0, 1, n).cumsum() for n in (1, 2, 5, 20, 37, 60)] + [np.full(8, 2.0)]
    for options in ({}, {"frac": 1.0}, {"method": "std", "k": 1.0}, {"method": "derivative", "k": 0.5}, {"region": (2, 6)}, {"region": (3, 3)}, {"method": "std", "region": (0, 4)}):
        detector = {("baseline_region" if k == "region" else k): v for k, v in options.items()}
        got = {r.roi_id: r.onset for r in onset.onset_time(table(spark, *signals), **detector).collect()}
        for i, s in enumerate(signals):
            want = reference_onset(s, **options)
            assert (got[i] is None) == (want is None), (options, i)
            assert want is None or got[i] == pytest.approx(want, abs=1e-9)
        # blocks of four samples: crossings at the edges of blocks, baselines over several
        cut = {r.roi_id: r.onset for r in onset.onset_time(table(spark, *signals), together=4, **detector).collect()}
        assert cut == {i: x if x is None else pytest.approx(x, abs=1e-9) for i, x in got.items()}


def test_onset_at_every_place_of_a_block(spark):
    for method in ({}, {"method": "derivative", "baseline_region": (0, 3)}):
        jumps = [np.where(np.arange(16) >= j, 5.0, 0.0) for j in range(4, 13)]
        got = {r.roi_id: r.onset for r in onset.onset_time(table(spark, *jumps), together=4, **method).collect()}
        want = {i: reference_onset(s, **{("region" if k == "baseline_region" else k): v for k, v in method.items()}) for i, s in enumerate(jumps)}
        assert got == {i: pytest.approx(x) for i, x in want.items()}


def test_onset_of_one_long_trace(spark):
    """400,000 samples, some fifty blocks, beside a short trace."""
    n = 400_000
    long = spark.range(n, numPartitions=8).select(F.lit(0).alias("roi_id"), F.col("id").cast("int").alias("t"), F.when(F.col("id") >= 300_001, 4.0).otherwise(F.col("id") % 2).cast("double").alias("raw"))
    both = long.union(table(spark, step(18)).withColumn("roi_id", F.lit(1)))
    for detector in ({}, {"method": "std"}, {"method": "derivative", "k": 1.0, "d": 1.0}):
        got = {r.roi_id: r.onset for r in onset.onset_time(both, **detector).collect()}
        want = reference_onset(np.where(np.arange(n) >= 300_001, 4.0, np.arange(n) % 2), **detector)
        assert got[0] == pytest.approx(want, abs=1e-6), detector
    assert onset.onset_time(both.where("roi_id = 1").drop("roi_id"), by=()).first().onset == pytest.approx(reference_onset(step(18)))


def test_onset_map_equals_the_detector(spark):
    cells = [(t, y, x, 4.0 * (t >= 25 + y + x)) for t in range(60) for y in range(3) for x in range(4)]
    movie = spark.createDataFrame(cells, "t int, y int, x int, v double")
    got = {(r.y, r.x): r.onset for r in onset.onset_map(movie, 3, 4).collect()}
    assert got == {(y, x): pytest.approx(24.5 + y + x) for y in range(3) for x in range(4)}
    binned = onset.onset_map(movie, 3, 4, bin_size=2).collect()
    assert {(r.y, r.x) for r in binned} == {(0, 0), (0, 1)}
    with pytest.raises(ValueError):
        onset.onset_map(movie, 3, 4, bin_size=5)
    assert onset.onset_summary(onset.onset_map(movie, 3, 4), 10, 0.5).first().n_onsets == 12


def points(spark, *rows):
    return spark.createDataFrame([(i, float(t), float(y), float(x)) for i, (t, y, x) in enumerate(rows)], "roi_id int, onset double, cy double, cx double")


def test_plane_wave(spark):
    centres = [(10, 10), (10, 30), (30, 10), (30, 30)]
    p = points(spark, *[(5 + 0.2 * x + 0.1 * y, y, x) for y, x in centres])
    fit = propagation.fit(p, "auto").first()
    assert fit.speed == pytest.approx(1 / math.hypot(0.2, 0.1))
    assert (fit.dir_y, fit.dir_x) == pytest.approx((0.1 / math.hypot(0.1, 0.2), 0.2 / math.hypot(0.1, 0.2)))
    assert propagation.source_roi(p).first().source_roi == 0
    assert propagation.pairwise_speeds(p).count() == 6
    assert propagation.delay_r2(p, propagation.fit(p, "auto")).first().r2 == pytest.approx(1.0)


def test_lines_and_degenerate_cases(spark):
    line = points(spark, (5, 10, 10), (15, 20, 20), (25, 30, 30), (35, 40, 40))
    for mode in ("roi_line", "auto"):
        fit = propagation.fit(line, mode).first()
        if mode == "roi_line":
            assert fit.speed == pytest.approx(math.sqrt(200) / 10)
        assert (fit.dir_y, fit.dir_x) == pytest.approx((math.sqrt(0.5),) * 2)
    # the plane of least norm, intercept included
    a = np.array([[10, 10, 1], [20, 20, 1], [30, 30, 1], [40, 40, 1.0]])
    gx, gy, _ = np.linalg.lstsq(a, np.array([5, 15, 25, 35.0]), rcond=None)[0]
    assert propagation.plane_fit(line).first().speed == pytest.approx(1 / math.hypot(gx, gy))
    two = points(spark, (20, 0, 0), (10, 0, 20))
    for mode in ("roi_line", "auto"):
        fit = propagation.fit(two, mode).first()
        assert (fit.speed, fit.dir_y, fit.dir_x) == pytest.approx((2.0, 0.0, -1.0), abs=1e-12)
    same_time = propagation.fit(points(spark, (5, 0, 0), (5, 0, 20)), "auto").first()
    assert same_time.speed == math.inf and same_time.dir_x == 1.0
    still = propagation.line_fit(points(spark, (5, 0, 0), (5, 0, 20))).first()
    assert still.speed == math.inf and still.dir_x is None
    assert propagation.line_fit(points(spark, (5, 3, 3), (9, 3, 3))).first().speed is None
    assert propagation.pairwise_speeds(points(spark, (5, 0, 0), (5, 0, 20))).first().speed_px_per_frame == math.inf
    assert propagation.line_fit(points(spark, (1, 1, 1))).count() == 0
    with pytest.raises(ValueError):
        propagation.fit(two, "sideways")


def test_ties_and_several_recordings(spark):
    p = points(spark, (5, 0, 0), (5, 0, 9), (7, 0, 5)).withColumn("recording", F.lit(1))
    both = p.unionByName(p.withColumn("recording", F.lit(2)).withColumn("onset", 10 - F.col("onset")))
    got = {r.recording: r.source_roi for r in propagation.source_roi(both, ("recording",)).collect()}
    assert got == {1: 0, 2: 2}
    assert propagation.pairwise_speeds(both, ("recording",)).count() == 6
    assert propagation.delay_r2(both, propagation.line_fit(both, ("recording",)), ("recording",)).count() == 2


def test_halves_round_as_in_the_sql(spark, tmp_path):
    """Two delays whose seventh decimal is a 5 that subtraction leaves inexact."""
    import datetime

    import duckdb

    from wavelake.jobs import queries

    crossings = {1464: (3, 0.89, 344.45, 93.5, 197.5), 4206: (11, 1.04, 277.19, 59.51, 152.31), 555: (6, 0.35, 262.34, 17.98, 144.38), 5807: (10, 0.02, 331.46, 2.93, 175.73)}
    values = [(user, v) for user, (t, low, high, before, raw) in crossings.items() for v in [low] * (t - 1) + [before, raw, high]]
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), user, v) for k, (user, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, queries.QUERIES["propagation_pairwise"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.execute(queries.ORACLE_SQL["propagation_pairwise"]).fetchall())


def test_pairs_of_many_regions_come_from_a_written_table(spark):
    """However the regions were found, their pairs read them from a table and are listed by several tasks."""
    n = 3000
    found = spark.range(n, numPartitions=1).select(F.col("id").alias("roi_id"), (F.col("id") % 7).cast("double").alias("onset"), F.floor(F.col("id") / 15).cast("double").alias("cy"), F.pmod("id", F.lit(15)).cast("double").alias("cx"))
    pairs = propagation.pairwise_speeds(found)
    assert pairs.inputFiles() and all("/points/" in f for f in pairs.inputFiles())
    assert pairs.rdd.getNumPartitions() >= n * n // propagation.PAIRS_TOGETHER
    assert pairs.count() == n * (n - 1) // 2
    assert propagation.pairwise_speeds(found.where("roi_id < 0")).count() == 0


def test_one_long_trace_spreads_over_tasks(spark):
    """A trace of 300,000 samples in blocks: as many groups, and the same values at their edges."""
    n = 300_000
    one = spark.range(n, numPartitions=8).select(F.lit(0).alias("roi_id"), F.col("id").cast("int").alias("t"), F.sin(F.col("id") / 7.0).alias("raw"))
    got = traces.smooth_gaussian(one, 2.0, value="raw").where(F.pmod(F.col("t"), F.lit(traces.TOGETHER)).isin(0, 1, traces.TOGETHER - 1)).collect()
    kernel = traces.gaussian_kernel(2.0)
    inner = [r for r in got if 8 <= r.t < n - 8]
    assert len(inner) >= 3 * (n // traces.TOGETHER) - 3
    assert all(abs(r.smoothed - sum(w * math.sin((r.t + k) / 7) for k, w in kernel)) < 1e-9 for r in inner)
