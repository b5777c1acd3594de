import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import align
from wavelake.operators import kymograph, motion, movie, regions, traces
from wavelake.session import Recording, register_analysis
from wavelake.sources import tables, tiff
from wavelake.streaming import live


def pixels(spark, stack):
    stack = np.asarray(stack, float)
    rows = [(int(t), int(y), int(x), float(stack[t, y, x])) for t, y, x in np.ndindex(*stack.shape)]
    return spark.createDataFrame(rows, "t int, y int, x int, v double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.t, r.y, r.x] = r.v
    return out


def test_import_steps(spark):
    stack = np.arange(640).reshape(10, 8, 8)
    got = array(movie.import_movie(pixels(spark, stack), 10, 0, 8, 2, 2, integer=True), (4, 4, 4))
    want = stack[:8].reshape(4, 2, 8, 8).mean(axis=1).astype(int)[:, ::2, ::2]
    assert (got == want).all()
    window = array(movie.crop_space(pixels(spark, stack), (1, 4, 2, 8)), (10, 3, 6))
    assert (window == stack[:, 1:4, 2:8]).all()
    two = pixels(spark, stack).withColumn("c", F.lit(0)).unionByName(pixels(spark, stack * 0 + 7).withColumn("c", F.lit(1)))
    assert movie.import_movie(two, 10, channel=1).agg(F.avg("v")).first()[0] == 7
    assert (array(movie.to_pixels(movie.to_frames(pixels(spark, stack), 8, 8)), stack.shape) == stack).all()


def test_projections_and_levels(spark):
    stack = np.random.default_rng(0).uniform(1, 9, (5, 3, 4))
    rise = {(r.y, r.x): r.rise for r in movie.max_projection(pixels(spark, stack)).collect()}
    want = (stack.max(0) - stack[0]) / (stack[0] + 1e-12)
    assert all(rise[y, x] == pytest.approx(want[y, x]) for y in range(3) for x in range(4))
    levels = movie.intensity_levels(pixels(spark, stack)).first()
    assert (levels.lo, levels.hi) == pytest.approx((stack[0].min(), np.percentile(stack[0], 99)))
    flat = movie.intensity_levels(pixels(spark, np.zeros((1, 2, 2)))).first()
    assert (flat.lo, flat.hi) == (0, 1)


def roi_rows(spark, rows):
    return spark.createDataFrame(rows, f"roi_id int, cy double, cx double, size double, shape string, vertices {regions.VERTICES}")


def polygon_mask(points, height, width):
    out = np.zeros((height, width), bool)
    for y in range(height):
        for x in range(width):
            for (ay, ax), (by, bx) in zip(points, points[-1:] + points[:-1]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + 1e-12) + ax:
                    out[y, x] ^= True
    return out


def test_region_masks_and_traces(spark):
    stack = np.random.default_rng(1).uniform(0, 5, (4, 12, 15))
    corners = [(1.5, 2.0), (9.0, 3.5), (7.0, 13.0), (2.0, 8.0)]
    vertices = [{"y": y, "x": x} for y, x in corners]
    rois = roi_rows(spark, [(0, 5.0, 6.0, 3.0, "circle", None), (1, 2.0, 12.0, 1.5, "square", None), (2, 0.0, 0.0, 0.0, "polygon", vertices), (3, 50.0, 50.0, 2.0, "circle", None), (4, 0.0, 0.0, 0.0, "polygon", vertices[:2])])
    yy, xx = np.mgrid[0:12, 0:15]
    masks = {0: (yy - 5) ** 2 + (xx - 6) ** 2 <= 9, 1: (abs(yy - 2) <= 1.5) & (abs(xx - 12) <= 1.5), 2: polygon_mask(corners, 12, 15)}
    got = {(r.roi_id, r.t): r.raw for r in regions.roi_traces(pixels(spark, stack), rois, 4, 12, 15).collect()}
    assert len(got) == 20
    for t in range(4):
        for k, m in masks.items():
            assert got[k, t] == pytest.approx(stack[t][m].mean())
        assert got[3, t] == got[4, t] == 0.0


def test_centroid_assignment_drift(spark):
    v = [{"y": 0.0, "x": 0.0}, {"y": 0.0, "x": 4.0}, {"y": 2.0, "x": 4.0}, {"y": 2.0, "x": 0.0}]
    one = spark.createDataFrame([(v,), ([{"y": 1.0, "x": 1.0}] * 3,)], f"v {regions.VERTICES}")
    got = [tuple(r.c) for r in one.select(regions.polygon_centroid(F.col("v")).alias("c")).collect()]
    assert got == [pytest.approx((1.0, 2.0)), pytest.approx((1.0, 1.0))]
    leaves = spark.createDataFrame([(0, 0, 10, 0, 10), (1, 5, 20, 5, 20)], "leaf_id int, y0 int, y1 int, x0 int, x1 int")
    rois = spark.createDataFrame([(0, 6.0, 6.0), (1, 10.0, 6.0), (2, 30.0, 1.0)], "roi_id int, cy double, cx double")
    assert {r.roi_id: r.leaf_id for r in regions.assign_leaves(rois, leaves).collect()} == {0: 0, 1: 1, 2: None}
    moves = spark.createDataFrame([(0, 0, 2.0, 0.0), (0, 1, 0.0, 2.5), (0, 2, 2.0, 2.0), (1, 0, 3.0, 0.0)], "leaf_id int, t int, dy double, dx double")
    assert {(r.leaf_id, r.t) for r in regions.drift_flags(moves, leaves).collect()} == {(0, 2)}
    outlined = leaves.withColumn("mask_polygon", F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for y, x in ((0, 0), (0, 6), (6, 6), (6, 0))]))
    assert regions.leaf_mask(outlined.where("leaf_id = 0")).count() == 36


def test_regions_follow_a_moving_blob(spark):
    yy, xx = np.mgrid[0:48, 0:48]
    stack = np.stack([200 * np.exp(-((yy - 24) ** 2 + (xx - 14 - 2 * t) ** 2) / 32) for t in range(8)])
    rois = roi_rows(spark, [(0, 24.0, 14.0, 4.0, "circle", None), (1, 0.0, 0.0, 0.0, "polygon", [{"y": y, "x": x} for y, x in ((20.0, 10.0), (20.0, 18.0), (28.0, 18.0), (28.0, 10.0))])])
    moves = spark.createDataFrame([(t, [1.0, 0.0, 2.0 * t, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for t in range(8)], "t int, m array<double>")
    got = regions.tracked_traces(pixels(spark, stack), rois, moves, 8, 48, 48).toPandas()
    for k in (0, 1):
        s = got[got.roi_id == k].raw
        assert s.std() / s.mean() < 0.02
    still = regions.roi_traces(pixels(spark, stack), rois, 8, 48, 48).where("roi_id = 0").orderBy("t").toPandas().raw
    assert still.iloc[-1] < 0.3 * still.iloc[0]


def bilinear(stack, y, x):
    t, h, w = stack.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = int(y), int(x)
    y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return stack[:, y0, x0] * (1 - fy) * (1 - fx) + stack[:, y1, x0] * fy * (1 - fx) + stack[:, y0, x1] * (1 - fy) * fx + stack[:, y1, x1] * fy * fx


def test_kymograph(spark):
    stack = np.random.default_rng(3).uniform(1, 5, (6, 9, 11))
    path = [(1.0, 1.0), (4.5, 7.0), (4.5, 7.0), (8.0, 9.5)]
    at, arc = kymograph.resample_path(path, 0.8)
    assert arc[0] == 0 and arc[-1] == pytest.approx(np.hypot(3.5, 6) + np.hypot(3.5, 2.5)) and np.allclose(np.diff(arc)[:-1], 0.8)
    got = kymograph.kymograph(pixels(spark, stack), path, 9, 11, step=0.8).toPandas()
    for r in got.itertuples():
        assert r.value == pytest.approx(bilinear(stack, *at[r.pos])[r.t])
    slope = np.gradient(at, axis=0)
    slope /= np.hypot(*slope.T)[:, None]
    wide = kymograph.kymograph(pixels(spark, stack), path, 9, 11, across=3, step=0.8).toPandas()
    for r in wide.itertuples():
        mean = np.mean([bilinear(stack, at[r.pos][0] + o * slope[r.pos][1], at[r.pos][1] - o * slope[r.pos][0])[r.t] for o in (-1, 0, 1)])
        assert r.value == pytest.approx(mean)
    rel = kymograph.kymograph(pixels(spark, np.concatenate([np.zeros((2, 9, 11)), stack])), path, 9, 11, baseline=(0, 2)).toPandas()
    assert (rel.value == 0).all()
    for bad in (lambda: kymograph.resample_path([(0, 0)]), lambda: kymograph.resample_path([(0, 0), (0, 0)]), lambda: kymograph.resample_path(path, 0), lambda: kymograph.kymograph(pixels(spark, stack), path, 9, 11, baseline=(3, 3))):
        with pytest.raises(ValueError):
            bad()


def blob_image(dy=0.0, dx=0.0, n=80, turn=0.0):
    y, x = np.mgrid[0:n, 0:n].astype(float)
    c, s = np.cos(turn), np.sin(turn)
    ys, xs = y - n / 2 - dy, x - n / 2 - dx
    y, x = c * ys - s * xs + n / 2, s * ys + c * xs + n / 2
    g = lambda cy, cx, w: np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * w * w))
    return 100 + 150 * (g(30, 50, 8) + 0.4 * g(55, 25, 5))


def frames(spark, images):
    return spark.createDataFrame([(t, i.shape[0], i.shape[1], i.ravel().tolist()) for t, i in enumerate(images)], "t int, height int, width int, px array<double>")


SHIFTS = [(0, 0), (3, -2), (-4, 5), (2, 6)]


@pytest.mark.parametrize(("reference", "model"), [("first", "affine"), ("previous", "rigid_body"), ("mean", "translation"), ("first", "scaled_rotation")])
def test_registration_recovers_motion(spark, reference, model):
    images = [blob_image(*s) for s in SHIFTS]
    f = frames(spark, images)
    found = motion.register(f, reference, model)
    m = {r.t: np.array(r.m).reshape(3, 3) for r in found.collect()}
    if reference != "mean":
        for t, (dy, dx) in enumerate(SHIFTS):
            assert m[t][:2] @ [40, 40, 1] - [40, 40] == pytest.approx([dx, dy], abs=0.1)
    steady = {r.t: np.array(r.px).reshape(80, 80) for r in motion.stabilise(f, found).collect()}
    inner = (slice(12, -12),) * 2
    base = steady[0][inner]
    for t in range(1, 4):
        assert ((steady[t][inner] - base) ** 2).mean() < 0.1 * ((images[t][inner] - images[0][inner]) ** 2).mean()


def test_registration_of_rotation_and_masks(spark):
    images = [blob_image(), blob_image(1, 2, turn=np.radians(5))]
    steady = motion.stabilise(frames(spark, images), motion.register(frames(spark, images), "first", "rigid"))
    inner = (slice(12, -12),) * 2
    moved = np.array(steady.where("t = 1").first().px).reshape(80, 80)
    assert ((moved - images[0])[inner] ** 2).mean() < 0.5 * ((images[1] - images[0])[inner] ** 2).mean()

    y, x = np.mgrid[0:64, 0:64]
    decoy = lambda dx: 100 * np.exp(-((y - 24) ** 2 + (x - 20 - dx) ** 2) / 50) + 400 * np.exp(-((y - 46) ** 2 + (x - 46) ** 2) / 50)
    f = frames(spark, [decoy(0), decoy(4)])
    inside = ((y < 36) & (x < 40)).ravel().tolist()
    mask = spark.createDataFrame([(inside,)], "mask array<boolean>")
    masked = motion.register(f, "first", "translation", mask=mask).where("t = 1").first().m
    free = motion.register(f, "first", "translation").where("t = 1").first().m
    assert abs(masked[2] - 4) < 0.5 and abs(free[2]) < 0.6 * 4
    with pytest.raises(ValueError):
        motion.register(f, "last")
    with pytest.raises(ValueError):
        motion.register(f, "first", "bilinear")


def test_bilinear_maps_are_recovered_and_undone(spark):
    """Planted maps to a fiftieth of a pixel in the whole window, also with masks; warping by them brings the frames back."""
    rng = np.random.default_rng(0)
    image = rng.normal(0, 1, (80, 80))
    for _ in range(6):
        image = sum(np.roll(image, d, a) for a in (0, 1) for d in (-1, 0, 1)) / 6
    c = align.spline_coefficients(500 * image)
    yy, xx = (v.ravel() for v in np.mgrid[0:64, 0:64].astype(float))
    planted = [((0.5, 1.2), (-0.5, -0.8)), ((-1.0, 0.0), (0.7, 1.5)), ((0.0, -0.6), (0.0, 0.0))]
    images, maps = [align.sample(c, yy + 8, xx + 8).reshape(64, 64)], []
    for (dx, bx), (dy, by) in planted:
        x, y = xx - 31.5, yy - 31.5
        for _ in range(60):
            bend = x * y / 31.5**2
            x, y = xx - 31.5 - dx - bx * bend, yy - 31.5 - dy - by * bend
        images.append(align.sample(c, y + 39.5, x + 39.5).reshape(64, 64))
        bend = (xx - 31.5) * (yy - 31.5) / 31.5**2
        maps.append((xx + dx + bx * bend, yy + dy + by * bend))
    f = frames(spark, images)
    inner = np.zeros((64, 64), bool)
    inner[5:-5, 5:-5] = True
    mask = spark.createDataFrame([(inner.ravel().tolist(),)], "mask array<boolean>")
    found = motion.register_bilinear(f, "first", mask=mask)
    m = {r.t: np.array(r.m).reshape(2, 4) for r in found.collect()}
    assert (m[0] == [[0, 1, 0, 0], [0, 0, 1, 0]]).all()
    basis = np.stack([np.ones_like(xx), xx, yy, xx * yy])
    for t, (u, v) in enumerate(maps, 1):
        assert np.abs(m[t] @ basis - [u, v]).max() < 0.02
    steady = {r.t: np.array(r.px).reshape(64, 64) for r in motion.stabilise(f, found).collect()}
    assert all(np.abs(steady[t] - images[0])[8:-8, 8:-8].max() < 0.05 * np.abs(images[0]).max() for t in range(1, 4))
    # a translation is a bilinear map too
    moved = align.register_bilinear(images[0], np.roll(images[0], (2, -1), (0, 1)), inner, inner)
    assert np.allclose(moved @ [1, 30, 30, 900], [29, 32], atol=0.02)
    with pytest.raises(ValueError):
        motion.register_bilinear(f, "previous")
    with pytest.raises(ValueError):
        align.register_bilinear(images[0], images[0][:-1])


def test_products_of_many_steps_are_a_scan_in_blocks(spark):
    rng = np.random.default_rng(3)
    steps = {r: [np.eye(3) + np.vstack([rng.normal(0, 0.05, (2, 3)), np.zeros(3)]) for _ in range(n)] for r, n in ((0, 130), (1, 9), (2, 1))}
    rows = [(r, t, m.ravel().tolist()) for r, own in steps.items() for t, m in enumerate(own)]
    table = spark.createDataFrame(rows, "recording int, t int, m array<double>").repartition(5)
    for together in (4, 50, motion.STEPS_TOGETHER):
        got = motion.chain(table, ("recording",), together)
        assert got.columns == ["recording", "t", "m"] and got.schema["t"].dataType.simpleString() == "int"
        found = {(r.recording, r.t): np.array(r.m).reshape(3, 3) for r in got.collect()}
        assert len(found) == len(rows)
        for r, own in steps.items():
            total = np.eye(3)
            for t, m in enumerate(own):
                total = m @ total
                assert np.allclose(found[r, t], total)
    alone = motion.chain(table.where("recording = 0").drop("recording"), (), 7).collect()
    assert len(alone) == 130 and motion.chain(table.limit(0), ("recording",)).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4])
def test_registration_under_a_moving_average(spark, n):
    """Against the same registration, frame by frame on the averaged images; masks take part where all frames of a window do."""
    images = [blob_image(0.4 * k, -0.6 * k) for k in range(5)]
    before, after = -(-n // 2) - 1, n // 2
    near = lambda t: [min(4, max(0, t + k)) for k in range(-before, after + 1)]
    means = [np.mean([images[k] for k in near(t)], axis=0) for t in range(5)]
    f = frames(spark, images)
    for together in (1, 2, motion.FRAMES_TOGETHER):
        got = {r.t: np.array(r.px).reshape(80, 80) for r in motion.average_frames(f, n, (), together).collect()}
        assert all(np.allclose(got[t], means[t]) for t in range(5))
    for reference in ("first", "previous", "mean"):
        found = {r.t: np.array(r.m).reshape(3, 3) for r in motion.register(f, reference, "translation", moving_average=n).collect()}
        total = np.eye(3)
        for t in range(5):
            ref = means[0] if reference == "first" else means[t - 1] if reference == "previous" else np.mean(means, axis=0)
            step = align.register(ref, means[t], "translation")
            total = step @ total if reference == "previous" else step
            assert np.allclose(found[t], total, atol=1e-6)
    masks = [np.ones(64, bool) for _ in range(5)]
    for t in range(5):
        masks[t][t] = False
    rows = spark.createDataFrame([(t, m.tolist()) for t, m in enumerate(masks)], "t int, mask array<boolean>")
    got = {r.t: r["mask"] for r in motion.common_masks(rows, n, (), 2).collect()}
    assert all(got[t] == np.all([masks[k] for k in near(t)], axis=0).tolist() for t in range(5))
    with pytest.raises(ValueError):
        motion.register(f, "first", moving_average=0)


def test_leaves_move_on_their_own(spark):
    y, x = np.mgrid[0:80, 0:80]
    blob = lambda cy, cx: 150 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 50)
    images = [10 + blob(20, 20) + blob(60, 60), 10 + blob(22, 17) + blob(57, 61)]
    f = frames(spark, images)
    leaves = spark.createDataFrame([(0, 5, 35, 5, 35), (1, 45, 75, 45, 75)], "leaf_id int, y0 int, y1 int, x0 int, x1 int")
    found = motion.register_leaves(f, leaves, "first", "translation")
    m = {(r.leaf_id, r.t): r.m for r in found.collect()}
    assert (m[0, 1][5], m[0, 1][2]) == pytest.approx((2, -3), abs=0.2)
    assert (m[1, 1][5], m[1, 1][2]) == pytest.approx((-3, 1), abs=0.2)
    steady = array(motion.stabilise_leaves(f, leaves, found), (2, 80, 80))
    for box in ((slice(12, 28),) * 2, (slice(52, 68),) * 2):
        assert ((steady[1] - images[0])[box] ** 2).mean() < 0.3 * ((images[1] - images[0])[box] ** 2).mean()
    assert steady[1][0, 0] == images[1][0, 0]


def noise_views(seed, dy, dx):
    """Two windows of 48 x 48 on smoothed noise, whose content moves by whole pixels, farther than its own grain."""
    image = tables._smoothed(np.random.default_rng(seed).normal(0, 1, (64, 64)))
    return image[8:56, 8:56], image[8 - dy : 56 - dy, 8 - dx : 56 - dx]


def test_small_boxes_that_move_far(spark):
    """A box without coarser levels, where the steps from no motion end in a minimum nearby."""
    leaves = spark.createDataFrame([(0, 2, 24, 2, 46)], "leaf_id int, y0 int, y1 int, x0 int, x1 int")
    for seed in (1, 6, 8):
        found = motion.register_leaves(frames(spark, noise_views(seed, 3, -5)), leaves, "first", "translation").where("t = 1").first()
        assert (found.m[5], found.m[2]) == pytest.approx((3, -5), abs=0.01)


@pytest.mark.parametrize("seed", [7, 11, 19])
def test_affine_steps_find_far_shifts(spark, seed):
    found = motion.register(frames(spark, noise_views(seed, 4, -6)), "first", "affine").where("t = 1").first()
    assert np.allclose(np.reshape(found.m, (3, 3)), [[1, 0, -6], [0, 1, 4], [0, 0, 1]], atol=1e-3)


def test_stabilised_frames_that_moved_far_are_still(spark):
    images = noise_views(11, 4, -6)
    f = frames(spark, images)
    steady = motion.stabilise(f, motion.register(f, "first", "affine")).where("t = 1").first().px
    inner = (slice(8, 40),) * 2
    assert ((np.reshape(steady, (48, 48)) - images[0])[inner] ** 2).mean() < 0.1 * ((images[1] - images[0])[inner] ** 2).mean()


def mapped_views(seed, linear, shift):
    """A window of 48 x 48 on smoothed noise, and its content mapped about its centre to parts of a pixel."""
    image = tables._smoothed(np.random.default_rng(seed).normal(0, 1, (64, 64)))
    yy, xx = (v.ravel() for v in np.mgrid[0:48, 0:48].astype(float))
    x, y = np.linalg.solve(linear, np.stack([xx, yy]) - 23.5 - np.reshape(shift, (2, 1))) + 23.5
    return image[8:56, 8:56], align.sample(align.spline_coefficients(image), y + 8, x + 8).reshape(48, 48)


@pytest.mark.parametrize("seed", range(4))
def test_the_rim_of_a_window_does_not_turn_it(spark, seed):
    """What a frame's border pixels are interpolated from lies outside of it; angles to a two-hundredth of a degree all the same."""
    c, s = np.cos(np.radians(1.5)), np.sin(np.radians(1.5))
    m = np.reshape(motion.register(frames(spark, mapped_views(seed, [[c, -s], [s, c]], (0.25, -0.5))), "first", "rigid_body").where("t = 1").first().m, (3, 3))
    assert (m @ [23.5, 23.5, 1])[:2] == pytest.approx([23.75, 23.0], abs=0.002)
    assert np.degrees(np.arctan2(m[1, 0], m[0, 0])) == pytest.approx(1.5, abs=0.005)


@pytest.mark.parametrize("seed", range(4))
def test_the_rim_of_a_window_does_not_stretch_it(spark, seed):
    linear = [[1.04, 0.04], [0, 1]]
    m = np.reshape(motion.register(frames(spark, mapped_views(seed, linear, (-0.5, 0.5))), "first", "affine").where("t = 1").first().m, (3, 3))
    assert (m @ [23.5, 23.5, 1])[:2] == pytest.approx([23.0, 24.0], abs=0.002)
    assert np.allclose(m[:2, :2], linear, atol=5e-4)


def test_recording_facade(spark):
    yy, xx = np.mgrid[0:20, 0:30]
    stack = np.stack([np.where(t >= 5 + np.round(xx / 2), 30.0, 10.0) for t in range(40)])
    r = Recording(pixels(spark, stack), 40, 20, 30)
    for k in (4, 12, 20):
        r.add_roi(10, k, 1.5, label=f"at {k}")
    fit = r.propagation()["fit"].first()
    assert fit.speed == pytest.approx(2.0, rel=0.05) and fit.dir_x == pytest.approx(1.0)
    before = r.revision
    r.set_crop(5, 40)
    assert r.revision == before + 1 and r.analyses == {} and r.traces().where("roi_id = 0").count() == 35
    r.smooth(1.0)
    assert {"raw", "dff", "smoothed"} <= set(r.traces().columns)
    assert r.add_polygon([(0, 0), (0, 4), (2, 4), (2, 0)]) == 3 and r.rois[3]["cy"] == pytest.approx(1.0)
    r.set_pixel_size("0.65")
    r.set_frame_interval(-1)
    assert r.pixel_size == 0.65 and r.frame_interval is None
    assert r.record()["crop"] == [5, 40] and r.apply(lambda t, p: p.count()) == stack.size
    with pytest.raises(ValueError):
        r.set_crop(9, 9)
    with pytest.raises(ValueError):
        r.register("per_leaf")
    assert r.kymograph([(10.0, 2.0), (10.0, 20.0)]).count() == 19 * 35
    assert r.onset_heatmap(bin_size=5).count() == 24


def test_recording_follows_motion(spark):
    yy, xx = np.mgrid[0:48, 0:48]
    stack = np.stack([50 + 200 * np.exp(-((yy - 24) ** 2 + (xx - 20 - t) ** 2) / 72) for t in range(4)])
    r = Recording(pixels(spark, stack), 4, 48, 48)
    r.add_roi(24, 20, 4)
    r.register("whole_frame", "first", apply=False, model="translation")
    s = r.traces().toPandas().raw
    assert s.std() / s.mean() < 0.02
    r.add_leaf((4, 44, 4, 44))
    r.register("per_leaf", "first", apply=False, model="translation")
    s = r.traces().toPandas().raw
    assert s.std() / s.mean() < 0.02
    r.register("whole_frame", "first", apply=True, model="translation")
    s = r.traces().toPandas().raw
    assert s.std() / s.mean() < 0.02


def test_outlines_limit_what_registers(spark):
    """A still decoy lies in the leaf's box; its outline leaves the decoy out."""
    yy, xx = np.mgrid[0:64, 0:64]
    blob = lambda y, x, s: np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))
    stack = np.stack([100 + 150 * blob(24 + 1.5 * t, 24 - t, 5) + 400 * blob(46, 46, 3) for t in range(4)])
    r = Recording(pixels(spark, stack), 4, 64, 64, frame_interval=0.5)
    leaf = r.add_leaf((4, 60, 4, 60))

    def shifts():
        r.register("per_leaf", "first", apply=False, model="translation")
        return {row.t: (row.m[5], row.m[2]) for row in r.transforms.collect()}

    plain = shifts()
    with pytest.raises(ValueError):
        r.set_leaf_outline(leaf, [(0, 0), (1, 1)])
    r.set_leaf_outline(leaf, [(0, 0), (0, 38), (38, 38), (38, 0)])
    masked = shifts()
    assert all(masked[t] == pytest.approx((1.5 * t, -t), abs=0.5) for t in range(4))
    assert abs(plain[3][0]) < 0.6 * 4.5
    assert r.drift.count() == 0 and len(r.references.first().ref) == 56 * 56
    r.clear_leaf_outline(leaf)
    assert shifts()[3] == pytest.approx(plain[3]) and r.leaves[0]["mask_polygon"] is None


def test_averaged_references_and_masks_of_each_frame(spark):
    images = [blob_image(0.5 * t, -0.25 * t) for t in range(5)]
    by_first = {r.t: np.array(r.m).reshape(3, 3) for r in motion.register(frames(spark, images), "first", "translation", n_frames=3).collect()}
    assert (by_first[0] == np.eye(3)).all() and abs(by_first[1][1, 2]) < 0.15 and by_first[4][1, 2] == pytest.approx(1.5, abs=0.1)
    # a bright square wanders through the frames; each frame masks its own
    masks, spoilt = [], []
    for t, image in enumerate(images):
        image, mask = image.copy(), np.ones(image.shape, bool)
        image[20:30, 8 + 12 * t : 18 + 12 * t] = 900
        mask[17:33, 5 + 12 * t : 21 + 12 * t] = False
        spoilt.append(image)
        masks.append(mask)
    table = spark.createDataFrame([(t, m.ravel().tolist()) for t, m in enumerate(masks)], "t int, mask array<boolean>")
    for reference in ("first", "previous"):
        got = {r.t: np.array(r.m).reshape(3, 3) for r in motion.register(frames(spark, spoilt), reference, "translation", frame_masks=table).collect()}
        assert all(got[t][:2, 2] == pytest.approx([-0.25 * t, 0.5 * t], abs=0.15) for t in range(5)), reference
    shared = np.array(motion.reference_masks(table, "mean").first().ref_mask).reshape(80, 80)
    assert (shared == np.logical_and.reduce(masks)).all()
    two = np.array(motion.reference_masks(table, "first", n_frames=2).first().ref_mask).reshape(80, 80)
    assert (two == (masks[0] & masks[1])).all()


def test_matrix_forms():
    m = np.array([[1.0, 2, 3], [4, 5, 6], [0, 0, 1]])
    assert align.short_matrix(m, "affine").tolist() == [[3, 1, 2], [6, 4, 5]] and (align.long_matrix(align.short_matrix(m, "affine"), "affine") == m).all()
    shift = np.array([[1.0, 0, 3], [0, 1, 6], [0, 0, 1]])
    assert align.short_matrix(shift, "translation").tolist() == [[3], [6]] and (align.long_matrix([[3], [6]], "translation") == shift).all()
    with pytest.raises(ValueError):
        align.short_matrix(np.eye(2), "affine")


def test_splines_of_short_sides_are_exact():
    image = np.random.default_rng(0).uniform(0, 9, (5, 16))
    yy, xx = (v.ravel().astype(float) for v in np.mgrid[0:5, 0:16])
    assert np.abs(align.sample(align.spline_coefficients(image), yy, xx) - image.ravel()).max() < 1e-9


def test_running_mask_and_negative_bounds(spark):
    inside = [True, False, True, True, True, True]
    rows = spark.createDataFrame([(t, 0, 0, v) for t, v in enumerate(inside)], "t int, y int, x int, inside boolean")
    got = [r.all_inside for r in traces.running_all(rows, 3, ("y", "x")).orderBy("t").collect()]
    assert got == [False, False, False, True, True, True]
    stack = np.arange(10 * 2 * 2).reshape(10, 2, 2)
    for start, end in ((-3, None), (2, -1), (-4, -2), (8, 3), (0, 99)):
        cut = movie.import_movie(pixels(spark, stack), 10, start, end)
        want = stack[start:end]
        assert cut.count() == want.size and (not want.size or (array(cut, want.shape) == want).all())


def test_exports_summary_and_registered_analyses(spark, tmp_path):
    stack = np.full((30, 12, 16), 10.0)
    for x in range(16):
        stack[8 + x :, :, x] += 20
    r = Recording(pixels(spark, stack), 30, 12, 16, pixel_size=0.5, frame_interval=0.25)
    with pytest.raises(RuntimeError):
        Recording(None, 1, 1, 1).traces()
    r.add_roi(6, 4, 1.0, label="left")
    r.add_roi(6, 12, 1.0)
    r.set_crop(2, 30)
    lines = [x.line for x in r.propagation_summary().collect()]
    assert lines[0].startswith("speed: 2.00 µm/s") and lines[3] == "source (earliest): left"
    assert lines[4].startswith("onset (s) left: 2.8") and lines[5].startswith("onset (s) roi_1: 4.8")
    r.export_all(str(tmp_path / "out"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "out" / "traces.csv"))
    assert wide.columns == ["frame", "seconds", "left_F", "left_dFF", "roi_1_F", "roi_1_dFF"]
    assert sorted(int(x.frame) for x in wide.collect()) == list(range(2, 30))
    assert tiff.read_frames(spark, str(tmp_path / "out" / "movie.tif")).count() == 30
    assert "left" in "".join(x.value for x in spark.read.text(str(tmp_path / "out" / "parameters.json")).collect())
    assert r.displayed().first().shown == pytest.approx(r.traces().first().dff) and r.displayed(dff=False).first().shown == 10
    register_analysis("mean", "dataset", lambda t, rois: t.join(rois.select("roi_id", "cx"), "roi_id").groupBy("cx").agg(F.avg("raw").alias("m")))
    assert r.run("mean").count() == 2 and "mean" in r.analyses
    with pytest.raises(ValueError):
        register_analysis("bad", "other", len)


def test_live_traces_are_those_of_the_batch(spark, tmp_path):
    """Frames whose pixels come in two files, with event times that straddle seconds, and a zero baseline."""
    rng = np.random.default_rng(5)
    stack = rng.uniform(1, 9, (20, 4, 5))
    rows = [("a", t, y, x, float(stack[t, y, x]) if y < 2 else 0.0, 1_700_000_000 + 0.7 * t) for t, y, x in np.ndindex(*stack.shape)]
    table = spark.createDataFrame(rows, "recording string, t long, y int, x int, v double, s double").select("recording", "t", "y", "x", "v", F.col("s").cast("timestamp").alias("at"))
    table.where("x < 3").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    table.where("x >= 3").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    mask = spark.createDataFrame([(r, y, x) for r, ys in ((0, (0, 1)), (1, (2, 3))) for y in ys for x in range(5)], "roi_id long, y int, x int")
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / "*"))
    means = live.live_traces(stream, mask, "1 second")
    run = means.writeStream.format("memory").queryName("live_means").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.roi_id, r.t): r.raw for r in spark.table("live_means").collect()}
    want = {(k, t): stack[t, :2].mean() if k == 0 else 0.0 for k in (0, 1) for t in range(20)}
    assert len(got) >= 34 and all(got[k] == pytest.approx(want[k]) for k in got)
    signal = spark.createDataFrame([("a", k, t, float(want[k, t])) for k, t in want], "recording string, roi_id long, t long, raw double")
    signal.coalesce(1).write.parquet(str(tmp_path / "traces"))
    dff = live.live_dff(spark.readStream.schema(signal.schema).parquet(str(tmp_path / "traces")), n=10)
    run = dff.writeStream.format("memory").queryName("live_dff").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {(r.roi_id, r.t): r.dff for r in spark.table("live_dff").collect()}
    base = np.mean([want[0, t] for t in range(10)])
    assert len(found) == 40 and all(found[0, t] == pytest.approx((want[0, t] - base) / base) for t in range(20))
    # batch gives NaN, which pandas hands over as null
    assert all(found[1, t] is None for t in range(20))
