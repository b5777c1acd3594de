import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import units
from wavelake.sources import export, tiff, written


def write(path, images, description=""):
    with open(path, "wb") as out:
        for piece in tiff.encode(iter(images), description):
            out.write(piece)


def tagged(path, unit=None, per_unit=None):
    """A one-pixel file with resolution tags."""
    tags = [(256, 3, 1, 1), (257, 3, 1, 1), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 200), (279, 4, 1, 2), (282, 5, 1, 180), (296, 3, 1, unit)]
    raw = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    raw = raw.ljust(180, b"\0") + struct.pack("<II", per_unit, 1)
    path.write_bytes(raw.ljust(200, b"\0") + struct.pack("<H", 7))


def test_movies_survive_a_round_trip(spark, tmp_path):
    images = np.random.default_rng(0).normal(size=(3, 5, 7)).astype(np.float32)
    write(tmp_path / "a.tif", images)
    frames = tiff.read_frames(spark, str(tmp_path))
    got = {r.t: np.array(r.px, np.float32).reshape(r.height, r.width) for r in frames.collect()}
    assert all((got[t] == images[t]).all() for t in range(3))
    tiff.write_movie(frames, str(tmp_path / "b.tiff"), "ImageJ=1.0")
    assert tiff.read_frames(spark, str(tmp_path / "b.tiff")).count() == 3
    (tmp_path / "c.tif").write_bytes(b"no tiff at all")
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.read_frames(spark, str(tmp_path / "c.tif")).collect()


def stack_file(path, images, dtype, description=b"", order="<", packed=1, tile=None, predictor=1, big=False, one_directory=False, samples=1):
    """A TIFF of any of the kinds that are read, written entry by entry."""
    word, number, size = ("Q", "Q", 8) if big else ("I", "H", 4)
    head = struct.pack(order + "2sH", b"II" if order == "<" else b"MM", 43 if big else 42) + (struct.pack(order + "HH", 8, 0) if big else b"")
    raw = bytearray(head + struct.pack(order + word, 0))
    link = len(raw) - size

    def pack(part):
        part = np.ascontiguousarray(part.astype(np.dtype(dtype).newbyteorder(order)))
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(part.dtype)
        data = part.tobytes()
        if packed == 8:
            return zlib.compress(data)
        if packed == 32773:
            return b"".join(bytes([0, b]) for b in data[: len(data) // 2]) + b"".join(bytes([len(c) - 1]) + c for c in (data[len(data) // 2 :][k : k + 100] for k in range(0, len(data), 100)) if c)
        if packed == 5:
            codes, n = [], 0
            for b in data:  # a code for every byte, starting anew before the width would grow
                codes += ([256] if n % 200 == 0 else []) + [b]
                n += 1
            bits = "".join(f"{c:09b}" for c in [*codes, 257])
            return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return data

    for k, image in enumerate(images):
        h, w = image.shape
        if tile:
            padded = np.pad(image, ((0, -h % tile), (0, -w % tile)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            parts = [image[:3], image[3:]]
        if one_directory:
            parts = [np.concatenate(images)]
        parts = [pack(p) for p in parts]
        at = []
        for p in parts:
            at.append(len(raw))
            raw += p
        itemsize = np.dtype(dtype).itemsize
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * itemsize]), (259, 3, [packed]), (277, 3, [samples]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, at), (325, 4, list(map(len, parts)))] if tile else [(273, 4, at), (279, 4, list(map(len, parts)))]
        if description and k == 0:
            tags.append((270, 2, description + b"\0"))
        rows = b""
        for tag, kind, values in sorted(tags):
            data = values if kind == 2 else struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > size:
                where = len(raw)
                raw += data
                data = struct.pack(order + word, where)
            rows += struct.pack(f"{order}HH{word}", tag, kind, len(values)) + data.ljust(size, b"\0")
        raw[link : link + size] = struct.pack(order + word, len(raw))
        raw += struct.pack(order + number, len(tags)) + rows
        link = len(raw)
        raw += struct.pack(order + word, 0)
        if one_directory:
            break
    path.write_bytes(bytes(raw))


def test_kinds_of_files_read_back_equal(spark, tmp_path):
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 200, (6, 9, 13))
    kinds = {
        "plain.tif": dict(dtype="u2"), "big_endian.tif": dict(dtype="i4", order=">"), "lzw.tif": dict(dtype="u1", packed=5), "packbits.tif": dict(dtype="u2", packed=32773),
        "deflate.tif": dict(dtype="u2", packed=8, predictor=2), "tiles.tif": dict(dtype="f4", tile=16), "bigtiff.tif": dict(dtype="f8", big=True), "lzw_tiles.TIFF": dict(dtype="u2", packed=5, tile=16, predictor=2, order=">"),
        "one.tif": dict(dtype="u2", one_directory=True, description=b"ImageJ=1.5\nimages=6\nframes=6\n"),
        "channels.tif": dict(dtype="u2", description=b"ImageJ=1.5\nimages=6\nchannels=2\nframes=3\n"),
    }
    for name, options in kinds.items():
        stack_file(tmp_path / name, list(whole), **options)
    rows = tiff.load(spark, str(tmp_path)).collect()
    for name in kinds:
        got = {(r.t, r.c): np.array(r.px).reshape(r.height, r.width) for r in rows if r.path.endswith("/" + name)}
        want = {(k // 2, k % 2): v for k, v in enumerate(whole)} if name == "channels.tif" else {(k, 0): v for k, v in enumerate(whole)}
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want), name
    bad = {"rgb": dict(dtype="u1", samples=3), "jpeg": dict(dtype="u1", packed=7), "count": dict(dtype="u1", description=b"ImageJ=1.5\nimages=4\n"), "odd": dict(dtype="u1", description=b"ImageJ=1.5\nimages=6\nchannels=4\n")}
    for name, options in bad.items():
        stack_file(tmp_path / f"{name}.tif", list(whole), **options)
        with pytest.raises(Exception, match="ValueError"):
            tiff.read_frames(spark, str(tmp_path / f"{name}.tif")).collect()
    with pytest.raises(ValueError, match="expected one of"):
        tiff.load(spark, str(tmp_path / "a.nd2"))


def test_scales(spark, tmp_path):
    one = [np.zeros((2, 2))]
    ome = '<OME xmlns="x"><Image><Pixels PhysicalSizeX="0.5" TimeIncrement="2000" TimeIncrementUnit="ms"/></Image></OME>'
    write(tmp_path / "fps.tif", one, "ImageJ=1.5\nunit=pixel\nfps=4.0\n")
    write(tmp_path / "finterval.tif", one, "ImageJ=1.5\nfinterval=0.25\nfps=9\n")
    write(tmp_path / "ome.tif", one, ome)
    write(tmp_path / "broken.tif", one, "<OME <")
    write(tmp_path / "bare.tif", one)
    tagged(tmp_path / "inch.tif", 2, 100)
    tagged(tmp_path / "none.tif", 1, 100)
    got = {r.path.split("/")[-1]: (r.pixel_size, r.frame_interval) for r in tiff.read_scales(spark, str(tmp_path)).collect()}
    assert got == {"fps.tif": (None, 0.25), "finterval.tif": (None, 0.25), "ome.tif": (0.5, 2.0), "broken.tif": (None, None), "bare.tif": (None, None), "inch.tif": (254.0, None), "none.tif": (None, None)}


def test_units(spark):
    rows = spark.createDataFrame([("mm",), (" Μm ",), ("inch",), ("pixel",), (None,)], "u string")
    got = [r.f for r in rows.select(units.factor(F.col("u"), units.LENGTHS_UM).alias("f")).collect()]
    assert got == [1e3, 1.0, 25400.0, None, None]
    known = spark.createDataFrame([(0.5, 2.5), (None, None), (0.5, None), (None, 0.5), (-1.0, float("nan"))], "size double, seconds double")
    speeds = [tuple(r.s) for r in known.select(units.speed_units(F.col("size"), F.col("seconds")).alias("s")).collect()]
    assert speeds == [(0.2, "µm/s"), (1.0, "px/frame"), (0.5, "µm/frame"), (2.0, "px/s"), (1.0, "px/frame")]
    assert units.positive_number("nan") is None and units.positive_number("x") is None and units.positive_number("0.5") == 0.5
    values = spark.createDataFrame([("1.5",), ("NaN",), ("-1",), ("Infinity",), ("x",)], "v string")
    assert [r.p for r in values.select(units.positive(F.col("v")).alias("p")).collect()] == [1.5, None, None, None, None]
    bars = spark.createDataFrame([(100.0,), (26.0,), (7.0,)], "s double").select(units.scale_bar(F.col("s")).alias("b"))
    assert [r.b for r in bars.collect()] == [20.0, 5.0, 1.0]


def test_wide_export(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "roi_id int, t int, raw double")
    wide = export.wide_traces(rows, [0, 1], {"F": "raw"}, {0: "leaf", 1: "leaf"}, 0.5)
    assert wide.columns == ["frame", "seconds", "leaf_F", "leaf_1_F"]
    export.write_csv(wide, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    export.write_record({"n": 1}, str(tmp_path / "record"), spark)
    assert spark.read.text(str(tmp_path / "record")).count() == 3
    with pytest.raises(ValueError):
        export.wide_traces(rows, [], {"F": "raw"})
    # the same table from rows of cells, with an empty cell
    export.write_wide(rows, str(tmp_path / "cells"), {"F": "raw"}, {0: "leaf", 1: "leaf"}, 0.5)
    same = lambda folder: sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / folder)).collect()))
    assert same("cells") == same("csv") and spark.read.option("header", True).csv(str(tmp_path / "cells")).columns == wide.columns


def test_wide_export_of_many_regions(spark, tmp_path):
    """The plan is that of a few regions, and gaps stay empty."""
    n = 3000
    rows = spark.range(n * 5).select((F.col("id") % n).cast("int").alias("roi_id"), F.floor(F.col("id") / n).cast("int").alias("t"), F.col("id").cast("double").alias("raw"), (-F.col("id")).cast("double").alias("dff"))
    rows = rows.where(~((F.col("t") == 2) & (F.col("roi_id").isin(0, 7, 8, n - 1))) & ((F.col("t") != 4) | (F.col("roi_id") == 5)))
    export.write_wide(rows, str(tmp_path / "wide"), {"F": "raw", "dFF": "dff"}, {7: 'a "b", c', 9: "roi_3"})
    import csv

    lines = [r.value for r in spark.read.text(str(tmp_path / "wide")).collect()]
    table = [row for row in csv.reader(lines) if row[0] != "frame"]
    head = next(row for row in csv.reader(lines) if row[0] == "frame")
    assert len(head) == 1 + 2 * n == len(set(head)) and head[15:17] == ['a "b", c_F', 'a "b", c_dFF'] and head[7] == "roi_3_F" and head[19] == "roi_3_9_F"
    got = {int(r[0]): r[1:] for r in table}
    assert sorted(got) == [0, 1, 2, 3, 4] and all(len(r) == 2 * n for r in got.values())
    for t, cells in got.items():
        for k in range(n):
            there = not (t == 2 and k in (0, 7, 8, n - 1)) and (t != 4 or k == 5)
            assert cells[2 * k : 2 * k + 2] == ([str(float(t * n + k)), str(float(-(t * n + k)))] if there else ["", ""])
    columns = export.wide_columns(rows)
    plans = [export.wide_rows(rows.where(F.col("roi_id") < k), {"F": "raw"}, columns)._jdf.queryExecution().toString() for k in (2, n)]
    assert abs(len(plans[0]) - len(plans[1])) < 200


def test_live_traces(spark, tmp_path):
    from wavelake.streaming.live import live_dff

    source = tmp_path / "in"
    spark.range(24).select(F.lit("a").alias("recording"), (F.col("id") % 2).alias("roi_id"), F.floor(F.col("id") / 2).alias("t"), (F.lit(10.0) + F.floor(F.col("id") / 2) * (F.col("id") % 2)).alias("raw")).write.parquet(str(source))
    rows = spark.readStream.schema("recording string, roi_id long, t long, raw double").parquet(str(source))
    query = live_dff(rows, 4).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.roi_id, r.t): r.dff for r in spark.table("live").collect()}
    assert len(got) == 24 and got[0, 5] == 0 and got[1, 11] == pytest.approx((21 - 11.5) / 11.5)


def test_tables_of_a_scratch_are_dropped(spark):
    import os

    with written.scratch(spark) as keep:
        first = written.materialize(spark.range(5), "first")
        kept = keep(first.where("id > 2"), "kept")
        with written.scratch(spark) as inner:
            inner(spark.range(2), "inner")
        gone, stays = (df.inputFiles()[0].removeprefix("file:") for df in (first, kept))
        assert os.path.exists(gone.replace("///", "/")) and os.path.exists(stays.replace("///", "/"))
    assert not os.path.exists(gone.replace("///", "/")) and kept.count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        written.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert written.shared_dir(Session())


def test_ranges_of_a_file_are_tasks_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 200, (24, 9, 13))
    kinds = {
        "a.tif": dict(dtype="u2"), "b.tif": dict(dtype="f8", big=True, order=">"), "c.tif": dict(dtype="u2", one_directory=True, description=b"ImageJ=1.5\nimages=24\nchannels=2\n"), "d.TIF": dict(dtype="u2", packed=8, tile=16),
    }
    for name, options in kinds.items():
        stack_file(tmp_path / name, list(whole), **options)
    (tmp_path / "_skipped.tif").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"no image")
    frames = tiff.read_frames(spark, str(tmp_path), range_bytes=1000)
    assert frames.rdd.getNumPartitions() >= 30
    rows = {(r.path, r.t, r.c): np.array(r.px).reshape(r.height, r.width) for r in frames.collect()}
    (tmp_path / "_skipped.tif").unlink()
    expected = {(r.path.replace("file:///", "file:/"), r.t, r.c): np.array(r.px).reshape(r.height, r.width) for r in tiff.read_whole_files(spark, str(tmp_path)).collect()}
    assert rows.keys() == expected.keys() and len(rows) == 96
    assert all((rows[k] == expected[k]).all() for k in rows)
    assert spark.read.format("tiff").load(f"{tmp_path}/[ab].tif").count() == 48
    assert spark.read.format("tiff").load(f"file://{tmp_path}/d.TIF").count() == 24
    with pytest.raises(Exception, match="no.tif"):
        tiff.read_frames(spark, str(tmp_path / "no.tif")).collect()


def test_a_file_beyond_4_gb_is_planned_from_its_directories(tmp_path):
    """Sparse on disk; the images after the first have no directory of their own."""
    path, images, side = tmp_path / "large.tif", 2700, 1000
    stack_file(path, [np.full((side, side), 7)], "u2", f"ImageJ=1.5\nimages={images}\nframes={images}\n".encode())
    start = tiff.directories(path.read_bytes())[1][0][273][0]
    with open(path, "r+b") as out:
        out.truncate(start + images * side * side * 2)
        out.seek(start + (images - 1) * side * side * 2)
        out.write(np.full((side, side), 9, "<u2").tobytes())
    assert path.stat().st_size > 5 << 30
    reader = tiff._RangeReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) == 82 and sum(len(p.numbers) for p in parts) == images
    last = list(reader.read(parts[-1]))
    assert [b.column("t")[0].as_py() for b in last] == list(parts[-1].numbers) and set(last[-1].column("px")[0].as_py()) == {9.0}


def test_samples_are_channels(spark, tmp_path):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 255, (5, 7, 3)).astype(np.uint8)
    for name, planar, strips in (("chunky", 1, [image.tobytes()]), ("planar", 2, [image[..., k].tobytes() for k in range(3)])):
        raw = bytearray(b"II*\0" + struct.pack("<I", 0))
        at = []
        for s in strips:
            at.append(len(raw))
            raw += s
        lists = {}
        for tag, values, form in ((258, [8] * 3, "H"), (273, at, "I"), (279, list(map(len, strips)), "I")):
            lists[tag] = len(raw)
            raw += struct.pack(f"<{len(values)}{form}", *values)
        one = len(strips) == 1
        tags = [(256, 4, 1, 7), (257, 4, 1, 5), (258, 3, 3, lists[258]), (273, 4, len(at), at[0] if one else lists[273]), (277, 3, 1, 3), (279, 4, len(at), len(strips[0]) if one else lists[279]), (284, 3, 1, planar)]
        raw[4:8] = struct.pack("<I", len(raw))
        raw += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
        (tmp_path / f"{name}.tif").write_bytes(bytes(raw))
        rows = tiff.read_frames(spark, str(tmp_path / f"{name}.tif")).orderBy("c").collect()
        assert [(r.t, r.c) for r in rows] == [(0, 0), (0, 1), (0, 2)]
        assert all((np.array(r.px).reshape(5, 7) == image[..., r.c]).all() for r in rows)


def test_movies_are_written_by_the_tasks(spark, tmp_path):
    rng = np.random.default_rng(7)
    images = rng.normal(size=(40, 6, 5)).astype(np.float32)
    rows = [(int(3 * t + 5000 * (t > 20)), 6, 5, images[t].ravel().tolist()) for t in range(40)]
    frames = spark.createDataFrame(rows, "t int, height int, width int, px array<double>").repartition(7)
    for big in (None, True):
        path = str(tmp_path / f"{big}.tif")
        tiff.write_movie(frames, path, "ImageJ=1.5\nfinterval=0.5\nunit=um\n", big=big)
        raw = open(path, "rb").read()
        order, tags = tiff.directories(raw)
        assert raw[2] == (43 if big else 42) and tiff.metadata(tags[0])["finterval"] == "0.5" and len(tags) == 40
        back = {r.t: np.array(r.px, np.float32).reshape(6, 5) for r in tiff.read_frames(spark, path).collect()}
        assert all((back[k] == images[k]).all() for k in range(40))
        assert tiff.read_scales(spark, path).first().frame_interval == 0.5
    tiff.write_movie(frames.where("t = 3"), str(tmp_path / "one.tif"))
    assert tiff.read_frames(spark, str(tmp_path / "one.tif")).count() == 1
    tiff.write_movie(frames.limit(0), str(tmp_path / "none.tif"))
    assert tiff.read_frames(spark, str(tmp_path / "none.tif")).count() == 0
    for bad in (frames.union(frames), frames.union(spark.createDataFrame([(-1, 1, 30, [0.0] * 30)], frames.schema))):
        with pytest.raises(ValueError, match="one size"):
            tiff.write_movie(bad, str(tmp_path / "bad.tif"))
