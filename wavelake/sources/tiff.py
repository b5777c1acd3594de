"""TIFF recordings in and out.

Files are read by ranges: their chains of directories are followed first (some hundred bytes an image), then each task
reads the images of one range of a file, so a file of any size spreads over many tasks and no row
holds more than an image.  ``TiffSource`` is a Spark data source (``spark.read.format("tiff")``) over the file systems that pyarrow
opens; on others, whole files are rows of Spark's binary source (2 GB at most).  TIFF and BigTIFF, strips or tiles, uncompressed, LZW, PackBits
or deflated, with or without horizontal differences, 8 to
64 bits, integers or floats, either byte order.  What can't be read raises an error.  One row per image comes out, in the frame
schema ``(path, t, c, height, width, px)``; several samples a pixel are as many channels.  ImageJ's description says how many images a file holds (also where only the first has a
directory) and how many of them are channels and slices, channels varying fastest; of several slices per time all
count as frames.  Scales are resolved per axis from the first source
that has them: the ImageJ description, OME-XML, the resolution tags.

A movie is written by the tasks as well: all its images take as many bytes, so each has its place in the file.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavelake.functions import units

FRAMES = "path string, t int, c int, height int, width int, px array<double>"
SUFFIXES = (".tif", ".tiff")
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: Bytes of images that a task reads.
RANGE_BYTES = 64 << 20
_PLANAR = 284
_SAMPLES, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES = 277, 317, 322, 323, 324, 325
_WIDTH, _HEIGHT, _BITS, _PACKED, _TEXT, _STRIPS, _SIZES, _XRES, _UNIT, _FORMAT = 256, 257, 258, 259, 270, 273, 279, 282, 296, 339
#: Names of the resolution units 2 and 3.
_RESOLUTION = {2: "inch", 3: "cm"}


class Ranged:
    """An open file that is sliced like bytes; small slices are cut from a block that is kept."""

    BLOCK = 1 << 16

    def __init__(self, handle):
        self.handle, self.size, self.at, self.held = handle, handle.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, where: slice) -> bytes:
        start, stop, _ = where.indices(self.size)
        if stop - start > self.BLOCK:
            self.handle.seek(start)
            return self.handle.read(stop - start)
        if start < self.at or stop > self.at + len(self.held):
            self.handle.seek(start)
            self.at, self.held = start, self.handle.read(self.BLOCK)
        return self.held[start - self.at : max(start, stop) - self.at]


def _unpack(form: str, raw, at: int) -> tuple:
    return struct.unpack(form, raw[at : at + struct.calcsize(form)])


class Layout:
    """A file's byte order and the places of its directories; ``raw`` is sliced only there."""

    def __init__(self, raw):
        self.order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        kind = _unpack(self.order + "H", raw, 2)[0] if self.order and len(raw) >= 8 else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        # BigTIFF has 8-byte offsets and counts
        self.word, self.number, start, self.head = ("Q", "Q", 8, 8) if kind == 43 else ("I", "H", 4, 2)
        self.size = struct.calcsize(self.order + self.word)
        self.places, seen = [], set()
        at = _unpack(self.order + self.word, raw, start)[0]
        while at and at + self.head <= len(raw) and at not in seen:
            seen.add(at)
            self.places.append(at)
            n = _unpack(self.order + self.number, raw, at)[0]
            at = _unpack(self.order + self.word, raw, at + self.head + (4 + 2 * self.size) * n)[0]

    def tags(self, raw, at: int) -> dict[int, tuple]:
        """The tags of the directory at a place."""
        out = {}
        for k in range(_unpack(self.order + self.number, raw, at)[0]):
            here = at + self.head + (4 + 2 * self.size) * k
            tag, code, count = _unpack(f"{self.order}HH{self.word}", raw, here)
            code = _TYPES.get(code)
            if code is None:
                continue
            where = here + 4 + self.size
            if struct.calcsize(self.order + code) * count > self.size:
                where = _unpack(self.order + self.word, raw, where)[0]
            out[tag] = (raw[where : where + count],) if code == "s" else _unpack(f"{self.order}{count * len(code)}{code[0]}", raw, where)
        return out


def directories(raw) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order and the tags of every image."""
    layout = Layout(raw)
    return layout.order, [layout.tags(raw, at) for at in layout.places]


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs and literals."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 starts anew, 257 ends."""
    out, table, last = bytearray(), [], b""
    held = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("damaged LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))


_UNPACK = {1: lambda b: b, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


def image_of(raw, order: str, tags: dict[int, tuple], skip: int = 0) -> np.ndarray:
    """The pixels of one image, (samples, height, width); ``skip``: images that lie before it without a directory of their own."""
    samples, bits = tags.get(_SAMPLES, (1,))[0], tags.get(_BITS, (8,))
    kind = {1: "u", 2: "i", 3: "f"}.get(tags.get(_FORMAT, (1,))[0])
    if kind is None or set(bits) - {bits[0]} or bits[0] not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits of format {tags.get(_FORMAT, (1,))[0]} are not supported")
    dtype = np.dtype(f"{order}{kind}{bits[0] // 8}")
    packed, predictor = tags.get(_PACKED, (1,))[0], tags.get(_PREDICTOR, (1,))[0]
    if packed not in _UNPACK or predictor not in (1, 2):
        raise ValueError(f"compression {packed} with predictor {predictor} is not supported")
    height, width = tags[_HEIGHT][0], tags[_WIDTH][0]
    planes = samples if tags.get(_PLANAR, (1,))[0] == 2 else 1
    # samples that stand side by side in a pixel
    own = samples // planes
    if skip:
        if packed != 1 or _TILES in tags or planes != 1:
            raise ValueError("images without a directory must be plain strips")
        start = tags[_STRIPS][0] + skip * height * width * own * dtype.itemsize
        flat = np.frombuffer(raw[start : start + height * width * own * dtype.itemsize], dtype)
        if flat.size < height * width * own:
            raise ValueError("the file ends before its last image")
        return np.moveaxis(flat.reshape(height, width, own), 2, 0)

    def piece(at: int, size: int, w: int) -> np.ndarray:
        part = np.frombuffer(_UNPACK[packed](raw[at : at + size]), dtype).reshape(-1, w, own)
        return np.cumsum(part, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else part

    starts, sizes = (tags[_TILES], tags[_TILE_SIZES]) if _TILES in tags else (tags[_STRIPS], tags[_SIZES])
    pieces = list(zip(starts, sizes, strict=True))
    each = len(pieces) // planes
    out = []
    for plane in range(planes):
        mine = pieces[plane * each : (plane + 1) * each]
        if _TILES in tags:
            tw, th = tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]
            across = -(-width // tw)
            image = np.zeros((-(-height // th) * th, across * tw, own), dtype)
            for k, (at, size) in enumerate(mine):
                y, x = k // across * th, k % across * tw
                image[y : y + th, x : x + tw] = piece(at, size, tw)
            image = image[:, :width]
        else:
            image = np.concatenate([piece(at, size, width) for at, size in mine])
        if len(image) < height:
            raise ValueError("the file ends before its last image")
        out.append(np.moveaxis(image[:height], 2, 0))
    return np.concatenate(out)


def counts(n: int, first: dict[int, tuple]) -> tuple[int, int]:
    """How many images a file of ``n`` directories holds and how many channels vary fastest among them."""
    said = metadata(first) if n else {}
    number = lambda k, other: int(said[k]) if said.get("flavour") == "imagej" and said.get(k, "").isdigit() else other
    total = number("images", n)
    if n not in (1, total):
        raise ValueError(f"{n} directories for {total} images")
    channels = max(1, number("channels", 1))
    if total % channels:
        raise ValueError(f"{total} images for {channels} channels")
    return total, channels


def metadata(tags: dict[int, tuple]) -> dict[str, str]:
    """What the first image says about scales, as raw strings."""
    text = tags.get(_TEXT, (b"",))[0].split(b"\0")[0].decode("utf-8", "replace")
    out = {"flavour": "plain"}
    if text.startswith("ImageJ"):
        out |= dict(line.split("=", 1) for line in text.splitlines() if "=" in line) | {"flavour": "imagej"}
    elif "<OME" in text:
        out["flavour"] = "ome"
        try:
            pixels = next((e for e in ET.fromstring(text).iter() if e.tag.split("}")[-1] == "Pixels"), None)
        except ET.ParseError:
            pixels = None
        if pixels is not None:
            out |= {f"ome_{k}": v for k, v in pixels.attrib.items()}
    if _XRES in tags and len(tags[_XRES]) == 2 and tags[_XRES][1]:
        out["x_resolution"] = repr(tags[_XRES][0] / tags[_XRES][1])
    if tags.get(_UNIT, (0,))[0] in _RESOLUTION:
        out["resolution_unit"] = _RESOLUTION[tags[_UNIT][0]]
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path).select("path", "content")


def load(spark: SparkSession, path: str) -> DataFrame:
    """``read_frames`` for a path whose suffix says what it is; others raise ``ValueError``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(SUFFIXES):
        raise ValueError(f"cannot read {name!r}, expected one of {', '.join(SUFFIXES)}")
    return read_frames(spark, path)


def _images(raw, layout: Layout, numbers: range, total: int, channels: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(t, c, pixels) of some of a file's images; its first directory stands for all if it is the only one."""
    one = len(layout.places) != total
    tags = layout.tags(raw, layout.places[0]) if one and total else {}
    for k in numbers:
        px = image_of(raw, layout.order, tags if one else layout.tags(raw, layout.places[k]), k if one else 0)
        for sample, plane in enumerate(px):
            yield k // channels, k % channels * len(px) + sample, plane


class _Range(InputPartition):
    def __init__(self, path: str, name: str, layout: Layout, numbers: range, total: int, channels: int):
        super().__init__(None)
        self.path, self.name, self.numbers, self.total, self.channels = path, name, numbers, total, channels
        # of the directories only those of the range are sent along
        self.layout = layout


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def _ranges(self, system, path: str) -> list[_Range]:
        with system.open_input_file(path) as handle:
            raw = Ranged(handle)
            layout = Layout(raw)
            first = layout.tags(raw, layout.places[0]) if layout.places else {}
        total, channels = counts(len(layout.places), first)
        size = first[_HEIGHT][0] * first[_WIDTH][0] * first.get(_SAMPLES, (1,))[0] * first.get(_BITS, (8,))[0] // 8 if first else 1
        step = max(1, self.bytes // max(1, size))
        name = path if system.type_name != "local" else f"file:{path}"
        return [_Range(path, name, _part(layout, k, step, total), range(k, min(total, k + step)), total, channels) for k in range(0, total, step)]

    def partitions(self) -> list[InputPartition]:
        system, files = listed(self.path)
        with ThreadPoolExecutor(16) as pool:
            return [r for ranges in pool.map(lambda f: self._ranges(system, f), files) for r in ranges]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        if partition is None or not hasattr(partition, "numbers"):
            return
        with system.open_input_file(partition.path) as handle:
            for t, c, px in _images(Ranged(handle), partition.layout, partition.numbers, partition.total, partition.channels):
                values = pa.array(px.astype(float).ravel())
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                sizes = [pa.array([v], pa.int32()) for v in (t, c, *px.shape)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.name]), *sizes, lists], ["path", "t", "c", "height", "width", "px"])


class _Places(dict):
    """Places of some of a file's directories by number, as long as the list of all."""

    def __init__(self, places: dict[int, int], n: int):
        super().__init__(places)
        self.n = n

    def __len__(self) -> int:
        return self.n

    def __reduce__(self):
        return _Places, (dict(self.items()), self.n)


def _part(layout: Layout, start: int, step: int, total: int) -> Layout:
    out = Layout.__new__(Layout)
    out.__dict__ |= layout.__dict__
    n = len(layout.places)
    out.places = _Places({k: layout.places[k] for k in (range(1) if n != total else range(start, min(n, start + step)))}, n)
    return out


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; an error if pyarrow opens no such one."""
    local = re.sub("^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", local):
        return arrow_fs.FileSystem.from_uri(local)
    return arrow_fs.LocalFileSystem(), local


def listed(path: str) -> tuple[arrow_fs.FileSystem, list[str]]:
    """The TIFF files of a folder, of a pattern in a folder, or the file named."""
    system, path = opened(path.rstrip("/"))
    folder, _, name = path.rpartition("/")
    info = system.get_file_info(path)
    if info.type == arrow_fs.FileType.File:
        return system, [path]
    if info.type == arrow_fs.FileType.Directory:
        folder, name = path, "*.[tT][iI][fF]*"
    elif not any(c in name for c in "*?["):
        raise FileNotFoundError(path)
    found = system.get_file_info(arrow_fs.FileSelector(folder or "/"))
    return system, sorted(f.path for f in found if f.type == arrow_fs.FileType.File and fnmatch.fnmatch(f.base_name, name) and not f.base_name.startswith((".", "_")))


class TiffSource(DataSource):
    """``spark.read.format("tiff").option("rangeBytes", n).load(path)``: one row per image, a task for each range of a file."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


def read_frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every image of every file under ``path``, read by ranges of about ``range_bytes``."""
    try:
        opened(path)
    except (pa.ArrowInvalid, OSError):
        return read_whole_files(spark, path)
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiff").option("rangeBytes", range_bytes).load(path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from rows that hold whole files, for file systems that only Spark opens."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                layout = Layout(raw)
                total, channels = counts(len(layout.places), layout.tags(raw, layout.places[0]) if layout.places else {})
                for t, c, px in _images(raw, layout, range(total), total, channels):
                    yield pd.DataFrame({"path": [name], "t": [t], "c": [c], "height": [px.shape[0]], "width": [px.shape[1]], "px": [px.astype(float).ravel()]})

    return _files(spark, path).mapInPandas(parse, FRAMES)


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    """``(path, flavour, pixel_size, frame_interval)`` in micrometres and seconds; null where unknown."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [metadata(directories(raw)[1][0]) for raw in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "tags": found})

    raw = _files(spark, path).mapInPandas(parse, "path string, tags map<string,string>")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    number = lambda k: units.positive(tag(k))
    per_pixel = lambda unit: F.try_divide(units.factor(unit, units.LENGTHS_UM), number("x_resolution"))
    imagej = tag("flavour") == "imagej"
    size = F.coalesce(
        F.when(imagej, per_pixel(tag("unit"))),
        number("ome_PhysicalSizeX") * units.factor(F.coalesce(tag("ome_PhysicalSizeXUnit"), F.lit("µm")), units.LENGTHS_UM),
        F.when(~imagej, per_pixel(tag("resolution_unit"))),
    )
    interval = F.coalesce(
        F.when(imagej, F.coalesce(number("finterval"), F.try_divide(F.lit(1.0), number("fps")))),
        number("ome_TimeIncrement") * units.factor(F.coalesce(tag("ome_TimeIncrementUnit"), F.lit("s")), units.TIMES_S),
    )
    return raw.select("path", tag("flavour").alias("flavour"), size.alias("pixel_size"), interval.alias("frame_interval"))


def encode(images: Iterator[np.ndarray], description: str = "") -> Iterator[bytes]:
    """A little-endian TIFF of 32-bit float images, piece by piece."""
    text = description.encode() + b"\0"
    yield b"II*\0" + struct.pack("<I", 8)
    at = 8
    image = next(images, None)
    while image is not None:
        after = next(images, None)
        px = np.ascontiguousarray(image, "<f4").tobytes()
        note = text if at == 8 and description else b""
        entries = 9 + bool(note)
        data = at + 2 + 12 * entries + 4
        rows = [(_WIDTH, 4, 1, image.shape[1]), (_HEIGHT, 4, 1, image.shape[0]), (_BITS, 3, 1, 32), (_PACKED, 3, 1, 1), (262, 3, 1, 1)]
        if note:
            rows.append((_TEXT, 2, len(note), data if len(note) > 4 else int.from_bytes(note.ljust(4, b"\0"), "little")))
        start = data + (len(note) if len(note) > 4 else 0)
        start += start % 2
        rows += [(_STRIPS, 4, 1, start), (277, 3, 1, 1), (_SIZES, 4, 1, len(px)), (_FORMAT, 3, 1, 3)]
        end = start + len(px)
        head = struct.pack("<H", entries) + b"".join(struct.pack("<HHII", *r) for r in rows) + struct.pack("<I", end if after is not None else 0)
        yield (head + (note if len(note) > 4 else b"")).ljust(start - at, b"\0") + px
        at, image = end, after


def _directory(k: int, n: int, base: int, height: int, width: int, big: bool, note: tuple[int, int] | None) -> bytes:
    """The directory of image ``k`` of ``n``; its pixels follow, and all images take as many bytes."""
    word, number, link, form = ("Q", "Q", "Q", "HHQQ") if big else ("I", "H", "I", "HHII")
    entries = 10
    head = struct.calcsize("<" + number) + entries * struct.calcsize("<" + form) + struct.calcsize("<" + word)
    size = head + 4 * height * width
    at = base + k * size
    # a description belongs to the first image; others name an empty one
    text = note if note and k == 0 else (1, 0)
    tags = [(_WIDTH, 4, 1, width), (_HEIGHT, 4, 1, height), (_BITS, 3, 1, 32), (_PACKED, 3, 1, 1), (262, 3, 1, 1), (_TEXT, 2, *text), (_STRIPS, 16 if big else 4, 1, at + head), (_SAMPLES, 3, 1, 1), (_SIZES, 16 if big else 4, 1, 4 * height * width), (_FORMAT, 3, 1, 3)]
    return struct.pack("<" + number, entries) + b"".join(struct.pack("<" + form, *t) for t in tags) + struct.pack("<" + link, at + size if k + 1 < n else 0)


def write_movie(frames: DataFrame, path: str, description: str = "", big: bool | None = None) -> None:
    """One movie as a TIFF of 32-bit floats in the order of ``t``, each image written by the task that has it.

    The tasks write into one file, so all executors must see ``path``.  ``big`` forces BigTIFF (``None``: where 4 GB don't do).
    Frames that differ in size or repeat a ``t`` raise an error.
    """
    said = frames.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("height", "width")], F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("times")).first()
    n, height, width = said["n"], said["min_height"], said["min_width"]
    if n and (height, width, n) != (said["max_height"], said["max_width"], said["times"]):
        raise ValueError("the frames of a movie must have one size, and each its own t")
    text = description.encode() + b"\0" if description else b""
    text = text.ljust(8, b"\0") + b"\0" * (-len(text.ljust(8, b"\0")) % 8) if text else b""
    big = big if big is not None else (n or 0) * (4 * (height or 0) * (width or 0) + 150) + len(text) >= 1 << 32
    start = (struct.pack("<2sHHHQ", b"II", 43, 8, 0, (16 + len(text)) if n else 0) if big else struct.pack("<2sHI", b"II", 42, (8 + len(text)) if n else 0)) + text
    base, note = len(start), (len(text), 16 if big else 8) if text else None
    with open(path, "wb") as out:
        out.write(start)
        out.truncate(base + (n or 0) * (len(_directory(0, 1, base, height, width, big, note)) + 4 * height * width if n else 0))
    if not n:
        return
    # numbers of the times, block by block: a few counts are all that the driver adds up
    block = F.floor(F.col("t") / 4096)
    held = frames.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("block").orderBy("t")) - 1
    numbered = frames.select("t", block.alias("block")).join(held.select("block", before.alias("before")), "block").select("t", (F.col("before") + place).alias("k"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(path, "r+b") as out:
                for r in range(batch.num_rows):
                    k = batch.column("k")[r].as_py()
                    px = batch.column("px")[r].values.to_numpy(zero_copy_only=False).astype("<f4")
                    head = _directory(k, n, base, height, width, big, note)
                    out.seek(base + k * (len(head) + 4 * height * width))
                    out.write(head + px.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])

    done = frames.select("t", "px").join(numbered, "t").mapInArrow(put, "written bigint").agg(F.sum("written")).first()[0]
    if done != n:
        raise RuntimeError(f"{done} of {n} frames were written")
