"""LAS point files as a Spark data source: many tasks a file, headers that skip files, and tables of headers and ranges.

A task reads a range of bytes: the header first, then the points that begin in its range. Comparisons of x, y and z with constants reach the source
(``spark.sql.python.filterPushdown.enabled``), so files whose header bounds lie elsewhere cost their header alone, and points outside never leave the task that
reads them. Ranges of points have no bounds of their own in the format; ``las_ranges`` makes a table of them once, and ``points_of_ranges`` reads the rows a caller keeps.
Files are opened by URI through Arrow's file systems, local paths included.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the public LAS format: bytes of each point format's fields, and of the longest header; from format 6 on the class has a byte of its own.
_POINT_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
_HEADER_BYTES = 375
_VLR_HEAD = 54
_GEO_KEYS, _WKT = 34735, 2112
_PROJECTED, _GEOGRAPHIC = 3072, 2048

POINTS = "file string, point_id long, x double, y double, z double, intensity int, classification int"
HEADERS = "file string, bytes long, version string, point_format int, point_count long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, epsg int, wkt string"
RANGES = "file string, begin long, end long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


@dataclass(frozen=True)
class Header:
    """What a LAS header says of the points that follow."""

    version: str
    start: int
    kind: int
    length: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    size: int
    records: int

    @property
    def end(self) -> int:
        return self.start + self.count * self.length


def las_header(data: bytes) -> Header:
    """The header at the start of a LAS 1.0-1.4 file; raises on other files and on compressed points."""
    if data[:4] != b"LASF" or len(data) < 227:
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    size, start, records = struct.unpack_from("<HII", data, 94)
    kind, length, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0xC0:
        raise ValueError("compressed points aren't supported")
    if kind not in _POINT_BYTES or length < _POINT_BYTES[kind]:
        raise ValueError(f"point format {kind} with {length} bytes a point isn't supported")
    if minor >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    return Header(f"{major}.{minor}", start, kind, length, count, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), (x0, y0, z0), (x1, y1, z1), size, records)


def reference_system(data: bytes, header: Header) -> tuple[int | None, str | None]:
    """EPSG code of the projected, else the geographic system, and the text description, from the records before the points; null where there is none."""
    at, epsg, wkt = header.size, None, None
    for _ in range(header.records):
        if at + _VLR_HEAD > min(len(data), header.start):
            break
        kind, length = struct.unpack_from("<HH", data, at + 18)
        body = data[at + _VLR_HEAD : at + _VLR_HEAD + length]
        if kind == _GEO_KEYS and len(body) >= 8:
            keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)[1:]
            found = {int(k): int(v) for k, place, _, v in keys if place == 0}
            epsg = found.get(_PROJECTED) or found.get(_GEOGRAPHIC) or epsg
        elif kind == _WKT:
            wkt = body.rstrip(b"\0").decode("utf-8", "replace")
        at += _VLR_HEAD + length
    return epsg, wkt


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray, scale: float = 0.001, epsg: int | None = None) -> bytes:
    """A LAS 1.2 file of format 0 points, with a record of the projected system where one is given."""
    xyz = np.stack([x, y, z], 1)
    low, high = (xyz.min(0), xyz.max(0)) if len(x) else (np.zeros(3), np.zeros(3))
    origin = np.floor(low)
    record = b"" if epsg is None else struct.pack("<H16sHH32s", 0, b"LASF_Projection", _GEO_KEYS, 16, b"") + struct.pack("<8H", 1, 1, 0, 1, _PROJECTED, 0, 1, epsg)
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 2)
    struct.pack_into("<HII", head, 94, 227, 227 + len(record), int(epsg is not None))
    struct.pack_into("<BHI", head, 104, 0, 20, len(x))
    struct.pack_into("<3d3d", head, 131, *([scale] * 3), *origin)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    body = np.zeros(len(x), np.dtype({"names": ["xyz", "class"], "formats": ["<3i4", "u1"], "offsets": [0, 15], "itemsize": 20}))
    body["xyz"], body["class"] = np.rint((xyz - origin) / scale), classification
    return bytes(head) + record + body.tobytes()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI or local path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class LasFile:
    """An open LAS file; ``read_bytes`` counts what was read of it."""

    def __init__(self, path: str) -> None:
        system, inner = located(path)
        self.path, self.stream, self.read_bytes = path, system.open_input_file(inner), 0
        self.header = las_header(self.bytes(0, _HEADER_BYTES))
        if self.stream.size() < self.header.end:
            raise ValueError(f"{path} is shorter than its header says")

    def bytes(self, at: int, n: int) -> bytes:
        data = self.stream.read_at(n, at)
        self.read_bytes += len(data)
        return data

    def close(self) -> None:
        self.stream.close()

    def starting(self, begin: int, end: int) -> tuple[int, int]:
        """Points whose first byte lies in a range of bytes: the first, and the one after the last."""
        h = self.header
        low, high = (min(h.count, max(0, -(-(at - h.start) // h.length))) for at in (begin, end))
        return low, high

    def points(self, begin: int, end: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers, coordinates, intensities and classes of points ``begin`` to ``end``, ``chunk`` at a time."""
        h = self.header
        layout = np.dtype({"names": ["xyz", "intensity", "class"], "formats": ["<3i4", "<u2", "u1"], "offsets": [0, 12, 16 if h.kind >= 6 else 15], "itemsize": h.length})
        for at in range(begin, end, chunk):
            n = min(chunk, end - at)
            part = np.frombuffer(self.bytes(h.start + at * h.length, n * h.length), layout)
            yield np.arange(at, at + n, dtype=np.int64), part["xyz"] * np.array(h.scale) + np.array(h.offset), part["intensity"].astype(np.int32), (part["class"] & (255 if h.kind >= 6 else 31)).astype(np.int32)


@dataclass
class Bounds:
    """Closed limits of x, y and z."""

    low: tuple[float, float, float] = (-math.inf,) * 3
    high: tuple[float, float, float] = (math.inf,) * 3

    def narrowed(self, filters: list[Filter]) -> Bounds:
        """Narrowed by comparisons of a coordinate with a number; other filters change nothing."""
        low, high = list(self.low), list(self.high)
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",), ("z",)) and isinstance(f.value, (int, float)):
                k = "xyz".index(f.attribute[0])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low[k] = max(low[k], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high[k] = min(high[k], float(f.value))
        return Bounds(tuple(low), tuple(high))

    def misses(self, header: Header) -> bool:
        """True if no point of the file lies inside. Headers hold rounded bounds, so a step of the scale is allowed for."""
        return any(b + s < lo or a - s > hi for a, b, s, lo, hi in zip(header.mins, header.maxs, header.scale, self.low, self.high, strict=True))

    def holds(self, xyz: np.ndarray) -> np.ndarray:
        return np.all((xyz >= np.array(self.low)) & (xyz <= np.array(self.high)), axis=1)


def point_batch(file: str, numbers: np.ndarray, xyz: np.ndarray, intensity: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.DictionaryArray.from_arrays(np.zeros(len(numbers), np.int32), [file]).cast(pa.string()), pa.array(numbers), *(pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3)), pa.array(intensity), pa.array(kind)]
    return pa.RecordBatch.from_arrays(arrays, ["file", "point_id", "x", "y", "z", "intensity", "classification"])


def listed(path: str) -> list[tuple[str, int]]:
    """LAS files at a path, or below it, with their sizes, in order of their names. Names that begin with a dot or an underscore are passed over."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: path.rindex(inner)] if inner in path else ""
    return sorted((f"{prefix}{f.path}", f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() == "las" and f.base_name[0] not in "._")


@dataclass
class Part(InputPartition):
    """A range of bytes of a file."""

    file: str
    begin: int
    end: int


class LasReader(DataSourceReader):
    """Points of ranges of files, for the filters that were pushed."""

    def __init__(self, path: str, part_bytes: int, chunk: int) -> None:
        self.path, self.part_bytes, self.chunk, self.bounds = path, part_bytes, chunk, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.bounds = self.bounds.narrowed(filters)
        yield from filters  # limits are closed here, so Spark tests each row that is left

    def partitions(self) -> list[Part]:
        parts = [Part(file, at, min(at + self.part_bytes, size)) for file, size in listed(self.path) for at in range(0, max(size, 1), self.part_bytes)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        file = LasFile(partition.file)
        try:
            if self.bounds.misses(file.header):
                return
            for numbers, xyz, intensity, kind in file.points(*file.starting(partition.begin, partition.end), self.chunk):
                keep = self.bounds.holds(xyz)
                if keep.any():
                    yield point_batch(partition.file, numbers[keep], xyz[keep], intensity[keep], kind[keep])
        finally:
            file.close()


class HeaderReader(DataSourceReader):
    """One row a file, from its header and the records before its points."""

    def __init__(self, path: str, files: int = 64) -> None:
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        found = listed(self.path)
        return [InputPartition(found[i : i + self.files]) for i in range(0, max(len(found), 1), self.files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name, size in partition.value:
            file = LasFile(name)
            h = file.header
            epsg, wkt = reference_system(file.bytes(0, h.start), h)
            yield (name, size, h.version, h.kind, h.count, *h.mins, *h.maxs, epsg, wkt)
            file.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class LasWriter(DataSourceArrowWriter):
    """Files of at most ``most`` points under hidden names; commit gives them their own names, abort removes those that are there: a task that still runs may leave a hidden one."""

    def __init__(self, path: str, names: list[str], most: int, scale: float, overwrite: bool) -> None:
        self.path, self.names, self.most, self.scale, self.overwrite, self.run = path.rstrip("/"), names, most, scale, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = located(self.path)
        system.create_dir(inner, recursive=True)
        files: list[str] = []
        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(waiting)
            column = lambda name, default: table[name].to_numpy() if name in self.names else np.full(len(table), default)
            data = las_bytes(*(table[c].cast(pa.float64()).to_numpy() for c in "xyz"), column("classification", 0), self.scale)
            files.append(f"{uuid.uuid4().hex}.las")
            with system.open_output_stream(f"{inner}/.{self.run}-{files[-1]}") as out:
                out.write(data)
            waiting.clear()

        for batch in iterator:
            for at in range(0, batch.num_rows, self.most):
                part = batch.slice(at, self.most)
                if waiting and sum(b.num_rows for b in waiting) + part.num_rows > self.most:
                    flush()
                waiting.append(part)
        if waiting:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = located(self.path)
        before = [f for f, _ in listed(self.path)] if self.overwrite and system.get_file_info(inner).type == fs.FileType.Directory else []
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{inner}/.{self.run}-{name}", f"{inner}/{name}")
        for file in before:
            system.delete_file(located(file)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = located(self.path)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(inner)):
                if info.base_name.startswith(f".{self.run}-"):
                    system.delete_file(info.path)


class LasSource(DataSource):
    """``spark.read.format("las")``: points, or with ``table`` = headers a row a file; ``df.write.format("las")`` takes x, y, z and classification."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return HEADERS if self.options.get("table") == "headers" else POINTS

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("table") == "headers":
            return HeaderReader(self.options["path"])
        return LasReader(self.options["path"], int(self.options.get("partbytes", 64 << 20)), int(self.options.get("chunk", 500_000)))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(self.options["path"], schema.names, int(self.options.get("filepoints", 1_000_000)), float(self.options.get("scale", 0.001)), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known and filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    return spark


def read_las(spark: SparkSession, path: str, part_bytes: int = 64 << 20, chunk: int = 500_000) -> DataFrame:
    """Points of the LAS files at or under a path: (file, point_id, x, y, z, intensity, classification); one task for each ``part_bytes`` of a file.

    Files shorter than their header says, compressed points and other files named .las raise. A path without files gives no row.
    """
    return registered(spark).read.format("las").option("partBytes", part_bytes).option("chunk", chunk).load(path)


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a LAS file: size, version, point format and count, bounds, and the reference system; no point is read."""
    return registered(spark).read.format("las").option("table", "headers").load(path)


def write_las(points: DataFrame, path: str, mode: str = "append", file_points: int = 1_000_000, scale: float = 0.001) -> None:
    """Points (x, y, z and, if there, classification) as LAS files of at most ``file_points``; a failed write leaves no file that readers see."""
    registered(points.sparkSession)
    columns = [c for c in ("x", "y", "z", "classification") if c in points.columns]
    points.select(columns).write.format("las").option("filePoints", file_points).option("scale", scale).mode(mode).save(path)


def las_ranges(spark: SparkSession, path: str, points: int = 1_000_000) -> DataFrame:
    """Bounds of each run of ``points`` points of each file: (file, begin, end, x0 ... z1). Computed by a pass over all points; keep it as a table."""
    each = read_las(spark, path).groupBy("file", F.floor(F.col("point_id") / points).alias("run"))
    bounds = [f(c).alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xyz"]
    return each.agg(F.min("point_id").alias("begin"), (F.max("point_id") + 1).alias("end"), *bounds).drop("run").select("file", "begin", "end", "x0", "y0", "z0", "x1", "y1", "z1")


def points_of_ranges(ranges: DataFrame, chunk: int = 500_000) -> DataFrame:
    """Points of the ranges (file, begin, end) that a caller kept of ``las_ranges``; each range is read where its row is, and nothing else of its file but the header."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                file = LasFile(name)
                for part in file.points(begin, end, chunk):
                    yield point_batch(name, *part)
                file.close()

    return ranges.select("file", "begin", "end").mapInArrow(decode, POINTS)
