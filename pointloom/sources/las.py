"""LAS files (ASPRS 1.2 to 1.4, point formats 0-3 and 6-8) as a Spark data source and sink.

``register(spark)`` makes ``spark.read.format("las").option("rows", 500000).load(path)`` and ``df.write.format("las").save(path)``
available. A path is a file or a folder of files, local or a URI that pyarrow's file systems open (file, hdfs, s3, gs).
Records have a fixed length, so a partition is a range of records, read by one seek. Ranges whose box no record of a filter
on x, y, z can lie in are not read: the boxes are those of the headers, of a folder's list of parts, and, for
a large file, those that ``index`` has stored beside it. Of a schema that is given only its columns are decoded.

A writing task makes a file of its own; the commit lists those of the tasks that count and removes all others,
so a retried or lost task leaves nothing. No row passes the driver. Compressed LAZ needs a codec that is not here; it is refused
with a clear error.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship_package

SCHEMA = "point_idx long, x double, y double, z double, intensity int, classification int, red int, green int, blue int, gps_time double"
# Offsets of optional fields by point format in the published layout.
GPS = {1: 20, 3: 20, 6: 22, 7: 22, 8: 22}
RGB = {2: 20, 3: 28, 7: 30, 8: 30}


@dataclass(frozen=True)
class Header:
    version: str
    format_id: int
    record_length: int
    count: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    minimum: tuple[float, float, float]
    maximum: tuple[float, float, float]

    @property
    def dimensions(self) -> list[str]:
        more = (["red", "green", "blue"] if self.format_id in RGB else []) + (["gps_time"] if self.format_id in GPS else [])
        return sorted(["X", "Y", "Z", "intensity", "classification", *more])


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


#: The list of a folder's parts, and the boxes of a file's ranges.
PARTS, BOUNDS = "_parts.json", ".bounds.json"


def files(path: str) -> list[str]:
    """The file itself, or a folder's committed parts, or else its LAS files by name."""
    system, at = _at(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    if system.get_file_info(f"{at.rstrip('/')}/{PARTS}").type == fs.FileType.File:
        with system.open_input_file(f"{at.rstrip('/')}/{PARTS}") as f:
            return [f"{base}/{name}" for name in json.loads(f.read())]
    return [f"{base}/{x.base_name}" for x in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.base_name) if x.base_name.lower().endswith((".las", ".laz"))]


def read_header(path: str) -> Header:
    """The header alone; of a folder that of its parts together."""
    each = files(path)
    if each != [path]:
        every = [read_header(x) for x in each]
        if not every:
            raise ValueError(f"{path} holds no LAS files")
        full = [h for h in every if h.count] or every
        box = [tuple(f(h.minimum[k] if f is min else h.maximum[k] for h in full) for k in range(3)) for f in (min, max)]
        return replace(every[0], count=sum(h.count for h in every), minimum=box[0], maximum=box[1])
    system, at = _at(path)
    with system.open_input_file(at) as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    major, minor = raw[24], raw[25]
    offset, = struct.unpack_from("<I", raw, 96)
    format_id, length, count = struct.unpack_from("<BHI", raw, 104)
    if format_id & 0x80 or path.lower().endswith(".laz"):
        raise NotImplementedError(f"{path} is compressed; convert LAZ to LAS or Parquet first")
    if (major, minor) >= (1, 4):
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", raw, 179)
    if format_id not in (0, 1, 2, 3, 6, 7, 8):
        raise NotImplementedError(f"point format {format_id}")
    return Header(f"{major}.{minor}", format_id, length, count, offset, scale, shift, (x0, y0, z0), (x1, y1, z1))


def read_crs(path: str) -> str:
    """The reference system named by the file's variable-length records: its WKT, or the EPSG code of its GeoTIFF keys; "none / local" without either."""
    path = files(path)[0]
    system, at = _at(path)
    with system.open_input_file(at) as f:
        raw = f.read(375)
        size, = struct.unpack_from("<H", raw, 94)
        records, = struct.unpack_from("<I", raw, 100)
        f.seek(size)
        code = None
        for _ in range(records):
            head = f.read(54)
            if len(head) < 54:
                break
            user, kind, length = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
            body = f.read(length)
            if user == b"LASF_Projection" and kind == 2112:
                return body.rstrip(b"\0").decode("utf-8", "replace")
            if user == b"LASF_Projection" and kind == 34735:
                keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)[1:]
                # The keys of a projected and of a geographic system.
                found = {int(k): int(v) for k, place, _, v in keys if place == 0}
                code = found.get(3072) or found.get(2048) or code
    return f"EPSG:{code}" if code else "none / local"


def validate(path: str) -> Header:
    """The header, once the file is known to hold all its records."""
    header = read_header(path)
    if files(path) != [path]:
        for x in files(path):
            validate(x)
        return header
    system, at = _at(path)
    size, wanted = system.get_file_info(at).size, header.offset + header.count * header.record_length
    if size < wanted:
        raise ValueError(f"{path} is truncated: {size} bytes of at least {wanted}")
    return header


def decode(raw: bytes, header: Header, first: int, columns: list[str]) -> pa.RecordBatch:
    n = len(raw) // header.record_length
    table = np.frombuffer(raw, np.uint8, n * header.record_length).reshape(n, header.record_length)
    field = lambda at, kind: np.ascontiguousarray(table[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]

    def column(name: str) -> pa.Array:
        if name == "point_idx":
            return pa.array(np.arange(first, first + n))
        if name in ("x", "y", "z"):
            k = "xyz".index(name)
            return pa.array(field(4 * k, "<i4") * header.scale[k] + header.shift[k])
        if name == "intensity":
            return pa.array(field(12, "<u2").astype(np.int32))
        if name == "classification":
            return pa.array((field(16, "u1") if header.format_id >= 6 else field(15, "u1") & 31).astype(np.int32))
        if name == "gps_time":
            return pa.array(field(GPS[header.format_id], "<f8")) if header.format_id in GPS else pa.nulls(n, pa.float64())
        k = ("red", "green", "blue").index(name)
        return pa.array(field(RGB[header.format_id] + 2 * k, "<u2").astype(np.int32)) if header.format_id in RGB else pa.nulls(n, pa.int32())

    return pa.RecordBatch.from_arrays([column(c) for c in columns], names=columns)


@dataclass
class _Range(InputPartition):
    path: str
    header: Header
    begin: int  # of the range in its file
    count: int
    first: int  # number of its first record in the whole


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, cap: int | None, columns: list[str]) -> None:
        self.rows, self.columns = rows, columns
        self.low, self.high = [-np.inf] * 3, [np.inf] * 3
        self.parts = [(x, validate(x)) for x in files(path)]
        self.cap = cap

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes the box that filters on single coordinates span; Spark applies them all to the rows that are read."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0].lower()
            if name in ("x", "y", "z") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                k = "xyz".index(name)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[k] = max(self.low[k], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[k] = min(self.high[k], float(f.value))
            yield f

    def _meets(self, low: Iterable[float], high: Iterable[float], scale: tuple[float, float, float]) -> bool:
        # Boxes may have been rounded to whole steps.
        return all(a - s <= h and b + s >= c for a, b, c, h, s in zip(low, high, self.low, self.high, scale, strict=True))

    def partitions(self) -> list[_Range]:
        out, first = [], 0
        for path, header in self.parts:
            count = header.count if self.cap is None else min(header.count, self.cap - first)
            if count > 0 and self._meets(header.minimum, header.maximum, header.scale):
                known = stored_bounds(path)
                rows = known["rows"] if known else self.rows
                for k, begin in enumerate(range(0, count, rows)):
                    if not known or self._meets(known["low"][k], known["high"][k], header.scale):
                        out.append(_Range(path, header, begin, min(rows, count - begin), first + begin))
            first += max(count, 0)
        return out or [_Range("", self.parts[0][1], 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, at = _at(partition.path)
        length = partition.header.record_length
        with system.open_input_file(at) as f:
            f.seek(partition.header.offset + partition.begin * length)
            for k in range(0, partition.count, 100_000):
                n = min(100_000, partition.count - k)
                yield decode(f.read(n * length), partition.header, partition.first + k, self.columns)


def stored_bounds(path: str) -> dict | None:
    system, at = _at(path + BOUNDS)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_file(at) as f:
        return json.loads(f.read())


def index(spark: SparkSession, path: str, rows: int = 500_000) -> int:
    """Store the box of each range of a file beside it, for reads that are cropped; how many ranges. One row for each range comes to the driver."""
    for one in files(path):
        found = load(spark, one, rows, columns=["point_idx", *"xyz"]).groupBy(F.floor(F.col("point_idx") / rows).alias("k")).agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"]).orderBy("k").collect()
        system, at = _at(one + BOUNDS)
        with system.open_output_stream(at) as out:
            out.write(json.dumps({"rows": rows, "low": [[r[f"l{c}"] for c in "xyz"] for r in found], "high": [[r[f"h{c}"] for c in "xyz"] for r in found]}).encode())
    return len(found)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    task: int


#: A record of format 3: place, intensity, (flags), class, (angle, user data, source, time), colour.
_RECORD = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("rest", "V4"), ("gps_time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])


class _Writer(DataSourceArrowWriter):
    """A LAS 1.2 file of format 3 for each task."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.scale = float(options.get("scale", 0.001))
        self.shift = [float(options.get(f"shift{c}", 0.0)) for c in "xyz"]
        system, at = _at(self.path)
        if not overwrite and system.get_file_info(f"{at}/{PARTS}").type == fs.FileType.File:
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        name = f"part-{task:06d}-{uuid.uuid4().hex}.las"
        n, low, high = 0, np.full(3, np.inf), np.full(3, -np.inf)
        # The header needs the numbers of the rows, so these go to a file of their own first.
        with system.open_output_stream(f"{at}/_{name}.records") as out:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, _RECORD)
                for k, c in enumerate("xyz"):
                    value = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    whole = np.round((value - self.shift[k]) / self.scale)
                    if len(whole) and not (np.abs(whole) < 2**31).all():
                        raise ValueError("a place does not fit the file's scale")
                    rows[c.upper()] = whole
                    if len(whole):
                        low[k], high[k] = min(low[k], value.min()), max(high[k], value.max())
                for c in ("intensity", "classification", "red", "green", "blue"):
                    i = batch.schema.get_field_index(c)
                    if i >= 0:
                        value = batch.column(i).fill_null(0).to_numpy(zero_copy_only=False)
                        rows[c] = value & 31 if c == "classification" else value
                n += len(rows)
                out.write(rows.tobytes())
        if n:
            box = [v for pair in zip(high, low, strict=True) for v in pair]
            header = bytearray(227)
            header[:4], header[24], header[25] = b"LASF", 1, 2
            struct.pack_into("<HI", header, 94, 227, 227)
            struct.pack_into("<BHI", header, 104, 3, 34, n)
            struct.pack_into("<12d", header, 131, *[self.scale] * 3, *self.shift, *box)
            with system.open_output_stream(f"{at}/{name}") as out, system.open_input_stream(f"{at}/_{name}.records") as records:
                out.write(bytes(header))
                while chunk := records.read(1 << 22):
                    out.write(chunk)
        system.delete_file(f"{at}/_{name}.records")
        return _Part(name if n else None, task)

    def commit(self, messages: list[_Part | None]) -> None:
        """List the parts, in the order of the tasks, and remove what no counting task has written."""
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        names = [m.name for m in sorted((m for m in messages if m), key=lambda m: m.task) if m.name]
        with system.open_output_stream(f"{at}/{PARTS}.new") as out:
            out.write(json.dumps(names).encode())
        system.move(f"{at}/{PARTS}.new", f"{at}/{PARTS}")
        for x in system.get_file_info(fs.FileSelector(at)):
            if x.type == fs.FileType.File and x.base_name != PARTS and x.base_name not in names:
                system.delete_file(x.path)

    def abort(self, messages: list[_Part | None]) -> None:
        system, at = _at(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{at}/{m.name}")


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        cap = self.options.get("maxrecords") or self.options.get("maxRecords")
        return _Reader(self.options["path"], int(self.options.get("rows", 500_000)), int(cap) if cap else None, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def write(points: DataFrame, path: str, scale: float = 0.001) -> int:
    """Points as a folder of LAS 1.2 files of format 3, in the order of point_idx; how many. Nulls of attributes become 0."""
    register(points.sparkSession)
    low = points.agg(F.count("*"), *[F.min(c) for c in "xyz"]).first()
    kept = [c for c in ("intensity", "classification", "red", "green", "blue") if c in points.columns]
    ordered = points.repartitionByRange("point_idx").sortWithinPartitions("point_idx").select(*[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("int").alias(c) for c in kept])
    ordered.write.format("las").option("scale", scale).options(**{f"shift{c}": low[k + 1] or 0.0 for k, c in enumerate("xyz")}).mode("overwrite").save(path)
    return low[0]


def truncated_copy(path: str, to: str) -> str:
    """The first file of ``path`` without its last byte, for tests of readers; the new path."""
    system, at = _at(files(path)[0])
    target, new = _at(to)
    with system.open_input_stream(at) as source, target.open_output_stream(new) as out:
        left = system.get_file_info(at).size - 1
        while left and (chunk := source.read(min(left, 1 << 22))):
            out.write(chunk)
            left -= len(chunk)
    return to


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)


def load(spark: SparkSession, path: str, rows: int = 500_000, max_records: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Points of a LAS file or folder; an error if one is truncated, compressed or all are empty. ``columns``: only these are decoded."""
    if not validate(path).count:
        raise ValueError(f"{path} holds no points")
    register(spark)
    reader = spark.read.format("las").option("rows", rows)
    if columns:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return (reader.option("maxRecords", max_records) if max_records else reader).load(path)


def size(path: str) -> int:
    """Bytes of the file, or of a folder's parts."""
    return sum(system.get_file_info(at).size for system, at in map(_at, files(path)))


def header_frame(spark: SparkSession, path: str) -> DataFrame:
    """The header as one row, with what attributes are there and the reference system (local if none is named)."""
    h = read_header(path)
    row = (h.version, h.format_id, h.record_length, h.count, h.offset, *h.minimum, *h.maximum, h.dimensions, read_crs(path), h.format_id in RGB, True, True, h.format_id in GPS)
    return spark.createDataFrame([row], "version string, format_id int, record_length int, point_count long, data_offset long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, dims array<string>, crs string, has_rgb boolean, has_intensity boolean, has_classification boolean, has_gps_time boolean")
