"""Token-id files: one shared zstandard dictionary, each document a frame of its own.

Layout of a store, a folder in the shared file system:

    dictionary.zdict            the dictionary, trained on serialized id arrays of a bounded sample
    part-<n>-<k>-<attempt>.ids  "TOKIDS01", frames, index, tail

The index holds, for the documents of the part in ascending doc_id order, the frame offsets (n + 1),
doc_ids, null flags and token counts, so that one short document is read by two small reads. The tail
is the index's offset, the number of documents, the bytes of an id, the index's crc32, the sha256 of
the dictionary and "TOKIDS01". A part ends at ``part_bytes``, so files and their indexes are bounded
whatever the table's size. Only parts that the returned manifest names belong to a store:
a task that is run twice writes two files, and the manifest names those of the attempt that won.

Texts become frames where they are read; only frames are shuffled. They are dealt out by ranges of doc_id with the
row's own number as the last key, so that equal ids spread; the bounds come from a sample of these keys, found
by hashes of the rows' numbers.

The dictionary is trained on ``sample`` windows of texts, those of the smallest hashes among all windows of
``window_chars`` characters of all different texts, whole texts long: each part of each text can be chosen, and
the sample is bounded by both parameters. Defined results: null or empty text is the end id alone; a null doc_id
sorts first; repeated rows are stored each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package, written
from .vocab import byte_bpe

MAGIC = b"TOKIDS01"
TAIL = "<QQII32s8s"
MANIFEST = "part int, piece int, uri string, docs long, ids long, bytes long"


@dataclass(frozen=True)
class StoreConfig:
    vocabulary: str = "byte_bpe_50k"
    end_id: int = 2
    id_bytes: int = 2  # 2 for vocabularies below 65,536 ids, else 4
    level: int = 3
    dictionary_bytes: int = 65_536
    sample: int = 2_000  # windows to train on
    window_chars: int = 8_192
    part_bytes: int = 128 << 20  # a part file ends behind the document that reaches it
    task_bytes: int = 64 << 20  # of text for each task that writes, while there are at most
    most_tasks: int = 20_000  # of them, so that the sample of keys for their bounds stays small; a task may write many parts
    keys_per_task: int = 64  # sampled for the bounds of the ranges


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _serial(ids: np.ndarray, config: StoreConfig) -> bytes:
    return np.append(ids, config.end_id).astype(f"<u{config.id_bytes}").tobytes()


def train_dictionary(docs: DataFrame, config: StoreConfig, chars: int) -> bytes:
    """Bytes of the dictionary; with too few samples to train on, the samples themselves. ``chars``: of all texts."""
    width = config.window_chars
    places = F.sequence(F.lit(0).cast("long"), F.expr(f"(length(text) - 1) div {width}"))
    windows = docs.where("text <> ''").select("text", F.xxhash64("text").alias("h"), F.explode(places).alias("at")).withColumn("key", F.xxhash64("h", "at"))
    # Twice as many keys as wanted lie below this bound if hashes are even; copies of a text count once, so many copies need another look.
    share = min(1.0, (2 * config.sample + 100) * width / max(1, chars))
    while True:
        few = windows.where(F.col("key") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
        one = few.groupBy("key").agg(F.any_value(F.expr(f"substring(text, cast(at * {width} as int) + 1, {width})")).alias("text"))
        rows = one.orderBy("key").limit(config.sample).collect()
        if len(rows) == config.sample or share == 1:
            break
        share = min(1.0, 16 * share)
    bpe = byte_bpe(config.vocabulary)
    samples = [_serial(bpe.ids(r["text"]), config) for r in rows]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or b"\0" * 8)[: config.dictionary_bytes]


def _range_bounds(keyed: DataFrame, rows: int, tasks: int, config: StoreConfig) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids (a null as the smallest long) and row numbers that bound the ranges of ``tasks`` tasks."""
    wanted = tasks * config.keys_per_task
    share = min(1.0, 2 * wanted / max(1, rows))
    some = keyed.where(F.xxhash64("row") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    got = some.orderBy(F.xxhash64("row")).limit(wanted).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "row").toPandas()
    got = got.sort_values(["doc_id", "row"])
    at = (np.arange(1, tasks) * len(got)) // tasks
    return got["doc_id"].to_numpy(np.int64)[at], got["row"].to_numpy(np.int64)[at]


def _frames(dictionary: bytes, config: StoreConfig, bounds: tuple[np.ndarray, np.ndarray]):
    """doc_id, text, row to task, doc_id, row, n (ids) and frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(config.vocabulary)
        squeeze = zstandard.ZstdCompressor(level=config.level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        ids_of, rows_of = bounds
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                serial = [_serial(bpe.ids(x.as_py()), config) for x in part.column(1)]
                key, row = part.column(0).fill_null(-(2**63)).to_numpy(), part.column(2).to_numpy()
                # How many bounds are at or below (doc_id, row): among those of an equal doc_id the row decides.
                low, high = np.searchsorted(ids_of, key, "left"), np.searchsorted(ids_of, key, "right")
                task = [a if a == b else a + int(np.searchsorted(rows_of[a:b], r, "right")) for a, b, r in zip(low.tolist(), high.tolist(), row.tolist(), strict=True)]
                n = [len(x) // config.id_bytes for x in serial]
                yield pa.record_batch([pa.array(task, pa.int32()), part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array([squeeze.compress(x) for x in serial], pa.binary())], names=["task", "doc_id", "row", "n", "frame"])

    return run


class _PartWriter:
    """One part file: frames as they come, then its index and tail."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        fs, path = _open(uri)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.offsets = [len(MAGIC)]

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.doc_ids.append(doc_id)
        self.sizes.append(n)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self, dictionary: bytes, config: StoreConfig) -> tuple[str, int, int, int]:
        """uri, docs, ids, bytes."""
        index = b"".join([
            np.array(self.offsets, "<u8").tobytes(), np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(),
            np.array([x is None for x in self.doc_ids], np.uint8).tobytes(), np.array(self.sizes, "<u8").tobytes(),
        ])
        self.out.write(index)
        self.out.write(struct.pack(TAIL, self.offsets[-1], len(self.doc_ids), config.id_bytes, zlib.crc32(index), hashlib.sha256(dictionary).digest(), MAGIC))
        self.out.close()
        return self.uri, len(self.doc_ids), sum(self.sizes), self.offsets[-1] + len(index) + struct.calcsize(TAIL)


def _write_parts(folder: str, dictionary: bytes, config: StoreConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        done: list[tuple[int, int, str, int, int, int]] = []
        part: _PartWriter | None = None
        task = 0
        for batch in batches:
            for name, doc_id, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if part is not None and (part.offsets[-1] >= config.part_bytes or name != task):
                    done.append((task, len(done), *part.close(dictionary, config)))
                    part = None
                if part is None:
                    task = name
                    part = _PartWriter(f"{folder}/part-{task:06d}-{len(done):04d}-{context.taskAttemptId()}.ids")
                part.add(doc_id, n, frame.as_py())
        if part is not None:
            done.append((task, len(done), *part.close(dictionary, config)))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)] if done else [pa.array([], k) for k in kinds], names=["part", "piece", "uri", "docs", "ids", "bytes"])

    return run


def write_store(docs: DataFrame, config: StoreConfig = StoreConfig(), folder: str | None = None) -> tuple[str, DataFrame]:
    """Write a store; its folder, and its manifest: (part, piece) ascending by doc_id, uri, docs, ids, bytes."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, chars, size = slim.agg(F.count("*"), F.sum(F.length("text")), F.sum(F.octet_length("text"))).first()
    dictionary = train_dictionary(slim, config, chars or 0)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)
    tasks = min(config.most_tasks, max(1, -(-(size or 0) // config.task_bytes)))
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    bounds = _range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")), rows, tasks, config)
    frames = numbered.mapInArrow(_frames(dictionary, config, bounds), "task int, doc_id long, row long, n long, frame binary")
    dealt = frames.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "doc_id", "row")
    return folder, written(dealt.mapInArrow(_write_parts(folder, dictionary, config), MANIFEST), "store-manifest")


class Part:
    """A part file: its index, and its documents on demand."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size() - struct.calcsize(TAIL)
        at, n, self.id_bytes, crc, sha, magic = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), end)) if end > 0 else (0, 0, 0, 0, b"", b"")
        index = self.file.read_at(end - at, at) if magic == MAGIC and at <= end else b""
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} is not whole")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.offsets = np.frombuffer(index, "<u8", n + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.nulls = np.frombuffer(index, np.uint8, n, 8 * (2 * n + 1)).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", n, 8 * (2 * n + 1) + n)
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Token ids of the documents at places first to last - 1, by one read."""
        base, end = int(self.offsets[first]), int(self.offsets[last])
        raw = self.file.read_at(end - base, base)
        for k in range(first, last):
            frame = raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]
            yield np.frombuffer(self.expand.decompress(frame), f"<u{self.id_bytes}")


def _dictionary(folder: str) -> bytes:
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/dictionary.zdict") as f:
        return f.read()


def _read_parts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for row in batch.to_pylist():
                dictionary = dictionary or _dictionary(folder)
                part, start = Part(row["uri"], dictionary), row["before"]
                n = len(part.doc_ids)
                starts = start + np.r_[0, np.cumsum(part.sizes.astype(np.int64))]
                for at in range(0, n, 256):
                    to = min(n, at + 256)
                    decoded = list(part.ids(at, to))
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in decoded]
                    yield pa.record_batch([pa.array(part.doc_ids[at:to], mask=part.nulls[at:to]), pa.array(starts[at:to]), pa.array([len(x) for x in decoded], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    parts = manifest.count()
    # One row for each part file.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("part", "uri", before.alias("before")).repartition(max(1, parts)).mapInArrow(_read_parts(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """Token ids of one document: by the index of each part until found, then one frame."""
    del spark
    dictionary = _dictionary(folder)
    for row in manifest.orderBy("part", "piece").toLocalIterator():
        part = Part(row["uri"], dictionary)
        at = np.flatnonzero((part.doc_ids == doc_id) & ~part.nulls)
        if len(at):
            return next(part.ids(int(at[0]), int(at[0]) + 1))
    return None
