"""Bounded-space online packing of token sequences.

Each partition streams its documents past a fixed number of open windows. Whole windows of a long
document leave at once; what remains is placed best-fit. When nothing fits, the fullest window is
emitted: topped up by the head of the document if both sides of that cut reach ``min_cut`` tokens,
else padded. Memory of a task is ``open_windows`` windows, whatever the number of documents.
Finally the windows still open in all partitions are merged in groups of bounded size, by whole
concatenation, so that one window of each group stays short.

Defined results: null or empty text is the end id alone; a null doc_id is kept as null; repeated
rows are packed once each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from .vocab import byte_bpe

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_open boolean, ids binary"
#: Windows of all partitions that one merging task may hold.
MERGE_GROUP = 256
_MERGED = 1 << 62


@dataclass(frozen=True)
class PackingConfig:
    sequence: int = 2048
    open_windows: int = 32
    min_cut: int = 16
    end_id: int = 1
    vocabulary: str = "byte_bpe_50k"
    with_ids: bool = False


Part = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class Windows:
    """The open windows of one partition; full ones go to ``out`` with their number."""

    def __init__(self, config: PackingConfig, first_id: int) -> None:
        self.config, self.next_id = config, first_id
        self.parts: list[list[Part]] = []
        self.used: list[int] = []
        self.out: list[tuple[int, list[Part]]] = []

    def emit(self, parts: list[Part]) -> None:
        self.out.append((self.next_id, parts))
        self.next_id += 1

    def close(self, k: int) -> None:
        self.emit(self.parts.pop(k))
        self.used.pop(k)

    def open(self, part: Part) -> None:
        self.parts.append([part])
        self.used.append(len(part[2]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        size, n = self.config.sequence, len(ids)
        whole = n - n % size
        for at in range(0, whole, size):
            self.emit([(doc_id, at, ids[at : at + size], n)])
        if whole == n:
            return
        rest = ids[whole:]
        fits = [k for k, u in enumerate(self.used) if u + len(rest) <= size]
        if fits:
            k = max(fits, key=self.used.__getitem__)
            self.parts[k].append((doc_id, whole, rest, n))
            self.used[k] += len(rest)
            if self.used[k] == size:
                self.close(k)
            return
        if len(self.used) == self.config.open_windows:
            k = max(range(len(self.used)), key=self.used.__getitem__)
            gap = size - self.used[k]
            if min(gap, len(rest) - gap) >= self.config.min_cut:
                self.parts[k].append((doc_id, whole, rest[:gap], n))
                whole, rest = whole + gap, rest[gap:]
            self.close(k)
        self.open((doc_id, whole, rest, n))


def _rows(sequences: list[tuple[int, list[Part]]], is_open: bool, with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in PIECE]
    for sequence, parts in sequences:
        offset = 0
        for doc_id, start, ids, total in parts:
            raw = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, is_open, raw if is_open or with_ids else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += len(ids)
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, PIECE, strict=True)], schema=PIECE)


def _pack_partition(config: PackingConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(config.vocabulary)
        windows = Windows(config, TaskContext.get().partitionId() << 32)
        end = np.array([config.end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                windows.add(doc_id, np.concatenate([bpe.ids(text.as_py()), end]))
                if len(windows.out) >= 512:
                    yield _rows(windows.out, False, config.with_ids)
                    windows.out = []
        yield _rows(windows.out, False, config.with_ids)
        windows.out = []
        yield _rows([(windows.next_id + k, parts) for k, parts in enumerate(windows.parts)], True, True)

    return run


def _merge_group(config: PackingConfig):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        sequences: list[tuple[int, list[Part]]] = []
        parts: list[Part] = []
        room, number = config.sequence, _MERGED + (rows[0]["grp"] << 32)
        for row in rows:
            ids, start = np.frombuffer(row["ids"], "<u4"), row["start"]
            while len(ids):
                head, ids = ids[:room], ids[room:]
                parts.append((row["doc_id"], start, head, row["doc_tokens"]))
                start, room = start + len(head), room - len(head)
                if not room:
                    sequences.append((number + len(sequences), parts))
                    parts, room = [], config.sequence
        if parts:
            sequences.append((number + len(sequences), parts))
        return pa.Table.from_batches([_rows(sequences, False, config.with_ids)])

    return run


def pack(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``with_ids``, ids (little-endian unsigned 32-bit)."""
    ship_package(docs.sparkSession)
    placed = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack_partition(config), PIECE_DDL), "packed")
    left = placed.where("is_open")
    # The number of open windows is at most open_windows for each partition; it only sets the number of groups.
    windows = left.where("offset = 0").count()
    groups = max(1, -(-windows // MERGE_GROUP))
    merged = left.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("grp").applyInArrow(_merge_group(config), PIECE_DDL)
    pieces = placed.where("not is_open").unionByName(merged).drop("is_open")
    if not config.with_ids:
        pieces = pieces.drop("ids")
    return pieces
