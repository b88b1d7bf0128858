"""Benchmark decontamination by a broadcast set of word windows.

The windows of the test items (10 words; a shorter item is one window) are hashed into sorted
arrays that go to every task: eight bytes of key and eight of place for a window, the hashes of the items' words, and the
items' words themselves as one piece of bytes. A task hashes the words of its documents, hashes
just the windows without a foreign word, looks them up, and verifies hits word by word against that piece. The set's size
is checked first: above ``block_bytes`` of item text the items are dealt into blocks by the hash of
their id and text, each block scans the documents by itself and is released, and the hits are merged, so what is
sent to a task stays bounded (about seven times the block's text; a single longer item is a block of its own).

Defined results: null or empty text has no words; an item without words has no window; a null
item_id counts as the empty string; a null doc_id is kept as null; repeated rows have the same result each;
an empty benchmark hits nothing; columns besides those named are ignored, and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from ._text import folded_words

WINDOW = 10
HITS = "doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>, h long"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FACTORS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
word_hash = xxhash.xxh3_64_intdigest


class WindowSet:
    """Different windows by length: their keys in order, a place of each in the items' words, and the items that have them."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int) -> None:
        blob, starts, hashes = bytearray(), array("Q"), array("Q")
        number: dict[str, int] = {}
        first, owner = array("Q"), array("I")
        by_size: dict[int, array] = {}
        for item, text in items:
            words = folded_words(text)
            if not words:
                continue
            first.append(len(starts))
            owner.append(number.setdefault(item, len(number)))
            size = min(window, len(words))
            by_size.setdefault(size, array("Q")).extend(range(len(starts), len(starts) + len(words) - size + 1))
            for w in words:
                starts.append(len(blob))
                hashes.append(word_hash(w))
                blob += w
                blob += b" "
        starts.append(len(blob))
        self.names = list(number)
        self.blob, self.starts = bytes(blob), np.array(starts, np.uint64)
        all_hashes = np.array(hashes, np.uint64)
        self.vocabulary = np.unique(all_hashes)
        begins, owners = np.array(first, np.int64), np.array(owner, np.int64)
        self.tables = [self._table(size, np.array(by_size[size], np.int64), all_hashes, begins, owners) for size in sorted(by_size)]

    def _table(self, size: int, places: np.ndarray, hashes: np.ndarray, begins: np.ndarray, owners: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """size, and by different window: key (in order), place; then the bounds of its items and these."""
        keys = np.concatenate([_keys(hashes, places[at : at + 200_000], size) for at in range(0, len(places), 200_000)])
        item = owners[np.searchsorted(begins, places, "right") - 1]
        order = np.lexsort((item, keys))
        keys, places, item = keys[order], places[order], item[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        # Equal keys of different words are windows of their own: the rows of such a key are put in order of their words.
        for at in np.flatnonzero(~new).tolist():
            if self.words(int(places[at]), size) != self.words(int(places[at - 1]), size):
                low, high = np.searchsorted(keys, keys[at], "left"), np.searchsorted(keys, keys[at], "right")
                rows = sorted(range(low, high), key=lambda k: (self.words(int(places[k]), size), int(item[k])))
                places[low:high], item[low:high] = places[rows], item[rows]
                for k in range(low + 1, high):
                    new[k] = self.words(int(places[k]), size) != self.words(int(places[k - 1]), size)
        of = np.cumsum(new) - 1
        once = np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])]
        bounds = np.searchsorted(of[once], np.arange(int(of[-1]) + 2))
        return size, keys[new], places[new], bounds.astype(np.uint32), item[once].astype(np.uint32)

    def words(self, place: int, size: int) -> bytes:
        return self.blob[int(self.starts[place]) : int(self.starts[place + size])]

    def nbytes(self) -> int:
        return len(self.blob) + self.starts.nbytes + self.vocabulary.nbytes + sum(x.nbytes for t in self.tables for x in t[1:])

    def hits(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text its number of words, hit spans of words (first, behind the last), and items."""
        lines: list[bytes] = []
        counts: list[int] = []
        for text in texts:
            words = folded_words(text)
            counts.append(len(words))
            lines += words
            lines.append(b"")
        flat = np.array([word_hash(w) for w in lines], np.uint64)
        begins = np.r_[0, np.cumsum(np.array(counts) + 1)][:-1] if counts else np.zeros(0, np.int64)
        known = np.zeros(len(flat), bool)
        if len(self.vocabulary):
            known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)] == flat
        known[np.cumsum(np.array(counts, np.int64) + 1) - 1] = False  # between texts
        foreign = np.r_[0, np.cumsum(~known)]
        delta = np.zeros(len(flat) + 1, np.int64)
        found: list[set[str]] = [set() for _ in texts]
        for size, keys, places, bounds, items in self.tables:
            if len(flat) < size:
                continue
            at = np.flatnonzero(foreign[size:] == foreign[:-size])
            for lot in range(0, len(at), 200_000):
                here = at[lot : lot + 200_000]
                key = _keys(flat, here, size)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                some = low < high
                seen: set[tuple[int, int]] = set()
                for a, k, end in zip(here[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                    line = b" ".join(lines[a : a + size]) + b" "
                    # More than one turn only where keys of different windows are equal.
                    for w in range(k, end):
                        if self.words(int(places[w]), size) == line:
                            delta[a] += 1
                            delta[a + size] -= 1
                            doc = bisect_right(begins, a) - 1
                            if (doc, w) not in seen:
                                seen.add((doc, w))
                                found[doc].update(self.names[i] for i in items[bounds[w] : bounds[w + 1]].tolist())
        hit = np.r_[0, (np.cumsum(delta[:-1]) > 0).astype(np.int8), 0]
        edges = np.diff(hit)
        first, behind = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for a, b, d in zip(first.tolist(), behind.tolist(), (np.searchsorted(begins, first, "right") - 1).tolist(), strict=True):
            spans[d].append((a - int(begins[d]), b - int(begins[d])))
        return counts, spans, found


def _keys(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A key of each window of ``size`` words from these places on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += hashes[at + j] * _FACTORS[j]
    return out


def _scan(windows, hits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts, spans, items = known.hits([x.as_py() for x in part.column(1)])
                out = pa.record_batch([
                    part.column(0), pa.array(counts, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), part.column(2),
                ], names=["doc_id", "n_words", "spans", "items", "h"])
                yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

    return run


def _number_of_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // block_bytes))


def _blocks(benchmark: DataFrame, window: int, n: int) -> Iterator[Broadcast]:
    """The windows of each of ``n`` blocks of items, sent to all tasks; the caller destroys one before it asks for the next."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield spark.sparkContext.broadcast(WindowSet(((r["item"], r["text"]) for r in part.toLocalIterator()), window))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_words, spans (of hit words), items (sorted as strings), for each row of docs."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    whole = hits = None
    n = _number_of_blocks(benchmark, block_bytes)
    for block in _blocks(benchmark, window, n):
        mapped = slim.mapInArrow(_scan(block, whole is not None), HITS)
        if n == 1:
            return mapped
        # Rows of equal id and text have equal hits, so (doc_id, h) may name them.
        mapped = written(mapped, "hits")
        block.destroy()
        some = mapped.where("size(spans) > 0").drop("n_words")
        whole, hits = (mapped, some) if whole is None else (whole, hits.unionByName(some))
    merged = hits.distinct().groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.expr("cast(array() as array<struct<a:long,b:long>>)")
    m = merged.select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), F.col("spans").alias("m_spans"), F.col("items").alias("m_items"))
    met = whole.join(m, whole.doc_id.eqNullSafe(m.m_id) & (whole.h == m.m_h), "left")
    return met.select("doc_id", "n_words", F.coalesce("m_spans", empty).alias("spans"), F.coalesce("m_items", F.expr("cast(array() as array<string>)")).alias("items"), "h")


def _hit_words() -> F.Column:
    """Words in the union of the spans, which may overlap when they come from several blocks."""
    ordered = F.array_sort("spans")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(ordered, start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).cast("long").alias("n"), F.greatest(x["b"], s["end"]).alias("end")))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, window, block_bytes)
    return found.select("doc_id", "n_words", _hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its hit words and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, places[a][0])])
        at = max(at, places[b - 1][1])
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _clean(windows: Broadcast, at: int, spans: bool):
    """Batches without hit rows, or with their hit spans cut; ``at`` is the text's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            found = [x for lot in range(0, batch.num_rows, 64) for x in known.hits(batch.column(at).slice(lot, 64).to_pylist())[1]]
            if spans:
                cleaned = [without_spans(t.as_py(), x) if x else t.as_py() for t, x in zip(batch.column(at), found, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(cleaned, batch.schema.field(at).type))
            else:
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return run


def _cut(at: int):
    """Rows (columns of docs, spans) to the columns of docs, their hit spans cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_joined([(x["a"], x["b"]) for x in row or ()]) for row in batch.column(batch.num_columns - 1).to_pylist()]
            cleaned = [without_spans(t, x) if x else t for t, x in zip(batch.column(at).to_pylist(), spans, strict=True)]
            columns = [pa.array(cleaned, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without hit documents (``documents``) or without hit spans (``spans``); all columns stay. One block of items is one pass; with more, the spans of all blocks are found on whole texts first and then cut, or their documents removed, once."""
    ship_package(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")
    if _number_of_blocks(benchmark, block_bytes) == 1:
        return docs.mapInArrow(_clean(next(_blocks(benchmark, window, 1)), at, mode == "spans"), docs.schema)
    found = scan(docs, benchmark, window, block_bytes).where("size(spans) > 0").select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), F.col("spans").alias("f_spans")).dropDuplicates(["f_id", "f_h"])
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(F.col("text").cast("string")).alias("k_h"))
    met = F.col("k_id").eqNullSafe(F.col("f_id")) & (F.col("k_h") == F.col("f_h"))
    if mode != "spans":
        return rows.join(found, met, "left_anti").select("row.*")
    return rows.join(found, met, "left").select("row.*", "f_spans").mapInArrow(_cut(at), docs.schema)
