"""SimHash near-duplicates by a self-join over a binary trie of the fingerprints.

1. Fingerprints: one Arrow pass over whole texts; only (doc_id, fingerprint) leaves it.
2. Two fingerprints that differ in at most 3 of 64 bits agree on one of four 16-bit blocks, so the
   distinct fingerprints are dealt out by each block. Each bucket is one Patricia trie, walked in
   pairs of nodes from (root, root): the differing bits of the common depth accumulate, a pair goes
   when they exceed the budget, and a pair whose leaves are known to be one component goes too, so
   a dense cluster does not cost all its pairs. A bucket over ``max_bucket`` fingerprints is dealt
   again by the pairs of subtrees of its next levels that are within what is left of the budget, which is
   exact; each bucket has its own number of levels, and those still too large are dealt again.
3. A bucket returns a spanning forest, at most one edge for each fingerprint. The components of these
   edges are found by alternating star contraction with its rounds written to the shared folder.

Defined results: null, empty or blank text has the fingerprint 0 and is linked like any other;
a null doc_id keeps its row and never names a component unless no other id is there; repeated rows
share a component; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from ._text import blank_words
from .components import connected_components

BITS = 64
BLOCK = 16
#: Fingerprints that one task walks at once (about 20 MB of arrays), and node pairs of one step.
CHUNK, STEP = 200_000, 400_000
#: Fingerprints of a bucket that is walked whole; larger ones are dealt again. One core walks 100,000 evenly spread ones in 20 s, and as many within 8 bits of one in 30 s.
MAX_BUCKET = 200_000
#: Levels of a large bucket that one deal takes at most: 15 rows of each fingerprint within 3 bits.
LEVELS = 4
#: Rows of about 20 bytes that are sent to all tasks instead of shuffling whole documents.
SENT = 500_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = blank_words(text.translate(_FOLD) if text else text)
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[:-1]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    h = np.array(hashes, ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


_FOLD = {c: c + 32 for c in range(65, 91)}


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (xxhash64 of the text), fp: the 64 bits as a signed long."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return slim.mapInArrow(_fingerprints(shingle), "doc_id long, h long, fp long")


# ---- the trie -----------------------------------------------------------------------------------


def _split(prints: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where bit ``depth`` turns to 1 in each sorted range, by bisection of all ranges at once."""
    low, high, shift = start.copy(), end.copy(), (BITS - 1 - depth).astype(np.uint64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        one = ((prints[np.minimum(mid, len(prints) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def _branch(prints: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Depth at which a node's leaves part; BITS for one leaf."""
    differing = prints[start] ^ prints[end - 1]
    depth = np.full(len(start), BITS, np.int64)
    some = differing > 0
    # Exact for all 64 bits: the halves are below 2**32, so their logarithms are exact enough.
    high = (differing >> np.uint64(32)).astype(np.int64)
    low = (differing & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])
    depth[some] = BITS - length[some]
    return depth


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make label[a] and label[b] one component, the smallest index naming it."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_self_join(prints: np.ndarray, bucket_starts: np.ndarray, budget: int) -> np.ndarray:
    """For sorted distinct fingerprints of each bucket: index of the smallest member of its component.

    ``bucket_starts`` holds the first index of each bucket, and len(prints) last.
    """
    label = np.arange(len(prints))
    _walk(prints, np.stack([bucket_starts[:-1], bucket_starts[1:]] * 2, axis=1), label, budget)
    return label


def _walk(prints: np.ndarray, roots: np.ndarray, label: np.ndarray, budget: int) -> None:
    """Join in ``label`` what the pairs of sorted ranges (a_start, a_end, b_start, b_end) link, a range with itself included."""
    n = len(prints)
    alone = (roots[:, 0] == roots[:, 2]) & (roots[:, 1] - roots[:, 0] < 2)
    roots = roots[~alone & (roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])]
    stack = [roots[at : at + STEP] for at in range(0, len(roots), STEP)]
    changes = np.zeros(n, np.int64)
    while stack:
        pairs = stack.pop()  # a_start, a_end, b_start, b_end
        np.cumsum(label[1:] != label[:-1], out=changes[1:])
        a0, a1, b0, b1 = pairs.T
        done = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (label[a0] == label[b0])
        pairs = pairs[~done]
        if not len(pairs):
            continue
        a0, a1, b0, b1 = pairs.T
        da, db = _branch(prints, a0, a1), _branch(prints, b0, b1)
        depth = np.minimum(da, db)
        # Bits above the common depth: all 64 when both are leaves; a shift by 64 is not defined.
        differing = np.where(depth == 0, np.uint64(0), (prints[a0] ^ prints[b0]) >> np.where(depth == 0, 0, BITS - depth).astype(np.uint64))
        within = np.bitwise_count(differing) <= budget
        leaves = within & (depth == BITS)
        if leaves.any():
            _join_labels(label, a0[leaves], b0[leaves])
        go = within & (depth < BITS)
        if not go.any():
            continue
        a0, a1, b0, b1, da, db, depth = (x[go] for x in (a0, a1, b0, b1, da, db, depth))
        same = (a0 == b0) & (a1 == b1)
        am = np.where(da == depth, _split(prints, a0, a1, depth), a1)
        bm = np.where(db == depth, _split(prints, b0, b1, depth), b1)
        children = np.concatenate([np.stack(x, axis=1) for x in ((a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1))])
        keep = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
        keep[2 * len(a0) : 3 * len(a0)] &= ~same  # (one, zero) mirrors (zero, one)
        keep &= ~((children[:, 0] == children[:, 2]) & (children[:, 1] == children[:, 3]) & (children[:, 1] - children[:, 0] == 1))
        children = children[keep]
        stack += [children[at : at + STEP] for at in range(0, len(children), STEP)]


def _bucket_forests(budget: int):
    """Sorted rows (bucket, side, fp) of a partition to edges (u, v): each fingerprint and its root, in chunks of whole buckets.

    A bucket of two subtrees returns what links them alone: the components of either side are known first (another bucket returns
    them), so a dense cluster takes one edge there.
    """

    def forest(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        prints = fp.view(np.uint64)
        order = np.lexsort((prints, side, bucket))
        bucket, side, prints = bucket[order], side[order], prints[order]
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1]), True])
        label = trie_self_join(prints, starts, budget)
        known = np.where(side < 0, np.arange(len(label)), label)
        two = np.flatnonzero((side[starts[:-2]] == 0) & (side[starts[1:-1]] == 1) & (bucket[starts[:-2]] == bucket[starts[1:-1]]))
        _walk(prints, np.stack([starts[two], starts[two + 1], starts[two + 1], starts[two + 2]], axis=1), label, budget)
        linked = np.flatnonzero((label != np.arange(len(label))) & (known == np.arange(len(label))))
        return pa.record_batch([pa.array(prints[linked].view(np.int64)), pa.array(prints[label[linked]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            count += batch.num_rows
            if count >= CHUNK:
                bucket, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on
                if last:
                    yield forest(bucket[:last], side[:last], fp[:last])
                held, count = [(bucket[last:], side[last:], fp[last:])], len(bucket) - last
        if count:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _bits(fp: Column, first: Column, count: Column | int) -> Column:
    """``count`` bits of fp from bit ``first`` (0 is the highest) on."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", fp, first), (F.lit(BITS) - count).cast("int"))


def _split_again(rows: DataFrame, budget: int, max_bucket: int) -> DataFrame:
    """Rows of large buckets by the pairs of subtrees that may hold a link. ``side`` tells which of two different subtrees a row is from (0 or 1; -1 in a bucket of one subtree), ``spent`` how many bits they differ in."""
    # Two subtrees of 2**levels make a bucket; levels end at a block's edge, so that bits do not wrap.
    wanted = F.ceil(F.log2(2.0 * F.col("count") / max_bucket)).cast("int")
    levels = F.least(F.greatest(wanted, F.lit(2)), F.lit(LEVELS), F.lit(BLOCK) - F.col("first") % BLOCK)
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("levels")) - 1), lambda m: F.bit_count(m) <= F.lit(budget) - F.col("spent"))
    out = rows.withColumn("levels", levels.cast("int")).withColumn("node", _bits(F.col("fp"), F.col("first"), F.col("levels"))).withColumn("mask", F.explode(near))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    lower = F.when(F.col("side") < 0, F.least("node", other)).when(F.col("side") == 0, F.col("node")).otherwise(other)
    upper = F.when(F.col("side") < 0, F.greatest("node", other)).when(F.col("side") == 0, other).otherwise(F.col("node"))
    side = F.when(F.col("side") >= 0, F.col("side")).when(F.col("mask") != 0, (F.col("node") > other).cast("int")).otherwise(-1)
    return out.select(F.xxhash64("bucket", lower, upper).alias("bucket"), "fp", ((F.col("first") + F.col("levels")) % BITS).cast("int").alias("first"), (F.col("spent") + F.bit_count("mask")).cast("int").alias("spent"), side.alias("side"))


def _buckets(prints: DataFrame, max_bucket: int, budget: int) -> DataFrame:
    """bucket long, side int, fp: every pair within the budget meets in a bucket, from both of its sides where it has sides 0 and 1."""
    blocks = BITS // BLOCK
    if blocks <= budget:
        raise ValueError(f"a budget of {budget} bits needs more than {blocks} blocks")
    max_bucket = max(2, max_bucket)  # two subtrees of all bits are two fingerprints
    dealt = prints.withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(blocks)])))
    dealt = dealt.select(
        ((F.col("block") * (1 << BLOCK)).cast("long") + _bits(F.col("fp"), F.col("block") * BLOCK, BLOCK)).alias("bucket"), "fp",
        F.pmod((F.col("block") + 1) * BLOCK, F.lit(BITS)).cast("int").alias("first"), F.lit(0).alias("spent"), F.lit(-1).alias("side"),
    )
    parts: list[DataFrame] = []
    while True:
        # At most blocks * fingerprints / max_bucket rows; Spark sizes that side of the join.
        large = written(dealt.groupBy("bucket").count().where(F.col("count") > max_bucket), "large")
        if large.isEmpty():
            parts.append(dealt.select("bucket", "side", "fp"))
            return reduce(DataFrame.unionByName, parts)
        met = dealt.join(large, "bucket", "left")
        parts.append(met.where("count is null").select("bucket", "side", "fp"))
        dealt = written(_split_again(met.where("count is not null"), budget, max_bucket), "dealt-again")


def links(prints: DataFrame, budget: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """u, v: a spanning forest of each bucket over distinct fingerprints; its components are those of all links."""
    buckets = _buckets(prints, max_bucket, budget).repartition("bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(_bucket_forests(budget), "u long, v long").distinct()


def _roots(slim: DataFrame, budget: int, max_bucket: int) -> DataFrame:
    """fp, root: each distinct fingerprint and the one that names its component."""
    prints = slim.select("fp").distinct()
    edges = written(links(prints, budget, max_bucket), "links")
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most ``budget`` differing bits."""
    ship_package(docs.sparkSession)
    slim = written(fingerprints(docs, shingle), "fingerprints")
    named = slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(_roots(slim, budget, max_bucket), "fp")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    # Rows of one fingerprint may be a third of all; that side of the join is split by adaptive execution.
    return slim.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sent(rows: DataFrame) -> DataFrame:
    """A written table, sent to all tasks where it has at most ``SENT`` rows."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def representatives(docs: DataFrame, shingle: int = 3, budget: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (nulls last, then the smallest hash of the text); all columns stay.

    The rows that go are named by doc_id and hash of the text and taken out by an anti-join; documents are shuffled only where those names are too many to send.
    """
    ship_package(docs.sparkSession)
    slim = written(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    best = slim.groupBy("fp").agg(first).join(_roots(slim, budget, max_bucket), "fp")
    chosen = best.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("c_id"), F.col("first.h").alias("c_h"))
    named = slim.groupBy("doc_id", "h").agg(F.count("*").alias("copies"))
    goes = written(named.join(chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left_anti").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")), "goes")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(F.col("text").cast("string")).alias("k_h"))
    kept = rows.join(_sent(goes), F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_h") == F.col("g_h")), "left_anti")
    repeated = written(named.where("copies > 1").join(goes, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left_anti").select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h")), "repeated")
    if not repeated.isEmpty():
        same = F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_h") == F.col("r_h"))
        few = _sent(repeated)
        kept = kept.join(few, same, "left_anti").unionByName(kept.join(few, same, "left_semi").dropDuplicates(["k_id", "k_h"]))
    return kept.select("row.*")
