"""URL filters: rules and listed hosts held as a cascade of Bloom filters that answers exactly for every key of the corpus.

A cascade is built against the whole key universe: level 0 encodes the listed keys, level 1 those keys of the corpus
that are not listed but pass level 0, level 2 the listed keys that pass level 1, and so on until nothing passes by
mistake. A key is looked up level by level until one of them does not hold it; an odd level says it is listed, an even
one that it is not, and a key that all levels hold belongs to the last. So membership is exact for every key
of the corpus, a task needs only the filters, and the rows are neither joined nor shuffled. Each level hashes whole
keys with a seed of its own, so keys that agree at one level part at the next.

The filters' size is counted before they are built. Where level 0 would be above ``part_bytes``, the keys are dealt into
parts by hash; each part's cascade is built, sent, applied to the rows (written between) and released, so that
what is gathered or sent stays near that bound whatever the list's length.

Rules are pairs of host and path with an action: a rule fits its host and all subdomains if the path begins with its own. Keys
of a URL are its last labels and first characters of its path, in the few shapes (number of labels, length of path) that the
rules have, so long hosts and paths give no more keys than short ones. The longest rule wins (of equal ones that of the longer
host, then ``block``). Where no rule fits, the host decides: it is blocked if it is on the list of hosts, by default those
that have a page which a rule blocks.

Defined results: a null URL or one without ``://`` has empty host and path, which no rule fits and which may be listed
like any other host; null page_id is kept as null; repeated rows have the same result each; an empty table gives no rows;
no rules, or an empty list, fit nothing; columns besides url and those asked for are ignored, also where they are named like
the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from ._text import ascii_lower

#: action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Bytes of level 0 that a cascade has at most, and false positives of the levels behind it.
PART_BYTES, RATE = 64 << 20, 1 / 8
URL = r"://([^/?#]*)([^?#]*)"


class Level:
    """A Bloom filter; its bits come later, from the tasks that encode the keys."""

    def __init__(self, seed: int, keys: int, rate: float) -> None:
        self.seed = seed
        self.size = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / keys * math.log(2)))
        self.words = np.zeros(0, np.uint64)

    def places(self, keys: list[str]) -> np.ndarray:
        """A row of bit numbers for each key."""
        whole = b"".join(xxhash.xxh3_128_digest(k, self.seed) for k in keys)
        both = np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, 2)
        return (both[:, :1] + (both[:, 1:] | np.uint64(1)) * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.size)

    def holds(self, keys: list[str]) -> np.ndarray:
        at = self.places(keys)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def listed_in(levels: list[Level], keys: list[str]) -> np.ndarray:
    """Which keys (of the universe that the levels were built against) are listed."""
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys)) if levels else np.zeros(0, np.int64)
    for depth, level in enumerate(levels):
        held = level.holds([keys[k] for k in left])
        out[left[~held]] = depth % 2 == 1
        left = left[held]
    out[left] = len(levels) % 2 == 1
    return out


def _encode(level: Level):
    """Keys to words of the filter with the keys' bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(level.places(batch.column(0).to_pylist()))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def _passing(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(batch.column(0).to_pylist()), pa.bool_()))

    return run


def cascade(keys: DataFrame) -> list[Level]:
    """Levels for a table of different keys: key, listed. No levels if none is listed."""
    spark = keys.sparkSession
    encoded, tested = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n, others = encoded.count(), tested.count()
    levels: list[Level] = []
    while n:
        # The first filter is as strict as leaves about as many false positives as there are listed keys.
        level = Level(len(levels), n, RATE if levels else min(0.5, max(2**-20, n / max(1, others) * math.sqrt(RATE))))
        rows = encoded.mapInArrow(_encode(level), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words = np.zeros(-(-level.size // 64), np.uint64)
        level.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        levels.append(level)
        sent = spark.sparkContext.broadcast(level)
        passed = written(tested.mapInArrow(_passing(sent), "key string"), "passing")
        sent.destroy()
        encoded, tested, n = passed, encoded, passed.count()
    return levels


def _look_up(sent, parts: int, part: int, first: bool):
    """Rows (.., array of keys[, array of flags]) with flags set for listed keys of this part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - (1 if first else 2))
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            mine = np.array([k for k, w in enumerate(words) if xxhash.xxh64_intdigest(w, 42) % parts == part], np.int64)
            flag = np.zeros(len(words), bool)
            flag[mine] = listed_in(levels, [words[k] for k in mine])
            flags = flag[flat.indices.to_numpy()]
            if not first:
                flags |= batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(flags, pa.bool_()))
            kept = batch.columns if first else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, found], names=[*batch.schema.names[: len(kept)], "found"])

    return run


def members(rows: DataFrame, listed: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows``, whose last column is an array of keys without nulls, with a column ``found``: for each key whether it is in ``listed`` (one column)."""
    ship_package(rows.sparkSession)
    universe = rows.select(F.explode(rows.columns[-1]).alias("key"), F.lit(False).alias("listed"))
    marked = universe.unionByName(listed.select(F.col(listed.columns[0]).alias("key"), F.lit(True).alias("listed")).where("key is not null"))
    keys = written(marked.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    # At most 20 * 1.44 bits a key; parts are a power of two, so that a hash's low bits name them.
    most = keys.where("listed").count() * 29 // 8
    parts = 1 << max(0, math.ceil(math.log2(max(1, most) / part_bytes)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for part in range(parts):
        mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else keys
        sent = rows.sparkSession.sparkContext.broadcast(cascade(mine))
        rows = rows.mapInArrow(_look_up(sent, parts, part, part == 0), f"{schema}, found array<boolean>")
        if parts > 1:
            rows = written(rows, "found")
            sent.destroy()
    return rows


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Keys that a rule fitting this host and path could have, the better ones last when sorted: its length, its host's, action, key."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    out = []
    for n, size in shapes:
        name = F.substring_index(host, ".", -n)
        rule = F.concat(name, F.substring(path, 1, size))
        for action in ("allow", "block"):
            fits = (labels >= n) & (F.length(path) >= size)
            out.append(F.when(fits, F.struct(F.length(rule).alias("size"), F.length(name).alias("of_host"), F.lit(action).alias("action"), rule.alias("rule"))))
    empty = F.expr("cast(array() as array<struct<size:int,of_host:int,action:string,rule:string>>)")
    return F.array_compact(F.array(*out)) if out else empty


def matched(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, keep: tuple[str, ...] = ("page_id",), part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep``, host, path, rule, action (null where no rule fits)."""
    key = lambda action, rule: F.concat(action, F.lit(" "), rule)
    whole = pages.select(F.struct(*keep).alias("kept"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    asked = whole.select("*", candidates(F.col("host"), F.col("path"), rules).alias("may")).select("*", F.transform("may", lambda x: key(x["action"], x["rule"])).alias("keys"))
    listed = pages.sparkSession.createDataFrame([(f"{action} {h}{p}",) for action, h, p in rules], "key string")
    told = members(asked, listed, part_bytes)
    best = F.array_max(F.filter(F.zip_with("may", "found", lambda x, y: F.when(y, x)), lambda x: x.isNotNull()))
    return told.select("kept.*", "host", "path", best.alias("best")).select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, hosts: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",), part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep``, host, path, rule, verdict; ``hosts`` (one column) are blocked where no rule fits, by default those with a page that a rule blocks."""
    by_rule = written(matched(pages, rules, keep, part_bytes), "by-rule")
    hosts = by_rule.where("action = 'block'").select("host").distinct() if hosts is None else hosts
    told = members(by_rule.select("*", F.array("host").alias("keys")), hosts, part_bytes)
    verdict = F.coalesce("action", F.when(F.get("found", F.lit(0)), "block").otherwise("allow"))
    return told.select(*keep, "host", "path", "rule", verdict.alias("verdict"))
