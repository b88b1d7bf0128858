"""Source divergence audit: how far the vocabularies of a language's sources lie apart, and by which terms.

Terms are runs of letters and non-ASCII characters with A-Z in lower case; a language keeps those in at least
``MIN_DOCS`` of its documents, V of them. A group (language and source, or the whole language) gives a kept term of
``count`` occurrences there the share ``1 + floor(10**9 * (count + 2) / (N + 2 * V))``, N being the counts' sum;
two shares p and q differ by ``floor((p - q)**2 / (p + q))``. All of it is whole numbers.

The index is inverted: nothing is ever made for a term that a source does not have. Two sources start at V times the
difference of their shares of no occurrence. Postings (term: sources and shares) then give corrections, in two parts:
a term of one source is first corrected as if the other had none of it, which depends on the count alone, so terms of
equal count are corrected as one; terms that both have get what is left, from their posting.

Occurrences are added up in the tasks that read the texts, so a hot source or term sends a row or so for each task. A
posting holds a row for each source at most, and a task adds the corrections of its postings for each pair of sources
before it sends them, ``HELD`` pairs at a time.

Defined results: null text, lang and source are the empty string; rows are documents, also repeated ones and those
without an id; a group without kept terms differs from the others by shares of no occurrence, by 0 if V is 0; texts of
any length are read whole, in pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, written
from ._text import LOWER, UPPER

MIN_DOCS, TOP = 10, 10
#: Characters of a text that are split at once, different terms that a task holds, and pairs of sources.
PIECE, TERMS, HELD = 1 << 22, 400_000, 1 << 20
PARTIAL = "lang string, source string, term string, n long, docs long"
SHARED = "lang string, a string, b string, value long"


def _letter_bytes() -> bytes:
    """ASCII letters in lower case and non-ASCII bytes as they are, the rest to a blank."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for up, low in zip(UPPER.encode(), LOWER.encode(), strict=True):
        table[up] = table[low] = low
    return bytes(table)


_TABLE = _letter_bytes()


def terms(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, of about ``piece`` bytes at a time."""
    line, at = text.encode().translate(_TABLE), 0
    while len(line) - at > piece:
        cut = line.find(b" ", at + piece)
        if cut < 0:
            break
        yield line[at:cut].split()
        at = cut
    yield line[at:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of the rows read so far, time and again; a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            yield pa.record_batch([
                pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32))), pa.array([source], pa.string()).take(pa.array(np.zeros(size, np.int32))),
                pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[t] for t in n), 0], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            of_doc: set[bytes] = set()
            for part in terms(text.as_py()):
                n.update(part)
                of_doc.update(part)
            docs.update(of_doc)
        if sum(len(n) for n, _ in held.values()) > TERMS:
            yield from rows()
            held.clear()
    yield from rows()


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): each once, and each group once with a null term."""
    ship_package(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, PARTIAL)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exact for counts of any size."""
    return F.expr(f"1 + cast(1000000000 as decimal(18,0)) * cast({count} + 2 as decimal(19,0)) div cast({total} + 2 * {kept} as decimal(19,0))")


def difference(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square is a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b (a before b), value: what terms that both have add to the corrections by count, summed over the postings read."""
    number: dict[tuple[str, str], int] = {}
    pairs: list[np.ndarray] = []
    values: list[np.ndarray] = []
    size = 0

    def of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def reduce() -> None:
        nonlocal size
        key, place = np.unique(np.concatenate(pairs), return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, place, np.concatenate(values))
        pairs[:], values[:], size = [key], [out], len(key)

    def rows() -> pa.RecordBatch:
        names = list(number)
        a, b = pairs[0] >> 32, pairs[0] & 0xFFFFFFFF
        return pa.record_batch([pa.array([names[k][0] for k in a]), pa.array([names[k][1] for k in a]), pa.array([names[k][1] for k in b]), pa.array(values[0], pa.int64())], names=["lang", "a", "b", "value"])

    for batch in batches:
        postings = batch.column(1)
        lengths = postings.value_lengths().to_numpy()
        langs = batch.column(0).dictionary_encode()
        each = postings.flatten()
        source, p, none = each.field(0).dictionary_encode(), each.field(1).to_numpy(), each.field(2).to_numpy()
        term = np.repeat(np.arange(len(lengths)), lengths)
        # A number for each lang and source of the batch.
        wide = len(source.dictionary)
        both = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths) * wide + source.indices.to_numpy()
        known, place = np.unique(both, return_inverse=True)
        ids = np.array([number.setdefault((langs.dictionary[k // wide].as_py(), source.dictionary[k % wide].as_py()), len(number)) for k in known.tolist()], np.int64)[place]
        # Postings are in order of their sources: all that are ``step`` places apart at once.
        for step in range(1, int(lengths.max(initial=0))):
            at = np.flatnonzero(term[step:] == term[:-step])
            for lot in range(0, len(at), HELD):
                a = at[lot : lot + HELD]
                b = a + step
                pairs.append((ids[a] << 32) | ids[b])
                values.append(of(p[a], p[b]) - of(p[a], none[b]) - of(none[a], p[b]) + of(none[a], none[b]))
                size += len(a)
                if size > HELD:
                    reduce()
                    if size > HELD // 2:
                        yield rows()
                        pairs, values, size = [], [], 0
    if size:
        reduce()
        yield rows()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair``: all other sources of the language; ``term``: the ``top`` terms above the language's share), item, value, rank."""
    counted = written(occurrences(docs), "occurrences")
    of_term = Window.partitionBy("lang", "term")
    met = counted.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("lang_n"))
    kept = written(met.where(F.col("in_docs") >= min_docs).drop("in_docs"), "kept-terms")

    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = written(groups.withColumn("p0", F.when(F.col("kept") > 0, share("0", "total", "kept"))), "groups")

    posted = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    above = posted.withColumn("q", share("lang_n", "lang_total", "kept")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    start = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * F.expr(difference("p0", "q0"))).otherwise(0).alias("value"))
    alike = posted.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("alike"))
    one = alike.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"alike * ({difference('p', 'q0')} - {difference('p0', 'q0')})").alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = posted.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("posting")).select("lang", "posting").mapInArrow(_shared, SHARED)
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # A difference is the same both ways, so what one gives goes to both.
    swapped = lambda df, a, b: df.select("lang", F.explode(F.array(F.struct(F.col(a).alias("source"), F.col(b).alias("item")), F.struct(F.col(b).alias("source"), F.col(a).alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    pairs = start.unionByName(swapped(one, "source", "item")).unionByName(swapped(both, "a", "b")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).select(order).unionByName(above.withColumn("rank", place).where(F.col("rank") <= top).select(order))
