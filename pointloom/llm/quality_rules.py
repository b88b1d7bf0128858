"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts are Spark expressions. From labelled rows a list of rules is learned: a
rule grows, condition by condition, by the best FOIL gain over thresholds at the quantiles of each
statistic, and is pruned from its end on rows held back; it is kept while its precision holds there and on rows held
back from both growing and pruning. Covered rows leave, and the next rule is learned. The list is one ordered Spark conditional expression.
Growing and pruning are aggregations over the labelled statistics; the driver sees tables of
(statistic, bin) counts. The labelled rows are a documented sample: those of the ``sample`` smallest hashes.

Defined results: null or empty text has no words and fails the base rule; a null doc_id has no label
and is judged like any other; repeated rows have the same verdict each; without labels the list is empty and only the
base rule holds; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ._text import blank_words_column, let

SYMBOLS = "#*$%&|<>"
STATISTICS = ["words", "word_length", "symbol_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "window_share"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class LearnConfig:
    sample: int = 20_000
    bins: int = 24
    max_rules: int = 12
    max_conditions: int = 3
    min_rows: int = 5  # of the bad class that a rule covers while it grows
    min_precision: float = 0.97  # on the rows held back for pruning, and on those held back from both


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float
    place: int  # of the threshold among the bounds; a value is above it if more than ``place`` bounds are below the value

    def column(self, s: Column) -> Column:
        return s[self.statistic] > self.threshold if self.above else s[self.statistic] <= self.threshold

    def binned(self) -> Column:
        return F.col(self.statistic) > self.place if self.above else F.col(self.statistic) <= self.place


def _all(rule: list[Condition]) -> Column:
    met = F.lit(True)
    for c in rule:
        met = met & c.binned()
    return met


@dataclass
class DecisionList:
    rules: list[list[Condition]] = field(default_factory=list)

    def column(self, s: Column) -> Column:
        """``keep`` or the rule that rejects, first match first, over the fields of ``s``."""
        out = None
        for k, rule in enumerate(self.rules):
            met = rule[0].column(s)
            for c in rule[1:]:
                met = met & c.column(s)
            out = F.when(met, f"rule{k + 1}") if out is None else out.when(met, f"rule{k + 1}")
        return F.lit("keep") if out is None else out.otherwise("keep")


def _repeated_places(w: Column) -> Column:
    """Places, ascending, of the 3-word windows found twice or more: their 64-bit hashes are sorted with their places, and neighbours of equal hash and words taken."""
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def twice(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.get(w, x["i"]) == F.get(w, y["i"])) & (F.get(w, x["i"] + 1) == F.get(w, y["i"] + 1)) & (F.get(w, x["i"] + 2) == F.get(w, y["i"] + 2))

        again = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def places(h: Column) -> Column:
        # Texts without a repeated window are told by the sizes alone; only the others are sorted.
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, twice)).otherwise(F.expr("cast(array() as array<int>)"))

    return let(hashes, places)


def _covered(places: Column) -> Column:
    """Words in the union of the windows at these ascending places."""
    new = F.transform(places, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - i, F.lit(3))))
    return F.aggregate(new, F.lit(0), lambda a, x: a + x)


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of STATISTICS."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), let(_repeated_places(w), lambda p: F.struct(F.size(p).alias("windows"), _covered(p).alias("words"))).alias("repeat"))

    counted = F.struct(
        let(blank_words_column(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")).alias("chars"), count(SYMBOLS).alias("symbols"),
        count("!?|").alias("marks"), count("0123456789").alias("digits"), (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).alias("uppers"),
    )

    def all_of(c: Column) -> Column:
        n, chars, repeat = c["w"]["n"], c["chars"], c["w"]["repeat"]
        return F.struct(
            n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), c["symbols"].cast("long").alias("n_symbols"), c["l"]["dup"].cast("long").alias("n_dup_lines"), repeat["words"].cast("long").alias("n_repeat_words"),
            n.cast("double").alias("words"), share(chars, n).alias("word_length"), share(c["symbols"], chars).alias("symbol_share"), share(c["marks"], n).alias("mark_share"),
            share(c["l"]["dup"], c["l"]["all"]).alias("dup_line_share"), share(repeat["words"], n).alias("repeat_share"), share(c["w"]["distinct"], n).alias("distinct_share"),
            share(c["uppers"], chars).alias("upper_share"), share(c["digits"], chars).alias("digit_share"), share(repeat["windows"], n).alias("window_share"),
        )

    return let(counted, all_of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def labelled_statistics(docs: DataFrame, labels: DataFrame, config: LearnConfig) -> DataFrame:
    """bad, held (back for pruning), last (held back from growing and pruning) and the statistics of the sampled labelled rows, from a written table. A repeated label or document counts once."""
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("l_id"), (F.col("quality") == 0).alias("bad")).groupBy("l_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("l_id"), "l_id").limit(config.sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The side that is sent to all tasks has at most ``sample`` rows of 9 bytes.
    met = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(6))
    one = met.groupBy("doc_id", "bad").agg(F.min("text").alias("text"))
    # Written before the filter, which would else be moved into the statistics' expressions.
    rows = written(one.select("bad", (part < 2).alias("held"), (part == 2).alias("last"), statistics(F.col("text")).alias("s")), "labelled")
    return rows.where(~base_failed(F.col("s"))).select("bad", "held", "last", *[F.col(f"s.{x}").alias(x) for x in STATISTICS])


def _bounds(rows: DataFrame, config: LearnConfig) -> dict[str, list[float]]:
    """Quantiles of each statistic in either class, and zero, which parts "none" from "some"."""
    shares = [k / config.bins for k in range(config.bins + 1)]
    quantiles = [F.percentile_approx(F.when(F.col("bad") == bad, F.col(s)), shares, 10_000).alias(f"{s}_{bad}") for s in STATISTICS for bad in (True, False)]
    got = rows.where("not held and not last").agg(*quantiles).first()
    return {s: sorted({*(got[f"{s}_True"] or []), *(got[f"{s}_False"] or []), 0.0}) for s in STATISTICS}


def _binned(rows: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """Each statistic as the number of bounds below it."""

    def place(s: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds[s])), lambda b: b < F.col(s)))

    return written(rows.select("bad", "held", "last", *[place(s).alias(s) for s in STATISTICS]), "binned")


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(rows: DataFrame, bounds: dict[str, list[float]], config: LearnConfig) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < config.max_conditions:
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("k")) for s in STATISTICS])).alias("b")
        table = rows.select("bad", each).groupBy("b.s", "b.k").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in table:  # at most len(STATISTICS) * (2 * bins + 4) rows
            counts.setdefault(r["s"], {})[r["k"]] = (r["p"], r["n"])
        if not counts:
            break
        p0, n0 = (sum(x[j] for x in next(iter(counts.values())).values()) for j in (0, 1))
        if p0 < config.min_rows or n0 == 0:
            break
        best: tuple[float, Condition] | None = None
        for s, by_bin in sorted(counts.items()):
            p = n = 0
            for k, bound in enumerate(bounds[s]):
                p, n = p + by_bin.get(k, (0, 0))[0], n + by_bin.get(k, (0, 0))[1]  # rows <= bound
                for condition, q, m in ((Condition(s, False, bound, k), p, n), (Condition(s, True, bound, k), p0 - p, n0 - n)):
                    if q >= config.min_rows and (g := _gain(p0, n0, q, m)) > 1e-9 and (best is None or g > best[0]):
                        best = (g, condition)
        if best is None:
            break
        rule.append(best[1])
        rows = rows.where(best[1].binned())
    return rule


def _prune(held: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The beginning of the rule with the best (p - n) / (p + n) on the rows held back, and its precision there."""
    sums = [F.count_if(_all(rule[: k + 1]) & (F.col("bad") == bad)).alias(f"{'p' if bad else 'n'}{k}") for k in range(len(rule)) for bad in (True, False)]
    got = held.agg(*sums).first()
    worth = lambda k: ((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), got[f"p{k}"], -k)
    best = max(range(len(rule)), key=worth)
    return rule[: best + 1], got[f"p{best}"] / max(1, got[f"p{best}"] + got[f"n{best}"])


def _wrong(rows: DataFrame, rule: list[Condition]) -> float:
    """Share of good rows among those that the rule covers; none if it covers none."""
    covered, good = rows.where(_all(rule)).agg(F.count("*"), F.count_if(~F.col("bad"))).first()
    return good / covered if covered else 0.0


def learn(docs: DataFrame, labels: DataFrame, config: LearnConfig = LearnConfig()) -> DecisionList:
    rows = labelled_statistics(docs, labels, config)
    found = DecisionList()
    if rows.isEmpty():
        return found
    bounds = _bounds(rows, config)
    left = _binned(rows, bounds)
    while len(found.rules) < config.max_rules:
        rule = _grow(left.where("not held and not last"), bounds, config)
        if not rule:
            break
        rule, precision = _prune(left.where("held"), rule)
        if precision < config.min_precision or _wrong(left.where("last"), rule) > 1 - config.min_precision:
            break
        found.rules.append(rule)
        left = left.where(~_all(rule))
    return found


def verdict(s: Column, rules: DecisionList) -> Column:
    """``base``, the rule that rejects, or ``keep``, from the struct of statistics."""
    return F.when(base_failed(s), "base").otherwise(rules.column(s))


def quality(docs: DataFrame, labels: DataFrame, config: LearnConfig = LearnConfig()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, verdict."""
    rules = learn(docs, labels, config)
    s = F.col("s")
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text").cast("string")).alias("s"))
    return judged.select("doc_id", *[s[x].alias(x) for x in COUNTS], base_failed(s).alias("base_failed"), (verdict(s, rules) == "keep").alias("kept"), verdict(s, rules).alias("verdict"))


def kept(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs less the rejected rows; all columns stay."""
    return docs.where(let(statistics(F.col("text").cast("string")), lambda s: verdict(s, rules)) == "keep")
