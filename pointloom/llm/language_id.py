"""Language identification by unigram pieces, all segmentations summed.

The vocabulary is that of a public sentencepiece model and stays fixed. For each language the
probability of a piece comes from its counts over all training rows, smoothed. The probability of a
word (a run of letters, lower case, behind the word mark) is the sum over all its segmentations
into pieces, by the forward algorithm over whole batches of words of equal length; characters without
a piece fall back to their bytes. The algorithm pushes from place to place and holds as many columns as
the longest piece has characters, so words of any length are summed whole. A text's score adds the
words; the prediction is the best language and the score its posterior under equal priors.

Only text and language of training rows are learned from. Languages are taken in blocks of at most
``BLOCK``, so that what the driver receives and sends is at most a table of pieces by that many languages
at once; with more languages than one block each block scores the documents by itself, and best
language and sum go on in columns.

Defined results: null text or text without a letter is ``und`` with score 0, as is every text when
nothing was learned; ties go to the smaller name; a null doc_id is a training row; repeated rows count
and are judged each; an empty table gives no rows; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from .vocab import default_path

MARK = "▁"
#: Languages of one block: its table of 32,000 pieces takes 64 MB.
BLOCK = 256
_LETTERS = re.compile(r"[^\W\d_]+")
_FLUSH, _TABLE = 200_000, 2_000_000
SMOOTHING = 0.1


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    special = [model.is_control(k) or model.is_unknown(k) for k in range(len(names))]
    byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    bytes_ = set(byte)
    table = {x: k for k, (x, s) in enumerate(zip(names, special, strict=True)) if not s and k not in bytes_}
    # What begins a piece without being one is -1, so that a search ends where no piece can follow.
    begins = {x[:n]: -1 for x in table for n in range(1, len(x))}
    return model, table, byte, max(map(len, table)), begins | table


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if no character is a letter."""
    if not text:
        return []
    found = _LETTERS.findall(text.lower())
    if not any(w.isalpha() or any(map(str.isalpha, w)) for w in found):
        return []
    return found


def _count_pieces(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path or default_path("piece_bpe_32k.model"))[0]
        totals: dict[str, Counter] = {}
        held: dict[str, Counter] = {}

        def settle() -> None:
            for lang, counts in held.items():
                known = list(counts)
                total = totals.setdefault(lang, Counter())
                for at in range(0, len(known), 50_000):
                    part = known[at : at + 50_000]
                    ids = model.encode(part, num_threads=1)
                    flat = np.array([i for x in ids for i in x], np.int64)
                    weight = np.repeat(np.array([counts[w] for w in part], np.int64), [len(x) for x in ids])
                    summed = np.bincount(flat, weight, model.get_piece_size()).astype(np.int64)
                    some = np.flatnonzero(summed)
                    total.update(dict(zip(some.tolist(), summed[some].tolist(), strict=True)))
            held.clear()

        def given() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                yield pa.record_batch([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["lang", "piece", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(words(text.as_py()))
                if sum(map(len, held.values())) > _FLUSH:
                    settle()
                    # Counts are summed after, so a task may give them in lots.
                    if sum(map(len, totals.values())) > _TABLE:
                        yield from given()
        settle()
        yield from given()

    return run


class Model:
    """Languages in order, and for each piece its probability in each of them."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str | None) -> None:
        self.languages, self.probability, self.path = languages, probability, path

    def score_words(self, batch: list[str]) -> np.ndarray:
        """Natural logarithms, words x languages, of words of any lengths."""
        _, _, byte, longest, begins = _pieces(self.path or default_path("piece_bpe_32k.model"))
        out = np.zeros((len(batch), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(batch):
            by_length.setdefault(len(w) + 1, []).append(k)
        lot = max(1, 2_000_000 // (len(self.languages) * (longest + 1)))
        for length, every in by_length.items():
            for at in range(0, len(every), lot):
                rows = every[at : at + lot]
                out[rows] = self._forward([MARK + batch[k] for k in rows], length, begins, byte, longest)
        return out

    def _forward(self, marked: list[str], length: int, begins: dict[str, int], byte: list[int], longest: int) -> np.ndarray:
        """Places from left to right: what is summed at a place goes on by each piece that begins there. Column ``place % turn`` is a place's; its room is used again ``turn`` places on."""
        p, n, turn = self.probability, len(marked), min(length, longest) + 1
        ahead = np.zeros((n, turn, p.shape[1]))
        ahead[:, 0] = 1.0
        scale = np.zeros((n, p.shape[1]))
        find = begins.get
        for start in range(length):
            here = ahead[:, start % turn]
            small = here < 1e-150
            if small.any():
                lift = np.where(small, 1e150, 1.0)
                ahead *= lift[:, None, :]
                scale -= np.log(lift)
            hits: dict[int, tuple[list[int], list[int]]] = {}
            for k, w in enumerate(marked):
                for end in range(start + 1, min(length, start + longest) + 1):
                    piece = find(w[start:end])
                    if piece is None:
                        if end == start + 1:
                            ahead[k, end % turn] += here[k] * np.prod([p[byte[b]] for b in w[start].encode()], axis=0)
                        break
                    if piece >= 0:
                        to = hits.get(end)
                        if to is None:
                            to = hits[end] = ([], [])
                        to[0].append(k)
                        to[1].append(piece)
                    elif end == start + 1:
                        ahead[k, end % turn] += here[k] * np.prod([p[byte[b]] for b in w[start].encode()], axis=0)
            for end, (rows, ids) in hits.items():
                if len(rows) == n:
                    ahead[:, end % turn] += here * p[ids]
                else:
                    ahead[rows, end % turn] += here[rows] * p[ids]
            here[:] = 0.0
        with np.errstate(divide="ignore"):
            return np.log(ahead[:, length % turn]) + scale


def learn(rows: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> list[Model]:
    """From columns text and lang (not null): a model for each block of languages, none if nothing was learned."""
    ship_package(rows.sparkSession)
    counted = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count_pieces(tokenizer), "lang string, piece int, n long")
    table = written(counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")), "pieces")
    names = table.select("lang").distinct()
    n = names.count()
    # Each name's block by its place in the order of hashes; only more names than one block need that sort.
    blocks = [names] if n <= block else [names.orderBy(F.xxhash64("lang"), "lang").offset(at).limit(block) for at in range(0, n, block)]
    return [_model(table if n <= block else table.join(F.broadcast(some), "lang"), tokenizer) for some in blocks] if n else []


def _model(table: DataFrame, tokenizer: str | None) -> Model:
    """The model of a table of at most a block's languages."""
    got = table.select("lang", "piece", "n").toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.full((_pieces(tokenizer or default_path("piece_bpe_32k.model"))[0].get_piece_size(), len(languages)), SMOOTHING)
    np.add.at(counts, (got["piece"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()])), got["n"].to_numpy())
    return Model(languages, counts / counts.sum(axis=0), tokenizer)


class Scorer:
    """Scores of words, kept up to a bound of entries."""

    def __init__(self, model: Model) -> None:
        self.model, self.capacity = model, max(10_000, min(300_000, 20_000_000 // len(model.languages)))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, float] | None]:
        """For each text its best language, that one's score, and the logarithm of the sum over all; None without a letter."""
        found = [words(x) for x in texts]
        new = {w for ws in found for w in ws if w not in self.place}
        if len(self.place) + len(new) > self.capacity:
            self.clear()
            new = {w for ws in found for w in ws}
        if new:
            order = list(new)
            self.place.update(zip(order, range(len(self.rows), len(self.rows) + len(order)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.score_words(order)])
        out: list[tuple[str, float, float] | None] = []
        for ws in found:
            if not ws:
                out.append(None)
                continue
            total = self.rows[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(total[best]), float(total[best] + np.log(np.exp(total - total[best]).sum()))))
        return out


def _better(old: tuple[str | None, float | None, float | None], new: tuple[str, float, float] | None) -> tuple[str | None, float | None, float | None]:
    """The better of two blocks' languages, and the sum over both."""
    if new is None or old[0] is None:
        return old if new is None else new
    best = min(old, new, key=lambda x: (-x[1], x[0]))
    return best[0], best[1], float(np.logaddexp(old[2], new[2]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = getattr(model, "_scorer", None)
        if scorer is None:
            scorer = model._scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scored = scorer.texts([x.as_py() for x in part.column(2)])
                if part.num_columns > 3:
                    scored = [_better(old, new) for old, new in zip(zip(*[part.column(k).to_pylist() for k in (3, 4, 5)], strict=True), scored, strict=True)]
                name, best, total = zip(*[x or (None, None, None) for x in scored], strict=True)
                yield pa.record_batch([*part.columns[:3], pa.array(name, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], names=["doc_id", "held_out", "text", "lang_pred", "best", "total"])

    return run


def _last(shared):
    """As ``_predict``, without the text."""
    run = _predict(shared)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(["doc_id", "held_out", "lang_pred", "best", "total"])

    return last


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Blocks but for the last write their rows, so that one block's table is in use at once."""
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if not models:
        return slim.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for model in models[:-1]:
        shared = spark.sparkContext.broadcast(model)
        slim = written(slim.mapInArrow(_predict(shared), "doc_id long, held_out boolean, text string, lang_pred string, best double, total double"), "languages")
        shared.destroy()
    scored = slim.mapInArrow(_last(spark.sparkContext.broadcast(models[-1])), "doc_id long, held_out boolean, lang_pred string, best double, total double")
    return scored.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(F.exp(F.col("best") - F.col("total")), F.lit(0.0)).alias("score"))


def identify(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Learn from the rows that are not held out, and predict all rows."""
    return predict(docs, learn(docs.where(~held_out()).select("text", "lang"), tokenizer, block))
