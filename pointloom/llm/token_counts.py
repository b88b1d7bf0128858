"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens as the tokenizer file says. The pre-tokens of a batch that are not
known yet stand as one flat array of symbols with their bounds; in each round every sequence applies
its own lowest-rank pair, everywhere in it, at once. Sequences without a pair left drop out and
what survives of them is counted. Pre-tokens over ``LONG`` characters go through the same rounds one by one,
with the places of each rank in an array of their own, so that a round visits only the places it
merges and the rest of the sequence stays untouched. Counts of pre-tokens are kept, up to ``KNOWN`` of them, but for
the long ones.

Case folding and letter classes are those of this Python, which agree with the library's on all characters
that both know; texts with characters that may be newer than that (``_ODD``) are normalized and cut by the
library's own normalizer and splitter from the file.

Defined results: null or empty text has 0 bytes and 0 tokens; a null doc_id is kept as null; repeated
rows are counted each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .vocab import default_path

KNOWN, ROUND, LONG = 300_000, 50_000, 256
_NONE = np.int64(1 << 40)


def _odd() -> re.Pattern[str]:
    """Characters whose class or case may differ between Unicode versions: those of the first plane that are unassigned here, and all beyond it but emoji and the like."""
    bare = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    first = [c for k, c in enumerate(bare) if not k or bare[k - 1] != c - 1]
    last = [c for k, c in enumerate(bare) if k + 1 == len(bare) or bare[k + 1] != c + 1]
    ranges = [*zip(first, last, strict=True), (0x10000, 0x1EFFF), (0x20000, 0x10FFFF)]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


_ODD = _odd()


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordBpe:
    """Counts of a lower-casing byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        self.final = np.array([vocab[c + suffix] for c in _byte_symbols()], np.int64)
        self.width = len(vocab) + len(spec["added_tokens"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.pair = keys  # by rank
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(cut)
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(cut), "removed", invert=True)
        self.special = {x["content"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, int] = {}
        self.passing: list[str] = []  # long ones, known until the next batch

    def words(self, text: str | None) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings the text holds."""
        if not text:
            return [], 0
        parts = self.cut.split(text) if "<|" in text else [text]
        out: list[str] = []
        special = 0
        for part in parts:
            if part in self.special:
                special += 1
            elif part and not part.isascii() and _ODD.search(part):
                out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
            elif part:
                # Lower case of each character by itself: no final sigma. White space only parts words.
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.pattern.findall(part.lower())
        return out, special

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols that survive of each word; words are not empty."""
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        ends = np.cumsum(length)
        symbol[ends - 1] = self.final[flat[ends - 1]]
        of = np.repeat(np.arange(len(raw)), length)
        left = np.zeros(len(raw), np.int64)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            rank = np.full(len(symbol), _NONE)
            inside = np.flatnonzero(of[1:] == of[:-1])
            key = symbol[inside] * self.width + symbol[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            rank[inside[found]] = self.ranks[at[found]]
            size = np.diff(np.r_[starts, len(symbol)])
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            left[of[starts[done]]] = size[done]
            here = (rank == np.repeat(least, size)) & (rank != _NONE)
            place = np.flatnonzero(here)
            # Overlaps (a pair of equal symbols in a run of them): every second place from the left.
            first = np.r_[True, place[1:] != place[:-1] + 1] if len(place) else np.zeros(0, bool)
            run = np.flatnonzero(first)
            place = place[(place - np.repeat(place[run], np.diff(np.r_[run, len(place)]))) % 2 == 0]
            symbol[place] = self.merged[rank[place]]
            keep = ~np.repeat(done, size)
            keep[place + 1] = False
            symbol, of = symbol[keep], of[keep]
        return left

    def count_long(self, word: str) -> int:
        """Symbols that survive of one word: the same rounds, lowest rank first, each on the array of the places of its pair."""
        raw = np.frombuffer(word.encode(), np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[-1] = self.final[raw[-1]]
        # Symbol n is behind the end and has no pair; a symbol that was merged into its left neighbour is -1.
        symbol = np.append(symbol, -1)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def found(at: np.ndarray) -> None:
            """Note the places whose symbol and the next one are a pair, under its rank."""
            key = symbol[at] * self.width + symbol[after[at]]
            key[(symbol[at] < 0) | (symbol[after[at]] < 0)] = -1
            here = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            some = self.keys[here] == key
            at, rank = at[some], self.ranks[here[some]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
            for r, group in zip(rank[starts].tolist(), np.split(at, starts[1:]) if len(at) else (), strict=True):
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(group)

        found(np.arange(n - 1))
        left = n
        while ranks:
            rank = heapq.heappop(ranks)
            groups = places.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else np.sort(groups[0])
            # Some were merged with another neighbour since.
            at = at[symbol[at] >= 0]
            at = at[symbol[at] * self.width + symbol[after[at]] == self.pair[rank]]
            if not len(at):
                continue
            # Overlaps: every second place of a run from the left.
            first = np.r_[True, after[at[:-1]] != at[1:]]
            run = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            gone = after[at]
            symbol[at], symbol[gone] = self.merged[rank], -1
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            around = np.concatenate([before[at], at])
            found(np.unique(around[around >= 0]))
        return left

    def learn(self, words: Iterable[str]) -> None:
        """Have the counts of all these words in ``known``."""
        for w in self.passing:
            self.known.pop(w, None)
        new = list(words - self.known.keys() if isinstance(words, set) else set(words) - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = list(set(words))
        short = [w for w in new if len(w) <= LONG]
        self.passing = [w for w in new if len(w) > LONG]
        self.known.update((w, self.count_long(w)) for w in self.passing)
        for at in range(0, len(short), ROUND):
            part = short[at : at + ROUND]
            self.known.update(zip(part, self.count(part).tolist(), strict=True))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _counts(path: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or default_path("word_bpe_49k.json"))
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, batch.num_rows, 64):
                part = [x.as_py() for x in texts[at : at + 64]]
                words = [bpe.words(x) for x in part]
                bpe.learn({w for ws, _ in words for w in ws})
                known = bpe.known
                n = [sum(map(known.__getitem__, ws)) + special for ws, special in words]
                size = [len(x.encode()) if x else 0 for x in part]
                yield pa.record_batch([doc_ids[at : at + 64], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``tokenizer``: path of the file on the executors, else the public word_bpe_49k.json."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_counts(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
