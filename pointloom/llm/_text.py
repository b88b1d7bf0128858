"""Word rules shared by the operators, as bytes in Python and as columns in Spark.

Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Java and DuckDB pattern of what stands between words of letters, digits and non-ASCII characters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pattern of a run of letters and non-ASCII characters.
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Pattern of what stands between words of visible characters.
BLANKS = r"[\x20\x09-\x0D]+"


def _word_bytes() -> bytes:
    """ASCII A-Z to a-z, digits and a-z and non-ASCII bytes as they are, the rest to a blank."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789" + LOWER.encode():
        table[c] = c
    for up, low in zip(UPPER.encode(), LOWER.encode(), strict=True):
        table[up] = low
    return bytes(table)


_TABLE = _word_bytes()


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, in UTF-8 (bytes.split() knows just these six blanks)."""
    return text.encode().split() if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded_words_column(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def blank_words_column(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
