"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the powers of 1024.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit below 1024 of it, with one decimal."""
    out = None
    for k, unit in enumerate(UNITS):
        text = F.concat(F.format_string("%.1f", n.cast("double") / float(1024**k)), F.lit(unit))
        last = k == len(UNITS) - 1
        if out is None:
            out = F.when(n < 1024, text)
        else:
            out = out.otherwise(text) if last else out.when(n < 1024 ** (k + 1), text)
    return out


def elapsed(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds; units above the largest that is not 0 are left out."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", h, m, rest)).when(s >= 60, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))
