"""Exact quantiles without bringing all values to one task."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of one pass.
BINS = 4_096


def order_statistics(values: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) in ascending order; null and NaN must be out. Each pass counts the values of equal bins between two bounds, and goes on in the bin that holds a rank until its values are equal, so only bins ever reach the driver. Ranks of one bin go on together."""
    v = F.col(column)
    out: dict[int, float] = {}
    low, high = values.agg(F.min(column), F.max(column)).first()
    open_ = {(low, high, 0): sorted(set(ranks))}  # bounds and how many values lie below, to ranks
    while open_:
        (low, high, under), wanted = open_.popitem()
        if low == high:
            out.update(dict.fromkeys(wanted, low))
            continue
        # Division and product never turn an order around, so a bin is a range of values.
        place = F.floor((v - low) / F.lit(high - low) * BINS)
        bins = values.where(v.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        for b in sorted(bins.collect(), key=lambda b: b["bin"]):  # at most BINS + 1 rows
            here = [r for r in wanted if under <= r < under + b["n"]]
            if here:
                open_[b["low"], b["high"], under] = here
            under += b["n"]
    return out


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles; None without values."""
    values = values.select(column)
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    known = order_statistics(values, column, [k for at in places for k in (floor(at), ceil(at))])
    return [known[floor(at)] + (known[ceil(at)] - known[floor(at)]) * (at - floor(at)) for at in places]
