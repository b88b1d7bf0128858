"""Attribute statistics, and the spacing report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .quantiles import quantiles


def class_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("classification").agg(F.count("*").alias("points"))


def intensity_stats(points: DataFrame) -> DataFrame:
    return points.agg(F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"), F.avg("intensity").alias("mean_intensity"))


def rgb_range(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("red", "green", "blue") for n, f in (("min", F.min), ("max", F.max))])


def spacing(nearest: DataFrame) -> DataFrame:
    """Millimetres, from column d: median, mean, p90, and the width that can be resolved (three medians)."""
    finite = written(nearest.where(~F.isnan("d") & (F.col("d") < float("inf"))).select("d"), "distances")
    median, p90 = quantiles(finite, "d", [0.5, 0.9])
    mm = lambda v, factor, name: F.lit(None if v is None else v * factor).cast("double").alias(name)
    out = finite.agg(F.count("*").alias("points"), (F.avg("d") * 1000).alias("mean_mm"))
    return out.select("points", mm(median, 1000, "median_mm"), "mean_mm", mm(p90, 1000, "p90_mm"), mm(median, 3000, "resolvable_mm"))
