"""Which points: crop, cap, systematic sample, recentring, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered, parts_of


def bounds(points: DataFrame) -> dict[str, float | None]:
    """Minimum and maximum of each axis (one aggregation; pushed to file statistics where there are some)."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]).first().asDict()


def bbox_extent(points: DataFrame) -> DataFrame:
    out = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    for c in "xyz":
        out = out.withColumn(f"extent_{c}", F.col(f"max_{c}") - F.col(f"min_{c}")).withColumn(f"centre_{c}", (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2)
    return out


def crop_sphere(points: DataFrame, radius: float, centre: tuple[float, float, float] | None = None) -> DataFrame:
    """Points within the radius of the box centre, inclusive; all points if none is. The box around the sphere goes along, since simple comparisons reach the file reader."""
    if centre is None:
        b = bounds(points)
        if b["min_x"] is None:
            return points
        centre = tuple((b[f"min_{c}"] + b[f"max_{c}"]) / 2 for c in "xyz")
    box = None
    for c, at in zip("xyz", centre, strict=True):
        side = F.col(c).between(at - radius * 1.000001, at + radius * 1.000001)
        box = side if box is None else box & side
    square = sum(((F.col(c) - at) * (F.col(c) - at) for c, at in zip("xyz", centre, strict=True)), F.lit(0.0))
    kept = points.where(box & (square <= radius * radius))
    return points if kept.isEmpty() else kept


def within_cap(points: DataFrame, n: int, of: Column | None = None) -> DataFrame:
    """All points with ``kept``: whether one is among the first n in file order (``of``: of the points where this holds). Ranges are counted by themselves, so no task sees more than its own."""
    of = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
    placed = numbered(points.withColumn("_of", of), ["_of", "point_idx"], "_place", parts=parts_of(points, points.count()))
    others = placed.where(~F.col("_of")).count()
    return placed.withColumn("kept", F.col("_of") & (F.col("_place") <= others + n)).drop("_of", "_place")


def point_cap(points: DataFrame, n: int) -> DataFrame:
    """The first n points in file order."""
    return within_cap(points, n).where("kept").drop("kept")


def stride_sample(points: DataFrame, count: int, chunk: int = 2_000_000, target: int = 500_000) -> DataFrame:
    """Every stride-th point, beginning anew in each chunk."""
    stride = max(1, count // target)
    return points.where((F.col("point_idx") % chunk) % stride == 0)


def concatenate(*clouds: DataFrame) -> DataFrame:
    """All points of the clouds, by column names; a column that one lacks is null there."""
    out = clouds[0]
    for more in clouds[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def recenter(points: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """Points less their mean, and the mean."""
    row = points.agg(*[F.avg(c) for c in "xyz"]).first()
    mean = tuple(v or 0.0 for v in row)
    return points.withColumns({c: F.col(c) - m for c, m in zip("xyz", mean, strict=True)}), mean


def intensity_gray(points: DataFrame, scale: float = 255.0) -> DataFrame:
    grey = F.least(F.greatest(F.col("intensity") / scale, F.lit(0.0)), F.lit(1.0))
    return points.withColumns({c: grey for c in "rgb"})
