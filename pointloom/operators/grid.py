"""Grid cells: binning, voxel means, occupancy, and rectangles of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(column: str | Column, size: float) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / size)


def voxel_downsample(points: DataFrame, voxel: float, extra: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """One point for each voxel: the mean of its members; the grid begins half a voxel below the minimum. Colours and other columns in ``extra`` are averaged too; those in ``first`` are its first member's, whose point_idx it has."""
    low = points.agg(*[F.min(c) for c in "xyz"]).first()
    if low[0] is None:
        return points.select(*"xyz", *extra, *first).limit(0)
    at = [cell(F.col(c) - (m - voxel / 2), voxel).alias(f"v{c}") for c, m in zip("xyz", low, strict=True)]
    return points.groupBy(*at).agg(*[F.avg(c).alias(c) for c in (*"xyz", *extra)], F.count("*").alias("members"), F.min("point_idx").alias("point_idx"), *[F.min_by(c, "point_idx").alias(c) for c in first])


def occupied_cells(uv: DataFrame, size: float, minimum: int, keys: tuple[str, ...] = ("wall_id",), depth: str | None = None) -> DataFrame:
    """keys, iu, iv, points, and with ``depth`` its maximum: cells of at least ``minimum`` points."""
    more = [F.max(depth).alias("depth")] if depth else []
    return uv.groupBy(*keys, cell("u", size).alias("iu"), cell("v", size).alias("iv")).agg(F.count("*").alias("points"), *more).where(F.col("points") >= minimum)


def occupied_bbox(cells: DataFrame, size: float, keys: tuple[str, ...] = ("wall_id",)) -> DataFrame:
    box = cells.groupBy(*keys).agg(F.min("iu").alias("bu0"), F.max("iu").alias("bu1"), F.min("iv").alias("bv0"), F.max("iv").alias("bv1"))
    return box.withColumn("area", (F.col("bu1") - F.col("bu0") + 1) * (F.col("bv1") - F.col("bv0") + 1) * (size * size))


def merge_rectangles(cells: DataFrame, keys: tuple[str, ...] = ("wall_id",), depth: bool = False) -> DataFrame:
    """Disjoint rectangles that cover distinct cells: runs in each row, then equal runs of consecutive rows. With ``depth`` a rectangle has its cells' maximum."""
    row = Window.partitionBy(*keys, "iv").orderBy("iu")
    most = [F.max("depth").alias("depth")] if depth else []
    bars = cells.withColumn("run", F.col("iu") - F.row_number().over(row)).groupBy(*keys, "iv", "run").agg(F.min("iu").alias("iu0"), F.max("iu").alias("iu1"), *most)
    span = Window.partitionBy(*keys, "iu0", "iu1").orderBy("iv")
    stacks = bars.withColumn("stack", F.col("iv") - F.row_number().over(span))
    return stacks.groupBy(*keys, "iu0", "iu1", "stack").agg(F.min("iv").alias("iv0"), F.max("iv").alias("iv1"), *most).drop("stack")


def metric(rects: DataFrame, size: float) -> DataFrame:
    """u_min, u_max, v_min, v_max and the centre of each rectangle, in this order of operations."""
    out = rects.withColumns({"u_min": F.col("iu0") * size, "u_max": (F.col("iu1") + 1) * size, "v_min": F.col("iv0") * size, "v_max": (F.col("iv1") + 1) * size})
    return out.withColumns({"cu": 0.5 * (F.col("u_min") + F.col("u_max")), "cv": 0.5 * (F.col("v_min") + F.col("v_max"))})
