"""Openings: cells that the outside does not reach, as rectangles, gated and classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Plane, SegmentConfig
from ..session import written
from . import forest, grid, planes


#: Cells of a row by which runs of neighbouring rows meet.
REACH = 256


def empty_runs(cells: DataFrame) -> DataFrame:
    """wall_id, iv, a, b, outer: the runs of empty cells of each row of a wall's bounding box, and whether one touches its border."""
    box = cells.groupBy("wall_id").agg(F.min("iu").alias("bu0"), F.max("iu").alias("bu1"), F.min("iv").alias("bv0"), F.max("iv").alias("bv1"))
    row = Window.partitionBy("wall_id", "iv").orderBy("iu")
    own = cells.select("wall_id", "iv", "iu").withColumns({"behind": F.lead("iu").over(row), "place": F.row_number().over(row)}).join(box, "wall_id")
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    after = gap(F.col("iu") + 1, F.coalesce(F.col("behind") - 1, F.col("bu1")))
    gaps = own.select("wall_id", "iv", F.explode(F.when(F.col("place") == 1, F.array(gap(F.col("bu0"), F.col("iu") - 1), after)).otherwise(F.array(after))).alias("g")).select("wall_id", "iv", "g.*")
    bare = box.select("wall_id", F.explode(F.sequence("bv0", "bv1")).alias("iv"), F.col("bu0").alias("a"), F.col("bu1").alias("b")).join(cells.select("wall_id", "iv").distinct(), ["wall_id", "iv"], "left_anti")
    outer = (F.col("iv") == F.col("bv0")) | (F.col("iv") == F.col("bv1")) | (F.col("a") == F.col("bu0")) | (F.col("b") == F.col("bu1"))
    return gaps.unionByName(bare).where("a <= b").join(box, "wall_id").select("wall_id", "iv", "a", "b", outer.alias("outer"))


def _filled(cells: DataFrame, outside: bool) -> DataFrame:
    """Empty cells that the outside reaches, or those that it does not: runs of neighbouring rows that overlap are one part, and a part is outside if one of its runs is."""
    runs = written(empty_runs(cells).withColumn("run", F.monotonically_increasing_id()), "runs")
    piece = runs.withColumn("k", F.explode(F.sequence(grid.cell("a", REACH), grid.cell("b", REACH))))
    over = piece.select("wall_id", (F.col("iv") - 1).alias("iv"), "k", F.col("a").alias("c"), F.col("b").alias("d"), F.col("run").alias("other"))
    touching = piece.join(over, ["wall_id", "iv", "k"]).where(F.greatest("a", "c") <= F.least("b", "d"))
    edges = touching.select(F.least("run", "other").alias("a"), F.greatest("run", "other").alias("b"), F.lit(0.0).alias("w"), F.lit(1).alias("s")).distinct()
    parts = runs.join(forest.signs(edges, ["a"]).select(F.col("node").alias("run"), "root"), "run", "left").withColumn("root", F.coalesce("root", "run"))
    wanted = parts.groupBy("root").agg(F.max("outer").alias("reached")).where(F.col("reached") == outside).select("root")
    return parts.join(wanted, "root", "left_semi").select("wall_id", F.explode(F.sequence("a", "b")).alias("iu"), "iv")


def exterior(cells: DataFrame) -> DataFrame:
    return _filled(cells, True)


def interior_voids(cells: DataFrame) -> DataFrame:
    return _filled(cells, False)


def gated(rects: DataFrame, box: DataFrame, size: float) -> DataFrame:
    """Rectangles of a door's or window's size: 2 cells each way, 0.45 m at least, 4.0 x 3.5 m and 30 % of the wall at most."""
    out = grid.metric(rects, size).withColumns({"width": F.col("u_max") - F.col("u_min"), "height": F.col("v_max") - F.col("v_min")}).join(F.broadcast(box), "wall_id")
    large = (F.col("iu1") - F.col("iu0") >= 1) & (F.col("iv1") - F.col("iv0") >= 1) & (F.col("width") >= 0.45) & (F.col("height") >= 0.45)
    return out.where(large & (F.col("width") <= 4.0) & (F.col("height") <= 3.5) & (F.col("width") * F.col("height") <= 0.30 * F.col("area")))


def sill(floor: tuple[float, float, float, float] | None, floor_z: float) -> Column:
    """Least height of the two lower corners over the floor plane, or over floor_z where there is none."""
    corner = lambda u: tuple(F.col(f"o{c}") + F.col(u) * F.col(f"u{c}") + F.col("v_min") * F.col(f"v{c}") for c in "xyz")
    a, b = corner("u_min"), corner("u_max")
    over = [p[2] - g.floor_z(p[0], p[1], floor) for p in (a, b)]
    return F.coalesce(F.least(*over), F.least(a[2], b[2]) - F.lit(float(floor_z)))


def opening_class(width: Column, height: Column, sill_m: Column) -> Column:
    return (
        F.when((width >= 1.0) & (height >= 2.0) & (sill_m < 0.25), "balcony_door")
        .when(width.between(0.65, 1.4) & height.between(1.75, 2.5) & (sill_m < 0.25), "door")
        .when((sill_m >= 0.4) & (width >= 0.45) & (height >= 0.45), "window").otherwise("unknown_opening")
    )


def openings(points: DataFrame, walls: list[Plane], config: SegmentConfig, floor: tuple[float, float, float, float] | None, floor_z: float) -> DataFrame:
    """wall_id, type, width, height, sill, uv bounds and the frame, from all inliers (wall_id, x, y, z) of walls with enough of them."""
    enough = points.groupBy("wall_id").count().where(F.col("count") >= config.min_plane // 4).select("wall_id")
    points = points.join(F.broadcast(enough), "wall_id", "left_semi")
    frames = planes.wall_frames(points, walls, config.strict_origin)
    uv = planes.flat_or_all(planes.with_uv(points, walls, frames), config.opening_flat)
    cells = grid.occupied_cells(uv, config.opening_cell, config.opening_min)
    rects = gated(grid.merge_rectangles(interior_voids(cells)), grid.occupied_bbox(cells, config.opening_cell), config.opening_cell)
    out = rects.join(F.broadcast(frames), "wall_id").withColumn("sill", sill(floor, floor_z))
    return out.withColumn("type", opening_class(F.col("width"), F.col("height"), F.col("sill")))
