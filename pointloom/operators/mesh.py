"""Meshes as two tables: vertices (mesh_id, vid, x, y, z) and triangles (mesh_id, tid, a, b, c).

Builders return one row for each triangle corner set (mesh_id, tid, corner coordinates); ``indexed`` makes the two tables,
equal coordinates of a mesh becoming one vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Plane, SegmentConfig
from ..session import joined, new_folder, remove, written
from . import grid, planes
from .quantiles import quantiles
from .ranges import numbered

# Corner order by (axis 1, axis 2, axis 3) bits and the triangles of quads and boxes.
QUAD = [(0, 1, 2), (1, 3, 2)]
BOX = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
FRAME_WIDTH, FRAME_DEPTH = 0.05, 0.075

Point = tuple[Column, Column, Column]


def _triangles(rows: DataFrame, corners: list[Point], faces: list[tuple[int, int, int]], flip: Column | None = None) -> DataFrame:
    """mesh_id, ax..cz: the faces of each row; where ``flip``, turned over."""
    c = F.array(*[F.named_struct(*[x for n, v in zip("xyz", p, strict=True) for x in (F.lit(n), v.cast("double"))]) for p in corners])
    order = F.array(*[F.struct(*[F.lit(i).alias(n) for n, i in zip("abc", f, strict=True)]) for f in faces])
    out = rows.select("mesh_id", c.alias("p"), F.posexplode(order).alias("face", "f"), (F.lit(False) if flip is None else flip).alias("flip"))
    second, third = F.when(F.col("flip"), F.col("f.c")).otherwise(F.col("f.b")), F.when(F.col("flip"), F.col("f.b")).otherwise(F.col("f.c"))
    take = lambda i: F.element_at("p", i + 1)
    out = out.select("mesh_id", take(F.col("f.a")).alias("A"), take(second).alias("B"), take(third).alias("C"))
    return out.select("mesh_id", *[F.col(f"{p}.{c}").alias(f"{p.lower()}{c}") for p in "ABC" for c in "xyz"])


def on_wall(u: Column, v: Column, d: Column | float = 0.0) -> Point:
    """Point of a wall frame's row at (u, v), d along its normal n."""
    d = d if isinstance(d, Column) else F.lit(d)
    return tuple(F.col(f"o{c}") + u * F.col(f"u{c}") + v * F.col(f"v{c}") + d * F.col(f"n{c}") for c in "xyz")  # type: ignore[return-value]


def with_normal(rows: DataFrame, walls: list[Plane]) -> DataFrame:
    return rows.withColumns({f"n{c}": planes.by_wall(walls, lambda p, k=k: p.unit[k]) for k, c in enumerate("xyz")})


def quads(rows: DataFrame) -> DataFrame:
    """From wall frames with normals and u_min .. v_max."""
    corner = lambda u, v: on_wall(F.col(u), F.col(v))
    return _triangles(rows, [corner("u_min", "v_min"), corner("u_max", "v_min"), corner("u_min", "v_max"), corner("u_max", "v_max")], QUAD)


def uv_boxes(rows: DataFrame, depth: Column, strict: bool = False) -> DataFrame:
    """Boxes over rectangles of a wall, ``depth`` along the normal; negative depths are turned over so that faces look outward, unless ``strict``."""
    corners = [on_wall(F.col(f"u_{'max' if k & 1 else 'min'}"), F.col(f"v_{'max' if k & 2 else 'min'}"), depth * F.lit(float(k >> 2))) for k in range(8)]
    return _triangles(rows, corners, BOX, F.lit(False) if strict else depth < 0)


def axis_boxes(rows: DataFrame) -> DataFrame:
    """Boxes x0..x1, y0..y1, z0..z1."""
    return _triangles(rows, [(F.col(f"x{k & 1}"), F.col(f"y{k >> 1 & 1}"), F.col(f"z{k >> 2}")) for k in range(8)], BOX)


def frames(rows: DataFrame) -> DataFrame:
    """Opening frames: bars below, left, right and above each rectangle, FRAME_DEPTH along the normal."""
    w, u0, u1, v0, v1 = F.lit(FRAME_WIDTH), *[F.col(c) for c in ("u_min", "u_max", "v_min", "v_max")]
    bar = lambda a, b, c, d: F.struct(a.alias("u_min"), b.alias("u_max"), c.alias("v_min"), d.alias("v_max"))
    bars = F.array(bar(u0, u1, v0, v0 + w), bar(u0, u0 + w, v0, v1), bar(u1 - w, u1, v0, v1), bar(u0, u1, v1 - w, v1))
    each = rows.withColumn("bar", F.explode(bars)).withColumns({c: F.col(f"bar.{c}") for c in ("u_min", "u_max", "v_min", "v_max")})
    return uv_boxes(each, F.lit(FRAME_DEPTH))


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles: equal places of a mesh are one vertex (ids are 128 bits of hash of the place, so that no two of 10**10 places share one), triangles with two equal corners go, and so do vertices that none uses."""
    half = lambda p, seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "mesh_id", *[F.col(f"{p}{c}") + 0.0 for c in "xyz"])), 16, "0")
    vid = lambda p: F.concat(half(p, 1), half(p, 2))
    t = triangles.select("*", *[vid(p).alias(p) for p in "abc"]).where("a <> b and b <> c and a <> c")
    corner = F.explode(F.array(*[F.struct(F.col(p).alias("vid"), *[(F.col(f"{p}{c}") + 0.0).alias(c) for c in "xyz"]) for p in "abc"])).alias("v")
    vertices = t.select("mesh_id", corner).select("mesh_id", "v.*").distinct()
    return vertices, t.select("mesh_id", "a", "b", "c")


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """mesh_id, x, y, z, nx, ny, nz: the sum of the normals of the triangles around a place, by area, of length 1."""
    e1 = tuple(F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    e2 = tuple(F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz")
    n = g.cross(e1, e2)
    t = triangles.select("mesh_id", *[F.col(f"{p}{c}") for p in "abc" for c in "xyz"], *[x.alias(f"n{c}") for c, x in zip("xyz", n, strict=True)])
    corner = F.explode(F.array(*[F.struct(*[(F.col(f"{p}{c}") + 0.0).alias(c) for c in "xyz"]) for p in "abc"])).alias("v")
    sums = t.select("mesh_id", "nx", "ny", "nz", corner).groupBy("mesh_id", "v").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return sums.select("mesh_id", "v.*", *[F.when(size > 0, F.col(f"n{c}") / size).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


#: Side of the squares by which rectangles meet openings, in metres.
SQUARE = 1.0


def outside_openings(rects: DataFrame, openings: DataFrame) -> DataFrame:
    """Rectangles (wall_id, cu, cv) whose centre lies in no opening of their wall, edges included. Openings are copied to the squares that they touch, so a centre meets those of its own square only."""
    o = openings.select(F.col("wall_id").alias("o_wall"), *[F.col(c).alias(f"o_{c}") for c in ("u_min", "u_max", "v_min", "v_max")])
    for c in "uv":
        o = o.withColumn(f"o_square_{c}", F.explode(F.sequence(grid.cell(f"o_{c}_min", SQUARE), grid.cell(f"o_{c}_max", SQUARE))))
    square = (grid.cell("cu", SQUARE) == F.col("o_square_u")) & (grid.cell("cv", SQUARE) == F.col("o_square_v"))
    inside = (F.col("wall_id") == F.col("o_wall")) & square & F.col("cu").between(F.col("o_u_min"), F.col("o_u_max")) & F.col("cv").between(F.col("o_v_min"), F.col("o_v_max"))
    return rects.join(o, inside, "left_anti")


def wall_mesh(points: DataFrame, walls: list[Plane], frames_of: DataFrame, openings: DataFrame, config: SegmentConfig) -> DataFrame:
    cells = grid.occupied_cells(planes.with_uv(points, walls, frames_of), config.wall_cell, config.wall_min)
    rects = outside_openings(grid.metric(grid.merge_rectangles(cells), config.wall_cell), openings)
    return quads(with_normal(rects.join(F.broadcast(frames_of), "wall_id"), walls).withColumn("mesh_id", F.format_string("wall_%03d", "wall_id")))


def groove_mesh(points: DataFrame, walls: list[Plane], frames_of: DataFrame, config: SegmentConfig) -> DataFrame:
    """Boxes over groove cells, as deep as their deepest point, away from the side on which the groove lies (``flip_grooves``: towards it)."""
    uv = planes.with_uv(points, walls, frames_of).withColumn("depth", F.abs("s"))
    rects = grid.metric(grid.merge_rectangles(grid.occupied_cells(uv, config.groove_cell, config.groove_min, depth="depth"), depth=True), config.groove_cell)
    rows = with_normal(rects.join(F.broadcast(frames_of), "wall_id").join(F.broadcast(planes.recess_sign(uv)), "wall_id"), walls)
    side = F.col("recess") if config.flip_grooves else -F.col("recess")
    return uv_boxes(rows.withColumn("mesh_id", F.format_string("wall_%03d_grooves", "wall_id")), side * F.greatest(F.col("depth"), F.lit(0.004)))


def misc_rectangles(points: DataFrame, config: SegmentConfig) -> tuple[DataFrame, tuple[float, float, float]]:
    """iz, iu0..iv1 of occupied voxels merged layer by layer, and the least corner."""
    low = points.agg(*[F.min(c) for c in "xyz"]).first()
    low = tuple(v if v is not None else 0.0 for v in low)
    sizes = (config.groove_cell, config.groove_cell, config.groove_cell_depth)
    at = [grid.cell(F.col(c) - m, s).alias(n) for c, m, s, n in zip("xyz", low, sizes, ("iu", "iv", "iz"), strict=True)]
    cells = points.groupBy(*at).agg(F.count("*").alias("points")).where(F.col("points") >= config.groove_min)
    return grid.merge_rectangles(cells, ("iz",)), low


def misc_mesh(points: DataFrame, config: SegmentConfig) -> DataFrame:
    rects, low = misc_rectangles(points, config)
    a, b = config.groove_cell, config.groove_cell_depth
    rows = rects.withColumns({
        "mesh_id": F.lit("misc_grooves"), "x0": low[0] + F.col("iu0") * a, "x1": low[0] + (F.col("iu1") + 1) * a, "y0": low[1] + F.col("iv0") * a, "y1": low[1] + (F.col("iv1") + 1) * a,
        "z0": low[2] + F.col("iz") * b, "z1": low[2] + (F.col("iz") + 1) * b,
    })
    return axis_boxes(rows)


def combine(*meshes: DataFrame, mesh_id: str = "combined") -> DataFrame:
    out = meshes[0]
    for m in meshes[1:]:
        out = out.unionByName(m)
    return out.withColumn("mesh_id", F.lit(mesh_id))


def finished(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with normals, and triangles, of meshes combined: equal places are one vertex, degenerate triangles go."""
    vertices, faces = indexed(triangles)
    return vertices.join(vertex_normals(triangles), ["mesh_id", "x", "y", "z"]), faces


def density_trim(vertices: DataFrame, triangles: DataFrame, percent: float = 5) -> tuple[DataFrame, DataFrame]:
    """Without vertices whose density is below the percentile, and without triangles that used one."""
    limit = quantiles(vertices.where("density is not null"), "density", [percent / 100])[0]
    kept = vertices.where(F.col("density") >= limit) if limit is not None else vertices
    for p in "abc":
        triangles = triangles.join(kept.select(F.col("vid").alias(p)), p, "left_semi")
    return kept, triangles


def obj_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """section, place, line of an OBJ file: v lines (with a colour where vertices have a grey) and vn lines by vertex, then f lines; vertices may have nx, ny, nz."""
    return mesh_lines(vertices.withColumn("mesh_id", F.lit("")), triangles.withColumn("mesh_id", F.lit(""))).drop("mesh_id")


def mesh_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, section, place, line: as ``obj_lines``, of each mesh by itself; all meshes are numbered in one pass."""

    def by_mesh(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        placed = numbered(rows, ["mesh_id", *order], name)
        before = placed.groupBy("mesh_id").agg((F.min(name) - 1).alias("_before"))
        return placed.join(before, "mesh_id").withColumn(name, (F.col(name) - F.col("_before")).cast("long")).drop("_before")

    v = written(by_mesh(vertices, ["x", "y", "z", "vid"], "n"), "numbered")
    text = lambda *cs: F.concat_ws(" ", *[F.format_string("%.6f", F.col(c) + 0.0) for c in cs])
    colour = F.when(F.col("grey").isNotNull(), F.concat(F.lit(" "), text("grey", "grey", "grey"))).otherwise("") if "grey" in vertices.columns else F.lit("")
    parts = [v.select("mesh_id", F.lit(0).alias("section"), F.col("n").alias("place"), F.concat(F.lit("v "), text(*"xyz"), colour).alias("line"))]
    if "nx" in vertices.columns:
        parts.append(v.select("mesh_id", F.lit(1).alias("section"), F.col("n").alias("place"), F.concat(F.lit("vn "), text("nx", "ny", "nz")).alias("line")))
    t = triangles
    for p in "abc":
        t = t.join(v.select(F.col("vid").alias(p), F.col("n").alias(f"n{p}")), p)
    corner = (lambda p: F.concat(F.col(f"n{p}"), F.lit("//"), F.col(f"n{p}"))) if len(parts) > 1 else (lambda p: F.col(f"n{p}").cast("string"))
    face = F.concat(F.lit("f "), F.concat_ws(" ", *[corner(p) for p in "abc"]))
    parts.append(by_mesh(t, ["na", "nb", "nc"], "nf").select("mesh_id", F.lit(2).alias("section"), F.col("nf").alias("place"), face.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_objs(vertices: DataFrame, triangles: DataFrame, paths: dict[str, str]) -> None:
    """An OBJ file for each mesh named in ``paths``, all in one pass: tasks write ranges of lines, which Spark commits, and the committed ranges are then joined byte by byte, so that no row passes the driver."""
    spark = vertices.sparkSession
    order = ["mesh_id", "section", "place"]
    lines = mesh_lines(vertices, triangles).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = new_folder(spark, "obj")
    lines.select("line", F.col("mesh_id").alias("mesh")).write.partitionBy("mesh").text(folder)
    for name, path in paths.items():
        joined(spark, f"{folder}/mesh={name}", path)
    remove(spark, folder)


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """One mesh as one file."""
    write_objs(vertices.withColumn("mesh_id", F.lit("one")), triangles.withColumn("mesh_id", F.lit("one")), {"one": path})
