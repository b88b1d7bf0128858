"""The composite queries: profile, mesh, and segmentation with its manifest."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_bytes
from ..model import MeshConfig, ProfileConfig, SegmentConfig
from ..operators import grid, knn, mesh, normals, planes, poisson, sample, stats, voids
from ..session import progress, written


def profile(points: DataFrame, config: ProfileConfig = ProfileConfig()) -> dict[str, DataFrame]:
    """Extent and attribute statistics of all points, and spacing of a systematic sample."""
    spark = points.sparkSession
    n = points.count()
    chosen = sample.stride_sample(points, n, config.chunk, config.target)
    progress(spark, "profile: spacing")
    spacing = stats.spacing(knn.nearest_distance(chosen))
    return {
        "extent": sample.bbox_extent(points), "classes": stats.class_histogram(points), "intensity": stats.intensity_stats(points), "rgb": stats.rgb_range(points),
        "sampled": spark.createDataFrame([(chosen.count(), n)], "sampled long, points long"), "spacing": spacing,
    }


def profile_report(points: DataFrame, header: dict | None = None, size: int | None = None, config: ProfileConfig = ProfileConfig()) -> list[str]:
    """The profile as a table of names and values: spacing first, as what a scan is judged by, then extent, what its points carry, and the file."""
    found = profile(points, config)
    spacing, box, grey, rgb, counted = (found[k].first().asDict() for k in ("spacing", "extent", "intensity", "rgb", "sampled"))
    has = lambda name: header is None or header[name]
    rows: list[tuple[str, str]] = [("points", f"{counted['points']}"), ("measured for spacing", f"{counted['sampled']}")]
    if spacing["median_mm"] is not None:
        rows += [(f"spacing {name}", f"{spacing[f'{name}_mm']:.2f} mm") for name in ("median", "mean", "p90")]
        rows.append(("smallest relief to expect", f"{spacing['resolvable_mm']:.1f} mm"))
    for c in "xyz":
        if box[f"min_{c}"] is not None:
            rows.append((c, f"{box[f'min_{c}']:.3f} .. {box[f'max_{c}']:.3f} ({box[f'extent_{c}']:.3f} m)"))
    if has("has_rgb") and rgb["min_red"] is not None:
        rows += [(c, f"{rgb[f'min_{c}']} .. {rgb[f'max_{c}']}") for c in ("red", "green", "blue")]
    if grey["min_intensity"] is not None:
        rows.append(("intensity", f"{grey['min_intensity']} .. {grey['max_intensity']}, on average {grey['mean_intensity']:.1f}"))
    # At most 256 codes.
    for r in found["classes"].where("classification is not null").orderBy("classification").collect():
        rows.append((f"class {r['classification']}", f"{r['points']}"))
    if header:
        rows += [("file", f"LAS {header['version']}, format {header['format_id']}, {header['point_count']} records"), ("fields", " ".join(header["dims"])), ("reference system", header["crs"]), ("time stamps", "each point" if header["has_gps_time"] else "none")]
    if size is not None:
        rows.append(("size", points.sparkSession.range(1).select(human_bytes(F.lit(size))).first()[0]))
    wide = max(len(name) for name, _ in rows)
    return [f"{name.ljust(wide)}  {value}" for name, value in rows]


def reconstruct(points: DataFrame, config: MeshConfig) -> tuple[DataFrame, DataFrame]:
    """Vertices with normals, density and (of points with an intensity) a grey, and triangles: crop and cap, recentre, downsample, outliers, normals, surface, trim.

    The surface is the screened Poisson one, its cell the cloud's extent by 2 to the depth, but not below a voxel, since no two points are closer.
    """
    spark = points.sparkSession
    if config.crop_radius:
        points = sample.crop_sphere(points, config.crop_radius)
    if config.max_points:
        points = sample.point_cap(points, config.max_points)
    if config.recentre:
        points, _ = sample.recenter(points)
    progress(spark, f"{config.name}: voxel downsampling")
    extra = ("grey",) if "intensity" in points.columns else ()
    if extra:
        points = sample.intensity_gray(points).withColumnRenamed("r", "grey")
    thin = written(grid.voxel_downsample(points, config.voxel, extra).select("point_idx", *"xyz", *extra), "thin")
    if not config.skip_outliers:
        progress(spark, f"{config.name}: outlier removal")
        thin = written(knn.outlier_filter(thin, 20, config.outlier_ratio), "inliers")
    progress(spark, f"{config.name}: normals")
    oriented = normals.mst_orientation(normals.estimate(thin, config.voxel, one_search=config.one_search))
    progress(spark, f"{config.name}: surface")
    b = sample.bounds(thin)
    extent = max((b[f"max_{c}"] - b[f"min_{c}"] for c in "xyz"), default=0.0)
    triangles = written(poisson.reconstruct(oriented, poisson.depth_of(extent, config.depth, config.voxel)), "surface")
    vertices, faces = mesh.indexed(triangles)
    corner = F.explode(F.array(*[F.struct(*[(F.col(f"{p}{c}") + 0.0).alias(c) for c in "xyz"]) for p in "abc"])).alias("v")
    of_place = triangles.select("density", "grey", corner).groupBy("v.x", "v.y", "v.z").agg(F.avg("density").alias("density"), F.avg("grey").alias("grey"))
    progress(spark, f"{config.name}: trim")
    vertices, faces = mesh.density_trim(written(vertices.join(of_place, [*"xyz"]), "vertices"), faces, config.trim_percent)
    return vertices.join(mesh.vertex_normals(triangles), ["mesh_id", "x", "y", "z"]), faces


def segment(points: DataFrame, config: SegmentConfig = SegmentConfig(), downsample: bool = True) -> dict:
    """Walls, grooves, openings and meshes of a cloud; tables under names, and the manifest's numbers. Walls, grooves and openings share one frame, that of all the wall's inliers; meshes have no colours, as in the reference."""
    spark = points.sparkSession
    points, _ = sample.recenter(points)
    if downsample:
        progress(spark, "segmentation: voxel downsampling")
        points = grid.voxel_downsample(points, config.voxel)
    found = planes.extract_planes(points.select("point_idx", *"xyz"), config)
    low = found.floor_z if found.floor_z is not None else points.agg(F.min("z")).first()[0]
    full = found.rows.where("role in ('wall', 'groove')")
    misc = mesh.misc_mesh(found.rows.where("role = 'residual'"), config)
    frames = written(planes.wall_frames(found.rows.where("wall_id is not null"), found.planes, config.strict_origin), "frames") if found.planes else None
    if frames is None:
        return {"extraction": found, "floor_z": low, "openings": None, "walls": None, "grooves": None, "misc": misc, "frames": None}
    progress(spark, "segmentation: openings")
    openings = written(voids.openings(found.rows.where("wall_id is not null"), found.planes, config, found.floor, low), "openings")
    progress(spark, "segmentation: meshes")
    return {
        "extraction": found, "floor_z": low, "openings": openings, "frames": mesh.frames(mesh.with_normal(openings, found.planes).withColumn("mesh_id", F.lit("frames"))),
        "walls": mesh.wall_mesh(full.where("role = 'wall'"), found.planes, frames, openings, config),
        "grooves": mesh.groove_mesh(full.where("role = 'groove'"), found.planes, frames, config), "misc": misc,
    }


#: The parts of a segmentation's mesh: those that are always in the combined one, and those a flag adds.
ALWAYS, ON_DEMAND = ("walls", "grooves"), ("misc", "frames")


def combined(result: dict, misc: bool = False, frames: bool = False) -> DataFrame | None:
    """Triangles of the parts that are wanted, as one mesh; None without any."""
    wanted = [*ALWAYS, *(k for k, use in zip(ON_DEMAND, (misc, frames), strict=True) if use)]
    parts = [result[k] for k in wanted if result.get(k) is not None]
    return mesh.combine(*parts) if parts else None


def manifest_rows(result: dict) -> DataFrame:
    """kind, wall_id, points, triangles: one row for each wall, wall's grooves and the rest, and (kind opening) for each opening its type as ``type``."""
    found = result["extraction"]
    spark = found.rows.sparkSession
    triangles = None
    for kind in ("walls", "grooves", "misc"):
        if result[kind] is not None:
            one = result[kind].groupBy(F.expr("cast(nullif(regexp_extract(mesh_id, '^wall_([0-9]+)', 1), '') as int)").alias("wall_id")).agg(F.count("*").alias("triangles")).withColumn("kind", F.lit({"walls": "wall", "grooves": "groove", "misc": "residual"}[kind]))
            triangles = one if triangles is None else triangles.unionByName(one)
    counted = found.rows.where("role in ('wall', 'groove', 'residual')").groupBy(F.col("role").alias("kind"), F.when(F.col("role") != "residual", F.col("wall_id")).alias("wall_id")).agg(F.count("*").alias("points"))
    t = triangles.select(F.col("kind").alias("t_kind"), F.col("wall_id").alias("t_wall"), "triangles") if triangles is not None else spark.createDataFrame([], "t_kind string, t_wall int, triangles long")
    met = counted.join(t, (F.col("kind") == F.col("t_kind")) & F.col("wall_id").eqNullSafe(F.col("t_wall")), "left")
    rows = met.select("kind", "wall_id", "points", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"), F.lit(None).cast("string").alias("type"))
    if result["openings"] is None:
        return rows
    return rows.unionByName(result["openings"].select(F.lit("opening").alias("kind"), "wall_id", F.lit(None).cast("long").alias("points"), F.lit(None).cast("long").alias("triangles"), "type"))


def manifest(result: dict, config: SegmentConfig, files: dict[str, str] | None = None, totals: dict[str, int] | None = None) -> dict:
    """The manifest as plain data: small tables only. ``totals``: triangles of the meshes that were combined and written."""
    files, totals = files or {}, totals or {}
    found = result["extraction"]
    rows = {(r["kind"], r["wall_id"]): r for r in manifest_rows(result).where("kind <> 'opening'").collect()}
    named = lambda name: {"file": files[name]} if name in files else {}
    number = lambda kind, i: {"points": rows[kind, i]["points"] if (kind, i) in rows else 0, "triangles": rows[kind, i]["triangles"] if (kind, i) in rows else 0}
    openings = result["openings"].orderBy("wall_id", "u_min", "v_min").collect() if result["openings"] is not None else []
    misc = number("residual", None)
    return {
        "reconstructed": files.get("combined"), "floor_z_m": round(result["floor_z"], 4) if result["floor_z"] is not None else None, "floor_plane": list(found.floor) if found.floor else None,
        "walls": [{"wall_id": p.wall_id, **number("wall", p.wall_id), "plane": list(p.unit), **named(f"wall_{p.wall_id:03d}")} for p in found.planes if ("wall", p.wall_id) in rows and rows["wall", p.wall_id]["triangles"]],
        "openings": [{"wall_id": o["wall_id"], "type": o["type"], "width_m": round(o["width"], 3), "height_m": round(o["height"], 3), "sill_m": round(o["sill"], 3)} for o in openings],
        "grooves_by_wall": [{"wall_id": p.wall_id, **number("groove", p.wall_id), **named(f"wall_{p.wall_id:03d}_grooves")} for p in found.planes if ("groove", p.wall_id) in rows],
        "misc_grooves": {**named("misc_grooves"), **misc} if misc["triangles"] else None,
        "grooves_all": {**named("grooves_all"), "triangles": totals["grooves_all"]} if "grooves_all" in totals else None,
        "settings": {"voxel_mm": config.voxel * 1000, "wall_flat_mm": config.flat * 1000, "groove_deviation_mm": config.distance * 1000, "groove_cell_uv_mm": config.groove_cell * 1000, "groove_cell_depth_mm": config.groove_cell_depth * 1000, "opening_cell_mm": config.opening_cell * 1000},
        "reconstructed_triangles": totals.get("combined", 0),
    }


def write_segmentation(result: dict, config: SegmentConfig, folder: str, parts: bool = False, misc: bool = False, frames: bool = False) -> dict:
    """OBJ files with normals, and manifest.json, in a folder; each kind of mesh is computed once, and all files are written in one pass."""
    out = Path(folder)
    result = {**result, **{k: written(result[k], k) for k in (*ALWAYS, *ON_DEMAND) if result.get(k) is not None}}
    whole = combined(result, misc, frames)
    meshes = [whole] if whole is not None else []
    if parts:
        meshes += [result[k] for k in ("walls", "grooves", "misc") if result[k] is not None]
        both = [result[k] for k in ("grooves", "misc") if result[k] is not None]
        meshes += [mesh.combine(*both, mesh_id="grooves_all")] if both else []
    files: dict[str, str] = {}
    totals: dict[str, int] = {}
    if meshes:
        everything = meshes[0]
        for m in meshes[1:]:
            everything = everything.unionByName(m)
        vertices, faces = mesh.finished(written(everything, "meshes"))
        # A row for each mesh that has triangles left when it is cleaned.
        totals = {r["mesh_id"]: r["n"] for r in faces.groupBy("mesh_id").agg(F.count("*").alias("n")).collect()}
        files = {name: "reconstructed.obj" if name == "combined" else f"{'grooves' if 'grooves' in name else 'walls'}/{name}.obj" for name in totals}
        for file in files.values():
            (out / file).parent.mkdir(parents=True, exist_ok=True)
        mesh.write_objs(vertices, faces, {name: str(out / file) for name, file in files.items()})
    out.mkdir(parents=True, exist_ok=True)
    data = manifest(result, config, files, totals)
    (out / "manifest.json").write_text(json.dumps(data, indent=2))
    return data
