"""Ground truth, micro-inputs and guards of the point-cloud engine."""

import os
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pointloom.functions import geometry as g
from pointloom.model import MeshConfig, Plane, SegmentConfig
from pointloom.operators import grid, knn, mesh, normals, planes, sample, stats, surface, voids
from pointloom.plans import pipelines, queries
from pointloom.sources import las
from pointloom.sources.tables import points, room
from pointloom.streaming import tiles


DATA = Path(os.environ.get("POINTLOOM_TESTDATA", "/root/testdata"))


def cells_of(spark, cells):
    return spark.createDataFrame([(1, u, v) for u, v in cells], "wall_id int, iu long, iv long")


@pytest.mark.parametrize("cells", [
    {(0, 0)}, {(0, 0), (1, 0), (0, 1)}, {(u, v) for u in range(4) for v in range(4) if (u, v) not in {(1, 1), (2, 1)}}, {(u, v) for u in range(-3, 3) for v in range(-3, 3) if (u + v) % 2},
    {(u, v) for u in (0, 1) for v in (0, 1, 3, 4)}, {(random.Random(4).randint(-9, 9), k % 7) for k in range(40)},
])
def test_rectangles_partition_their_cells(spark, cells):
    rects = grid.merge_rectangles(cells_of(spark, cells)).collect()
    covered = [(u, v) for r in rects for u in range(r.iu0, r.iu1 + 1) for v in range(r.iv0, r.iv1 + 1)]
    assert len(covered) == len(set(covered)) and set(covered) == cells


def test_voids_are_what_the_outside_does_not_reach(spark):
    ring = {(u, v) for u in range(5) for v in range(5) if u in (0, 4) or v in (0, 4)}
    assert {(r.iu, r.iv) for r in voids.interior_voids(cells_of(spark, ring)).collect()} == {(u, v) for u in range(1, 4) for v in range(1, 4)}
    assert voids.interior_voids(cells_of(spark, ring - {(2, 0)})).count() == 0


def test_window_of_the_room_is_found(spark, small):
    found = queries.QUERIES["openings"](spark, small).collect()
    assert [(r.wall_id, r.type) for r in found] == [(1, "window")]
    assert abs(found[0].width - 1) < 0.11 and abs(found[0].sill - 0.9) < 0.11


def test_box_is_closed_and_faces_outward(spark):
    rows = spark.createDataFrame([("b", 0.0, 2.0, 0.0, 1.0, 0.0, 3.0)], "mesh_id string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    t = np.array([[r[f"{p}{c}"] for p in "abc" for c in "xyz"] for r in mesh.axis_boxes(rows).collect()]).reshape(-1, 3, 3)
    assert len(t) == 12 and np.isclose(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6, 6.0)
    edges = {(tuple(a), tuple(b)) for f in t for a, b in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
    assert len(edges) == 36 and all((b, a) in edges for a, b in edges)
    vertices, triangles = mesh.indexed(mesh.axis_boxes(rows))
    assert vertices.count() == 8 and triangles.count() == 12


def cloud(spark, n=300):
    rng = np.random.default_rng(9)
    xyz = np.round(rng.random((n, 3)), 3)
    xyz[:5] = xyz[5:10]
    return xyz, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_idx long, x double, y double, z double")


def test_neighbours_are_exact(spark):
    xyz, df = cloud(spark)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, :6]
    got = {}
    for r in knn.knn(df, 6, 0.05).collect():
        got.setdefault(r.q, []).append(r.d2 ** 0.5)
    assert all(np.allclose(sorted(got[k]), want[k]) for k in range(len(xyz)))
    near = {r.point_idx: r.d for r in knn.nearest_distance(df, 0.05).collect()}
    assert all(np.isclose(near[k], want[k][1]) for k in range(len(xyz)))


def test_neighbours_of_crowds_lone_points_and_one_place(spark):
    """Dense and thin parts, far points, and a third of all points at one place."""
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.random((150, 3)) * 0.001, rng.random((100, 3)) * 50, [[900.0, 0, 0], [-400.0, 3, 3]], np.zeros((120, 3)) + 7])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_idx long, x double, y double, z double")
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    order = [sorted(range(len(xyz)), key=lambda j, k=k: (d2[k, j], j != k, j)) for k in range(len(xyz))]
    for radius in (None, 0.01, 500.0):
        got = {}
        for r in knn.knn(df, 5, radius).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.p)
        assert got == {k: order[k][:5] for k in range(len(xyz))}
    near = {}
    for r in knn.hybrid_neighbours(df, 1.5, 30).orderBy("q", "rank").collect():
        near.setdefault(r.q, []).append(r.p)
    assert near == {k: [j for j in order[k] if d2[k, j] <= 1.5**2][:30] for k in range(len(xyz))}
    assert knn.knn(df, 1).count() == len(xyz) and knn.knn(df.limit(1), 3).count() == 1 and knn.knn(df.limit(0), 3).count() == 0


def test_quantiles_are_exact(spark):
    from pointloom.operators.quantiles import quantiles

    rng = np.random.default_rng(8)
    for values in (rng.normal(size=3_001), np.r_[np.full(5_000, 0.25), rng.random(40)], np.array([3.0]), np.array([-1e300, 0.0, 1e-300, 1e300, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "d double")
        assert np.allclose(quantiles(df, "d", [0.0, 0.05, 0.5, 0.9, 1.0]), np.quantile(values, [0.0, 0.05, 0.5, 0.9, 1.0]), rtol=1e-14, atol=0)
    assert quantiles(df.limit(0), "d", [0.5]) == [None]


def test_neighbour_queries_read_the_whole_room(spark, tiny):
    rows = room(spark, tiny).select("point_idx", *"xyz").collect()
    ids, at = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    near = np.concatenate([np.sort(np.sqrt(((at[k : k + 500, None] - at[None]) ** 2).sum(axis=2)), axis=1)[:, :20] for k in range(0, len(at), 500)])
    got = {r.q: (r.n, r.farthest) for r in queries.QUERIES["knn20"](spark, tiny).collect()}
    assert len(got) == len(ids) and all(got[q] == (20, pytest.approx(d, abs=2e-6)) for q, d in zip(ids, near[:, 19], strict=True))
    mean = near.mean(axis=1)
    limit = mean.mean() + 2 * mean.std(ddof=1)
    clear = np.abs(mean - limit) > 1e-9
    kept = {r[0] for r in queries.QUERIES["outlier_filter"](spark, tiny).collect()}
    assert all((q in kept) == (0 < m < limit) for q, m in zip(ids[clear], mean[clear], strict=True))
    assert queries._normals(spark, tiny).count() == grid.voxel_downsample(room(spark, tiny), 0.05).count()


def test_planes_are_refined_and_extracted(spark, small):
    fits = {r.wall_id: r for r in queries.QUERIES["plane_refine"](spark, small).collect()}
    for p in queries.WALLS:
        assert abs(np.dot(p.unit[:3], [fits[p.wall_id].a, fits[p.wall_id].b, fits[p.wall_id].c])) > 0.9999
    kinds = [e["kind"] for e in queries._extraction(spark, small).log]
    assert kinds.count("wall") == 4 and kinds.count("floor") >= 1


def test_a_plane_of_a_tenth_of_the_cloud_is_found(spark):
    rng = np.random.default_rng(5)
    xyz = rng.random((4000, 3)) * 20
    xyz[:400, 2] = 7 + rng.uniform(-0.004, 0.004, 400)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_idx long, x double, y double, z double")
    for seed in (1, 2, 3):
        log = planes.extract_planes(df, SegmentConfig(min_plane=300, seed=seed)).log
        assert [e["kind"] for e in log] == ["floor"] and abs(log[0]["mean_z"] - 7) < 0.01


def _hidden(seed: int, n: int = 20_000, share: float = 0.01, side: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """A square of a share of the points, turned at random, in 20 m of clutter; and its normal."""
    rng = np.random.default_rng(seed)
    normal = rng.normal(size=3)
    normal /= np.linalg.norm(normal)
    u = np.cross(normal, [1.0, 0, 0])
    u /= np.linalg.norm(u)
    few = int(n * share)
    flat = rng.uniform(-side / 2, side / 2, (few, 1)) * u + rng.uniform(-side / 2, side / 2, (few, 1)) * np.cross(normal, u)
    points = np.concatenate([rng.random((n - few, 3)) * 20, rng.uniform(5, 15, 3) + flat + rng.uniform(-0.004, 0.004, (few, 1)) * normal])
    return points[rng.permutation(n)], normal


@pytest.mark.parametrize("side", [2.0, 4.0])
def test_a_plane_of_a_hundredth_in_clutter_is_found_by_every_seed(side):
    for seed in range(20):
        points, normal = _hidden(seed, side=side)
        best = planes.best_candidates(points, SegmentConfig.candidates, SegmentConfig.distance, 100 + seed)
        units = np.array([p.unit for p in best])
        top = units[planes.sampled(points, units, SegmentConfig.distance).argmax()]
        assert abs(top[:3] @ normal) > 0.999


def test_a_hidden_plane_is_peeled_from_the_whole_cloud(spark):
    points, normal = _hidden(4, n=60_000)
    shift = np.array([500_000.0, 4_000_000.0, 100.0])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points + shift)], "point_idx long, x double, y double, z double")
    df = df.unionByName(df.sparkSession.sql("select -1L point_idx, double('nan') x, double(0) y, double('inf') z"))
    log = planes.extract_planes(df, SegmentConfig(min_plane=500, min_share=0.008)).log
    assert len(log) == 1 and log[0]["inliers"] >= 590 and abs(np.dot(log[0]["plane"][:3], normal)) > 0.9999


def test_draws_stop_early_where_one_plane_holds_most_points(monkeypatch):
    drawn = []
    whole = planes.through
    monkeypatch.setattr(planes, "through", lambda t: drawn.append(len(t)) or whole(t))
    points, _ = _hidden(1, share=0.6)
    planes.best_candidates(points, 5_000, 0.015, 1)
    assert sum(drawn) == planes.LOT
    drawn.clear()
    planes.best_candidates(_hidden(1)[0], 5_000, 0.015, 1)
    assert sum(drawn) == 5_000
    assert planes.best_candidates(points[:2], 5_000, 0.015, 1) == []
    assert planes.best_candidates(np.zeros((10, 3)), 100, 0.015, 1) == []


def test_fits_in_one_pass_equal_those_of_the_inliers(spark):
    points, normal = _hidden(2, n=5_000, share=0.3)
    points += [1e5, -1e5, 50]
    near = points[np.abs((points - points.mean(axis=0)) @ normal) < 8]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double").repartition(3)
    unit = Plane(4, *map(float, normal), -float(normal @ points.mean(axis=0)))
    far = Plane(5, 0.0, 0.0, 1.0, 1e6)
    got = planes.fits(df, [unit, far], 8.0, points.mean(axis=0))
    c = np.cov(near.T, bias=True)
    assert got[4]["n"] == len(near) and got[5]["n"] == 0
    assert np.allclose([got[4][f"m{a}"] for a in "xyz"], near.mean(axis=0), rtol=1e-12)
    assert np.allclose([got[4][k] for k in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")], [c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2]], rtol=1e-9)


def test_the_gate_of_planes_does_not_grow_with_the_cloud(spark):
    assert [queries.least_plane(n) for n in (100, 5_844, 58_479, 584_250, 10**9)] == [300, 730, 7_309, 8_000, 8_000]
    # The clutter at z = 2 of the largest room: more than 8,000 points, less than an eighth of the cloud.
    kinds = [e["kind"] for e in queries._extraction(spark, str(DATA / "sf0.1")).log]
    assert kinds.count("floor") == 2 and kinds.count("wall") == 4


def test_geometry_of_planes():
    for n in ((0.0, 1.0, 0.0), (0.6, 0.8, 0.0), (0.36, 0.48, 0.8), (0.0, 0.0, 1.0)):
        u, v = g.wall_basis(n)
        assert np.allclose(np.cross(u, v), n) and np.isclose(np.dot(u, v), 0)


def test_stride_begins_anew_in_each_chunk(spark):
    df = spark.range(25).withColumnRenamed("id", "point_idx")
    assert [r[0] for r in sample.stride_sample(df, 25, 10, 8).orderBy("point_idx").collect()] == [0, 3, 6, 9, 10, 13, 16, 19, 20, 23]


def test_crop_falls_back_and_percentiles(spark):
    _, df = cloud(spark, 50)
    assert sample.crop_sphere(df, 0.5, (9.0, 9.0, 9.0)).count() == 50
    row = stats.spacing(spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9, 20)], "d double")).first()
    assert row.p90_mm == pytest.approx(15_600) and row.median_mm == 4_000
    assert points(df, intensity=F.lit(7)).first().intensity == 7


def test_normals_of_a_plane(spark):
    flat = spark.range(900).select(F.col("id").alias("point_idx"), ((F.col("id") % 30) * 0.05).alias("x"), (F.floor(F.col("id") / 30) * 0.05).alias("y"), F.lit(0.2).alias("z"))
    with_normals = normals.mst_orientation(normals.estimate(flat, 0.05), cell=0.2)
    rows = with_normals.collect()
    assert len(rows) == 900 and all(abs(r.nz - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        normals.estimate(flat.limit(99), 0.05)


def test_orientation_goes_on_over_tile_borders(spark):
    rows = []
    for y in (0.0, 40.0):
        for i in range(60):
            for j in range(12):
                x = (i - 29.5) * 0.3
                rows.append((len(rows), x, y + 0.004 * (-1) ** j, j * 0.3, 0.0, -1.0 if (x < 0) == (y == 0) else 1.0, 0.0))
    tilted = spark.createDataFrame(rows, "point_idx long, x double, y double, z double, nx double, ny double, nz double")
    got = normals.mst_orientation(tilted, cell=0.9).collect()
    assert len(got) == len(rows)
    for y in (0.0, 40.0):
        assert len({r.ny for r in got if abs(r.y - y) < 1}) == 1


def test_each_wall_of_the_room_has_one_side(spark, small):
    p = grid.voxel_downsample(room(spark, small).where("surf in (1, 2, 3, 4)").withColumns({"x": F.col("x") * 4, "y": F.col("y") * 4, "z": F.col("z") * 4}), 0.4).select("point_idx", *"xyz")
    rows = normals.mst_orientation(p.join(normals.from_neighbours(knn.hybrid_neighbours(p, 1.6, 30)), "point_idx"), cell=1.6).collect()
    for c, n in (("x", "nx"), ("y", "ny")):
        other = "y" if c == "x" else "x"
        for at in (0, 12):
            sides = [r[n] > 0 for r in rows if abs(r[c] - at) < 0.1 and 2 < r[other] < 10]
            assert len(sides) > 100 and len(set(sides)) == 1


def write_las(path, xyz, fmt=3, version=(1, 2), cut=0):
    size = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36}[fmt]
    head = 375 if version == (1, 4) else 227
    h = bytearray(head)
    h[:4], h[24], h[25] = b"LASF", *version
    struct.pack_into("<H", h, 94, head)
    struct.pack_into("<I", h, 96, head)
    struct.pack_into("<BHI", h, 104, fmt, size, 0 if version == (1, 4) else len(xyz))
    struct.pack_into("<3d3d", h, 131, 0.001, 0.001, 0.001, 10.0, 20.0, 30.0)
    if version == (1, 4):
        struct.pack_into("<Q", h, 247, len(xyz))
    body = bytearray()
    for k, p in enumerate(xyz):
        r = bytearray(size)
        struct.pack_into("<3iH", r, 0, *p, 100 + k)
        r[16 if fmt >= 6 else 15] = 5
        if fmt in las.RGB:
            struct.pack_into("<3H", r, las.RGB[fmt], 1, 2, k)
        if fmt in las.GPS:
            struct.pack_into("<d", r, las.GPS[fmt], k + 0.5)
        body += r
    path.write_bytes(bytes(h) + bytes(body)[: len(body) - cut])
    return str(path)


@pytest.mark.parametrize(("fmt", "version"), [(0, (1, 2)), (3, (1, 2)), (6, (1, 4)), (7, (1, 4))])
def test_las_round_trip(spark, tmp_path, fmt, version):
    path = write_las(tmp_path / "a.las", [(k, 2 * k, -k) for k in range(25)], fmt, version)
    rows = las.load(spark, path, rows=10).orderBy("point_idx").collect()
    assert len(rows) == 25 and rows[3].x == pytest.approx(10.003) and rows[3].z == pytest.approx(29.997) and rows[3].intensity == 103 and rows[3].classification == 5
    assert rows[4].blue == (4 if fmt in las.RGB else None) and rows[4].gps_time == (4.5 if fmt in las.GPS else None)
    assert las.load(spark, path, rows=10, max_records=7).count() == 7
    assert las.header_frame(spark, path).first().point_count == 25


def test_las_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="truncated"):
        las.load(spark, write_las(tmp_path / "b.las", [(1, 2, 3)] * 4, cut=9))
    with pytest.raises(ValueError, match="no points"):
        las.load(spark, write_las(tmp_path / "c.las", []))


def test_manifest_and_files(spark, small, tmp_path):
    table = room(spark, small)
    config = SegmentConfig(min_plane=max(300, table.count() // 8), min_groove=10, opening_cell=0.1, wall_cell=0.1, groove_cell=0.1, groove_cell_depth=0.05, candidates=300)
    data = pipelines.write_segmentation(pipelines.segment(table, config, downsample=False), config, str(tmp_path), parts=True)
    assert len(data["walls"]) == 4 and [o["type"] for o in data["openings"]] == ["window"] and (tmp_path / "manifest.json").exists()
    for name in ("reconstructed.obj", "grooves/misc_grooves.obj", "grooves/grooves_all.obj"):
        lines = (tmp_path / name).read_text().splitlines()
        places = [x for x in lines if x.startswith("v ")]
        assert places and len(set(places)) == len(places) == sum(x.startswith("vn ") for x in lines)
        faces = [[tuple(map(int, i.split("//"))) for i in x.split()[1:]] for x in lines if x.startswith("f ")]
        assert faces and all(len(set(f)) == 3 and all(a == b and 1 <= a <= len(places) for a, b in f) for f in faces)
        if name == "reconstructed.obj":
            assert data["reconstructed_triangles"] == len(faces)
    assert data["misc_grooves"]["file"] == "grooves/misc_grooves.obj" and data["grooves_all"]["triangles"] == len(faces) and [w["file"] for w in data["walls"]] == [f"walls/wall_{k:03d}.obj" for k in range(1, 5)]


def test_flags_change_what_is_combined(spark, small, tmp_path):
    points = room(spark, small)
    config = SegmentConfig(min_plane=queries.least_plane(points.count()), min_groove=10, opening_cell=0.1, wall_cell=0.1, groove_cell=0.1, groove_cell_depth=0.05)
    result = pipelines.segment(points, config, downsample=False)
    rows = pipelines.manifest_rows(result).collect()
    n = {k: sum(r.triangles for r in rows if r.kind == k) for k in ("wall", "groove", "residual")}
    plain, more = (pipelines.combined(result, misc=m).count() for m in (False, True))
    assert plain == n["wall"] + n["groove"] and more == plain + n["residual"] and n["residual"] > 0
    data = pipelines.write_segmentation(result, config, str(tmp_path), misc=True)
    assert data["grooves_all"] is None and "file" not in data["walls"][0] and data["reconstructed_triangles"] <= more


def test_colours_and_depth_reach_the_mesh(spark, tmp_path):
    flat = spark.range(4_900).select(F.col("id").alias("point_idx"), ((F.col("id") % 70) * 0.03).alias("x"), (F.floor(F.col("id") / 70) * 0.03).alias("y"), F.lit(0.2).alias("z"), F.lit(51).alias("intensity"))
    sizes = []
    for depth in (5, 6):
        vertices, triangles = pipelines.reconstruct(flat, MeshConfig("flat", 0.03, depth, skip_outliers=True))
        rows = vertices.collect()
        assert rows and all(abs(r.grey - 0.2) < 1e-12 for r in rows)
        sizes.append(triangles.count())
    assert sizes[0] < sizes[1] / 2
    mesh.write_obj(vertices, triangles, str(tmp_path / "a.obj"))
    assert (tmp_path / "a.obj").read_text().startswith("v ") and (tmp_path / "a.obj").read_text().splitlines()[0].endswith(" 0.200000 0.200000 0.200000")
    bare, _ = pipelines.reconstruct(flat.drop("intensity"), MeshConfig("flat", 0.05, 3, skip_outliers=True, recentre=False, one_search=True))
    assert all(r.grey is None and abs(r.z - 0.2) < 0.1 for r in bare.collect())


def test_points_that_no_forest_reaches_look_to_the_origin(spark):
    rows = [(0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    lone = spark.createDataFrame(rows, "point_idx long, x double, y double, z double, nx double, ny double, nz double")
    assert [(r.nx, r.ny, r.nz) for r in normals.mst_orientation(lone).collect()] == [(-1.0, 0.0, 0.0)]


def test_profile_report_and_command_line(spark, tmp_path, capsys, monkeypatch, caplog):
    from pointloom import cli

    path = write_las(tmp_path / "a.las", [(k % 20 * 50, k // 20 * 50, 0) for k in range(400)], 3)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    cli.main(["profile", path])
    lines = capsys.readouterr().out.splitlines()
    shown = dict(x.split("  ", 1) for x in lines[1:])
    shown = {k: v.strip() for k, v in shown.items()}
    wanted = {
        "points": "400", "file": "LAS 1.2, format 3, 400 records", "reference system": "none / local", "red": "1 .. 1", "green": "2 .. 2", "blue": "0 .. 399", "intensity": "100 .. 499, on average 299.5", "time stamps": "each point",
        "class 5": "400", "spacing median": "50.00 mm", "smallest relief to expect": "150.0 mm",
    }
    assert {k: shown.get(k) for k in wanted} == wanted, lines
    assert spark.sparkContext.getLocalProperty("spark.job.description") == "profile: spacing"
    room(spark, str(DATA / "sf0.001")).write.parquet(str(tmp_path / "room.parquet"))
    cli.main(["mesh", str(tmp_path / "room.parquet"), str(tmp_path / "out.obj"), "--preset", "smoke"])
    assert (tmp_path / "out.obj").read_text().count("\nf ") > 100
    assert [m for m in caplog.messages if m.startswith("smoke: surface")]
    cli.main(["segment", str(tmp_path / "room.parquet"), str(tmp_path / "parts"), "--parts"])
    assert (tmp_path / "parts" / "manifest.json").exists()


@pytest.mark.parametrize(("records", "wanted"), [
    ([(b"LASF_Projection", 2112, b'PROJCS["x"]\0')], 'PROJCS["x"]'), ([(b"other", 1, b"abc"), (b"LASF_Projection", 34735, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 25832))], "EPSG:25832"), ([(b"other", 34735, b"12345678")], "none / local"),
])
def test_reference_system_of_a_file(tmp_path, records, wanted):
    path = write_las(tmp_path / "a.las", [(1, 2, 3)])
    raw = open(path, "rb").read()
    body = b"".join(struct.pack("<H16sHH32s", 0, user, kind, len(data), b"") + data for user, kind, data in records)
    head = bytearray(raw[:227])
    struct.pack_into("<II", head, 96, 227 + len(body), len(records))
    open(path, "wb").write(bytes(head) + body + raw[227:])
    assert las.read_crs(path) == wanted and las.read_header(path).count == 1


def test_streamed_tiles_equal_the_batch(spark, tmp_path):
    table = room(spark, str(DATA / "sf0.001"))
    for k in range(3):
        table.where(F.col("point_idx") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "tiles"))
    stream = tiles.read_tiles(spark, str(tmp_path / "tiles"), table.schema)
    for name, made in (("voxels", tiles.running_voxels(stream, 0.1)), ("classes", tiles.running_classes(stream))):
        run = made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination()
    want = {r.classification: r.points for r in stats.class_histogram(table).collect()}
    assert {r.classification: r.points for r in spark.table("classes").collect()} == want
    voxels = spark.table("voxels").agg(F.sum("members"), F.count("*")).first()
    cells = table.select(*[grid.cell(c, 0.1).alias(c) for c in "xyz"]).distinct().count()
    assert tuple(voxels) == (table.count(), cells)


def test_tables_go_and_clusters_need_a_folder(spark, tmp_path):
    from pointloom import session

    before = session.written(spark.range(2), "before")
    with session.dropping(spark) as drop:
        gone, stays = session.written(spark.range(3), "gone"), session.written(spark.range(4), "stays")
        with session.dropping(spark) as inner:
            own = session.written(spark.range(5), "own")
            inner(1)
            assert own.count() == 5
        drop(2)
        assert before.count() == 2 and stays.count() == 4 and own.count() == 5
        with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|does not exist"):
            spark.read.parquet(gone.inputFiles()[0]).count()

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="shared folder"):
        session.shared_dir(type("S", (), {"sparkContext": Context()})())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
