"""LAS files as source and sink: folders, pruned ranges, columns, retried tasks; and meshes written in one pass."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from pointloom.operators import mesh
from pointloom.sources import las


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(10_000).select(F.col("id").alias("point_idx"), (F.col("id") * 0.01).alias("x"), (F.col("id") % 7 * 1.0).alias("y"), (-F.col("id") * 0.002).alias("z"), (F.col("id") % 256).cast("int").alias("intensity"))


def read(path, rows=500):
    return las._Reader(path, rows, None, ["x", "y"])


def test_a_crop_opens_only_the_files_that_meet_it(spark, cloud, tmp_path):
    path = f"file://{tmp_path}/cloud"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert las.write(cloud.repartition(6), path) == 10_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = read(path)
    assert len(every.parts) >= 2 and sum(p.count for p in every.partitions()) == 10_000
    some = read(path)
    assert len(list(some.pushFilters([GreaterThan(("x",), 5.0), LessThanOrEqual(("x",), 6.0), EqualTo(("intensity",), 3)]))) == 3
    assert 0 < sum(p.count for p in some.partitions()) < 10_000
    rows = las.load(spark, path, columns=["x", "intensity"]).where("x > 5 and x <= 6")
    assert rows.columns == ["x", "intensity"] and sorted(round(r.x, 3) for r in rows.collect()) == [round(k * 0.01, 3) for k in range(501, 601)]
    assert rows.rdd.getNumPartitions() < las.load(spark, path).rdd.getNumPartitions()


def test_ranges_of_one_file_are_pruned_by_stored_boxes(spark, cloud, tmp_path):
    path = f"file://{tmp_path}/one"
    las.write(cloud.coalesce(1), path)
    whole = las.files(path)[0] if len(las.files(path)) == 1 else None
    for one in [whole] if whole else las.files(path):
        before = len(read(one).partitions())
        las.index(spark, one, rows=100)
        h = las.read_header(one)
        crop = read(one)
        middle = (h.minimum[0] + h.maximum[0]) / 2
        list(crop.pushFilters([GreaterThan(("x",), middle), LessThanOrEqual(("x",), middle + 0.5)]))
        assert 1 <= len(crop.partitions()) <= 2 and len(read(one).partitions()) > before
    assert las.load(spark, path).where("x > 50 and x <= 50.5").count() == 50


def test_what_no_counting_task_wrote_goes(spark, cloud, tmp_path):
    folder = tmp_path / "retried"
    las.write(cloud, str(folder))
    kept = json.loads((folder / "_parts.json").read_text())
    assert sorted(p.name for p in folder.glob("*.las")) == sorted(kept) and not list(folder.glob("_part*.records"))
    (folder / "part-000000-lost.las").write_bytes(b"LASF half a file")
    (folder / "_part-000001-lost.las.records").write_bytes(b"x")
    assert las.load(spark, str(folder)).count() == 10_000
    las.write(cloud.limit(10), str(folder))
    assert las.load(spark, str(folder)).count() == 10 and not list(folder.glob("*lost*"))
    with pytest.raises(Exception, match="is there already"):
        cloud.write.format("las").mode("append").save(str(folder))


def test_nulls_no_rows_and_places_out_of_range(spark, tmp_path):
    some = spark.createDataFrame([(0, 1.0, 2.0, 3.0, None, 40), (1, 1.5, 2.5, 3.5, 9, None)], "point_idx long, x double, y double, z double, intensity int, classification int")
    las.write(some, str(tmp_path / "nulls"))
    assert [(r.intensity, r.classification) for r in las.load(spark, str(tmp_path / "nulls")).orderBy("point_idx").collect()] == [(0, 8), (9, 0)]
    las.write(some.limit(0), str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no LAS files"):
        las.load(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="scale"):
        las.write(some.unionByName(some.withColumn("x", F.lit(1e9))), str(tmp_path / "far"))


def test_all_meshes_are_written_in_one_pass(spark, tmp_path):
    boxes = spark.createDataFrame([("a", 0.0, 2.0, 0.0, 1.0, 0.0, 3.0), ("b", 5.0, 6.0, 0.0, 1.0, 0.0, 3.0), ("b", 6.0, 7.0, 0.0, 1.0, 0.0, 3.0)], "mesh_id string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    vertices, faces = mesh.finished(mesh.axis_boxes(boxes))
    mesh.write_objs(vertices, faces, {k: str(tmp_path / f"{k}.obj") for k in "abc"})
    for name, places, triangles in (("a", 8, 12), ("b", 12, 24), ("c", 0, 0)):
        lines = Path(tmp_path / f"{name}.obj").read_text().splitlines()
        kinds = [x.split()[0] for x in lines]
        assert kinds == ["v"] * places + ["vn"] * places + ["f"] * triangles
        assert all(1 <= int(i.split("//")[0]) <= places for x in lines if x.startswith("f ") for i in x.split()[1:])
        assert [x for x in lines if x.startswith("v ")] == sorted((x for x in lines if x.startswith("v ")), key=lambda x: [float(v) for v in x.split()[1:]])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.obj", "b.obj", "c.obj"]


def test_a_hundred_thousand_openings_meet_only_their_squares(spark):
    rects = spark.range(50_000).select(F.lit(1).alias("wall_id"), (F.col("id") * 0.1 + 0.05).alias("cu"), F.lit(0.5).alias("cv"))
    openings = spark.range(100_000).select(F.lit(1).alias("wall_id"), (F.col("id") * 0.1).alias("u_min"), (F.col("id") * 0.1 + 0.02).alias("u_max"), F.lit(0.0).alias("v_min"), F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.4).alias("v_max"))
    left = mesh.outside_openings(rects, openings.withColumn("u_max", F.col("u_max") + 0.05))
    assert left.count() == 25_000 and "NestedLoop" not in left._jdf.queryExecution().toString()
