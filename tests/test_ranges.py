"""Order without a task that sees all rows."""

import pytest
from pyspark.sql import functions as F

from pointloom import session
from pointloom.model import SegmentConfig
from pointloom.operators import grid, planes, ranges, sample
from pointloom.plans import queries
from pointloom.sources import tables
from pointloom.sources.tables import room


def most_rows(spark, run):
    """The most rows that a task of these jobs has from a shuffle."""
    context = spark.sparkContext
    group = f"most-rows-{id(run)}"
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    most = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10_000)
            for k in range(tasks.size()):
                metrics = tasks.apply(k).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_no_task_sees_the_whole_room(spark, small):
    spark.sparkContext.__dict__.pop("_pointloom_rooms", None)
    assert 0 < most_rows(spark, lambda: room(spark, small).count()) < 60_000 / 4


def test_places_are_those_of_the_order(spark):
    rows = spark.range(10_000).select((F.col("id") * 7_919 % 10_000).alias("k"), (F.col("id") % 3).alias("of")).repartition(5)
    for parts in (1, 7, None):
        got = ranges.numbered(rows, ["of", "k"], "place", parts=parts).collect()
        assert [r.place for r in sorted(got, key=lambda r: (r.of, r.k))] == list(range(1, 10_001))
    assert ranges.numbered(rows, ["k"], "place", ["k"]).columns == ["k", "place"]


def test_numbers_of_the_sphere_and_of_a_cap_come_from_ranges_of_some_rows(spark, small, monkeypatch):
    """Whatever number of partitions the session has: a part of all rows would grow with them."""

    class Numbered(Exception):
        pass

    def numbered(*_):
        raise Numbered

    points = room(spark, small)
    n = points.count()
    monkeypatch.setattr(ranges, "LOT", 3_000)
    monkeypatch.setattr(queries, "sphere", numbered)

    def of_sphere():
        with pytest.raises(Numbered):
            queries.poisson_sphere(spark, small)

    for run in (of_sphere, lambda: sample.within_cap(points.select("point_idx"), 1000)):
        assert 0 < most_rows(spark, run) < n / 8


def test_voxels_bring_their_first_points_surface_and_the_room_is_not_met_again(spark, small):
    points = room(spark, small)
    each = grid.voxel_downsample(points, 0.05, first=("surf",)).select("point_idx", "surf")
    assert each.join(points.select("point_idx", "surf"), ["point_idx", "surf"], "left_semi").count() == each.count() > 1_000
    assert grid.voxel_downsample(points.where("point_idx < 0"), 0.05, first=("surf",)).columns == ["x", "y", "z", "surf"]
    plan = queries.mst_orientation(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "/normals-" in plan and "/room-" not in plan


def test_a_cap_marks_every_point_and_drops_none(spark, small):
    points = room(spark, small)
    first = [r[0] for r in points.where("z > 1").orderBy("point_idx").limit(1000).collect()]
    rows = queries.point_cap(spark, small)
    assert rows.count() == points.count()
    assert sorted(r[0] for r in rows.where("kept").select("point_idx").collect()) == first
    assert sorted(r[0] for r in sample.point_cap(points, 77).select("point_idx").collect()) == list(range(77))
    assert sample.point_cap(points, 77).columns == points.columns


def test_no_condition_of_the_room_holds_all_that_its_columns_are_made_of(spark, small, monkeypatch):
    """One too long for the compiler cost four fifths of a larger room's time."""
    made = []
    monkeypatch.setattr(tables, "written", lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or session.written(df, name))
    monkeypatch.setitem(spark.sparkContext.__dict__, "_pointloom_rooms", {})
    rows = room(spark, small)
    joins = [line for plan in made for line in plan.splitlines() if "Join" in line]
    assert joins and max(map(len, joins)) < 300
    assert rows.where("surf = 1 and x between 1 and 2 and z between 0.9 and 1.9").isEmpty() and not rows.where("surf = 2 and x between 1 and 2").isEmpty()


def test_a_points_plane_is_chosen_once_and_the_rest_looked_up(spark, small, monkeypatch):
    """A role chosen among all planes was too long for the compiler and took half of a segmentation's time."""
    made = {}

    def written(df, name):
        made[name] = df
        return session.written(df, name)

    monkeypatch.setattr(planes, "written", written)
    config = SegmentConfig(min_plane=queries.least_plane(room(spark, small).count()), min_groove=10)
    found = planes.extract_planes(room(spark, small).select("point_idx", *"xyz"), config)
    plan = made["planes"]._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.log) >= 5 and plan.count("abs(") <= 2 * len(found.log) + 4, plan
    # The same as each plane's own points, taken in turn.
    cloud, roles = made["cloud"], found.rows
    for k, x in enumerate(found.log):
        mine = roles.where(F.col("plane_no") == k)
        s = F.abs(F.lit(x["plane"][0]) * F.col("x") + F.lit(x["plane"][1]) * F.col("y") + F.lit(x["plane"][2]) * F.col("z") + F.lit(x["plane"][3]))
        assert mine.count() == x["inliers"]
        if x["kind"] == "wall":
            assert mine.where((s <= config.flat) != (F.col("role") == "wall")).isEmpty()
            assert mine.where("role = 'wall'").count() == x["flat"] and mine.where("role = 'groove'").count() == (x["groove"] if x["groove"] >= config.min_groove else 0)
            assert [r[0] for r in mine.select("wall_id").distinct().collect()] == [[p.unit for p in found.planes].index(x["plane"]) + 1]
        else:
            assert mine.where("wall_id is not null").isEmpty() and {r[0] for r in mine.select("role").distinct().collect()} <= {"floor", "residual", "dropped"}
    assert roles.count() == cloud.count() and roles.where("plane_no is null and (role <> 'residual' or wall_id is not null)").isEmpty()
