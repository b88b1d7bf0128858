"""Tiles that finish leave the state, and their voxels equal those of a batch."""

from pyspark.sql import functions as F

from pointloom.streaming import tiles


def test_finished_tiles_leave_the_state(spark, tmp_path):
    schema = "tile string, x double, y double, z double, last boolean"
    deliveries = [
        [("a", 0.1 * k, 0.0, 1.0, False) for k in range(30)] + [("b", 5.0, 0.1 * k, 0.0, False) for k in range(30)],
        [("a", 0.1 * k + 0.05, 0.0, 1.0, k == 19) for k in range(20)] + [("c", 1.0, 1.0, -0.1 * k, True) for k in range(10)],
        [("b", 5.0, 0.1 * k + 0.02, 0.3, False) for k in range(5)],
    ]
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tiles.finished_tiles(tiles.read_tiles(spark, str(tmp_path / "in"), schema), 0.5)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        # Open after each delivery: a and b, then b alone.
        assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == (2 if k == 0 else 1)
    points = spark.read.parquet(str(tmp_path / "in")).where("tile in ('a', 'c')")
    at = [F.floor(F.col(c) / 0.5).alias(f"v{c}") for c in "xyz"]
    want = points.groupBy("tile", *at).agg(*[F.round(F.avg(c), 9).alias(c) for c in "xyz"], F.count("*").alias("members"))
    got = spark.read.parquet(str(tmp_path / "out")).withColumns({c: F.round(c, 9) for c in "xyz"})
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
