"""Tiles of points that arrive as files: running voxel means and class counts, and the voxels of finished tiles (beyond the batch engine's needs)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.grid import cell
from ..session import ship_package


def read_tiles(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_voxels(points: DataFrame, voxel: float) -> DataFrame:
    """Voxel means on a fixed grid; write with output mode update or complete. State is one row for each occupied voxel."""
    return points.groupBy(*[cell(c, voxel).alias(f"v{c}") for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("members"))


def running_classes(points: DataFrame) -> DataFrame:
    return points.groupBy("classification").agg(F.count("*").alias("points"))


VOXELS = "tile string, vx long, vy long, vz long, x double, y double, z double, members long"
_STATE = "vx array<long>, vy array<long>, vz array<long>, x array<double>, y array<double>, z array<double>, n array<long>"


def _summed(voxels: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, place = np.unique(voxels, axis=0, return_inverse=True)
    out = np.zeros((len(known), 4))
    np.add.at(out, place.ravel(), sums)
    return known, out


def _tile(voxel: float, idle: int | None):
    """Adds a tile's rows to the sums of its voxels; gives the means and forgets the tile when its last rows have come, or when none came for ``idle`` milliseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        voxels, sums = np.zeros((0, 3), np.int64), np.zeros((0, 4))
        if state.exists:
            *at, x, y, z, n = (np.array(c) for c in state.get)
            voxels, sums = np.stack(at, 1), np.stack([x, y, z, n.astype(float)], 1)
        last = state.hasTimedOut
        for frame in frames:
            place = frame[["x", "y", "z"]].to_numpy(float)
            new = np.floor(place / voxel).astype(np.int64)
            voxels, sums = _summed(np.r_[voxels, new], np.r_[sums, np.c_[place, np.ones(len(place))]])
            last = last or bool(frame["last"].any())
        if not last:
            state.update((*(voxels[:, k].tolist() for k in range(3)), *(sums[:, k].tolist() for k in range(3)), sums[:, 3].astype(int).tolist()))
            if idle:
                state.setTimeoutDuration(idle)
            return
        if state.exists:
            state.remove()
        mean = sums[:, :3] / sums[:, 3:]
        yield pd.DataFrame({"tile": key[0], **{f"v{c}": voxels[:, k] for k, c in enumerate("xyz")}, **{c: mean[:, k] for k, c in enumerate("xyz")}, "members": sums[:, 3].astype(np.int64)})

    return run


def finished_tiles(points: DataFrame, voxel: float, idle: int | None = None) -> DataFrame:
    """Voxel means of each tile, once, when it is finished; write with output mode append.

    Points have a tile (string) and ``last``, true for a row of the tile's last delivery. State is a row for each tile that is still open;
    a tile that gets rows later begins anew.
    """
    ship_package(points.sparkSession)
    return points.groupBy("tile").applyInPandasWithState(_tile(voxel, idle), VOXELS, _STATE, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")
