"""Normals from neighbourhoods: estimation, acceptance, fallbacks and orientation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from . import forest, knn, planes

#: Side of the blocks by which edges come together, in the points' unit.
NEAR = 1.0
NORMALS = "point_idx long, nx double, ny double, nz double"


def _axes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        m = np.empty((len(f), 3, 3))
        for i, a in enumerate("xyz"):
            for j, b in enumerate("xyz"):
                m[:, i, j] = f["c" + "".join(sorted(a + b))]
        bad = ~np.isfinite(m).all(axis=(1, 2)) | (f["n"].to_numpy() < 3)
        m[bad] = np.eye(3)
        n = np.linalg.eigh(m)[1][:, :, 0]
        n[bad] = np.nan
        # The largest component is positive, so the sign does not depend on the solver.
        top = np.take_along_axis(n, np.abs(np.nan_to_num(n)).argmax(axis=1)[:, None], axis=1)
        n = n * np.where(top < 0, -1.0, 1.0)
        yield pd.DataFrame({"point_idx": f["q"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})


def from_neighbours(neighbours: DataFrame) -> DataFrame:
    """point_idx, nx, ny, nz: the axis of least variance of each point's neighbours; NaN below three of them."""
    ship_package(neighbours.sparkSession)
    return planes.covariance(neighbours, ("q",)).mapInPandas(_axes, NORMALS)


def finite_fraction(normals: DataFrame) -> DataFrame:
    ok = None
    for c in ("nx", "ny", "nz"):
        one = ~F.isnan(c) & (F.abs(c) < float("inf"))
        ok = one if ok is None else ok & one
    return normals.agg(F.avg(F.coalesce(ok, F.lit(False)).cast("int")).alias("finite"))


def estimate(points: DataFrame, voxel: float, least: float = 0.9, one_search: bool = False) -> DataFrame:
    """The first of three searches whose normals are finite for 90 % of the points: 30 within max(4 voxels, 0.05), 50 within max(8 voxels, 0.15), the 30 nearest. An error below 100 points or if none will do. ``one_search``: only 30 within 4 voxels, whatever comes of it."""
    if points.limit(100).count() < 100:
        raise ValueError("normals need at least 100 points")
    if one_search:
        return points.join(written(from_neighbours(knn.hybrid_neighbours(points, 4 * voxel, 30)), "normals"), "point_idx")
    near, far = max(4 * voxel, 0.05), max(8 * voxel, 0.15)
    for search in (lambda: knn.hybrid_neighbours(points, near, 30), lambda: knn.hybrid_neighbours(points, far, 50), lambda: knn.knn(points, 30)):
        normals = written(from_neighbours(search()), "normals")
        if (finite_fraction(normals).first()[0] or 0.0) >= least:
            return points.join(normals, "point_idx")
    raise RuntimeError("no search gave finite normals")


def viewpoint_flip(points: DataFrame, view: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Normals turned towards the viewpoint."""
    towards = sum((F.col(f"n{c}") * (F.lit(v) - F.col(c)) for c, v in zip("xyz", view, strict=True)), F.lit(0.0))
    return points.withColumns({f"n{c}": F.when(towards < 0, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"})


def mst_orientation(points: DataFrame, k: int = 15, cell: float | None = None) -> DataFrame:
    """Normals made consistent along the minimum spanning forest (of 1 - |dot|) of the k nearest neighbours, so that each connected part has one orientation and its highest point (of equal ones that of the smallest id) looks up. Points without an edge look towards the origin."""
    n = [F.col(f"n{c}") for c in "xyz"]
    a, b = (points.select(F.col("point_idx").alias(e), *[x.alias(f"{e}{c}") for x, c in zip(n, "xyz", strict=True)]) for e in "ab")
    pairs = knn.knn(points, k, cell).where("q <> p").groupBy(F.least("q", "p").alias("a"), F.greatest("q", "p").alias("b")).agg(F.first(F.struct(*"xyz")).alias("at"))
    dot = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in "xyz"), F.lit(0.0))
    block = [F.floor(F.col(f"at.{c}") / F.lit(NEAR)).alias(f"c{c}") for c in "xyz"]
    edges = pairs.join(a, "a").join(b, "b").select("a", "b", (1 - F.abs(dot)).alias("w"), F.when(dot < 0, -1).otherwise(1).alias("s"), *block)
    signed = points.join(forest.signs(edges, ["cx", "cy", "cz"]), F.col("point_idx") == F.col("node"))
    top = signed.groupBy("root").agg(F.max(F.struct("z", -F.col("point_idx"), (F.col("nz") * F.col("sign")).alias("up")))["up"].alias("up"))
    turned = signed.join(top.select("root", F.when(F.col("up") < 0, -1).otherwise(1).alias("turn")), "root")
    turn = F.col("sign") * F.col("turn")
    own = viewpoint_flip(points).withColumnsRenamed({f"n{c}": f"o{c}" for c in "xyz"})
    met = own.join(turned.select("point_idx", *[(x * turn).alias(f"n{c}") for x, c in zip(n, "xyz", strict=True)]), "point_idx", "left")
    return met.withColumns({f"n{c}": F.coalesce(f"n{c}", f"o{c}") for c in "xyz"}).drop("ox", "oy", "oz")
