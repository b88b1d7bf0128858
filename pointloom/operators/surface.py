"""Triangles of a function given at grid nodes, marched over the six tetrahedra of each cube.

Only the marching of single cubes is imperative; finding the cubes is relational and grows with those that the surface crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
#: Six tetrahedra around the diagonal of a cube; corner k is at bits (x, y, z) of k.
TETRAHEDRA = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]
TRIANGLES = "mesh_id string, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz") + ", density double, grey double"


def cubes(corner: DataFrame) -> DataFrame:
    """i, j, k, f (of 8 corners), density, grey, for cubes with all corners and a change of sign."""
    offset = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(k & 1).alias("x"), F.lit(k >> 1 & 1).alias("y"), F.lit(k >> 2).alias("z")) for k in range(8)])).alias("o")
    each = corner.select("i", "j", "k", "f", "density", "grey", offset)
    each = each.select((F.col("i") - F.col("o.x")).alias("i"), (F.col("j") - F.col("o.y")).alias("j"), (F.col("k") - F.col("o.z")).alias("k"), F.struct(F.col("o.n"), F.col("f")).alias("c"), "density", "grey")
    whole = each.groupBy("i", "j", "k").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.min("c.f").alias("low"), F.max("c.f").alias("high"), F.avg("density").alias("density"), F.avg("grey").alias("grey"))
    return whole.where("size(cs) = 8 and low < 0 and high >= 0").select("i", "j", "k", F.transform("cs", lambda c: c["f"]).alias("f"), "density", "grey")


def _march(voxel: float, mesh_id: str, origin: tuple[float, float, float]):
    places = np.array([[k & 1, k >> 1 & 1, k >> 2] for k in range(8)], float)

    def cut(p, f, a, b):
        # From the lesser corner on, so that all cubes around an edge find the same place on it.
        a, b = min(a, b), max(a, b)
        t = f[:, a] / (f[:, a] - f[:, b])
        return p[:, a] + t[:, None] * (p[:, b] - p[:, a])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            base = frame[["i", "j", "k"]].to_numpy(float)
            values, density = np.stack(frame["f"].to_numpy()), frame[["density", "grey"]].to_numpy(float)
            out, weight = [], []
            for tet in TETRAHEDRA:
                p, f = (base[:, None, :] + places[list(tet)][None]) * voxel + np.array(origin), values[:, list(tet)]
                code = ((f < 0) * np.array([1, 2, 4, 8])).sum(axis=1)
                for c in range(1, 15):
                    rows = np.flatnonzero(code == c)
                    if not len(rows):
                        continue
                    q, g = p[rows], f[rows]
                    inside = [k for k in range(4) if c >> k & 1]
                    outer = [k for k in range(4) if not c >> k & 1]
                    if len(inside) == 2:
                        w = [cut(q, g, inside[0], outer[0]), cut(q, g, inside[0], outer[1]), cut(q, g, inside[1], outer[1]), cut(q, g, inside[1], outer[0])]
                        faces = [(w[0], w[1], w[2]), (w[0], w[2], w[3])]
                    else:
                        one, rest = (inside[0], outer) if len(inside) == 1 else (outer[0], inside)
                        faces = [tuple(cut(q, g, one, r) for r in rest)]
                    towards = q[:, outer].mean(axis=1) - q[:, inside].mean(axis=1)
                    for a, b, d in faces:
                        over = (np.cross(b - a, d - a) * towards).sum(axis=1) < 0
                        b, d = np.where(over[:, None], d, b), np.where(over[:, None], b, d)
                        out.append(np.concatenate([a, b, d], axis=1))
                        weight.append(density[rows])
            if out:
                t = np.round(np.concatenate(out), 9)
                named = pd.DataFrame(t, columns=[f"{p}{c}" for p in "abc" for c in "xyz"])
                named.insert(0, "mesh_id", mesh_id)
                named[["density", "grey"]] = np.concatenate(weight)
                named["grey"] = named["grey"].astype(object).where(named["grey"].notna(), None)
                yield named

    return run


def marched(cube: DataFrame, voxel: float, mesh_id: str = "surface", origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Triangles of cubes, their lesser corners at origin + voxel * (i, j, k)."""
    ship_package(cube.sparkSession)
    return cube.mapInPandas(_march(voxel, mesh_id, origin), TRIANGLES)
