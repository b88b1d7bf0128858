"""Screened Poisson surfaces on an octree of bricks.

The surface is where a function of the whole space, whose gradient is to be the field of the points' outward normals and whose value at
the points is to be 0 (Kazhdan and Hoppe 2013), takes its mean over the points. The function is given by
values at grid nodes. One brick of 32 cells an axis covers the cloud at depth 5; a brick is divided into eight at the next
depth if it holds points or if the function passes its level there, so the tree is deep along the surface, also where it
bridges a hole, and nowhere else.

A depth is one pass. Each brick has a margin of 8 cells, whose outer nodes keep the value of the depth above;
inside, the linear system (differences of neighbouring nodes against the field on the edges between them, and the values at
the points) is solved by conjugate gradients. What lies far away has come down with those values, and what is near
lies within the margin. A brick needs its parent's values, cut out for it, and points thinned to eight a cell, so
what a task holds depends on the brick's size alone. At the last depth bricks meet node by node: where margins overlap,
the values are averaged, with weights that fall to zero within 4 cells, so each node has one value and the surface no seams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from . import sample, surface

#: Cells of a brick, of its margin, and of the part of the margin in which bricks blend; the depth of the first brick.
BRICK, MARGIN, BLEND, FIRST = 32, 8, 4, 5
NODES = BRICK + 2 * MARGIN + 1
#: Of the cube over the cloud's longest side; weight of the values at points; share of a plane's count that smoothed splats find at it.
SCALE, SCREEN, AT_PLANE = 1.1, 4.0, 0.423
KEYS = ["bi", "bj", "bk"]
#: For the solver: where the residual has fallen to this share, or after so many steps.
EXACT, STEPS = 1e-3, 200

CHILDREN = "bi long, bj long, bk long, sampled boolean, low double, high double, weight double, total double, coarse binary"
CORNERS = "i long, j long, k long, f double, w double, density double, grey double, lit double"


def _weights(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat node numbers and trilinear weights (8 columns each) of places in node units; places outside the brick count at its edge."""
    base = np.clip(np.floor(u).astype(np.int64), 0, NODES - 2)
    t = np.clip(u - base, 0.0, 1.0)
    at, weight = [], []
    for c in range(8):
        bits = [c & 1, c >> 1 & 1, c >> 2]
        at.append(((base[:, 0] + bits[0]) * NODES + base[:, 1] + bits[1]) * NODES + base[:, 2] + bits[2])
        weight.append(np.prod([t[:, a] if bits[a] else 1 - t[:, a] for a in range(3)], axis=0))
    return np.stack(at, 1), np.stack(weight, 1)


def _splat(at: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(at.ravel(), (weight * values[:, None]).ravel(), NODES**3).reshape(NODES, NODES, NODES)


def _smoothed(a: np.ndarray) -> np.ndarray:
    for axis in range(3):
        out = 0.5 * a
        o, b = np.moveaxis(out, axis, 0), np.moveaxis(a, axis, 0)
        o[1:] += 0.25 * b[:-1]
        o[:-1] += 0.25 * b[1:]
        a = out
    return a


def _upsampled(coarse: np.ndarray) -> np.ndarray:
    for axis in range(3):
        c = np.moveaxis(coarse, axis, 0)
        fine = np.empty((2 * len(c) - 1, *c.shape[1:]))
        fine[::2], fine[1::2] = c, 0.5 * (c[:-1] + c[1:])
        coarse = np.moveaxis(fine, 0, axis)
    return coarse


def solve(u: np.ndarray, normals: np.ndarray, counts: np.ndarray, coarse: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Node values of a brick with its margin, and the points' shares of surface, in cells; ``u`` in node units. Outer nodes keep the values of the depth above; the first brick has none and is free there."""
    at, weight = _weights(u)
    around = _smoothed(_splat(at, weight, counts)).ravel()
    area = counts * AT_PLANE / np.maximum((around[at] * weight).sum(1), 1e-12)
    right = np.zeros((NODES, NODES, NODES))
    for axis in range(3):
        shift = np.zeros(3)
        shift[axis] = 0.5
        # Smoothed twice: a step of some cells is one that values at nodes can tell the place of.
        field = np.moveaxis(_smoothed(_smoothed(_splat(*_weights(u - shift), area * normals[:, axis]))), axis, 0)
        b = np.moveaxis(right, axis, 0)
        b[1:] += field[:-1]
        b[:-1] -= field[:-1]

    def applied(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for axis in range(3):
            d = np.diff(x, axis=axis)
            o = np.moveaxis(out, axis, 0)
            d = np.moveaxis(d, axis, 0)
            o[1:] += d
            o[:-1] -= d
        held = SCREEN * area * (x.ravel()[at] * weight).sum(1)
        return out + _splat(at, weight, held)

    free = np.ones((NODES, NODES, NODES), bool)
    x = np.zeros((NODES, NODES, NODES))
    if coarse is not None:
        x = _upsampled(coarse)
        free[:] = False
        free[1:-1, 1:-1, 1:-1] = True
    r = np.where(free, right - applied(x), 0.0)
    p, rr = r.copy(), float((r * r).sum())
    least = EXACT**2 * max(float((right * right).sum()), 1e-30)
    for _ in range(STEPS):
        if rr <= least:
            break
        ap = np.where(free, applied(p), 0.0)
        step = rr / float((p * ap).sum())
        x, r = x + step * p, r - step * ap
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return x, area


def _samples(points: DataFrame, depth: int) -> DataFrame:
    """Points thinned to the cells of depth + 1: mean place and normal, count, grey; places in units of the whole cube."""
    cell = 2.0 ** (depth + 1)
    of = [F.floor(F.col(c) * cell) for c in "xyz"]
    mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")]
    return points.groupBy(*[c.alias(f"c{k}") for k, c in enumerate(of)]).agg(*mean, F.sum("n").alias("n"), F.sum(F.col("lit") * F.col("grey")).alias("grey"), F.sum("lit").alias("lit")).select(*"xyz", "nx", "ny", "nz", "n", "lit", F.try_divide("grey", "lit").alias("grey"))


def _dealt(samples: DataFrame, depth: int) -> DataFrame:
    """Samples with each brick that they lie in or in the margin of; places in cells of the depth."""
    bricks = 2**depth // BRICK
    out = samples.withColumns({c: F.col(c) * float(2**depth) for c in "xyz"})
    for key, c in zip(KEYS, "xyz", strict=True):
        low, high = F.floor((F.col(c) - MARGIN) / BRICK), F.floor((F.col(c) + MARGIN) / BRICK)
        out = out.withColumn(key, F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(bricks - 1)))))
    return out


def _of_brick(key: tuple, table: pa.Table) -> tuple[np.ndarray, ...]:
    """Places in node units, normals and counts of a brick's samples, and which lie in the brick itself."""
    place = np.stack([table[c].to_numpy() for c in "xyz"], 1) if table.num_rows else np.zeros((0, 3))
    normal = np.stack([table[f"n{c}"].to_numpy() for c in "xyz"], 1) if table.num_rows else np.zeros((0, 3))
    counts = table["n"].to_numpy().astype(float) if table.num_rows else np.zeros(0)
    u = place - (np.array(key) * BRICK - MARGIN)
    own = ((u >= MARGIN) & (u < MARGIN + BRICK)).all(1)
    return u, normal, counts, own


def _coarse(table: pa.Table) -> np.ndarray | None:
    raw = table["coarse"][0].as_py()
    side = NODES // 2 + 1
    return np.frombuffer(raw, np.float32).reshape(side, side, side).astype(float) if raw else None


def _descended(key: tuple, samples: pa.Table, above: pa.Table) -> pa.Table:
    """A solved brick's values, cut out for each of its eight children."""
    schema = pa.schema([(k, pa.int64()) for k in KEYS] + [("sampled", pa.bool_()), ("low", pa.float64()), ("high", pa.float64()), ("weight", pa.float64()), ("total", pa.float64()), ("coarse", pa.binary())])
    if not above.num_rows:
        return schema.empty_table()
    brick = tuple(k.as_py() for k in key)
    u, normal, counts, own = _of_brick(brick, samples)
    x, area = solve(u, normal, counts, _coarse(above))
    at, weight = _weights(u[own])
    level, side, rows = (x.ravel()[at] * weight).sum(1), NODES // 2 + 1, []
    for c in range(8):
        bits = np.array([c & 1, c >> 1 & 1, c >> 2])
        first = bits * (BRICK // 2) + MARGIN // 2
        cut = x[tuple(slice(a, a + side) for a in first)]
        inner = cut[tuple(slice(MARGIN // 2, MARGIN // 2 + BRICK // 2 + 1) for _ in range(3))]
        mine = ((u[own] >= MARGIN + bits * (BRICK // 2)) & (u[own] < MARGIN + (bits + 1) * (BRICK // 2))).all(1)
        share = (float(area[own].sum()), float((area[own] * level).sum())) if c == 0 else (0.0, 0.0)
        rows.append((*(2 * np.array(brick) + bits).tolist(), bool(mine.any()), float(inner.min()), float(inner.max()), *share, cut.astype(np.float32).tobytes()))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _finished(iso: float | None):
    """A brick of the last depth to its nodes near the surface, in grid numbers; ``iso`` None: the mean over its own points."""

    def run(key: tuple, samples: pa.Table, above: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in "ijk"] + [(c, pa.float64()) for c in ("f", "w", "density", "grey", "lit")])
        if not above.num_rows:
            return schema.empty_table()
        brick = tuple(k.as_py() for k in key)
        u, normal, counts, own = _of_brick(brick, samples)
        x, area = solve(u, normal, counts, _coarse(above))
        at, weight = _weights(u)
        level = iso
        if level is None:
            level = float((area * (x.ravel()[at] * weight).sum(1)).sum() / max(area.sum(), 1e-12))
        f = x - level
        inside = f < 0
        one = sum(inside[a : a + NODES - 1, b : b + NODES - 1, c : c + NODES - 1].astype(np.int8) for a in (0, 1) for b in (0, 1) for c in (0, 1))
        crossed = np.zeros((NODES + 1,) * 3, bool)
        crossed[1:-1, 1:-1, 1:-1] = (one > 0) & (one < 8)
        # Nodes of crossed cells and of their neighbours: an average may move the crossing by a cell.
        near = crossed
        for axis in range(3):
            near = near | np.roll(near, 1, axis) | np.roll(near, -1, axis)
        for axis in range(3):
            n = np.moveaxis(near, axis, 0)
            near = np.moveaxis(n[1:] | n[:-1], 0, axis)
        t = np.arange(NODES) - MARGIN
        fall = np.clip(1 - np.maximum(np.maximum(-t, t - BRICK), 0) / BLEND, 0, 1)
        w = fall[:, None, None] * fall[None, :, None] * fall[None, None, :]
        i, j, k = np.nonzero(near & (w > 0))
        density = _smoothed(_splat(at, weight, counts))
        lit = samples["lit"].to_numpy().astype(float) if samples.num_rows else np.zeros(0)
        grey = np.nan_to_num(samples["grey"].to_numpy(zero_copy_only=False).astype(float)) if samples.num_rows else np.zeros(0)
        glow, lights = _smoothed(_splat(at, weight, lit * grey)), _smoothed(_splat(at, weight, lit))
        columns = [i + brick[0] * BRICK - MARGIN, j + brick[1] * BRICK - MARGIN, k + brick[2] * BRICK - MARGIN, *(a[i, j, k] for a in (f, w, density, glow, lights))]
        return pa.table([pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], schema=schema)

    return run


def nodes(points: DataFrame, depth: int) -> tuple[DataFrame, tuple[float, float, float], float]:
    """i, j, k, f, density, grey of the grid nodes along the surface, the grid's origin and its cell; points have oriented normals (nx, ny, nz), which point to where f is above 0. Points without a finite place and normal are left out."""
    ship_package(points.sparkSession)
    for c in ("x", "y", "z", "nx", "ny", "nz"):
        points = points.where(F.abs(c) < float("inf"))
    depth = max(depth, FIRST)
    b = sample.bounds(points)
    side = SCALE * max((b[f"max_{c}"] - b[f"min_{c}"] for c in "xyz" if b[f"min_{c}"] is not None), default=0.0) or 1.0
    origin = tuple(((b[f"max_{c}"] or 0.0) + (b[f"min_{c}"] or 0.0) - side) / 2 for c in "xyz")
    grey = F.col("grey").cast("double") if "grey" in points.columns else F.lit(None).cast("double")
    unit = points.select(*[((F.col(c) - o) / side).alias(c) for c, o in zip("xyz", origin, strict=True)], "nx", "ny", "nz", F.lit(1.0).alias("n"), grey.isNotNull().cast("double").alias("lit"), F.coalesce(grey, F.lit(0.0)).alias("grey"))
    levels = {depth: written(_samples(unit, depth), "samples")}
    for d in range(depth - 1, FIRST - 1, -1):
        levels[d] = _samples(levels[d + 1].withColumn("grey", F.coalesce("grey", F.lit(0.0))), d)
    bricks = points.sparkSession.createDataFrame([(0, 0, 0, True, 0.0, 0.0, 0.0, 0.0, None)], CHILDREN)
    iso = None
    for d in range(FIRST, depth):
        dealt = _dealt(levels[d], d)
        bricks = written(dealt.groupBy(KEYS).cogroup(bricks.groupBy(KEYS)).applyInArrow(_descended, CHILDREN), "bricks")
        weight, total = bricks.agg(F.sum("weight"), F.sum("total")).first()
        iso = total / weight if weight else 0.0
        bricks = bricks.where(F.col("sampled") | ((F.col("low") < iso) & (F.col("high") > iso)))
    solved = _dealt(levels[depth], depth).groupBy(KEYS).cogroup(bricks.groupBy(KEYS)).applyInArrow(_finished(iso), CORNERS)
    for c in "ijk":
        solved = solved.where(F.col(c).between(0, 2**depth))
    met = solved.groupBy(*"ijk").agg(F.sum(F.col("f") * F.col("w")).alias("f"), F.sum("w").alias("w"), F.sum(F.col("density") * F.col("w")).alias("density"), F.sum(F.col("grey") * F.col("w")).alias("grey"), F.sum(F.col("lit") * F.col("w")).alias("lit"))
    # Where no point is near, the surface has the mean grey.
    mean = levels[depth].agg(F.try_divide(F.sum(F.col("grey") * F.col("lit")), F.sum("lit"))).first()[0]
    out = met.select(*"ijk", (F.col("f") / F.col("w")).alias("f"), (F.col("density") / F.col("w")).alias("density"), F.coalesce(F.try_divide("grey", "lit"), F.lit(mean).cast("double")).alias("grey"))
    return out, origin, side / 2**depth


def depth_of(extent: float, most: int, finest: float) -> int:
    """The greatest depth up to ``most`` whose cell is not below ``finest``: an octree does not divide where points do not fill its cells."""
    depth = FIRST
    while depth < most and SCALE * extent / 2 ** (depth + 1) >= finest:
        depth += 1
    return depth


def reconstruct(points: DataFrame, depth: int, mesh_id: str = "surface") -> DataFrame:
    """Triangles with a density, and a grey where the points have one."""
    at, origin, cell = nodes(points, depth)
    return surface.marched(surface.cubes(written(at, "nodes")), cell, mesh_id, origin)
