"""Planes: bands, frames, refinement, seeded extraction and routing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import Plane, SegmentConfig
from ..session import progress, ship_package, written


def xyz() -> g.Vector:
    return g.vector("x", "y", "z")


def by_wall(planes: list[Plane], value) -> Column:
    """A number of the plane of the row's wall_id; there are at most a few dozen planes, so they are literals, not a join."""
    out = None
    for p in planes:
        out = F.when(F.col("wall_id") == p.wall_id, F.lit(float(value(p)))) if out is None else out.when(F.col("wall_id") == p.wall_id, F.lit(float(value(p))))
    return F.lit(None).cast("double") if out is None else out


def with_distance(points: DataFrame, planes: list[Plane]) -> DataFrame:
    return points.withColumn("s", g.signed_distance(xyz(), *[by_wall(planes, lambda p, k=k: p.unit[k]) for k in range(4)]))


def with_projection(points: DataFrame, planes: list[Plane]) -> DataFrame:
    """s, and px, py, pz on the plane."""
    out = with_distance(points, planes)
    n = tuple(by_wall(planes, lambda p, k=k: p.unit[k]) for k in range(3))
    return out.withColumns(dict(zip(("px", "py", "pz"), g.project(xyz(), n, F.col("s")), strict=True)))


def bands(s: Column, flat: float, far: float) -> Column:
    """``wall`` within the flat band, ``groove`` behind it, else ``far``."""
    return F.when(F.abs(s) <= flat, "wall").when(F.abs(s) <= far, "groove").otherwise("far")


def orientation(nz: Column, floor: float = 0.85, wall: float = 0.20) -> Column:
    return F.when(F.abs(nz) > floor, "floor").when(F.abs(nz) < wall, "wall").otherwise("oblique")


def wall_frames(points: DataFrame, planes: list[Plane], strict: bool = False) -> DataFrame:
    """wall_id, ox, oy, oz, ux..vz: the origin is the least corner of the projected points, put onto the plane unless ``strict``."""
    low = with_projection(points, planes).groupBy("wall_id").agg(*[F.min(f"p{c}").alias(f"m{c}") for c in "xyz"])
    off = g.signed_distance(g.vector("mx", "my", "mz"), *[by_wall(planes, lambda p, k=k: p.unit[k]) for k in range(4)])
    n = [by_wall(planes, lambda p, k=k: p.unit[k]) for k in range(3)]
    origin = {f"o{c}": F.col(f"m{c}") - (F.lit(0.0) if strict else off) * n[k] for k, c in enumerate("xyz")}
    basis = {p.wall_id: g.wall_basis(p.unit[:3]) for p in planes}
    axes = {f"{name}{c}": by_wall(planes, lambda p, j=j, k=k: basis[p.wall_id][j][k]) for j, name in enumerate("uv") for k, c in enumerate("xyz")}
    return low.withColumns(origin).withColumns(axes).drop("mx", "my", "mz")


def with_uv(points: DataFrame, planes: list[Plane], frames: DataFrame) -> DataFrame:
    """points plus s, px, py, pz, u, v and the frame; frames have one row for each of a few walls."""
    p = with_projection(points, planes).join(F.broadcast(frames), "wall_id")
    d = tuple(F.col(f"p{c}") - F.col(f"o{c}") for c in "xyz")
    return p.withColumns({"u": g.dot(d, g.vector("ux", "uy", "uz")), "v": g.dot(d, g.vector("vx", "vy", "vz"))})


def flat_or_all(points: DataFrame, flat: float, least: int = 100) -> DataFrame:
    """Rows (with s) of the flat band; all rows of walls with fewer than ``least`` such rows."""
    counts = points.groupBy("wall_id").agg(F.count_if(F.abs("s") <= flat).alias("n_flat"))
    return points.join(F.broadcast(counts), "wall_id").where((F.abs("s") <= flat) | (F.col("n_flat") < least)).drop("n_flat")


def covariance(points: DataFrame, keys: tuple[str, ...] = ("wall_id",)) -> DataFrame:
    """keys, n, means and population covariances."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def smallest_axis(row: dict) -> np.ndarray:
    m = np.array([[row["cxx"], row["cxy"], row["cxz"]], [row["cxy"], row["cyy"], row["cyz"]], [row["cxz"], row["cyz"], row["czz"]]])
    return np.linalg.eigh(m)[1][:, 0]


def refine(points: DataFrame, planes: list[Plane]) -> list[Plane]:
    """Least-squares planes of each wall's points, turned like the old normals; unchanged below 3 points. One aggregation for all walls."""
    fits = {r["wall_id"]: r.asDict() for r in covariance(points).collect()}
    return [_refined(p, fits.get(p.wall_id)) for p in planes]


def _refined(p: Plane, fit: dict | None) -> Plane:
    if not fit or fit["n"] < 3:
        return p
    n = smallest_axis(fit)
    if np.dot(n, p.unit[:3]) < 0:
        n = -n
    return Plane(p.wall_id, *map(float, n), -float(n @ [fit["mx"], fit["my"], fit["mz"]]))


#: Points that meet all candidates at once in a task.
SCORED = 1_000


def _scorer(unit: np.ndarray, distance: float):
    a, b, c, d = unit.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(unit), np.int64)
        for batch in batches:
            x, y, z = (batch.column(k).to_numpy()[:, None] for k in range(3))
            for at in range(0, batch.num_rows, SCORED):
                lot = slice(at, at + SCORED)
                counts += (np.abs(x[lot] * a + y[lot] * b + z[lot] * c + d) < distance).sum(axis=0)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    return run


def score(points: DataFrame, planes: list[Plane], distance: float) -> dict[int, int]:
    """Points strictly within the distance of each candidate, by id; candidates without any are left out. One pass; a task returns a number for each candidate."""
    ship_package(points.sparkSession)
    counted = points.select(*"xyz").mapInArrow(_scorer(np.array([p.unit for p in planes]), distance), "place long, n long")
    rows = counted.groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {planes[r["place"]].wall_id: r["n"] for r in rows}


def _moments(unit: np.ndarray, centre: np.ndarray, distance: float):
    a, b, c, d = unit.T
    i, j = np.triu_indices(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(unit), 10))
        for batch in batches:
            points = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            for at in range(0, len(points), SCORED):
                p = points[at : at + SCORED]
                near = np.abs(p[:, :1] * a + p[:, 1:2] * b + p[:, 2:] * c + d) < distance
                q = p[near.any(axis=1)] - centre
                sums += near[near.any(axis=1)].T @ np.column_stack([np.ones(len(q)), q, q[:, i] * q[:, j]])
        yield pa.record_batch([pa.array(np.arange(len(unit))), *map(pa.array, sums.T)], names=["place", *SUMS])

    return run


#: Count, sums and sums of products of a candidate's points, from the centre.
SUMS = ["n", "x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz"]


def fits(points: DataFrame, planes: list[Plane], distance: float, centre: np.ndarray) -> dict[int, dict]:
    """n, means and covariances of the points strictly within the distance of each plane, by id. One pass; a task returns ten numbers for each plane, summed from a ``centre`` among the points so that no digits are lost far from the origin."""
    ship_package(points.sparkSession)
    summed = points.select(*"xyz").mapInArrow(_moments(np.array([p.unit for p in planes]), centre, distance), ", ".join(["place long", *[f"{c} double" for c in SUMS]]))
    out = {}
    for r in summed.groupBy("place").agg(*[F.sum(c).alias(c) for c in SUMS]).collect():
        n, mean = max(r["n"], 1.0), {c: r[c] / max(r["n"], 1.0) for c in "xyz"}
        spread = {f"c{c}": r[c] / n - mean[c[0]] * mean[c[1]] for c in SUMS[4:]}
        out[planes[r["place"]].wall_id] = {"n": int(r["n"]), **{f"m{c}": mean[c] + centre[k] for k, c in enumerate("xyz")}, **spread}
    return out


def triples(sample: np.ndarray, n: int, scale: int, rng: np.random.Generator) -> np.ndarray:
    """Triples of points: any at scale 0, else of one cell each of a randomly placed grid whose cells are the sample's longest side over 2 ** scale."""
    if scale == 0:
        return sample[rng.integers(0, len(sample), (n, 3))]
    low = sample.min(axis=0)
    side = max(float((sample.max(axis=0) - low).max()), 1e-9) / 2**scale
    cell = np.floor((sample - low) / side + rng.random(3)).astype(np.int64)
    order = np.lexsort(cell.T)
    starts = np.concatenate([[0], np.flatnonzero((np.diff(cell[order], axis=0) != 0).any(axis=1)) + 1, [len(order)]])
    first = rng.integers(0, len(order), n)
    at = np.searchsorted(starts, first, "right") - 1
    others = starts[at, None] + np.floor(rng.random((n, 2)) * (starts[at + 1] - starts[at])[:, None]).astype(np.int64)
    return sample[order[np.column_stack([first, others])]]


def through(drawn: np.ndarray) -> np.ndarray:
    """Planes through triples: rows of unit normal and offset; near-collinear triples are left out."""
    normal = np.cross(drawn[:, 1] - drawn[:, 0], drawn[:, 2] - drawn[:, 0])
    size = np.linalg.norm(normal, axis=1)
    normal, at = normal[size > 1e-6] / size[size > 1e-6, None], drawn[size > 1e-6, 0]
    return np.column_stack([normal, -(normal * at).sum(axis=1)])


def best_candidates(sample: np.ndarray, n: int, distance: float, seed: int) -> list[Plane]:
    """The ``FINALISTS`` planes with the most sample points of up to ``n`` through seeded triples.

    Half of each lot's triples are drawn from the whole sample, which large planes need, and half from cells at
    ``SCALES`` sizes, which finds small planes in clutter: inside a cell that it crosses a small plane holds a large
    share. A lot is tried on the first ``TRIED`` points of the sample, its best fifth on all, and the finalists are
    fitted to their points there. Draws stop early when any plane with more points than the best so far would have
    been met by the whole-sample triples with a chance of 1 - ``MISSED``, however those points lie.
    """
    if len(sample) < 3:
        return []
    rng = np.random.default_rng(seed)
    best, counts, far = np.zeros((0, 4)), np.zeros(0, np.int64), 0
    for start in range(0, n, LOT):
        lot = min(LOT, n - start)
        sizes = [lot - lot // 2, *[lot // 2 // SCALES] * SCALES]
        tried = through(np.concatenate([triples(sample, size, scale, rng) for scale, size in enumerate(sizes)]))
        far += sizes[0]
        if len(sample) > TRIED:
            tried = tried[np.argsort(-sampled(sample[:TRIED], tried, distance), kind="stable")[: max(FINALISTS, len(tried) // 5)]]
        best, counts = np.concatenate([best, tried]), np.concatenate([counts, sampled(sample, tried, distance)])
        order = np.argsort(-counts, kind="stable")[:FINALISTS]
        best, counts = best[order], counts[order]
        if len(best) and (1 - (counts[0] / len(sample)) ** 3) ** far < MISSED:
            break
    return [Plane(k, *_fitted(sample, unit, int(count), distance)) for k, (unit, count) in enumerate(zip(best, counts, strict=True))]


def _fitted(sample: np.ndarray, unit: np.ndarray, count: int, distance: float) -> tuple[float, ...]:
    """The least-squares plane of a plane's sample points, again while it gains points."""
    for _ in range(FITS):
        near = sample[np.abs(sample @ unit[:3] + unit[3]) < distance]
        if len(near) < 3:
            break
        mean = near.mean(axis=0)
        normal = np.linalg.eigh((near - mean).T @ (near - mean))[1][:, 0]
        new = np.append(normal, -normal @ mean)
        gained = int(sampled(sample, new[None], distance)[0])
        if gained <= count:
            break
        unit, count = new, gained
    return tuple(map(float, unit))


@dataclass
class Extraction:
    """planes: accepted walls in order; other: floor candidates and oblique planes; rows: point_idx, x, y, z, plane_no, role, wall_id."""

    planes: list[Plane]
    floor: tuple[float, float, float, float] | None
    floor_z: float | None
    rows: DataFrame
    log: list[dict]


@dataclass
class Taken:
    """A plane that is taken off the cloud: which of the points left are near it, its refined plane, its kind, its groove points, its number as a wall."""

    inside: Column
    plane: Plane
    kind: str
    groove: int
    wall_id: int | None


#: Points of the sample that candidates are drawn from and tried on. The least plane is a share of the cloud (0.5 %), so a bound holds for clouds of any size: that plane has 100 points in it.
SAMPLE = 20_000
#: Candidates drawn at once, and the best of all that are counted on all points.
LOT, FINALISTS = 1_000, 32
#: Sizes of cells that local triples come from; sample points that all candidates are tried on; the chance of a missed larger plane at which draws stop; fits of a finalist.
SCALES, TRIED, MISSED, FITS = 5, 4_000, 1e-3, 3


def sampled(sample: np.ndarray, unit: np.ndarray, distance: float) -> np.ndarray:
    """Sample points strictly within the distance of each plane, a row of unit normal and offset."""
    return (np.abs(sample @ unit[:, :3].T + unit[:, 3]) < distance).sum(axis=0)


def _sample(points: DataFrame, n: int, seed: int) -> np.ndarray:
    """Places of the ``SAMPLE`` points of the least hashes (ties by place); rows with larger hashes stay in their tasks, whatever their number. Points without a finite place are left out, since no plane is near them."""
    bound = (SAMPLE + 6 * SAMPLE**0.5) / max(n, 1)
    while True:
        hashed = points.select(F.xxhash64("point_idx", F.lit(seed)).alias("h"), *"xyz")
        some = hashed.where(F.col("h") < int(min(bound, 1.0) * 2**64) - 2**63) if bound < 1 else hashed
        rows = some.toPandas().sort_values(["h", *"xyz"]).head(SAMPLE)
        if len(rows) >= SAMPLE or bound >= 1:
            places = rows[[*"xyz"]].to_numpy(np.float64)
            return places[np.isfinite(places).all(axis=1)]
        bound *= 2


def extract_planes(points: DataFrame, config: SegmentConfig) -> Extraction:
    """Peel planes off the cloud: seeded candidates from a sample of what is left, tried there, the best counted and fitted on all of it, inliers routed.

    A plane costs two passes over what is left: one counts and fits all finalists, one counts the winner's bands. The cloud is written once, and what is left of it again when that has halved, with a new sample; in between, what is left are the points near none of the planes taken so far, in the cloud as in the sample. Rows get their plane and role in one projection at the end.
    Roles: floor, oblique, dropped (flat points of a plane too small for a wall), wall, groove, residual.
    """
    cloud = written(points.select("point_idx", *"xyz"), "cloud")
    total = remaining = stored = cloud.count()
    taken: list[Taken] = []
    left = cloud
    walls: list[Plane] = []
    floors: list[tuple[float, int, Plane]] = []
    log: list[dict] = []
    sample = _sample(cloud, total, config.seed)
    for number in range(config.max_planes):
        if remaining < max(3, config.min_plane):
            break
        progress(cloud.sparkSession, f"plane {number}: {remaining} points left")
        best = best_candidates(sample, config.candidates, config.distance, config.seed + number)
        if not best:
            break
        found = fits(left, best, config.distance, sample.mean(axis=0))
        top = max(best, key=lambda p: (found[p.wall_id]["n"] if p.wall_id in found else 0, -p.wall_id))
        inliers = found[top.wall_id]["n"] if top.wall_id in found else 0
        if inliers < config.min_plane or inliers / total < config.min_share:
            break
        a, b, c, d = top.unit
        inside = F.abs(g.signed_distance(xyz(), a, b, c, d)) < config.distance
        plane = _refined(top, found[top.wall_id])
        band = bands(g.signed_distance(xyz(), *plane.unit), config.flat, config.distance)
        flat, groove, mean_z = left.where(inside).select(band.alias("band"), "z").agg(F.count_if(F.col("band") == "wall"), F.count_if(F.col("band") == "groove"), F.avg("z")).first()
        turn = abs(plane.unit[2])
        kind = "floor" if turn > config.floor_nz else "oblique" if turn >= config.wall_nz else "wall" if flat >= config.min_plane else "small"
        wall_id = len(walls) + 1 if kind == "wall" else None
        if kind == "wall":
            walls.append(Plane(wall_id, *plane.unit))
        if kind == "floor":
            floors.append((mean_z, number, plane))
        taken.append(Taken(inside, plane, kind, groove, wall_id))
        log.append({"plane_no": number, "kind": kind, "inliers": inliers, "flat": flat, "groove": groove, "mean_z": mean_z, "plane": plane.unit})
        left = left.where(~inside)
        remaining -= inliers
        sample = sample[np.abs(sample @ [a, b, c] + d) >= config.distance]
        if 2 * remaining < stored:
            # What is read next shrinks with what is left.
            left, stored = written(left, "left"), remaining
            sample = _sample(left, remaining, config.seed + number + 1)
    floor = min(floors, key=lambda f: (f[0], f[1])) if floors else None
    return Extraction(walls, floor[2].unit if floor else None, floor[0] if floor else None, written(_tagged(cloud, taken, config), "planes"), log)


def _tagged(cloud: DataFrame, taken: list[Taken], config: SegmentConfig) -> DataFrame:
    """point_idx, x, y, z, plane_no, role, wall_id: each point by the first plane that it is near. Only the plane's number is a choice among all planes; the rest is looked up by it, since a role chosen so would hold all planes' bands and be too long to be compiled."""
    number = F.lit(None).cast("int")
    for k in reversed(range(len(taken))):
        number = F.when(taken[k].inside, F.lit(k)).otherwise(number)
    points = cloud.select("point_idx", *"xyz", number.alias("plane_no"))
    if not taken:
        return points.withColumns({"role": F.lit("residual"), "wall_id": F.lit(None).cast("int")})
    of = lambda kind, values: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("plane_no") + 1)
    points = points.withColumn("s", g.signed_distance(xyz(), *[of("double", [t.plane.unit[j] for t in taken]) for j in range(4)]))
    band = bands(F.col("s"), config.flat, config.distance)
    role = route(of("string", [t.kind for t in taken]), band, of("long", [t.groove for t in taken]), config.min_groove)
    return points.select("point_idx", *"xyz", "plane_no", F.when(F.col("plane_no").isNull(), "residual").otherwise(role).alias("role"), of("int", [t.wall_id for t in taken]).alias("wall_id"))


def route(kind: Column, band: Column, grooves: Column, min_groove: int) -> Column:
    """Role of an inlier from its plane's kind and its band."""
    groove = F.when(grooves >= min_groove, "groove").otherwise("residual")
    wall = F.when(band == "wall", "wall").when(band == "groove", groove).otherwise("residual")
    small = F.when(band == "wall", "dropped").otherwise("residual")
    return F.when(kind == "floor", "floor").when(kind == "oblique", "residual").when(kind == "small", small).otherwise(wall)


def recess_sign(points: DataFrame) -> DataFrame:
    """wall_id, recess: the side on which the median of s lies; 0 counts as +1. Counts tell it, and the two values next to 0 where they are even."""
    m = points.groupBy("wall_id").agg(F.count("s").alias("n"), F.count_if(F.col("s") < 0).alias("under"), F.max(F.when(F.col("s") < 0, F.col("s"))).alias("a"), F.min(F.when(F.col("s") >= 0, F.col("s"))).alias("b"))
    negative = (2 * F.col("under") > F.col("n")) | ((2 * F.col("under") == F.col("n")) & (F.col("a") + F.col("b") < 0))
    return m.select("wall_id", F.when(negative, -1).otherwise(1).alias("recess"))
