"""Screened Poisson surfaces against shapes with a formula."""

from collections import Counter

import numpy as np
import pytest

from pointloom.operators import poisson


def frame(spark, places, normals, grey=None):
    rows = [(k, *map(float, p), *map(float, n), None if grey is None else float(grey)) for k, (p, n) in enumerate(zip(places, normals, strict=True))]
    return spark.createDataFrame(rows, "point_idx long, x double, y double, z double, nx double, ny double, nz double, grey double")


def sphere(n=6_000, hole=1.0):
    k = np.arange(n)
    z = 1 - (2 * k + 1) / n
    r, t = np.sqrt(1 - z * z), k * 2.399963229728653
    out = np.stack([r * np.cos(t), r * np.sin(t), z], 1)[z < hole]
    return out * 2 + (10, -20, 5), out


def torus(n=20_000):
    k = np.arange(n)
    u, v = k * 2.399963229728653, 2 * np.pi * k / n
    keep = np.random.default_rng(1).random(n) < (3 + np.cos(v)) / 4
    u, v = u[keep], v[keep]
    normal = np.stack([np.cos(v) * np.cos(u), np.cos(v) * np.sin(u), np.sin(v)], 1)
    return np.stack([(3 + np.cos(v)) * np.cos(u), (3 + np.cos(v)) * np.sin(u), np.sin(v)], 1), normal


def corners(triangles):
    return [np.array([[r[f"{p}{c}"] for c in "xyz"] for r in triangles]) for p in "abc"]


def open_edges(a, b, c):
    ways = Counter()
    for x, y, z in zip(*(map(tuple, v) for v in (a, b, c)), strict=True):
        if len({x, y, z}) == 3:
            for e in ((x, y), (y, z), (z, x)):
                ways[e] += 1
    return sum(ways[e] != ways[e[1], e[0]] for e in ways)


def area(a, b, c):
    return np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2


@pytest.fixture(scope="module")
def spheres(spark):
    place, normal = sphere(hole=0.9)
    return {d: corners(poisson.reconstruct(frame(spark, place, normal), d).collect()) for d in (5, 6)}


def test_a_sphere_with_a_hole_is_closed_and_has_its_area(spheres):
    for d in (5, 6):
        assert open_edges(*spheres[d]) == 0
        assert abs(area(*spheres[d]) / (16 * np.pi) - 1) < 0.005


def test_the_error_falls_with_depth(spheres):
    error = {}
    for d, (a, b, c) in spheres.items():
        v = np.concatenate([a, b, c]) - (10, -20, 5)
        v = v[v[:, 2] < 1.6]
        error[d] = np.sqrt(np.mean((np.linalg.norm(v, axis=1) - 2) ** 2))
    assert error[6] < 0.6 * error[5] and error[5] < 0.05 * 1.1 * 4 / 32


def test_a_torus_keeps_its_hole(spark):
    a, b, c = corners(poisson.reconstruct(frame(spark, *torus()), 6).collect())
    assert open_edges(a, b, c) == 0
    assert abs(area(a, b, c) / (12 * np.pi**2) - 1) < 0.01
    v = np.unique(np.concatenate([a, b, c]), axis=0)
    off = np.hypot(np.hypot(v[:, 0], v[:, 1]) - 3, v[:, 2]) - 1
    assert np.sqrt(np.mean(off**2)) < 0.1 * 1.1 * 8 / 64
    faces = {tuple(sorted(map(tuple, t))) for t in zip(a, b, c, strict=True) if len({*map(tuple, t)}) == 3}
    edges = {e for t in faces for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))}
    assert len({p for t in faces for p in t}) - len(edges) + len(faces) == 0


def test_turned_normals_turn_the_triangles(spark):
    place, normal = sphere(2_000)
    for sign in (1, -1):
        a, b, c = corners(poisson.reconstruct(frame(spark, place, sign * normal), 5).collect())
        assert (sign * (np.cross(b - a, c - a) * ((a + b + c) / 3 - (10, -20, 5))).sum(1) > -1e-12).all()


def test_greys_and_densities_follow_the_points(spark):
    rows = poisson.reconstruct(frame(spark, *sphere(3_000, 0.8), grey=0.25), 5).collect()
    assert {round(r["grey"], 9) for r in rows} == {0.25}
    top = [r["density"] for r in rows if abs(r["ax"] - 10) < 0.3 and abs(r["ay"] + 20) < 0.3 and r["az"] > 6]
    low = [r["density"] for r in rows if max(r["az"], r["bz"], r["cz"]) < 6]
    assert max(top) < 0.05 * np.median(low)


def test_points_without_a_normal_are_left_out(spark):
    place, normal = sphere(2_000)
    odd = np.array([[np.nan, 0, 0], [0, np.inf, 0]])
    with_them = frame(spark, np.r_[place, [[10, -20, 5], [10, -20, 6]]], np.r_[normal, odd])
    assert len(poisson.reconstruct(with_them, 5).collect()) == len(poisson.reconstruct(frame(spark, place, normal), 5).collect()) > 1_000


def test_no_points_one_point_and_points_at_one_place(spark):
    one = frame(spark, [(1, 2, 3)], [(0, 0, 1)])
    assert poisson.reconstruct(one.limit(0), 5).collect() == []
    for df in (one, one.unionByName(one)):
        assert all(np.isfinite([r["ax"], r["by"], r["cz"]]).all() for r in poisson.reconstruct(df, 5).collect())


def test_depth_stops_where_points_do_not_fill_the_cells():
    assert poisson.depth_of(3.0, 10, 0.05) == 6 and poisson.depth_of(28.0, 10, 0.015) == 10 and poisson.depth_of(28.0, 8, 0.015) == 8 and poisson.depth_of(0.0, 10, 0.1) == 5
