"""Signs of the spanning forest against a tree found edge by edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import forest, knn, normals, voids


def brute(a, b, w, s):
    """Each node's component (its smallest node) and its sign against that, along the tree of sorted edges."""
    parent, tree = {}, {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for e in np.lexsort((b, a, w)):
        ra, rb = root(a[e]), root(b[e])
        if ra != rb:
            parent[ra] = rb
            tree.setdefault(a[e], []).append((b[e], s[e]))
            tree.setdefault(b[e], []).append((a[e], s[e]))
    out = {}
    for start in sorted(tree):
        if start not in out:
            out[start], stack = (start, 1), [start]
            while stack:
                k = stack.pop()
                for j, t in tree[k]:
                    if j not in out:
                        out[j] = (start, out[k][1] * t)
                        stack.append(j)
    return out


def same(got, want):
    """Equal components, and equal signs but for one turn of each component."""
    assert {r["node"] for r in got} == set(want)
    roots, turns = {}, {}
    for r in got:
        start, sign = want[r["node"]]
        assert roots.setdefault(r["root"], start) == start and roots[r["root"]] == start
        assert turns.setdefault(start, r["sign"] * sign) == r["sign"] * sign
    assert len(set(roots.values())) == len(roots)


@pytest.mark.parametrize("small", [0, 400, 10**9])
def test_signs_equal_those_of_a_tree_edge_by_edge(spark, small, monkeypatch):
    rng = np.random.default_rng(small % 97)
    n, m = 700, 2_500
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    a, b = np.minimum(a, b), np.maximum(a, b)
    keep = (a != b) & (a // 350 == b // 350)  # two parts at least
    pairs = sorted({(int(x), int(y)) for x, y in zip(a[keep], b[keep], strict=True)})
    a, b = np.array(pairs).T
    w, s = np.round(rng.random(len(a)), 1), rng.choice([-1, 1], len(a))
    rows = spark.createDataFrame([(int(x), int(y), float(z), int(t), int(x) % 13) for x, y, z, t in zip(a, b, w, s, strict=True)], "a long, b long, w double, s int, near int")
    same(forest.signs(rows, ["near"], small=small).collect(), brute(a, b, w, s))


def test_a_path_of_ever_smaller_weights_is_one_component(spark):
    n = 300
    rows = [(k, k + 1, 1.0 / (k + 1), -1, 0) for k in range(n)]
    got = forest.signs(spark.createDataFrame(rows, "a long, b long, w double, s int, near int"), ["near"], small=0).collect()
    assert len({r["root"] for r in got}) == 1 and len(got) == n + 1
    sign = {r["node"]: r["sign"] for r in got}
    assert all(sign[k] == -sign[k + 1] for k in range(n))


def test_no_edges(spark):
    assert forest.signs(spark.createDataFrame([], "a long, b long, w double, s int, near int"), ["near"]).collect() == []


def test_orientation_equals_a_tree_of_5000_points(spark):
    rng = np.random.default_rng(4)
    place = rng.random((5_000, 3)) * (6, 6, 0.2) + (0, 0, 1)
    place[:, 2] += 0.5 * np.sin(place[:, 0]) * np.cos(place[:, 1])
    normal = np.stack([-0.5 * np.cos(place[:, 0]) * np.cos(place[:, 1]), 0.5 * np.sin(place[:, 0]) * np.sin(place[:, 1]), np.ones(5_000)], 1) + rng.normal(0, 0.3, (5_000, 3))
    normal = normal / np.linalg.norm(normal, axis=1)[:, None] * rng.choice([-1, 1], 5_000)[:, None]
    points = spark.createDataFrame([(k, *map(float, p), *map(float, n)) for k, (p, n) in enumerate(zip(place, normal, strict=True))], "point_idx long, x double, y double, z double, nx double, ny double, nz double")
    edges = sorted({(min(r.q, r.p), max(r.q, r.p)) for r in knn.knn(points, 15).where("q <> p").collect()})
    a, b = np.array(edges).T
    dot = (normal[a] * normal[b]).sum(1)
    want = brute(a, b, 1 - np.abs(dot), np.where(dot < 0, -1, 1))
    turn = {}
    for k in sorted(want, key=lambda k: (-place[k, 2], k)):
        start, sign = want[k]
        turn.setdefault(start, -1 if normal[k, 2] * sign < 0 else 1)
    got = {r.point_idx: np.array([r.nx, r.ny, r.nz]) for r in normals.mst_orientation(points).collect()}
    assert len(got) == 5_000
    wrong = [k for k, (start, sign) in want.items() if not np.allclose(got[k], normal[k] * sign * turn[start])]
    assert not wrong


@pytest.mark.parametrize("seed", range(3))
def test_flood_by_runs_equals_flood_by_cells(spark, seed):
    rng = np.random.default_rng(seed)
    full = {(w, int(u), int(v)) for w in (1, 2) for u, v in zip(rng.integers(-20, 20, 900), rng.integers(-9, 9, 900), strict=True)}
    cells = spark.createDataFrame(sorted(full), "wall_id int, iu long, iv long")
    want = {True: set(), False: set()}
    for w in (1, 2):
        own = {(u, v) for x, u, v in full if x == w}
        us, vs = [u for u, _ in own], [v for _, v in own]
        empty = {(u, v) for u in range(min(us), max(us) + 1) for v in range(min(vs), max(vs) + 1)} - own
        out = {c for c in empty if c[0] in (min(us), max(us)) or c[1] in (min(vs), max(vs))}
        todo = list(out)
        while todo:
            u, v = todo.pop()
            for c in ((u + 1, v), (u - 1, v), (u, v + 1), (u, v - 1)):
                if c in empty and c not in out:
                    out.add(c)
                    todo.append(c)
        want[True] |= {(w, *c) for c in out}
        want[False] |= {(w, *c) for c in empty - out}
    assert {(r.wall_id, r.iu, r.iv) for r in voids.exterior(cells).collect()} == want[True]
    assert {(r.wall_id, r.iu, r.iv) for r in voids.interior_voids(cells).collect()} == want[False]


def test_a_wall_of_two_kilometres_with_a_thousand_windows(spark):
    """40,000 by 60 cells, all occupied but for the windows and a crack that reaches one of them."""
    wall = spark.range(40_000 * 60).select((F.col("id") % 40_000).alias("iu"), F.floor(F.col("id") / 40_000).alias("iv"))
    window = (F.col("iu") % 40).between(10, 20) & F.col("iv").between(20, 40) | (F.col("iu") == 15) & (F.col("iv") < 20)
    found = voids.interior_voids(wall.where(~window).select(F.lit(1).alias("wall_id"), "iu", "iv"))
    assert found.count() == 999 * 11 * 21
