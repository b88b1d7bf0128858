"""Vectors as triples of columns, and planes ax + by + cz + d = 0 as four numbers or columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Number = float | Column


def vector(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return a[0] / n, a[1] / n, a[2] / n


def signed_distance(p: Vector, a: Number, b: Number, c: Number, d: Number) -> Column:
    """Distance along the unit normal; d is scaled with the normal, so any multiple of a plane gives the same."""
    a, b, c, d = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b, c, d))
    n = F.sqrt(a * a + b * b + c * c)
    return (p[0] * a + p[1] * b + p[2] * c + d) / n


def project(p: Vector, normal: Vector, distance: Column) -> Vector:
    return p[0] - distance * normal[0], p[1] - distance * normal[1], p[2] - distance * normal[2]


def plane_basis(n: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Any two unit vectors across the normal: the first is n x Z, or n x X for level planes."""
    reference = (1.0, 0.0, 0.0) if abs(n[2]) >= 0.9 else (0.0, 0.0, 1.0)
    u = _unit(_cross(n, reference))
    return u, _cross(n, u)


def wall_basis(n: tuple[float, float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """u along the wall and v up the wall, u x v = n; for level planes any basis."""
    up = (-n[2] * n[0], -n[2] * n[1], 1.0 - n[2] * n[2])
    if sum(x * x for x in up) ** 0.5 < 1e-6:
        return plane_basis(n)
    v = _unit(up)
    return _unit(_cross(v, n)), v


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1] + 0.0, a[2] * b[0] - a[0] * b[2] + 0.0, a[0] * b[1] - a[1] * b[0] + 0.0


def _unit(a):
    n = sum(x * x for x in a) ** 0.5
    return tuple(x / n for x in a)


def floor_z(x: Column, y: Column, plane: tuple[float, float, float, float] | None) -> Column:
    """Height of the floor plane at (x, y); null if there is none or it is upright."""
    if plane is None or abs(plane[2]) < 1e-9:
        return F.lit(None).cast("double")
    a, b, c, d = plane
    return -(F.lit(a) * x + F.lit(b) * y + F.lit(d)) / F.lit(c)
