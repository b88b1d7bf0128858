"""Settings and plane models."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Plane:
    """ax + by + cz + d = 0 of a wall."""

    wall_id: int
    a: float
    b: float
    c: float
    d: float

    @property
    def unit(self) -> tuple[float, float, float, float]:
        n = (self.a**2 + self.b**2 + self.c**2) ** 0.5
        return self.a / n, self.b / n, self.c / n, self.d / n


@dataclass(frozen=True)
class ProfileConfig:
    chunk: int = 2_000_000
    target: int = 500_000


@dataclass(frozen=True)
class MeshConfig:
    name: str
    voxel: float
    depth: int
    trim_percent: float = 5
    outlier_ratio: float = 2.0
    crop_radius: float | None = None
    max_points: int | None = None
    skip_outliers: bool = False
    recentre: bool = True
    one_search: bool = False  # normals by the first search alone, within 4 voxels


SMOKE = MeshConfig("smoke", 0.03, 8, max_points=100_000, skip_outliers=True)
DETAIL = MeshConfig("detail", 0.015, 10)
FIRST = MeshConfig("first", 0.015, 10, recentre=False, one_search=True)
PRESETS = {c.name: c for c in (SMOKE, DETAIL, FIRST)}


@dataclass(frozen=True)
class SegmentConfig:
    voxel: float = 0.015
    distance: float = 0.015
    flat: float = 0.006
    opening_flat: float = 0.012
    min_plane: int = 8000
    min_share: float = 0.005
    max_planes: int = 40
    candidates: int = 5000
    floor_nz: float = 0.85
    wall_nz: float = 0.20
    min_groove: int = 80
    wall_cell: float = 0.05
    opening_cell: float = 0.05
    groove_cell: float = 0.010
    groove_cell_depth: float = 0.008
    opening_min: int = 3
    wall_min: int = 2
    groove_min: int = 4
    seed: int = 7
    flip_grooves: bool = False
    strict_origin: bool = False
