"""Column expressions for cameras and 4x4 rigid transforms (arrays of 16 doubles, row by row)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class Camera:
    """Pinhole camera: focal lengths, principal point and five distortion values (k1, k2, p1, p2, k3)."""

    fx: float
    fy: float
    cx: float
    cy: float
    dist: tuple[float, float, float, float, float] = (0.0,) * 5

    def shifted(self, x: float, y: float) -> Camera:
        return replace(self, cx=self.cx - x, cy=self.cy - y)


def identity() -> Column:
    return F.array(*[F.lit(x) for x in IDENTITY])


def translation(axis: int, distance: Column) -> Column:
    """The transform that moves by ``distance`` along an axis (0 x, 1 y, 2 z)."""
    cells = [F.lit(x) for x in IDENTITY]
    cells[4 * axis + 3] = distance.cast("double")
    return F.array(*cells)


def rotation_z(degrees: Column, tx: Column | float = 0.0) -> Column:
    """Rotation about z, then a move by tx along x."""
    c, s, zero, one = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(0.0), F.lit(1.0)
    tx = tx if isinstance(tx, Column) else F.lit(float(tx))
    return F.array(c, -s, zero, tx, s, c, zero, zero, zero, zero, one, zero, zero, zero, zero, one)


def rotation_deg(t: Column) -> Column:
    """Angle of the rotation part in degrees; 0 for null."""
    cos = (t[0] + t[5] + t[10] - 1.0) / 2.0
    return F.coalesce(F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))), F.lit(0.0))


def translation_m(t: Column) -> Column:
    """Length of the translation part; 0 for null."""
    return F.coalesce(F.sqrt(t[3] * t[3] + t[7] * t[7] + t[11] * t[11]), F.lit(0.0))


def product(a: Column, b: Column) -> Column:
    """a times b."""
    cell = lambda i, j: a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j]
    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def inverse(t: Column) -> Column:
    """Inverse of a rigid transform: the rotation transposed and the move turned back."""
    r = [[t[4 * j + i] for j in range(3)] for i in range(3)]
    rows = []
    for i in range(3):
        rows += [*r[i], -(r[i][0] * t[3] + r[i][1] * t[7] + r[i][2] * t[11])]
    return F.array(*rows, *[F.lit(x) for x in IDENTITY[12:]])


def moved(t: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point after the transform."""
    return tuple(t[4 * i] * x + t[4 * i + 1] * y + t[4 * i + 2] * z + t[4 * i + 3] for i in range(3))
