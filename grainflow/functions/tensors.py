"""Orientation and tensor algebra as column expressions, all inside code generation.

A 3 x 3 matrix is a nested list of columns. Euler angles are in Bunge's convention: a rotation about z by
phi1, about the new x by phi, about the new z by phi2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]
#: Voigt numbers of the index pairs: 11, 22, 33, 23, 13, 12.
VOIGT = ((0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1))


def contract(i: Column, j: Column) -> Column:
    """Voigt number (from 1) of a pair of indices (from 1)."""
    return F.when(i == j, i).otherwise(9 - i - j)


def rotation(phi1: Column, phi: Column, phi2: Column, frame_deg: float = 0.0) -> Matrix:
    """From crystal to sample axes; a rotation of the frame about z adds to phi1."""
    a = phi1 + F.lit(math.radians(frame_deg)) if frame_deg else phi1
    c1, s1, c, s, c2, s2 = F.cos(a), F.sin(a), F.cos(phi), F.sin(phi), F.cos(phi2), F.sin(phi2)
    return [
        [c1 * c2 - s1 * c * s2, -(c1 * s2) - s1 * c * c2, s1 * s],
        [s1 * c2 + c1 * c * s2, c1 * c * c2 - s1 * s2, -(c1 * s)],
        [s * s2, s * c2, c],
    ]


def add(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def congruence(a: Matrix, k: Matrix) -> Matrix:
    """a k a^T."""
    ak = [[add([a[i][m] * k[m][j] for m in range(3)]) for j in range(3)] for i in range(3)]
    return [[add([ak[i][m] * a[j][m] for m in range(3)]) for j in range(3)] for i in range(3)]


def determinant(m: Matrix) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m: Matrix) -> Matrix:
    """By cofactors."""
    d = determinant(m)
    r = ((1, 2), (0, 2), (0, 1))
    minor = lambda i, j: m[r[i][0]][r[j][0]] * m[r[i][1]][r[j][1]] - m[r[i][0]][r[j][1]] * m[r[i][1]][r[j][0]]
    return [[(minor(j, i) if (i + j) % 2 == 0 else -minor(j, i)) / d for j in range(3)] for i in range(3)]


def of_array(name: str) -> Matrix:
    """The matrix in an array column of nine numbers, row by row."""
    return [[F.col(name)[3 * i + j] for j in range(3)] for i in range(3)]


def named(m: Matrix, prefix: str) -> list[Column]:
    """Columns prefix11 ... prefix33."""
    return [m[i][j].alias(f"{prefix}{i + 1}{j + 1}") for i in range(3) for j in range(3)]


def magnitude(*parts: Column) -> Column:
    return F.sqrt(add([p * p for p in parts]))


def decimal_order(value: Column) -> Column:
    """The power of ten of a number: floor(log10 |v|); null for 0."""
    return F.when(value != 0, F.floor(F.log10(F.abs(value)))).cast("int")


def in_plane_anisotropy(k11: Column, k12: Column, k22: Column) -> dict[str, Column]:
    """Principal values and directions (degrees from axis 1, in [0, 180)) of a plane tensor, their ratio and its norm."""
    mean, half = (k11 + k22) / 2, (k11 - k22) / 2
    radius = F.sqrt(half * half + k12 * k12)
    turn = F.degrees(F.atan2(k12, half)) / 2
    low = lambda t: F.when(t < 0, t + 180).when(t >= 180, t - 180).otherwise(t)
    return {"k_max": mean + radius, "k_min": mean - radius, "theta_max": low(turn), "theta_min": low(turn + 90), "ratio": (mean + radius) / (mean - radius), "norm": F.sqrt(k11 * k11 + 2 * k12 * k12 + k22 * k22)}


def expansion_along(alpha: list[Column], angle: Column) -> Column:
    """Thermal expansion along the direction at `angle` in the plane of axes 1 and 2 (shear is engineering shear)."""
    c, s = F.cos(angle), F.sin(angle)
    return alpha[0] * c * c + alpha[1] * s * s + alpha[5] * c * s


def young_along(compliance: list[Column], n: list[Column]) -> Column:
    """Young's modulus along a unit vector: one over the compliance contracted with it four times."""
    v = [n[i] * n[j] for i, j in VOIGT]
    return 1 / add([v[i] * compliance[6 * i + j] * v[j] for i in range(6) for j in range(6)])


def lambert(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Equal-area projection of the unit sphere from its pole z = 1, which itself goes to (0, 0)."""
    f = F.when(z >= 1, 0.0).otherwise(F.sqrt(2 / (1 - z)))
    return x * f, y * f


def inverse_lambert(px: Column, py: Column) -> tuple[Column, Column, Column]:
    r = px * px + py * py
    f = F.sqrt(F.greatest(1 - r / 4, F.lit(0.0)))
    return f * px, f * py, r / 2 - 1


def symmetric_eigenvalues(a: Column, b: Column, c: Column, bc: Column, ac: Column, ab: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues, largest first, of a symmetric matrix with diagonal a, b, c, in closed trigonometric form."""
    mean = (a + b + c) / 3
    off = ab * ab + ac * ac + bc * bc
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * off) / 6)
    unit = lambda x: x / spread
    m = [[unit(a - mean), unit(ab), unit(ac)], [unit(ab), unit(b - mean), unit(bc)], [unit(ac), unit(bc), unit(c - mean)]]
    half = F.least(F.greatest(determinant(m) / 2, F.lit(-1.0)), F.lit(1.0))
    turn = F.acos(half) / 3
    first, last = mean + 2 * spread * F.cos(turn), mean + 2 * spread * F.cos(turn + 2 * math.pi / 3)
    flat = spread < 1e-300
    return F.when(flat, mean).otherwise(first), F.when(flat, mean).otherwise(3 * mean - first - last), F.when(flat, mean).otherwise(last)
