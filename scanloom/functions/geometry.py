"""Rigid-body, rotation and projection helpers as Column expressions.

Everything here stays inside whole-stage code generation: no UDF. A rotation is
a list of nine Columns in row-major order, a vector a list of three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cols = Sequence[Column]
ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]
TRANS = ["tx", "ty", "tz"]
QUAT = ["qx", "qy", "qz", "qw"]


def cols(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def dot(a: Cols, b: Cols) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Cols, b: Cols) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def norm(a: Cols) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Cols, b: Cols) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def add(a: Cols, b: Cols) -> list[Column]:
    return [p + q for p, q in zip(a, b)]


def mat_vec(m: Cols, v: Cols) -> list[Column]:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def transpose(m: Cols) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def mat_mul(a: Cols, b: Cols) -> list[Column]:
    bt = transpose(b)
    return [dot(a[3 * i : 3 * i + 3], bt[3 * j : 3 * j + 3]) for i in range(3) for j in range(3)]


def rotation_from_quat(q: Cols) -> list[Column]:
    x, y, z, w = q
    one = F.lit(1.0)
    return [
        one - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), one - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), one - 2 * (x * x + y * y),
    ]


def quat_from_rotation(m: Cols) -> list[Column]:
    """Unit quaternion (x, y, z, w) with the largest component computed first."""
    trace = m[0] + m[4] + m[8]
    s0 = 2 * F.sqrt(F.greatest(1 + trace, F.lit(1e-300)))
    s1 = 2 * F.sqrt(F.greatest(1 + m[0] - m[4] - m[8], F.lit(1e-300)))
    s2 = 2 * F.sqrt(F.greatest(1 + m[4] - m[0] - m[8], F.lit(1e-300)))
    s3 = 2 * F.sqrt(F.greatest(1 + m[8] - m[0] - m[4], F.lit(1e-300)))
    by_w = [(m[7] - m[5]) / s0, (m[2] - m[6]) / s0, (m[3] - m[1]) / s0, s0 / 4]
    by_x = [s1 / 4, (m[1] + m[3]) / s1, (m[2] + m[6]) / s1, (m[7] - m[5]) / s1]
    by_y = [(m[1] + m[3]) / s2, s2 / 4, (m[5] + m[7]) / s2, (m[2] - m[6]) / s2]
    by_z = [(m[2] + m[6]) / s3, (m[5] + m[7]) / s3, s3 / 4, (m[3] - m[1]) / s3]
    return [
        F.when(trace > 0, by_w[i])
        .when((m[0] >= m[4]) & (m[0] >= m[8]), by_x[i])
        .when(m[4] >= m[8], by_y[i])
        .otherwise(by_z[i])
        for i in range(4)
    ]


def with_rotation(df: DataFrame, quat: Sequence[str] = QUAT, out: Sequence[str] = ROT) -> DataFrame:
    return df.withColumns(dict(zip(out, rotation_from_quat(cols(quat)))))


def rigid(m: Cols, t: Cols, p: Cols) -> list[Column]:
    """R p + t."""
    return add(mat_vec(m, p), t)


def rigid_inverse(m: Cols, t: Cols, p: Cols) -> list[Column]:
    """R' (p - t)."""
    return mat_vec(transpose(m), sub(p, t))


def compose(ma: Cols, ta: Cols, mb: Cols, tb: Cols) -> tuple[list[Column], list[Column]]:
    """Pose a followed on the right by pose b: (Ra Rb, Ra tb + ta)."""
    return mat_mul(ma, mb), rigid(ma, ta, tb)


def invert(m: Cols, t: Cols) -> tuple[list[Column], list[Column]]:
    mt = transpose(m)
    return mt, [-c for c in mat_vec(mt, t)]


def between(ma: Cols, ta: Cols, mb: Cols, tb: Cols) -> tuple[list[Column], list[Column]]:
    """Relative pose a⁻¹ b."""
    return mat_mul(transpose(ma), mb), rigid_inverse(ma, ta, tb)


def euler_from_rotation(m: Cols) -> list[Column]:
    """Roll, pitch, yaw; yaw is zero at the singularity."""
    sy = F.sqrt(m[0] * m[0] + m[3] * m[3])
    singular = sy < 1e-6
    return [
        F.when(singular, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8])),
        F.atan2(-m[6], sy),
        F.when(singular, F.lit(0.0)).otherwise(F.atan2(m[3], m[0])),
    ]


def rotation_from_euler(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        cp * cy, sr * sp * cy - cr * sy, cr * sp * cy + sr * sy,
        cp * sy, sr * sp * sy + cr * cy, cr * sp * sy - sr * cy,
        -sp, sr * cp, cr * cp,
    ]


def skew(v: Cols) -> list[Column]:
    zero = F.lit(0.0)
    return [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]


def so3_exp(v: Cols) -> list[Column]:
    """Rotation vector to matrix; identity below 1e-7 rad."""
    angle = norm(v)
    small = angle <= 1e-7
    safe = F.when(small, F.lit(1.0)).otherwise(angle)
    k = skew([c / safe for c in v])
    kk = mat_mul(k, k)
    eye = [1.0 if i % 4 == 0 else 0.0 for i in range(9)]
    return [
        F.when(small, F.lit(eye[i])).otherwise(eye[i] + F.sin(angle) * k[i] + (1 - F.cos(angle)) * kk[i])
        for i in range(9)
    ]


def so3_log(m: Cols) -> list[Column]:
    trace = m[0] + m[4] + m[8]
    theta = F.when(trace > 3.0 - 1e-6, F.lit(0.0)).otherwise(
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (trace - 1))))
    )
    k = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
    small = F.abs(theta) < 0.001
    scale = F.when(small, F.lit(0.5)).otherwise(
        0.5 * theta / F.sin(F.when(small, F.lit(1.0)).otherwise(theta))
    )
    return [scale * c for c in k]


def quat_angle(a: Cols, b: Cols) -> Column:
    """Angle between two rotations given as unit quaternions."""
    d = F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])
    return 2 * F.acos(F.least(F.lit(1.0), d))


def point_covariance(p: Cols, range_noise: float, degree_noise: float) -> list[Column]:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of a point's noise covariance.

    Range noise acts along the ray, bearing noise on the plane across it. The two
    bearing directions carry equal variance, so their sum does not depend on the
    basis chosen: A A' = range² (I - d d').
    """
    rng = norm(p)
    d = [c / rng for c in p]
    r2 = range_noise * range_noise
    s2 = F.pow(F.sin(F.radians(F.lit(degree_noise))), 2)
    out = []
    for i in range(3):
        for j in range(i, 3):
            eye = 1.0 if i == j else 0.0
            out.append(d[i] * d[j] * r2 + s2 * rng * rng * (eye - d[i] * d[j]))
    return out


def spherical(p: Cols, hor_res: float, ver_res: float, rows: int = 2095, half_turn: float = 3.141593) -> dict[str, Column]:
    """Azimuth, elevation, depth, pixel and linear pixel position of a point."""
    azimuth = F.atan2(p[1], p[0])
    elevation = F.atan2(p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]))
    hor = F.floor((azimuth + half_turn) / hor_res)
    ver = F.floor((elevation + 0.5 * half_turn) / ver_res)
    return {
        "azimuth": azimuth,
        "elevation": elevation,
        "depth": norm(p),
        "hor": hor,
        "ver": ver,
        "position": hor * rows + ver,
    }


def match_confidence(distance: Column, p: Cols) -> Column:
    """1 - 0.9 |distance| / sqrt(range)."""
    return 1 - 0.9 * F.abs(distance) / F.sqrt(norm(p))


def calibrate_elevation(p: Cols, degrees: float = 0.15) -> list[Column]:
    """Raise every point by a fixed angle, measured as atan2(z, full range)."""
    rng = norm(p)
    azimuth = F.atan2(p[1], p[0])
    lifted = F.atan2(p[2], rng) + F.radians(F.lit(degrees))
    flat = rng * F.cos(lifted)
    return [flat * F.cos(azimuth), flat * F.sin(azimuth), rng * F.tan(lifted)]
