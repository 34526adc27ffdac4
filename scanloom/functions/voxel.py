"""Voxel keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
KEYS = ("vx", "vy", "vz")
_BIAS = 1 << 20


def voxel_key(c: Column, size: float) -> Column:
    """Truncate c/size toward zero after subtracting one when it is negative.

    This is floor except on exact negative multiples, which land one cell lower.
    """
    scaled = c.cast("double") / size
    return F.when(scaled < 0, scaled - 1.0).otherwise(scaled).cast("bigint")


def voxel_keys(size: float, axes: Sequence[str] = AXES, names: Sequence[str] = KEYS) -> dict[str, Column]:
    return {n: voxel_key(F.col(a), size) for n, a in zip(names, axes)}


def floor_keys(
    size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), axes: Sequence[str] = AXES,
    names: Sequence[str] = KEYS,
) -> dict[str, Column]:
    """Grid cell with an origin: floor((c - origin) / size)."""
    return {
        n: F.floor((F.col(a).cast("double") - o) / size).cast("bigint")
        for n, a, o in zip(names, axes, origin)
    }


def grid_index(keys: Sequence[Column], edge_xy: int, edge_z: int) -> Column:
    return keys[0] * (edge_xy * edge_z) + keys[1] * edge_z + keys[2]


def grid_decode(
    index: Column, size: float, edge_xy: int, edge_z: int, origin: Sequence[float] = (0.0, 0.0, 0.0)
) -> list[Column]:
    """Lower corner of a linear grid cell."""
    plane = edge_xy * edge_z
    ix = F.floor(index / plane)
    rest = index - ix * plane
    iy = F.floor(rest / edge_z)
    iz = rest - iy * edge_z
    return [o + i * size for o, i in zip(origin, (ix, iy, iz))]


def pack(keys: Sequence[Column]) -> Column:
    """Three voxel coordinates as one order-preserving BIGINT; outside ±2^20 it is an error.

    Projected coordinates with a small voxel size can be that far out: shift the origin first.
    """
    inside = [k.between(-_BIAS, _BIAS - 1) for k in keys]
    x, y, z = [(k + _BIAS).cast("bigint") for k in keys]
    packed = F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)
    far = F.raise_error(F.lit("voxel coordinate outside 2^20; shift the origin or enlarge the voxels")).cast("bigint")
    return F.when(inside[0] & inside[1] & inside[2], packed).when(keys[0].isNotNull() & keys[1].isNotNull() & keys[2].isNotNull(), far)
