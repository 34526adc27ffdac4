"""Small dense algebra on aggregated rows: stacked numpy calls per Arrow batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _eigen(cov: pd.Series) -> pd.Series:
    """Ascending eigenvalues, then the eigenvectors of the smallest and of the largest."""
    c = np.stack([np.asarray(v, dtype=float) for v in cov])
    values, vectors = np.linalg.eigh(c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    out = [values]
    for k in (0, 2):
        v = vectors[:, :, k]
        lead = np.where(v[:, 2] != 0, v[:, 2], np.where(v[:, 1] != 0, v[:, 1], v[:, 0]))
        out.append(v * np.where(lead < 0, -1.0, 1.0)[:, None])
    return pd.Series(list(np.concatenate(out, axis=1)))


def with_eigen(
    df: DataFrame, prefix: str = "", values: Sequence[str] = ("l1", "l2", "l3"),
    normal: Sequence[str] | None = ("nx", "ny", "nz"), longest: Sequence[str] | None = None,
) -> DataFrame:
    """Add ascending eigenvalues of the covariance columns and, if asked, eigenvectors.

    One stacked decomposition per Arrow batch of aggregated rows. ``normal`` belongs to the
    smallest eigenvalue and ``longest`` to the largest; the sign of an eigenvector is free
    and we return the one with z > 0 (then y, then x).
    """
    keep = df.columns
    df = df.withColumn("_eig", _eigen(F.array(*[F.col(prefix + n).cast("double") for n in COV])))
    names = [*values, *(normal or ("_u", "_u", "_u")), *(longest or ("_u", "_u", "_u"))]
    return df.select(*keep, *[F.col("_eig")[i].alias(n) for i, n in enumerate(names) if n != "_u"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve3(system: pd.Series) -> pd.Series:
    """Cramer's rule on stacked symmetric systems (xx, xy, xz, yy, yz, zz, b0, b1, b2)."""
    xx, xy, xz, yy, yz, zz, b0, b1, b2 = np.stack([np.asarray(v, dtype=float) for v in system]).T
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    with np.errstate(divide="ignore", invalid="ignore"):
        a0 = (b0 * (yy * zz - yz * yz) - xy * (b1 * zz - yz * b2) + xz * (b1 * yz - yy * b2)) / det
        a1 = (xx * (b1 * zz - yz * b2) - b0 * (xy * zz - yz * xz) + xz * (xy * b2 - b1 * xz)) / det
        a2 = (xx * (yy * b2 - b1 * yz) - xy * (xy * b2 - b1 * xz) + b0 * (xy * yz - yy * xz)) / det
    solved = np.stack([a0, a1, a2], axis=1)
    return pd.Series([v if ok else None for v, ok in zip(solved, np.abs(det) > 1e-12)])


def with_solution(df: DataFrame, matrix: Sequence[str], right: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Solve a symmetric 3x3 system per aggregated row; singular rows are dropped."""
    df = df.withColumn("_sol", _solve3(F.array(*[F.col(c).cast("double") for c in (*matrix, *right)])))
    df = df.filter(F.col("_sol").isNotNull())
    return df.withColumns({n: F.col("_sol")[i] for i, n in enumerate(out)}).drop("_sol")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(h: pd.Series, g: pd.Series) -> pd.Series:
    """Solve H x = -g for stacked symmetric systems given as flat arrays."""
    out = []
    for hv, gv in zip(h, g):
        g0 = np.asarray(gv, dtype=float)
        h0 = np.asarray(hv, dtype=float).reshape(len(g0), len(g0))
        out.append(np.linalg.lstsq(h0, -g0, rcond=None)[0])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rigid_fit(src: pd.Series, dst: pd.Series) -> pd.Series:
    """Rotation (9) and translation (3) that best map paired points src to dst.

    Each value is a flat array of xyz triples; the rotations of a whole Arrow batch
    are computed with one stacked SVD per array length.
    """
    a = [np.asarray(v, dtype=float).reshape(-1, 3) for v in src]
    b = [np.asarray(v, dtype=float).reshape(-1, 3) for v in dst]
    out: list[np.ndarray] = [np.empty(0)] * len(a)
    sizes = np.array([len(v) for v in a])
    for n in np.unique(sizes):
        idx = np.flatnonzero(sizes == n)
        pa, pb = np.stack([a[i] for i in idx]), np.stack([b[i] for i in idx])
        ca, cb = pa.mean(axis=1, keepdims=True), pb.mean(axis=1, keepdims=True)
        u, _, vt = np.linalg.svd(np.swapaxes(pa - ca, 1, 2) @ (pb - cb))
        v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
        flip = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
        v[:, :, 2] *= flip[:, None]
        rot = v @ ut
        t = cb[:, 0] - np.einsum("nij,nj->ni", rot, ca[:, 0])
        for k, i in enumerate(idx):
            out[i] = np.concatenate([rot[k].ravel(), t[k]])
    return pd.Series(out)
