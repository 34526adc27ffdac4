"""Per-session object tracker: a few boxes per scan, constant-velocity filter, one-to-one matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.params import TrackParams

# Filter covariances. State: position, velocity, angles, angular rates, size.
STATE_VAR = np.repeat([0.04, 8.0, 0.04, 8.0, 0.01], 3)
NOISE_VAR = np.array([0.01, 0.01, 0.01, 0.01, 0.01, 0.1, 0.1, 0.1, 0.1])
ACC, ANGLE_STEP, RATE, SIZE_STEP = 10.0, (0.1, 0.1, 0.0), 1.0, 0.01


def aabb_iou(a: str = "", b: str = "o_") -> Column:
    """IoU of axis-aligned boxes with columns min_*, max_*; zero unless they overlap on every axis."""
    inter, va, vb, overlap = F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True)
    for x in "xyz":
        lo, hi = F.greatest(F.col(f"{a}min_{x}"), F.col(f"{b}min_{x}")), F.least(F.col(f"{a}max_{x}"), F.col(f"{b}max_{x}"))
        inter, overlap = inter * (hi - lo), overlap & (hi > lo)
        va = va * (F.col(f"{a}max_{x}") - F.col(f"{a}min_{x}"))
        vb = vb * (F.col(f"{b}max_{x}") - F.col(f"{b}min_{x}"))
    return F.when(overlap, inter / (va + vb - inter)).otherwise(F.lit(0.0))


def iou_pairs(boxes: DataFrame, others: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Overlapping box pairs of a key with their IoU; boxes are cut into grid cells to meet."""
    def cut(df: DataFrame) -> DataFrame:
        for x in "xyz":
            df = df.withColumn("_c" + x, F.explode(F.sequence(F.floor(F.col("min_" + x) / cell).cast("bigint"), F.floor(F.col("max_" + x) / cell).cast("bigint"))))
        return df

    extent = [f"{m}_{x}" for m in ("min", "max") for x in "xyz"]
    a = cut(boxes.select(*keys, "cluster", *extent))
    b = cut(others.select(*keys, "cluster", *extent))
    b = b.select(*keys, "_cx", "_cy", "_cz", *[F.col(c).alias("o_" + c) for c in ("cluster", *extent)])
    met = a.join(b, [*keys, "_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz").distinct()
    return met.withColumn("iou", aabb_iou()).filter(F.col("iou") > 0).select(*keys, "cluster", "o_cluster", "iou")


def assign(gain: np.ndarray) -> np.ndarray:
    """One-to-one assignment of rows to columns with the largest total gain; -1 for a zero gain."""
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = -np.floor(gain * 10000)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while True:
            used[j0] = True
            slack = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(gain.shape[0], -1)
    for j in range(1, gain.shape[1] + 1):
        i = match[j] - 1
        if i < gain.shape[0] and gain[i, j - 1] > 0:
            out[i] = j - 1
    return out


def matched(gain: np.ndarray) -> np.ndarray:
    """``assign`` for each connected part of the overlaps: boxes and tracks that do not overlap never compete.

    Gains count in steps of 1/10000; a smaller one is none, as it is to the assignment.
    """
    out = np.full(gain.shape[0], -1)
    gain = np.where(np.floor(gain * 10000) >= 1, gain, 0.0)
    row, col = np.nonzero(gain > 0)
    if (row[1:] != row[:-1]).all() and len(np.unique(col)) == len(col):
        out[row] = col
        return out
    part: dict[int, tuple[list[int], list[int]]] = {}
    rows, cols = {}, {}
    for i, j in zip(row.tolist(), col.tolist()):
        a, b = rows.get(i), cols.get(j)
        if a is None and b is None:
            rows[i] = cols[j] = i
            part[i] = ([i], [j])
        elif a is None:
            rows[i] = b
            part[b][0].append(i)
        elif b is None:
            cols[j] = a
            part[a][1].append(j)
        elif a != b:
            one, two = part[a], part.pop(b)
            for k in two[0]:
                rows[k] = a
            for k in two[1]:
                cols[k] = a
            one[0].extend(two[0])
            one[1].extend(two[1])
    for some, others in part.values():
        some, others = np.sort(some), np.sort(others)
        if len(some) == 1:
            out[some[0]] = others[np.argmax(np.floor(gain[some[0], others] * 10000))]
        else:
            best = assign(gain[np.ix_(some, others)])
            out[some] = np.where(best >= 0, others[best], -1)
    return out


STATUS = np.array(["NEW", "LOST", "MATCHED_ONCE", "MATCHED_MORE"])
_OUT = ("t", "track", "status", "x", "y", "z", "vx", "vy", "vz")


class Tracker:
    """State of one session: a row of each array for a live track.

    Measurement and motion of an axis do not touch the others, so the filter is one of two
    values (place, speed) for each of three axes and angles and one value for each size.
    """

    def __init__(self, params: TrackParams) -> None:
        self.p, self.count = params, 0
        self.tracks, self.status, self.t = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: place (x, y, z, angles) and its rate, their variances and covariance; size and its variance
        self.place, self.rate, self.var, self.cov, self.rate_var = (np.zeros((0, 6)) for _ in range(5))
        self.size, self.size_var = np.zeros((0, 3)), np.zeros((0, 3))

    _ARRAYS = ("tracks", "status", "t", "place", "rate", "var", "cov", "rate_var", "size", "size_var")

    def _keep(self, rows: np.ndarray) -> None:
        for name in self._ARRAYS:
            setattr(self, name, getattr(self, name)[rows])

    def _add(self, t: float, centre: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(centre)
        place = np.concatenate([centre, np.zeros((n, 3))], axis=1)
        level = lambda at: np.tile(STATE_VAR[at], (n, 1))
        fresh = {
            "tracks": self.count + 1 + np.arange(n), "status": np.zeros(n, np.int64), "t": np.full(n, t), "place": place, "rate": np.zeros((n, 6)),
            "var": level([0, 1, 2, 6, 7, 8]), "cov": np.zeros((n, 6)), "rate_var": level([3, 4, 5, 9, 10, 11]), "size": size, "size_var": level([12, 13, 14]),
        }
        for name in self._ARRAYS:
            setattr(self, name, np.concatenate([getattr(self, name), fresh[name]]))
        self.count += n
        return np.arange(len(self.tracks) - n, len(self.tracks))

    def _update(self, at: np.ndarray, t: float, centre: np.ndarray, size: np.ndarray) -> None:
        dt = (t - self.t[at])[:, None]
        self.t[at] = t
        place, rate, var, cov, rate_var = (getattr(self, name)[at] for name in ("place", "rate", "var", "cov", "rate_var"))
        place = place + rate * dt
        turn = np.concatenate([np.zeros(3), np.square(ANGLE_STEP)])
        push = np.concatenate([np.repeat((ACC * dt) ** 2, 3, axis=1), np.repeat((RATE * dt) ** 2, 3, axis=1)], axis=1)
        both = cov + dt * rate_var
        var, cov, rate_var = var + dt * cov + both * dt + turn, both, rate_var + push
        inverse = 1.0 / (var + NOISE_VAR[:6])
        one, two = var * inverse, cov * inverse
        off = np.concatenate([centre, np.zeros((len(at), 3))], axis=1) - place
        self.place[at], self.rate[at] = place + one * off, rate + two * off
        self.var[at], self.cov[at], self.rate_var[at] = var - one * var, cov - one * cov, rate_var - two * cov
        size_var = self.size_var[at] + SIZE_STEP
        gain = size_var / (size_var + NOISE_VAR[6:])
        self.size[at] = self.size[at] + gain * (size - self.size[at])
        self.size_var[at] = size_var - gain * size_var

    def gains(self, t: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """IoU of boxes and the boxes of tracks at ``t``, where ``t`` is one of a track's predicted steps."""
        k = np.rint((t - self.t) / self.p.step)
        due = np.flatnonzero((k >= 1) & (k <= self.p.steps) & (np.abs(self.t + k * self.p.step - t) <= self.p.match_tolerance))
        gain = np.zeros((len(low), len(self.tracks)))
        centre, half = self.place[due, :3] + self.rate[due, :3] * k[due, None] * self.p.step, self.size[due] / 2
        a, b = centre - half, centre + half
        side = np.minimum(high[:, None], b) - np.maximum(low[:, None], a)
        inter = np.where((side > 0).all(axis=2), side.prod(axis=2), 0.0)
        gain[:, due] = inter / ((high - low).prod(axis=1)[:, None] + (b - a).prod(axis=1) - inter)
        return gain

    def frame(self, t: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Track, status and motion (x, y, z, vx, vy, vz) of each box of a frame."""
        old = t - self.t > self.p.step * self.p.steps
        if old.any():
            self._keep(~old)
        match = matched(self.gains(t, low, high)) if len(self.tracks) else np.full(len(low), -1)
        centre, size = (low + high) / 2, high - low
        known, fresh = np.flatnonzero(match >= 0), np.flatnonzero(match < 0)
        at = match[known]
        status = np.where(self.status[at] >= 2, 3, 2)
        self.status[:] = 1
        self.status[at] = status
        if len(at):
            self._update(at, t, centre[known], size[known])
        match[fresh] = self._add(t, centre[fresh], size[fresh])
        return self.tracks[match], self.status[match], np.concatenate([self.place[match, :3], self.rate[match, :3]], axis=1)

    def step(self, t: float, frame: pd.DataFrame) -> list[tuple]:
        low, high = (frame[[f"{m}_{a}" for a in "xyz"]].to_numpy(dtype=float) for m in ("min", "max"))
        return list(pd.DataFrame(self.table([t], [0, len(low)], low, high)).itertuples(index=False, name=None))

    def table(self, times: Sequence[float], ends: Sequence[int], low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of the rows of several frames; the boxes of frame i are those from ``ends[i]`` to ``ends[i + 1]``."""
        parts = [self.frame(t, low[a:b], high[a:b]) for t, a, b in zip(times, ends, ends[1:])]
        number, status, motion = (np.concatenate(c) for c in zip(*parts))
        return dict(zip(_OUT, (np.repeat(np.asarray(times), np.diff(ends)), number, STATUS[status], *motion.T)))


def predicted_positions(tracks: DataFrame, p: TrackParams) -> DataFrame:
    """Positions of each track at its next steps."""
    df = tracks.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(p.steps))))
    dt = F.col("k") * p.step
    return df.select("session", "track", (F.col("t") + dt).alias("t"), *[(F.col(a) + F.col("v" + a) * dt).alias(a) for a in "xyz"])
