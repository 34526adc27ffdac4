"""Feature codes of the points of a scan line.

A point gets its code from three rules, each a step over the whole table:

1. Flat stretches. From a start point a stretch reaches to the first point farther away than a
   limit that grows with range. It is flat when its points stay close to its chord and its
   spacing is even. Stretches follow each other along the line; a flat one shares its last point
   with the next, and where two flat ones meet the angle tells a surface from an edge.
2. Jumps and wires. What a point's two neighbours are (regular, in line with the beam, missing
   near or far) tells depth jumps and free-hanging points.
3. Small surfaces. A plain point that lies straight and evenly between its neighbours is surface
   and so are its plain neighbours; a point taken over by its predecessor does not act itself.

A line is the points of one turn of one laser, so windows over a line are bounded by the sensor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geometry as g
from scanloom.params import LineFeatureParams

LINE = ["session", "scan_id", "line"]
#: Codes of the output.
CODES = {"plain": 0, "flat_end": 1, "flat": 2, "jump": 3, "edge": 4, "wire": 5}


def _ragged(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of runs that begin at ``first``, one after the other, and the run each belongs to."""
    run = np.repeat(np.arange(len(first)), sizes)
    return first[run] + np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run], run


def _reach(xyz: np.ndarray, rng: np.ndarray, starts: np.ndarray, stop: np.ndarray, p: LineFeatureParams) -> tuple[np.ndarray, np.ndarray]:
    """For every start: where its stretch ends, and whether a blind point ended it. ``stop`` is the end of its line."""
    blind = np.append(np.flatnonzero(rng < p.blind), len(xyz))
    hidden = np.minimum(blind[np.searchsorted(blind, starts)], stop)
    limit = (p.dis_a * rng[starts] + p.dis_b) ** 2
    end = starts + p.group_size
    open_ = np.flatnonzero((hidden >= end) & (end < stop))
    while len(open_):
        far = ((xyz[end[open_]] - xyz[starts[open_]]) ** 2).sum(axis=1) >= limit[open_]
        open_ = open_[~far & (end[open_] < hidden[open_])]
        end[open_] += 1
        open_ = open_[end[open_] < stop[open_]]
    cut = hidden <= np.minimum(end, stop - 1)
    return np.where(cut, hidden, end), cut


def _flat(xyz: np.ndarray, step: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray, p: LineFeatureParams) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches a..b keep to the chord at even distances, and their directions."""
    chord = xyz[np.minimum(b, stop - 1)] - xyz[a]
    upto = np.minimum(b, stop)
    at, run = _ragged(a + 1, upto - a - 1)
    width = np.zeros(len(a))
    np.maximum.at(width, run, (np.cross(xyz[at] - xyz[a[run]], chord[run]) ** 2).sum(axis=1))
    length2 = (chord * chord).sum(axis=1)
    bent = (width > 0) & (length2**2 < p.line_ratio * width)
    at, run = _ragged(a, upto - a)
    spacing = step[at][np.lexsort((step[at], run))]
    n = upto - a
    first = np.cumsum(n) - n
    second, middle, widest = spacing[first + 1], spacing[first + n - 1 - n // 2], spacing[first + n - 1]
    even = (widest < p.max_mid * middle) & (middle < p.mid_min * second) if p.mid_ratio_rule else widest < p.max_min * second
    unit = chord / np.where(length2 > 0, np.sqrt(length2), 1.0)[:, None]
    return ~bent & (second >= p.tiny_step) & even, unit


def _walk(xyz: np.ndarray, sizes: np.ndarray, p: LineFeatureParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows (first, last, follows, direction) of the flat stretches of many lines, and their line.

    All lines take their first step at once, then all their second, so the number of steps is that
    of the longest line.
    """
    begin = np.cumsum(sizes) - sizes
    rng = np.hypot(xyz[:, 0], xyz[:, 1])
    step = np.append(((xyz[1:] - xyz[:-1]) ** 2).sum(axis=1), 0.0)
    step[(begin + sizes - 1)[sizes > 0]] = 0.0
    line = np.flatnonzero((sizes > p.min_points) & (sizes > p.group_size))
    starts, run = _ragged(begin[line], sizes[line] - p.group_size)
    end, cut = np.zeros(len(xyz), np.int64), np.zeros(len(xyz), bool)
    end[starts], cut[starts] = _reach(xyz, rng, starts, (begin + sizes)[line[run]], p)
    at, before = begin[line], np.full(len(line), -1)
    rows, lines = [np.empty((0, 6))], [np.empty(0, np.int64)]
    while len(line):
        stop, fin = (begin + sizes)[line], end[at]
        flat, unit = np.zeros(len(line), bool), np.zeros((len(line), 3))
        seen = np.flatnonzero(~cut[at])
        flat[seen], unit[seen] = _flat(xyz, step, at[seen], fin[seen], stop[seen], p)
        low = begin[line]
        rows.append(np.column_stack([at - low, np.minimum(fin, stop - 1) - low, before == at, unit])[flat])
        lines.append(line[flat])
        # a blind start is stepped over, any other stretch that is not flat with its end
        before = np.where(flat, fin, before)
        at = np.where(flat, fin, np.maximum(fin, at) + 1)
        go = at < stop - p.group_size
        line, at, before = line[go], at[go], before[go]
    return np.concatenate(rows), np.concatenate(lines)


def flat_stretches(points: DataFrame, p: LineFeatureParams = LineFeatureParams()) -> DataFrame:
    """(line, first, last, follows, dx, dy, dz): flat stretches by position in the line.

    ``follows`` marks a stretch that begins where a flat one ended. A line is one row of arrays, and
    the lines of a batch are walked together.
    """
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def walk(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        sizes = np.array([len(v) for v in x], np.int64)
        xyz = np.stack([np.concatenate([np.asarray(v, float) for v in c]) for c in (x, y, z)], axis=1)
        rows, lines = _walk(xyz, sizes, p)
        order = np.argsort(lines, kind="stable")
        bounds = np.searchsorted(lines[order], np.arange(len(sizes) + 1))
        rows = rows[order]
        return pd.Series([list(rows[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], index=x.index)

    lines = points.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("point_idx", *[F.col(c).cast("double").alias(c) for c in "xyz"]))).alias("_p"))
    found = lines.select(*LINE, F.explode(walk("_p.x", "_p.y", "_p.z")).alias("_s"))
    cell = lambda i: F.col("_s")[i]
    return found.select(
        *LINE, cell(0).cast("bigint").alias("first"), cell(1).cast("bigint").alias("last"), (cell(2) > 0).alias("follows"),
        *[cell(3 + i).alias("d" + c) for i, c in enumerate("xyz")],
    )


def _stretch_codes(stretches: DataFrame, p: LineFeatureParams) -> DataFrame:
    """(line, pos, code) of the points of flat stretches; where two meet, the later one decides."""
    order = Window.partitionBy(*LINE).orderBy("first")
    old = [F.lag(c).over(order) for c in ("dx", "dy", "dz")]
    turn = sum((a * F.col(c) for a, c in zip(old, ("dx", "dy", "dz"), strict=True)), F.lit(0.0))
    long_enough = F.sqrt(sum((a * a for a in old), F.lit(0.0))) > p.min_direction
    head = F.when(~F.col("follows") | ~long_enough, CODES["flat_end"]).when(F.abs(turn) < p.edge_turn, CODES["edge"]).otherwise(CODES["flat"])
    coded = stretches.withColumn("head", head)
    spread = coded.select(*LINE, "first", "last", "head", F.explode(F.sequence("first", "last")).alias("pos"))
    code = F.when(F.col("pos") == F.col("first"), F.col("head")).when(F.col("pos") == F.col("last"), CODES["flat_end"]).otherwise(CODES["flat"])
    return spread.groupBy(*LINE, "pos").agg(F.max_by(code, "first").alias("code"))


def _neighbours(points: DataFrame, p: LineFeatureParams) -> DataFrame:
    """Position, range, squared steps and neighbour figures of every point of a line."""
    w = Window.partitionBy(*LINE).orderBy("point_idx")
    df = points.select(*LINE, "point_idx", "x", "y", "z").withColumns({
        "pos": F.row_number().over(w).cast("bigint") - 1, "n": F.count("*").over(Window.partitionBy(*LINE)),
        "rng": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "me": F.struct("x", "y", "z"),
    })
    df = df.withColumns({"prev": F.lag("me").over(w), "next": F.lead("me").over(w)})
    p0 = g.cols("xyz")
    va, vb = g.sub(g.cols(["prev.x", "prev.y", "prev.z"]), p0), g.sub(g.cols(["next.x", "next.y", "next.z"]), p0)
    df = df.withColumns({"step": F.coalesce(g.dot(vb, vb), F.lit(0.0)), "la": g.norm(va), "lb": g.norm(vb), "pa": g.dot(p0, va), "pb": g.dot(p0, vb), "ab": g.dot(va, vb)})
    shifted = {f"rng{k:+d}": F.lag("rng", -k).over(w) for k in (-2, -1, 1, 2)} | {f"step{k:+d}": F.lag("step", -k).over(w) for k in (-2, -1, 1)}
    first_seen = F.min(F.when(F.col("rng") >= p.blind, F.col("pos"))).over(Window.partitionBy(*LINE))
    return df.withColumns(shifted).withColumn("seen", first_seen)


def _kind(rng: str, cosine: Column, p: LineFeatureParams) -> Column:
    """Neighbour: regular, beam (in line with it), behind (against it), far or near when it is blind."""
    return (
        F.when(F.col(rng) < p.blind, F.when(F.col("rng") > p.inf_bound, "far").otherwise("near"))
        .when(cosine < p.jump_up, "behind").when(cosine > p.jump_down, "beam").otherwise("regular")
    )


def _even(near: str, next_near: str, one: str, two: str, p: LineFeatureParams) -> Column:
    """The two points of a side are seen and their spacing changes little."""
    big, small = F.sqrt(F.greatest(one, two)), F.sqrt(F.least(one, two))
    return (F.col(near) >= p.blind) & (F.col(next_near) >= p.blind) & (big <= p.edge_a * small) & (big - small <= p.edge_b)


def line_features(points: DataFrame, p: LineFeatureParams = LineFeatureParams()) -> DataFrame:
    """Feature code and surface group per point."""
    df = _neighbours(points, p).join(_stretch_codes(flat_stretches(points, p), p), [*LINE, "pos"], "left")
    df = df.withColumn("code", F.coalesce("code", F.lit(CODES["plain"])))
    seen = (F.col("n") > p.min_points) & (F.col("rng") >= p.blind)
    tested = seen & (F.col("pos") >= F.col("seen") + 3) & (F.col("pos") < F.col("n") - 3) & (F.col("code") < CODES["flat"]) & (F.col("step-1") >= p.tiny_step) & (F.col("step") >= p.tiny_step)
    both = (F.col("rng-1") >= p.blind) & (F.col("rng+1") >= p.blind)
    df = df.withColumns({
        "tested": tested, "a": _kind("rng-1", F.try_divide("pa", g.norm(g.cols("xyz")) * F.col("la")), p), "b": _kind("rng+1", F.try_divide("pb", g.norm(g.cols("xyz")) * F.col("lb")), p),
        "between": F.when(tested & both, F.try_divide("ab", F.col("la") * F.col("lb"))),
        "even_a": _even("rng-1", "rng-2", "step-1", "step-2", p), "even_b": _even("rng+1", "rng+2", "step", "step+1", p),
    })
    sides = F.concat_ws("-", "a", "b")
    bent = F.coalesce(F.col("between") > p.cos160, F.lit(False))
    wide = lambda big, small: (F.col(big) > p.jump_step) & (F.col(big) > p.jump_ratio * F.col(small))
    jump = (
        F.when((sides == "regular-beam") & wide("step", "step-1"), bent & F.col("even_a"))
        .when((sides == "beam-regular") & wide("step-1", "step"), bent & F.col("even_b"))
        .when(sides == "regular-far", F.col("even_a")).when(sides == "far-regular", F.col("even_b")).otherwise(False)
    )
    wire = (F.col("a") != "regular") & (F.col("b") != "regular") & (F.col("code") == CODES["plain"])
    df = df.withColumn("code", F.when(F.col("tested") & jump, CODES["jump"]).when(F.col("tested") & wire, CODES["wire"]).otherwise(F.col("code")))
    return _surface_groups(_small_surfaces(df, p), p)


def _small_surfaces(df: DataFrame, p: LineFeatureParams) -> DataFrame:
    """Plain points straight between their neighbours: every second one of a run acts."""
    w = Window.partitionBy(*LINE).orderBy("pos")
    big, small = F.greatest("step-1", "step"), F.least("step-1", "step")
    acts = (
        (F.col("code") == CODES["plain"]) & (F.col("pos") > F.col("seen")) & (F.col("pos") < F.col("n") - 1) & (F.least("rng-1", "rng", "rng+1") >= p.blind)
        & (F.col("step-1") >= p.small_step) & (F.col("step") >= p.small_step) & (F.col("between") < p.small_intersect) & (big < p.small_ratio * small)
    )
    df = df.withColumn("acts", F.coalesce(acts, F.lit(False)))
    df = df.withColumn("run", F.col("pos") - F.max(F.when(~F.col("acts"), F.col("pos"))).over(w))
    df = df.withColumn("acts", F.col("acts") & (F.coalesce("run", F.col("pos") + 1) % 2 == 1))
    near = F.col("acts") | F.coalesce(F.lag("acts").over(w), F.lit(False)) | F.coalesce(F.lead("acts").over(w), F.lit(False))
    return df.withColumn("near", near).withColumn("code", F.when(F.col("near") & (F.col("code") == CODES["plain"]), CODES["flat"]).otherwise(F.col("code")))


def _surface_groups(df: DataFrame, p: LineFeatureParams) -> DataFrame:
    """Number of each surface run: -1 none, -2 edge point.

    Runs are cut at ``keep_every`` points; such a full run is represented by its last point alone.
    A run that is still open at the end of the line is left out.
    """
    w = Window.partitionBy(*LINE).orderBy("pos")
    surface = F.col("code").isin(CODES["flat_end"], CODES["flat"])
    df = df.withColumn("surf", surface)
    df = df.withColumn("brk", F.coalesce(F.max(F.when(~F.col("surf"), F.col("pos"))).over(w), F.lit(-1)))
    place = F.col("pos") - F.col("brk") - 1
    df = df.withColumns({"part": F.floor(place / p.keep_every), "in_part": place % p.keep_every})
    group = Window.partitionBy(*LINE, "brk", "part", "surf")
    df = df.withColumns({"size": F.count("*").over(group), "last_pos": F.max("pos").over(group)})
    full = F.col("size") == p.keep_every
    shown = F.col("surf") & F.when(full, F.col("in_part") == p.keep_every - 1).otherwise(F.col("last_pos") < F.col("n") - 1)
    df = df.withColumn("shown", shown)
    df = df.withColumn("opens", F.col("shown") & (full | (F.col("in_part") == 0)))
    number = F.sum(F.col("opens").cast("int")).over(w) - 1
    code = F.when(F.col("shown"), number).when(F.col("code").isin(CODES["jump"], CODES["edge"]), -2).otherwise(-1)
    return df.select(*LINE, "point_idx", "x", "y", "z", F.col("code").cast("int").alias("code"), code.cast("int").alias("surface"))


def surface_points(features: DataFrame) -> DataFrame:
    """Averaged surface points of the classified lines."""
    return features.filter(F.col("surface") >= 0).groupBy(*LINE, "surface").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n")
    )


def edge_points(features: DataFrame) -> DataFrame:
    return features.filter(F.col("surface") == -2)
