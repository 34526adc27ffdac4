"""Spatial joins as equi joins on grid cells.

Spark has no spatial join, and a bare distance condition becomes a nested loop. Each
operator keys both sides by a cell, replicates the probe into the cells it can reach,
joins on the cell and then tests the exact distance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import cut, rounds

CELL = ("_cx", "_cy", "_cz")


def with_cell(df: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z"), names: Sequence[str] = CELL) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(a) / size).cast("bigint") for n, a in zip(names, axes)})


def offsets(reach: int = 1, half: bool = False, dims: int = 3) -> Column:
    """Array literal of cell offsets; ``half`` keeps one of each opposite pair and zero."""
    grid: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        grid = [g + (i,) for g in grid for i in range(-reach, reach + 1)]
    if half:
        grid = [g for g in grid if g >= (0,) * dims]
    return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"o{k}") for k, v in enumerate(g)]) for g in grid])


def spread(df: DataFrame, reach: int = 1, half: bool = False, names: Sequence[str] = CELL) -> DataFrame:
    """Replicate every row into its neighbour cells."""
    df = df.withColumn("_o", F.explode(offsets(reach, half, len(names))))
    return df.withColumns({n: F.col(n) + F.col(f"_o.o{k}") for k, n in enumerate(names)})


def touched(df: DataFrame, radius: float, axes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Replicate every row into the cells of side 2·radius its ball touches: two per axis, 8 in space."""
    for n, a in zip(names, axes):
        low, high = [F.floor((F.col(a) + sign * radius) / (2.0 * radius)).cast("bigint") for sign in (-1, 1)]
        df = df.withColumn(n, F.explode(F.sequence(low, high)))
    return df


#: Side of a wide cell in radii: a ball touches 1.5 of them per axis on average, for more comparisons.
WIDE = 4.0


def wide_cell(df: DataFrame, radius: float, axes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide cell of every row. Cells are centred on the origin, so that flat ground does not lie on a border."""
    return df.withColumns({n: F.floor(F.col(a) / (WIDE * radius) + 0.5).cast("bigint") for n, a in zip(names, axes)})


def wide_touched(df: DataFrame, radius: float, axes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Replicate every row into the wide cells its ball touches; only rows near a border are shuffled more than once."""
    for n, a in zip(names, axes):
        # a hair more than the radius, as the sums are rounded; the exact distance is tested later
        low, high = [F.floor((F.col(a) + sign * radius * (1 + 1e-9)) / (WIDE * radius) + 0.5).cast("bigint") for sign in (-1, 1)]
        df = df.withColumn(n, F.explode(F.sequence(low, high)))
    return df


def dist2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for p, q in zip(a, b):
        term = (p.cast("double") - q) * (p.cast("double") - q)
        total = term if total is None else total + term
    return total


def _side(df: DataFrame, prefix: str, keys: Sequence[str], axes: Sequence[str], take: Sequence[str]) -> DataFrame:
    return df.select(
        *keys, *[F.col(a).cast("double").alias(prefix + a) for a in axes],
        *[F.col(c).alias(prefix + c) for c in take],
    )


def radius_pairs(
    df: DataFrame, keys: Sequence[str], ident: str, radius: float, axes: Sequence[str] = ("x", "y", "z"),
    take: Sequence[str] = (),
) -> DataFrame:
    """All unordered pairs closer than ``radius`` as (keys, a_id, b_id, d2), a_id < b_id.

    One side visits 14 instead of 27 cells, so each pair is produced once.
    """
    carried = [ident, *take]
    a = spread(with_cell(_side(df, "a_", keys, axes, carried), radius, ["a_" + x for x in axes], CELL[: len(axes)]), half=True, names=CELL[: len(axes)])
    b = with_cell(_side(df, "b_", keys, axes, carried), radius, ["b_" + x for x in axes], CELL[: len(axes)])
    cell = list(CELL[: len(axes)])
    same = F.lit(True)
    for k in range(len(axes)):
        same = same & (F.col(f"_o.o{k}") == 0)
    apart = ~same & (F.col("a_" + ident) != F.col("b_" + ident))  # rows of one id are one point, wherever they lie
    joined = a.join(b, [*keys, *cell]).filter(apart | (F.col("a_" + ident) < F.col("b_" + ident)))
    d2 = dist2([F.col("a_" + x) for x in axes], [F.col("b_" + x) for x in axes])
    lo, hi = F.least("a_" + ident, "b_" + ident), F.greatest("a_" + ident, "b_" + ident)
    a_first = F.col("a_" + ident) <= F.col("b_" + ident)
    extra = []
    for c in take:
        extra.append(F.when(a_first, F.col("a_" + c)).otherwise(F.col("b_" + c)).alias("a_" + c))
        extra.append(F.when(a_first, F.col("b_" + c)).otherwise(F.col("a_" + c)).alias("b_" + c))
    return (
        joined.withColumn("d2", d2).filter(F.col("d2") < radius * radius)
        .select(*keys, lo.alias("a_id"), hi.alias("b_id"), "d2", *extra)
    )


def within(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], radius: float,
    axes: Sequence[str] = ("x", "y", "z"), anti: bool = False,
) -> DataFrame:
    """Probe rows with (or without) a ref point closer than ``radius``.

    Cells with a diagonal of ``radius`` decide most rows without comparing points: a ref
    in the probe's own cell is always close enough. Only the rest visits neighbours, so
    a hot cell costs one row per side instead of all its pairs.
    """
    fine = radius / (len(axes) ** 0.5)
    cell, names = list(CELL[: len(axes)]), ["_f" + c for c in CELL[: len(axes)]]
    p = probe.withColumn("_row", F.monotonically_increasing_id())
    p = cut(with_cell(p, fine, axes, names))
    refs = ref.select(*keys, *[F.col(a).cast("double").alias("r_" + a) for a in axes]).distinct()
    taken = with_cell(refs, fine, ["r_" + a for a in axes], names).select(*keys, *names).distinct()
    rest = p.join(taken, [*keys, *names], "left_anti")
    far = wide_touched(rest.select(*keys, "_row", *axes), radius, axes, cell)
    target = wide_cell(refs, radius, ["r_" + a for a in axes], cell)
    near = (
        far.join(target, [*keys, *cell])
        .filter(dist2([F.col(a) for a in axes], [F.col("r_" + a) for a in axes]) < radius * radius)
        .select("_row").distinct()
    )
    if anti:
        return rest.join(near, "_row", "left_anti").drop("_row", *names)
    own = p.join(taken, [*keys, *names], "left_semi")
    return own.unionByName(rest.join(near, "_row", "left_semi")).drop("_row", *names)


def nearest_capped(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], ident: str, ref_ident: str, radius: float,
    take: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), carry: bool = False,
) -> DataFrame:
    """Nearest ref closer than ``radius`` per probe: (keys, ident, d2, near struct). No match, no row.

    ``carry`` keeps the probe's own coordinates, so that they need not be joined again.
    """
    cell = list(CELL[: len(axes)])
    a = wide_touched(probe.select(*keys, ident, *axes), radius, axes, cell)
    b = wide_cell(_side(ref, "r_", keys, axes, [ref_ident, *take]), radius, ["r_" + x for x in axes], cell)
    hit = a.join(b, [*keys, *cell]).withColumn(
        "d2", dist2([F.col(x) for x in axes], [F.col("r_" + x) for x in axes])
    ).filter(F.col("d2") < radius * radius)
    payload = F.struct("d2", F.col("r_" + ref_ident).alias(ref_ident), *[F.col("r_" + c).alias(c) for c in (*axes, *take) if c != ref_ident])
    return hit.groupBy(*keys, ident, *(axes if carry else ())).agg(F.min(payload).alias("near")).withColumn("d2", F.col("near.d2"))


#: Refs that share the cell of a ref, on average, up to which k-nearest starts with the side it was given.
_CROWD = 16


def _crowds(refs: DataFrame, keys: Sequence[str], side: float, axes: Sequence[str], levels: int) -> list[float]:
    """Refs in the cell of a ref, on average, for the side and its halves, quarters and so on."""
    at = refs.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))) if levels > 1 else refs.withColumn("_l", F.lit(0))
    cell = [F.floor(F.col("r_" + a) / side * F.pow(F.lit(2.0), "_l")).alias("_c" + a) for a in axes]
    counts = at.groupBy(*keys, "_l", *cell).agg(F.count("*").cast("double").alias("_n"))
    rows = counts.groupBy("_l").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_m")).collect()
    return [r["_m"] for r in sorted(rows)]


def knn(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], ident: str, ref_ident: str, k: int,
    size: float, take: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), max_rounds: int = 200, coarse: bool = False,
) -> DataFrame:
    """Exact k nearest refs without a distance cap: (keys, ident, rank from 0, d2, near struct).

    A round looks into the neighbour cells of side ``size``, which hold every ref closer
    than ``size``. A probe is done when it has k of them, or all refs of its group;
    the others go on with twice the side. Ties go to the smaller ref id.
    ``coarse`` uses cells of twice the side: 8 instead of 27 copies of a probe are shuffled, for about
    2.4 times the comparisons, which suits groups of few refs.
    Where cells hold many refs, only the k smallest ids of refs at one place are kept, which are all that can
    be among the nearest, and the search starts with a side halved until cells are small. The result is
    the same for any side; comparisons then grow with the probes, not with probes times refs.
    """
    totals = ref.groupBy(*keys).agg(F.count("*").alias("_total"))
    todo = cut(probe.select(*keys, ident, *axes).join(totals, list(keys)))
    b0 = cut(_side(ref, "r_", keys, axes, [ref_ident, *take]))
    cell = list(CELL[: len(axes)])
    payload = F.struct(*[F.col("r_" + c).alias(c) for c in dict.fromkeys((ref_ident, *axes, *take))])
    order = Window.partitionBy(*keys, ident).orderBy("d2", "r_" + ref_ident)
    done = []
    side, limit, finer = 2.0 * size if coarse else size, max(_CROWD, 4 * k), 0
    if max(_crowds(b0, keys, side, axes, 1), default=0.0) > limit:
        place = Window.partitionBy(*keys, *["r_" + x for x in axes]).orderBy("r_" + ref_ident)
        b0 = cut(b0.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= k).drop("_rn"))
        means = _crowds(b0, keys, side, axes, 16)
        finer = next((i for i, m in enumerate(means) if m <= limit), means.index(min(means)))
        size /= 2.0 ** finer
    for _ in rounds(max_rounds + finer, "nearest neighbours"):
        a = touched(todo, size, axes, cell) if coarse else spread(with_cell(todo, size, axes, cell), names=cell)
        b = with_cell(b0, 2.0 * size if coarse else size, ["r_" + x for x in axes], cell)
        hits = (
            a.join(b, [*keys, *cell])
            .withColumn("d2", dist2([F.col(x) for x in axes], [F.col("r_" + x) for x in axes]))
            .filter(F.col("d2") < size * size)
            .withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") <= k)
            .select(*keys, ident, "_total", (F.col("_rn") - 1).alias("rank"), "d2", payload.alias("near"))
        )
        hits = cut(hits)
        full = hits.groupBy(*keys, ident).agg(F.count("*").alias("_n"), F.first("_total").alias("_t")).filter(
            F.col("_n") >= F.least(F.lit(k), F.col("_t"))
        ).select(*keys, ident)
        done.append(hits.join(full, [*keys, ident], "left_semi").drop("_total"))
        todo = cut(todo.join(full, [*keys, ident], "left_anti"))
        if todo.isEmpty():
            break
        size *= 2.0
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


#: Reaches, in pixels, of the tile sizes that probes of differing reach are dealt over.
_REACHES = (2, 8, 32)


def window_join(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], hor_reach: Column | int, ver_reach: Column | int,
    max_reach: int = 0, depth: tuple[str, Column, Column] | None = None,
) -> DataFrame:
    """Probe x ref pixels within a window of pixels: probe has (hor, ver), ref (r_hor, r_ver).

    An equi join on tiles with the range as a condition after it. A tile is as large as the window,
    so a probe lies in at most two tiles of each axis, four in all, whatever its reach. Where
    the reach is a column, at most ``max_reach``, probes go to one of a few tile sizes and refs to each.
    ``depth`` names a column of ``ref`` and bounds of a probe: tiles whose refs all lie outside
    the bounds are left out before refs are joined, and so are these refs.
    The steps from the probe's pixel are in (_dh, _dv).
    """
    fixed = isinstance(hor_reach, int) and isinstance(ver_reach, int)
    hor_reach, ver_reach = (v if isinstance(v, Column) else F.lit(v).cast("bigint") for v in (hor_reach, ver_reach))
    df = probe.withColumns({"_hr": hor_reach, "_vr": ver_reach})
    if fixed:
        df = df.withColumns({"_tw": 2 * F.col("_hr") + 1, "_th": 2 * F.col("_vr") + 1})
        right = ref.withColumns({"_tw": 2 * hor_reach + 1, "_th": 2 * ver_reach + 1})
    else:
        sizes = [2 * r + 1 for r in (*[r for r in _REACHES if r < max_reach], max_reach)]
        need = 2 * F.greatest("_hr", "_vr") + 1
        size = F.lit(sizes[-1])
        for n in reversed(sizes[:-1]):
            size = F.when(need <= n, n).otherwise(size)
        df = df.withColumn("_tw", size.cast("bigint")).withColumn("_th", F.col("_tw"))
        right = ref.withColumn("_tw", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes]))).withColumn("_th", F.col("_tw"))
    tile = lambda at, width: F.floor(at / F.col(width)).cast("bigint")
    ends = lambda c, reach, width: F.explode(F.array_distinct(F.array(tile(F.col(c) - F.col(reach), width), tile(F.col(c) + F.col(reach), width))))
    df = df.withColumn("_ti", ends("hor", "_hr", "_tw")).withColumn("_tj", ends("ver", "_vr", "_th"))
    right = right.withColumns({"_ti": tile(F.col("r_hor"), "_tw"), "_tj": tile(F.col("r_ver"), "_th")})
    on = [*keys, "_tw", "_th", "_ti", "_tj"]
    inside = (F.abs(F.col("r_hor") - F.col("hor")) <= F.col("_hr")) & (F.abs(F.col("r_ver") - F.col("ver")) <= F.col("_vr"))
    if depth is not None:
        name, low, high = depth
        df = df.withColumns({"_from": low, "_to": high})
        spans = right.groupBy(*on).agg(F.min(name).alias("_min"), F.max(name).alias("_max"))
        df = df.join(spans, on).filter((F.col("_max") >= F.col("_from")) & (F.col("_min") <= F.col("_to"))).drop("_min", "_max")
        inside = inside & F.col(name).between(F.col("_from"), F.col("_to"))
    out = df.join(right, on).filter(inside).withColumns({"_dh": F.col("r_hor") - F.col("hor"), "_dv": F.col("r_ver") - F.col("ver")})
    return out.drop("_hr", "_vr", "_tw", "_th", "_ti", "_tj", "_from", "_to")
