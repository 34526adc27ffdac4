"""Triangle descriptors: building, the descriptor store and lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.cells import knn
from scanloom.params import LoopParams, TriangleParams
from scanloom.session import cut, rounds

FRAME = ("session", "keyframe")
KEY = ("kx", "ky", "kz")
SIDES = ("a", "b", "c")
CORNERS = ("pa", "pb", "pc")


def neighbours(keypoints: DataFrame, keys: Sequence[str], k: int, size: float) -> DataFrame:
    """k nearest key points of each key point, itself included, within its key frame."""
    return knn(keypoints, keypoints, keys, "kp", "kp", k, size, take=("bits", "summary"))


def _distance(p: Column, q: Column) -> Column:
    total = None
    for a in "xyz":
        t = (p[a] - q[a]) * (p[a] - q[a])
        total = t if total is None else total + t
    return F.sqrt(total)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row: the optimiser copies plain ones into all filters and uses after them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def triangles(keypoints: DataFrame, p: TriangleParams, keys: Sequence[str] = FRAME, size: float = 8.0) -> DataFrame:
    """Triangles of each key point with two of its neighbours.

    pa, pb, pc are the corners shared by the sides (1, 2), (1, 3), (2, 3) in ascending order.
    Triangles with equal sides in millimetres are kept once per key frame, the first in
    (key point, m, n) order. A key point has at most ``neighbours`` entries, so its list is
    bounded and all pairs come from one array.
    """
    near = neighbours(keypoints, keys, p.neighbours, size)
    lists = near.groupBy(*keys, "kp").agg(F.sort_array(F.collect_list(F.struct("rank", "near"))).alias("l"))
    pairs = [(m, n) for m in range(1, p.neighbours - 1) for n in range(m + 1, p.neighbours)]
    pair = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in pairs])
    df = lists.withColumn("_q", F.explode(pair)).filter(F.col("_q.n") < F.size("l"))
    # The optimiser may test the sides before the size, so a position past the list's end must be null.
    corner = {f"p{i}": F.get("l", at).near for i, at in ((1, F.lit(0)), (2, F.col("_q.m")), (3, F.col("_q.n")))}
    df = _once(df, corner).select(*keys, "kp", F.col("_q.m").alias("m"), F.col("_q.n").alias("n"), *corner)
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    df = _once(df, {"s1": _distance(p1, p2), "s2": _distance(p1, p3), "s3": _distance(p3, p2)})
    for side in ("s1", "s2", "s3"):
        df = df.filter((F.col(side) <= p.max_side) & (F.col(side) >= p.min_side))
    ordered = F.sort_array(F.array(*[F.struct(F.col(f"s{i}").alias("len"), F.lit(i).alias("i")) for i in (1, 2, 3)]))
    df = _once(df, {"_s": ordered})
    length = [F.col("_s")[i].len for i in range(3)]
    df = df.filter(F.abs(length[2] - (length[0] + length[1])) >= p.flat_margin)

    # Side 1 joins corners 1-2, side 2 joins 1-3, side 3 joins 2-3: two sides share corner i + j - 2.
    def shared(i: int, j: int) -> Column:
        which = F.col("_s")[i].i + F.col("_s")[j].i
        return F.when(which == 3, F.col("p1")).when(which == 4, F.col("p2")).otherwise(F.col("p3"))

    df = df.select(
        *keys, "kp", "m", "n", *[x.alias(s) for x, s in zip(length, SIDES)],
        shared(0, 1).alias("pa"), shared(0, 2).alias("pb"), shared(1, 2).alias("pc"),
    )
    mm = {f"_m{s}": (F.col(s) * 1000).cast("float").cast("bigint") for s in SIDES}
    scale = 1.0 / p.resolution
    one = F.min(F.struct("kp", "m", "n", *SIDES, *CORNERS))
    once = df.withColumns(mm).groupBy(*keys, *mm).agg(one.alias("t")).select(*keys, "t.*")
    centre = {f"c{x}": (F.col(f"pa.{x}") + F.col(f"pb.{x}") + F.col(f"pc.{x}")) / 3 for x in "xyz"}
    return (
        once.withColumns({s: F.col(s) * scale for s in SIDES}).withColumns(centre)
        .withColumn("sid", F.col("kp") * 4096 + F.col("m") * 64 + F.col("n")).drop("m", "n")
        .withColumns({k: F.floor(F.col(s) + 0.5).cast("int") for k, s in zip(KEY, SIDES)})
    )


def save_store(descriptors: DataFrame, table: str, buckets: int) -> None:
    """Append descriptors to the store, bucketed on the lookup key so lookups need no shuffle of it."""
    descriptors.write.mode("append").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)


def similarity(p: str, q: str) -> Column:
    """Mean over the corners of 2·|p ∧ q| / (|p| + |q|)."""
    total = None
    for c in CORNERS:
        a, b = F.col(f"{p}.{c}"), F.col(f"{q}.{c}")
        one = 2.0 * F.bit_count(a.bits.bitwiseAND(b.bits)) / (a.summary + b.summary)
        total = one if total is None else total + one
    return total / 3


def binary_similarity(a_bits: Column, b_bits: Column, a_sum: Column, b_sum: Column) -> Column:
    return 2.0 * F.bit_count(a_bits.bitwiseAND(b_bits)) / (a_sum + b_sum)


def _slim(df: DataFrame, side: str, frame: dict[str, str]) -> DataFrame:
    """Sides, bits and counts of descriptors as ``<side>_*``: all that a comparison needs."""
    corners = [x for c in CORNERS for x in (F.col(f"{c}.bits").alias(f"{side}_{c}"), F.col(f"{c}.summary").alias(f"{side}_n{c}"))]
    return df.select(*[F.col(k).alias(v) for k, v in frame.items()], F.col("sid").alias(f"{side}_sid"), *[F.col(x).alias(f"{side}_{x}") for x in SIDES], *corners)


def _fine_cells(df: DataFrame, side: str, ratio: float, reach: bool, axes: Sequence[str] = SIDES) -> DataFrame:
    """Cell (_l, and _f of each axis) of every descriptor, or with ``reach`` all cells that may hold a match.

    A match lies closer than ``ratio`` times the length of the query, and within the key cells next to it. Cells are
    as wide as that; their level is the power of two of the length, of which a query reaches two at most.
    """
    least = 3.0  # key cells around a query end closer than this
    at = [F.col(f"{side}_{x}") for x in SIDES]
    size = F.sqrt(sum((c * c for c in at[1:]), at[0] * at[0]))
    slack = 1 + 1e-9  # sums are rounded; the exact distance is tested later
    if ratio >= 0.5:
        level, width = (F.lit(0), F.lit(0)), F.lit(least)
    else:
        level = (F.floor(F.log2(size * (1 - ratio * slack) / slack)), F.floor(F.log2(size * (1 + ratio * slack) * slack)))
        width = F.least(F.pow(F.lit(2.0), F.col("_l") + 1) * (ratio / (1 - ratio * slack) * slack), F.lit(least))
    df = df.filter(size > 0)
    if not reach:
        df = df.withColumn("_l", (F.floor(F.log2(size)) if ratio < 0.5 else F.lit(0)).cast("int")).withColumn("_w", width)
        return df.withColumns({f"_f{x}": F.floor(F.col(f"{side}_{x}") / F.col("_w")).cast("bigint") for x in axes}).drop("_w")
    df = df.withColumn("_l", F.explode(F.sequence(level[0].cast("int"), level[1].cast("int")))).withColumns({"_w": width, "_r": F.least(size * ratio, F.lit(least)) * slack})
    for x in axes:
        ends = [F.floor((F.col(f"{side}_{x}") + sign * F.col("_r")) / F.col("_w")).cast("bigint") for sign in (-1, 1)]
        df = df.withColumn(f"_f{x}", F.explode(F.sequence(*ends)))
    return df.drop("_w", "_r")


def hits(query: DataFrame, store: DataFrame, p: LoopParams, within_session: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """Matching descriptor pairs without their corners: (PAIR, q_sid, d_sid, side_dist, _len, similarity).

    The query visits the key cells around its sides that come closer than 1.5. Slim rows meet in fine cells, which
    hold little more than what lies within the side distance, and are narrowed by key cell, frame gap, side distance and
    similarity. ``pairs`` keeps the matches of some frame pairs only: the descriptors of two frames then meet by one side.
    """
    axes, on = (SIDES, []) if pairs is None else (SIDES[-1:], ["map_session", "db_keyframe"])
    q = _slim(query, "q", {"session": "session", "keyframe": "keyframe"})
    if pairs is not None:
        q = q.join(pairs.select(*PAIR).distinct(), list(FRAME))
    q = _fine_cells(q, "q", p.side_ratio, True, axes)
    d = store.select(*KEY, "session", "keyframe", "sid", *SIDES, *CORNERS)
    d = _slim(d.withColumnsRenamed({"session": "map_session", "keyframe": "db_keyframe"}), "d", {"map_session": "map_session", "db_keyframe": "db_keyframe"} | {k: k for k in KEY})
    d = _fine_cells(d, "d", p.side_ratio, False, axes)
    order = (F.col("map_session") <= F.col("session")) if within_session else (F.col("map_session") < F.col("session"))
    diff = sum(((F.col(f"q_{x}") - F.col(f"d_{x}")) * (F.col(f"q_{x}") - F.col(f"d_{x}")) for x in SIDES[1:]), (F.col("q_a") - F.col("d_a")) * (F.col("q_a") - F.col("d_a")))
    size = sum((F.col(f"q_{x}") * F.col(f"q_{x}") for x in SIDES[1:]), F.col("q_a") * F.col("q_a"))
    gap2 = [(F.col(f"q_{x}") - (F.col(k) + 0.5)) * (F.col(f"q_{x}") - (F.col(k) + 0.5)) for k, x in zip(KEY, SIDES)]
    visited = gap2[0] + gap2[1] + gap2[2] < 1.5 * 1.5
    for k, x in zip(KEY, SIDES):
        visited = visited & (F.abs(F.col(k) - F.floor(F.col(f"q_{x}"))) <= 1)
    hit = q.join(d, [*on, "_l", *[f"_f{x}" for x in axes]]).filter((F.col("keyframe") - F.col("db_keyframe") > p.skip_near) & order)
    hit = hit.withColumn("side_dist", F.sqrt(diff)).withColumn("_len", F.sqrt(size)).filter((F.col("side_dist") < F.col("_len") * p.side_ratio) & visited)
    alike = [binary_similarity(F.col(f"q_{c}"), F.col(f"d_{c}"), F.col(f"q_n{c}"), F.col(f"d_n{c}")) for c in CORNERS]
    hit = hit.withColumn("similarity", (alike[0] + alike[1] + alike[2]) / 3).filter(F.col("similarity") > p.similarity)
    return hit.select(*FRAME, "map_session", "db_keyframe", "q_sid", "d_sid", "side_dist", "_len", "similarity")


def lookup(query: DataFrame, store: DataFrame, p: LoopParams, within_session: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """Matching descriptor pairs: (session, keyframe, map_session, db_keyframe, q, d, side_dist, similarity).

    Only ``hits`` fetch the corners of both descriptors.
    """
    found = hits(query, store, p, within_session, pairs)
    cols = ["sid", *SIDES, *CORNERS]
    wide_q = query.select(*FRAME, F.col("sid").alias("q_sid"), F.struct(*cols).alias("q"))
    wide_d = store.select(F.col("session").alias("map_session"), F.col("keyframe").alias("db_keyframe"), F.col("sid").alias("d_sid"), F.struct(*cols).alias("d"))
    out = found.join(wide_q, [*FRAME, "q_sid"]).join(wide_d, ["map_session", "db_keyframe", "d_sid"])
    return out.select(*FRAME, "map_session", "db_keyframe", "q", "d", "side_dist", "_len", "similarity")


PAIR = ("session", "keyframe", "map_session", "db_keyframe")


def votes(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PAIR).agg(F.count("*").alias("votes"))


def candidates(vote_counts: DataFrame, count: int) -> DataFrame:
    """Frames with more than one vote, the best ``count`` per key frame and map; lower frame first on ties."""
    order = Window.partitionBy("session", "keyframe", "map_session").orderBy(F.col("votes").desc(), F.col("db_keyframe"))
    return (
        vote_counts.filter(F.col("votes") > 1).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    )


def exact_scores(query: DataFrame, store: DataFrame, p: LoopParams) -> DataFrame:
    """Single-cell variant: similarity summed per frame pair over equal rounded keys."""
    q = _slim(query, "q", {c: c for c in (*FRAME, *KEY)})
    d = _slim(store, "d", {"session": "map_session", "keyframe": "db_keyframe"} | {k: k for k in KEY})
    q, d = (df.drop(f"{side}_sid", *[f"{side}_{x}" for x in SIDES]) for df, side in ((q, "q"), (d, "d")))
    hit = q.join(d, list(KEY)).filter((F.col("keyframe") - F.col("db_keyframe") > p.skip_near) & (F.col("map_session") <= F.col("session")))
    alike = [binary_similarity(F.col(f"q_{c}"), F.col(f"d_{c}"), F.col(f"q_n{c}"), F.col(f"d_n{c}")) for c in CORNERS]
    hit = hit.withColumn("similarity", (alike[0] + alike[1] + alike[2]) / 3).filter(F.col("similarity") > p.similarity)
    return hit.groupBy(*PAIR).agg(F.sum("similarity").alias("score"), F.count("*").alias("votes"))


def range_matches(query: DataFrame, store: DataFrame, max_centre: float = 100.0, gap: int = 25, side: float = 2.0) -> DataFrame:
    """Older variant: equal key, centres within ``max_centre``, frames further apart than ``gap``."""
    cols = ["sid", "a", "b", "c", "cx", "cy", "cz"]
    q = query.select(*FRAME, *KEY, F.struct(*cols).alias("q"))
    d = store.select(F.col("session").alias("map_session"), F.col("keyframe").alias("db_keyframe"), *KEY, F.struct(*cols).alias("d"))
    centre, sides = None, None
    for x in "xyz":
        t = (F.col(f"q.c{x}") - F.col(f"d.c{x}")) * (F.col(f"q.c{x}") - F.col(f"d.c{x}"))
        centre = t if centre is None else centre + t
    for x in SIDES:
        t = (F.col(f"q.{x}") - F.col(f"d.{x}")) * (F.col(f"q.{x}") - F.col(f"d.{x}"))
        sides = t if sides is None else sides + t
    return (
        q.join(d, list(KEY))
        .filter((F.col("keyframe") - F.col("db_keyframe") > gap) & (centre < max_centre * max_centre) & (sides < side * side))
        .groupBy(*PAIR).agg(F.count("*").alias("votes"))
    )


def dedupe_descriptors(
    descriptors: DataFrame, keys: Sequence[str] = ("session",), side_ratio: float = 0.005, min_similarity: float = 0.75,
    max_rounds: int = 100_000,
) -> DataFrame:
    """Fold a descriptor into the first kept, earlier one of its key that is nearly equal.

    Insertion in (keyframe, sid) order keeps exactly the descriptors without a kept earlier
    neighbour. Round by round we keep those whose earlier neighbours are all dropped and
    drop the neighbours of the kept ones; the result is that of the sequential insertion.
    """
    ident = [*keys, *KEY, "keyframe", "sid"]
    cols = ["keyframe", "sid", *SIDES, *CORNERS]
    a = descriptors.select(*keys, *KEY, F.struct(*cols).alias("q"))
    b = descriptors.select(*keys, *KEY, F.struct(*cols).alias("d"))
    diff, size = None, None
    for x in SIDES:
        t = (F.col(f"q.{x}") - F.col(f"d.{x}")) * (F.col(f"q.{x}") - F.col(f"d.{x}"))
        u = F.col(f"q.{x}") * F.col(f"q.{x}")
        diff, size = (t, u) if diff is None else (diff + t, size + u)
    earlier = (F.col("d.keyframe") < F.col("q.keyframe")) | ((F.col("d.keyframe") == F.col("q.keyframe")) & (F.col("d.sid") < F.col("q.sid")))
    links = (
        a.join(b, [*keys, *KEY]).filter(earlier & (diff < size * side_ratio * side_ratio))
        .filter(similarity("q", "d") > min_similarity)
        .select(*keys, *KEY, "q.keyframe", "q.sid", F.col("d.keyframe").alias("hk"), F.col("d.sid").alias("hs"))
    )
    links = cut(links)
    host = [*keys, *KEY, "hk", "hs"]
    as_host = [F.col(c).alias(h) for c, h in zip(ident, host)]
    open_links = links
    later = links.select(*ident).distinct()
    kept = cut(links.select(*host).distinct().toDF(*ident).join(later, ident, "left_anti"))
    todo = cut(later)
    for _ in rounds(max_rounds, "descriptor insertion"):
        gone = open_links.join(kept.select(*as_host), host, "left_semi").select(*ident).distinct()
        todo = cut(todo.join(gone, ident, "left_anti"))
        if todo.isEmpty():
            break
        waiting = links.join(todo, ident, "left_semi").join(todo.select(*as_host), host, "left_semi").select(*ident).distinct()
        fresh = todo.join(waiting, ident, "left_anti")
        kept = cut(kept.unionByName(fresh))
        todo = cut(todo.join(kept, ident, "left_anti"))
    free = descriptors.join(later, ident, "left_anti")
    saved = descriptors.join(later, ident, "left_semi").join(kept, ident, "left_semi")
    folded = (
        links.join(kept, ident, "left_anti").join(kept.select(*as_host), host, "left_semi")
        .groupBy(*ident).agg(F.min(F.struct("hk", "hs")).alias("h"))
        .groupBy(*keys, *KEY, F.col("h.hk").alias("keyframe"), F.col("h.hs").alias("sid")).agg(F.count("*").alias("folded"))
    )
    return free.unionByName(saved).join(folded, ident, "left").withColumn("frames", 1 + F.coalesce("folded", F.lit(0))).drop("folded")
