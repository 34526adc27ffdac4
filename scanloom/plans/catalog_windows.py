"""Queries over sequences: key frames, edges, epochs, scan lines and joins on time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import imu, points as pt, scanlines, temporal, windows as wn
from scanloom.operators.ordered import block_of, neighbour, row_number
from scanloom.params import LineFeatureParams
from scanloom.plans.catalog_points import P, POSE_ROT, snapped
from scanloom.plans.registry import query, s, snap

SCAN_BLOCK = 4096.0 * 16777216 * 8


def point_block():
    return block_of(F.col("point_idx"), SCAN_BLOCK)


@query("wn_keyframe", """WITH kf AS (SELECT session, scan_id, (rn - 1) // 5 k FROM (SELECT session, scan_id, row_number() OVER (PARTITION BY session ORDER BY scan_id) rn FROM v_poses)),
  fk AS (SELECT session, k, min(scan_id) anchor_scan FROM kf GROUP BY 1, 2 HAVING count(*) = 5),
  kn AS (SELECT *, (row_number() OVER (ORDER BY session, k) - 1)::INT keyframe FROM fk)
  SELECT session, scan_id, keyframe, anchor_scan FROM kf JOIN kn USING (session, k)""")
def _(v):
    return wn.key_frames(v.poses, 5)


@query("wn_odom_edges", f"""WITH {POSE_ROT}, q AS (SELECT *, lag(scan_id) OVER w src, lag(tx) OVER w px, lag(ty) OVER w py, lag(tz) OVER w pz,
    {', '.join(f'lag(r{i}{j}) OVER w q{i}{j}' for i in range(3) for j in range(3))} FROM pr WINDOW w AS (PARTITION BY session ORDER BY scan_id))
  SELECT session, src, scan_id dst, {', '.join(s(f'q0{i} * (tx - px) + q1{i} * (ty - py) + q2{i} * (tz - pz)') + f' t{a}' for i, a in enumerate('xyz'))},
  {', '.join(s(f'q0{i} * r0{j} + q1{i} * r1{j} + q2{i} * r2{j}') + f' r{i}{j}' for i in range(3) for j in range(3))} FROM q WHERE src IS NOT NULL""")
def _(v):
    return wn.odometry_edges(v.poses).select("session", "src", "dst", *snapped([*g.TRANS, *g.ROT]))


LOOPS = """lp AS (SELECT (o_custkey % 3)::INT session, (o_custkey % 2)::INT map_session, o_orderkey keyframe, o_orderkey * 2 - (floor(o_totalprice)::BIGINT % 40) db_keyframe FROM orders)"""


@query("wn_frame_consistency", f"""WITH {LOOPS} SELECT session, map_session, keyframe, coalesce(abs((keyframe - lag(keyframe) OVER w) - (db_keyframe - lag(db_keyframe) OVER w)) < 20, true) consistent
  FROM lp WINDOW w AS (PARTITION BY session, map_session ORDER BY keyframe)""")
def _(v):
    c = F.col
    loops = v.table("orders").select(
        (c("o_custkey") % 3).cast("int").alias("session"), (c("o_custkey") % 2).cast("int").alias("map_session"),
        c("o_orderkey").alias("keyframe"), (c("o_orderkey") * 2 - F.floor("o_totalprice") % 40).alias("db_keyframe"),
    )
    return wn.frame_consistency(loops, 20).select("session", "map_session", "keyframe", "consistent")


@query("wn_arrival_cap", """SELECT session, hor, ver, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY session, hor, ver ORDER BY scan_id, point_idx) rn FROM (
  SELECT session, scan_id, point_idx, floor((atan2(y, x) + 3.141593::DOUBLE) / 0.1::DOUBLE)::BIGINT hor, floor((atan2(z, sqrt(x * x + y * y)) + 0.5 * 3.141593::DOUBLE) / 0.1::DOUBLE)::BIGINT ver FROM v_points)) WHERE rn <= 20""")
def _(v):
    sph = g.spherical(g.cols("xyz"), 0.1, 0.1, 32)
    df = v.points.select("session", "scan_id", "point_idx", sph["hor"].alias("hor"), sph["ver"].alias("ver"))
    return wn.arrival_cap(df, ["session", "hor", "ver"], ["scan_id", "point_idx"], 20).select("session", "hor", "ver", "point_idx")


@query("wn_map_epochs", """WITH RECURSIVE e AS (SELECT session, min(t) st, 0::BIGINT epoch FROM v_track GROUP BY session
  UNION ALL SELECT e.session, min(k.t), e.epoch + 1 FROM e JOIN v_track k ON k.session = e.session AND k.t - e.st >= 7.0 GROUP BY e.session, e.epoch)
  SELECT k.session, k.seq, e.epoch FROM v_track k ASOF JOIN e ON k.session = e.session AND k.t >= e.st""")
def _(v):
    scans = v.track.select("session", F.col("seq").alias("scan_id"), "t")
    return wn.map_epochs(scans, 7.0).select("session", F.col("scan_id").alias("seq"), "epoch")


@query("flt_motion_skip", """WITH RECURSIVE q AS (SELECT session, seq, tx, ty, sin(yaw / 2) qz, cos(yaw / 2) qw, row_number() OVER (PARTITION BY session ORDER BY seq) rn FROM v_track),
  e AS (SELECT session, rn, tx, ty, qz, qw, true AS kept FROM q WHERE rn = 1
    UNION ALL SELECT session, rn, CASE WHEN moved THEN nx ELSE tx END, CASE WHEN moved THEN ny ELSE ty END, CASE WHEN moved THEN nz ELSE qz END, CASE WHEN moved THEN nw ELSE qw END, moved FROM (
      SELECT q.session, q.rn, e.tx, e.ty, e.qz, e.qw, q.tx nx, q.ty ny, q.qz nz, q.qw nw,
      sqrt((q.tx - e.tx) * (q.tx - e.tx) + (q.ty - e.ty) * (q.ty - e.ty)) >= 0.23 OR 2 * acos(least(1.0::DOUBLE, abs(q.qz * e.qz + q.qw * e.qw))) >= 0.085 AS moved
      FROM e JOIN q ON q.session = e.session AND q.rn = e.rn + 1))
  SELECT session, seq FROM e JOIN q USING (session, rn) WHERE kept""")
def _(v):
    track = v.track.withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(F.col("yaw") / 2), "qw": F.cos(F.col("yaw") / 2)})
    return wn.motion_skip(track, "seq", 0.23, 0.085).filter(F.col("kept") == 1).select("session", "seq")


RANKED = "rk AS (SELECT session, scan_id, row_number() OVER (PARTITION BY session ORDER BY scan_id) rn FROM v_poses)"


@query("wn_batch_clouds", f"""WITH {RANKED}, b AS (SELECT *, (rn - 1) // 4 batch, count(*) OVER (PARTITION BY session, (rn - 1) // 4) c FROM rk)
  SELECT session, batch, count(*)::BIGINT n, {s('sum(x)', 3)} sx FROM v_points JOIN b USING (session, scan_id) WHERE c = 4 GROUP BY 1, 2""")
def _(v):
    return v.points.join(wn.batch_windows(v.poses, 4), ["session", "scan_id"]).groupBy("session", "batch").agg(
        F.count("*").alias("n"), snap(F.sum("x"), 3).alias("sx"))


LINES = "(PARTITION BY session, scan_id, line ORDER BY point_idx)"


@query("wn_ring_time", f"""WITH y AS (SELECT session, scan_id, line, point_idx, atan2(y, x) * 57.2957 yaw, first_value(atan2(y, x) * 57.2957) OVER w f, row_number() OVER w rn FROM v_points WINDOW w AS {LINES}),
  r AS (SELECT *, (CASE WHEN f - yaw >= 0 THEN f - yaw ELSE f - yaw + 360 END) / 3.61 raw FROM y WHERE rn > 1),
  d AS (SELECT *, CASE WHEN raw < lag(raw) OVER w THEN 1 ELSE 0 END back FROM r WINDOW w AS {LINES})
  SELECT session, scan_id, point_idx, {s('raw + CASE WHEN max(back) OVER w = 1 THEN 360 / 3.61 ELSE 0 END')} time_ms FROM d WINDOW w AS {LINES}""")
def _(v):
    return wn.ring_time(v.points).select(*P, snap(F.col("time_ms")).alias("time_ms"))


@query("wn_ring_index", """WITH RECURSIVE q AS (SELECT session, scan_id, point_idx, atan2(y, x) a, row_number() OVER (PARTITION BY session, scan_id ORDER BY point_idx) rn FROM v_points),
  e AS (SELECT session, scan_id, 0::BIGINT rn, 1.0::DOUBLE last, 1::BIGINT ring, 0::BIGINT since FROM q GROUP BY session, scan_id
  UNION ALL SELECT q.session, q.scan_id, q.rn, q.a, CASE WHEN q.a >= 0 AND q.a < 1 AND e.last <= 0 AND e.last > -1 AND e.since > 5 THEN ring + 1 ELSE ring END,
    CASE WHEN q.a >= 0 AND q.a < 1 AND e.last <= 0 AND e.last > -1 AND e.since > 5 THEN 0 ELSE since + 1 END
    FROM e JOIN q ON q.session = e.session AND q.scan_id = e.scan_id AND q.rn = e.rn + 1)
  SELECT session, scan_id, point_idx, ring FROM e JOIN q USING (session, scan_id, rn)""")
def _(v):
    return wn.ring_index(v.points.select(*P, "x", "y"), 5).select(*P, "ring")


@query("wn_line_geometry", f"""WITH l AS (SELECT *, lag(x) OVER w px, lag(y) OVER w py, lag(z) OVER w pz, lead(x) OVER w nx, lead(y) OVER w ny, lead(z) OVER w nz FROM v_points WINDOW w AS {LINES})
  SELECT session, scan_id, point_idx, {s('sqrt(x * x + y * y)')} AS range, {s('(nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)')} step2,
  {s('CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN ((px - x) * (nx - x) + (py - y) * (ny - y) + (pz - z) * (nz - z)) / sqrt((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z)) / sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) END')} cos_between FROM l""")
def _(v):
    df = wn.line_geometry(v.points)
    return df.select(*P, *snapped(["range", "step2", "cos_between"]))


# Wide limits, so that every rule finds something in scattered points.
LINE_P = LineFeatureParams(
    blind=3.0, inf_bound=20.0, line_ratio=0.6, max_mid=60.0, mid_min=60.0, jump_up=-0.6, jump_down=0.6, cos160=-0.95,
    edge_a=30.0, edge_b=60.0, small_intersect=-0.2, small_ratio=30.0, keep_every=3,
)


def line_sql(p: LineFeatureParams) -> str:
    """Scan-line rules in SQL; the walk along the stretches is a recursion over all lines at once."""
    key = "session, scan_id, line"
    on = "b.session = a.session AND b.scan_id = a.scan_id AND b.line = a.line"
    sq = lambda q, r: " + ".join(f"({q}.{c} - {r}.{c}) * ({q}.{c} - {r}.{c})" for c in "xyz")
    cross = " + ".join(f"power((k.{u} - s.{u}) * (e.{w} - s.{w}) - (k.{w} - s.{w}) * (e.{u} - s.{u}), 2)" for u, w in ("yz", "zx", "xy"))
    unit = lambda c: f"(e.{c} - s.{c}) / sqrt(greatest(s.len2, 1e-300))"
    even = lambda n1, n2, s1, s2: f"coalesce({n1} >= {p.blind} AND {n2} >= {p.blind} AND sqrt(greatest({s1}, {s2})) <= {p.edge_a} * sqrt(least({s1}, {s2})) AND sqrt(greatest({s1}, {s2})) - sqrt(least({s1}, {s2})) <= {p.edge_b}, false)"
    kind = lambda r, c: f"CASE WHEN {r} < {p.blind} THEN CASE WHEN rng > {p.inf_bound} THEN 'far' ELSE 'near' END WHEN {c} < {p.jump_up} THEN 'behind' WHEN {c} > {p.jump_down} THEN 'beam' ELSE 'regular' END"
    return f"""WITH RECURSIVE l0 AS (SELECT {key}, point_idx, x, y, z, sqrt(x * x + y * y) rng, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY {key}) n FROM v_points WINDOW w AS (PARTITION BY {key} ORDER BY point_idx)),
  l1 AS MATERIALIZED (SELECT *, coalesce({' + '.join(f'power(lead({c}) OVER w - {c}, 2)' for c in 'xyz')}, 0.0) step, min(pos) FILTER (rng >= {p.blind}) OVER (PARTITION BY {key}) seen,
    coalesce(min(CASE WHEN rng < {p.blind} THEN pos END) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) hid FROM l0 WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
  s0 AS (SELECT a.*, coalesce((SELECT min(b.pos) FROM l1 b WHERE {on} AND b.pos >= a.pos + {p.group_size} AND {sq('b', 'a')} >= power({p.dis_a} * a.rng + {p.dis_b}, 2)), a.n) far FROM l1 a WHERE a.n > {p.min_points} AND a.pos < a.n - {p.group_size}),
  s1 AS MATERIALIZED (SELECT * EXCLUDE (far), hid <= least(far, n - 1) AS cut, CASE WHEN hid <= least(far, n - 1) THEN hid ELSE far END fin FROM s0),
  s2 AS (SELECT s.*, {sq('e', 's')} len2 FROM s1 s JOIN l1 e ON e.session = s.session AND e.scan_id = s.scan_id AND e.line = s.line AND e.pos = least(s.fin, s.n - 1) WHERE NOT cut),
  s3 AS (SELECT s.session, s.scan_id, s.line, s.pos, any_value(s.fin) fin, any_value(s.n) n, any_value(s.len2) len2, {', '.join(f'any_value({unit(c)}) d{c}' for c in 'xyz')},
    coalesce(max({cross}) FILTER (k.pos > s.pos), 0.0) width, list_sort(list(k.step)) sp
    FROM s2 s JOIN l1 e ON e.session = s.session AND e.scan_id = s.scan_id AND e.line = s.line AND e.pos = least(s.fin, s.n - 1)
    JOIN l1 k ON k.session = s.session AND k.scan_id = s.scan_id AND k.line = s.line AND k.pos >= s.pos AND k.pos < s.fin GROUP BY 1, 2, 3, 4),
  s4 AS (SELECT * FROM s3 WHERE NOT (width > 0 AND len2 * len2 < {p.line_ratio} * width) AND sp[2] >= {p.tiny_step} AND sp[-1] < {p.max_mid} * sp[len(sp) - len(sp) // 2] AND sp[len(sp) - len(sp) // 2] < {p.mid_min} * sp[2]),
  nx AS MATERIALIZED (SELECT s1.session, s1.scan_id, s1.line, s1.pos, CASE WHEN s4.pos IS NOT NULL THEN s1.fin ELSE greatest(s1.fin, s1.pos) + 1 END nxt FROM s1 LEFT JOIN s4 USING (session, scan_id, line, pos)),
  wk AS (SELECT {key}, pos FROM nx WHERE pos = 0 UNION ALL SELECT nx.session, nx.scan_id, nx.line, t.pos FROM wk JOIN nx USING (session, scan_id, line, pos) JOIN nx t ON t.session = nx.session AND t.scan_id = nx.scan_id AND t.line = nx.line AND t.pos = nx.nxt),
  fl AS (SELECT *, lag(fin) OVER v = pos AS follows, lag(dx) OVER v * dx + lag(dy) OVER v * dy + lag(dz) OVER v * dz turn, sqrt(lag(dx) OVER v * lag(dx) OVER v + lag(dy) OVER v * lag(dy) OVER v + lag(dz) OVER v * lag(dz) OVER v) old
    FROM s4 SEMI JOIN wk USING (session, scan_id, line, pos) WINDOW v AS (PARTITION BY {key} ORDER BY pos)),
  fc AS (SELECT {key}, pos AS first, unnest(range(pos, least(fin, n - 1) + 1)) pos, least(fin, n - 1) AS last, CASE WHEN NOT coalesce(follows, false) OR old <= {p.min_direction} THEN 1 WHEN abs(turn) < {p.edge_turn} THEN 4 ELSE 2 END head FROM fl),
  pc AS (SELECT {key}, pos, arg_max(CASE WHEN pos = first THEN head WHEN pos = last THEN 1 ELSE 2 END, first) code FROM fc GROUP BY 1, 2, 3, 4),
  g0 AS (SELECT l1.*, coalesce(code, 0) code, {', '.join(f'lag({c}) OVER w p{c}, lead({c}) OVER w q{c}' for c in 'xyz')}, lag(rng, 2) OVER w r2, lag(rng) OVER w r1, lead(rng) OVER w t1, lead(rng, 2) OVER w t2, lag(step, 2) OVER w u2, lag(step) OVER w u1, lead(step) OVER w v1
    FROM l1 LEFT JOIN pc USING (session, scan_id, line, pos) WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
  g1 AS (SELECT *, n > {p.min_points} AND rng >= {p.blind} AND pos >= seen + 3 AND pos < n - 3 AND code < 2 AND u1 >= {p.tiny_step} AND step >= {p.tiny_step} AS tested, sqrt(x * x + y * y + z * z) nn,
    sqrt({' + '.join(f'power(p{c} - {c}, 2)' for c in 'xyz')}) la, sqrt({' + '.join(f'power(q{c} - {c}, 2)' for c in 'xyz')}) lb,
    {' + '.join(f'{c} * (p{c} - {c})' for c in 'xyz')} pa, {' + '.join(f'{c} * (q{c} - {c})' for c in 'xyz')} pb, {' + '.join(f'(p{c} - {c}) * (q{c} - {c})' for c in 'xyz')} ab FROM g0),
  g2 AS (SELECT *, {kind('r1', 'pa / (nn * la)')} || '-' || {kind('t1', 'pb / (nn * lb)')} sides, CASE WHEN tested AND r1 >= {p.blind} AND t1 >= {p.blind} THEN ab / (la * lb) END between_, {even('r1', 'r2', 'u1', 'u2')} ea, {even('t1', 't2', 'step', 'v1')} eb FROM g1),
  g3 AS (SELECT * REPLACE (CASE WHEN coalesce(tested, false) AND (CASE WHEN sides = 'regular-beam' AND step > {p.jump_step} AND step > {p.jump_ratio} * u1 THEN coalesce(between_ > {p.cos160}, false) AND ea
      WHEN sides = 'beam-regular' AND u1 > {p.jump_step} AND u1 > {p.jump_ratio} * step THEN coalesce(between_ > {p.cos160}, false) AND eb WHEN sides = 'regular-far' THEN ea WHEN sides = 'far-regular' THEN eb ELSE false END) THEN 3
    WHEN coalesce(tested, false) AND sides NOT LIKE 'regular%' AND sides NOT LIKE '%regular' AND code = 0 THEN 5 ELSE code END AS code) FROM g2),
  g4 AS (SELECT *, coalesce(code = 0 AND pos > seen AND pos < n - 1 AND least(r1, rng, t1) >= {p.blind} AND u1 >= {p.small_step} AND step >= {p.small_step} AND between_ < {p.small_intersect} AND greatest(u1, step) < {p.small_ratio} * least(u1, step), false) acts FROM g3),
  g5 AS (SELECT *, acts AND (pos - coalesce(max(CASE WHEN NOT acts THEN pos END) OVER (PARTITION BY {key} ORDER BY pos), -1)) % 2 = 1 AS act2 FROM g4),
  g6 AS (SELECT * REPLACE (CASE WHEN code = 0 AND (act2 OR coalesce(lag(act2) OVER w, false) OR coalesce(lead(act2) OVER w, false)) THEN 2 ELSE code END AS code) FROM g5 WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
  h0 AS (SELECT *, coalesce(max(CASE WHEN code NOT IN (1, 2) THEN pos END) OVER (PARTITION BY {key} ORDER BY pos), -1) brk FROM g6),
  h1 AS (SELECT *, (pos - brk - 1) // {p.keep_every} part, (pos - brk - 1) % {p.keep_every} AS inp FROM h0),
  h2 AS (SELECT *, count(*) OVER v = {p.keep_every} AS full_, max(pos) OVER v lastp FROM h1 WINDOW v AS (PARTITION BY {key}, brk, part, code IN (1, 2))),
  h3 AS (SELECT *, code IN (1, 2) AND (CASE WHEN full_ THEN inp = {p.keep_every - 1} ELSE lastp < n - 1 END) shown FROM h2),
  h4 AS (SELECT *, sum(CASE WHEN shown AND (full_ OR inp = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) - 1 number FROM h3),
  lf AS (SELECT {key}, point_idx, x, y, z, code::INT code, (CASE WHEN shown THEN number WHEN code IN (3, 4) THEN -2 ELSE -1 END)::INT surface FROM h4)"""


@query("wn_line_features", f"{line_sql(LINE_P)} SELECT session, scan_id, point_idx, code, surface FROM lf")
def _(v):
    return scanlines.line_features(v.points, LINE_P).select(*P, "code", "surface")


@query("wn_line_plane", f"{line_sql(LINE_P)} SELECT session, scan_id, line, surface, {', '.join(s(f'avg({c})', 4) + ' ' + c for c in 'xyz')}, count(*) n FROM lf WHERE surface >= 0 GROUP BY 1, 2, 3, 4")
def _(v):
    return scanlines.surface_points(scanlines.line_features(v.points, LINE_P)).withColumns({c: snap(F.col(c), 4) for c in "xyz"})


@query("flt_every_nth", """SELECT session, scan_id, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY session, scan_id ORDER BY point_idx) rn FROM v_points) WHERE (rn - 1) % 3 = 0""")
def _(v):
    df = row_number(v.points.select(*P), ["session", "scan_id"], ["point_idx"], point_block())
    return df.filter((F.col("rn") - 1) % 3 == 0).select(*P)


@query("flt_repeat_point", """SELECT session, scan_id, point_idx, coalesce(abs(x - lag(x) OVER w) <= 1e-7 AND abs(y - lag(y) OVER w) <= 1e-7 AND abs(z - lag(z) OVER w) <= 1e-7, false) repeated
  FROM v_points WINDOW w AS (PARTITION BY session, scan_id ORDER BY point_idx)""")
def _(v):
    df = neighbour(v.points, ["session", "scan_id"], "point_idx", point_block(), ["x", "y", "z"])
    same = F.lit(True)
    for a in "xyz":
        same = same & (F.abs(F.col(a) - F.col("prev." + a)) <= 1e-7)
    return df.select(*P, F.coalesce(same, F.lit(False)).alias("repeated"))


@query("tk_time_sort", "SELECT session, scan_id, point_idx, offset_ns FROM v_points")
def _(v):
    return v.points.select(*P, "offset_ns").repartition("session", "scan_id").sortWithinPartitions("session", "scan_id", "offset_ns")


def probe_events(v):
    return v.stream.select((F.col("session") % 3).alias("session"), "seq", (F.col("seq") * 0.15).alias("pt"), "value")


PROBE = "pe AS (SELECT (session % 3)::INT session, seq, seq * 0.15::DOUBLE pt, value FROM v_stream)"


@query("jn_nearest_time", f"""WITH {PROBE}, o AS (SELECT session, t, min(seq) rseq FROM v_track GROUP BY 1, 2),
  a AS (SELECT pe.*, o.t ta, o.rseq ra FROM pe ASOF LEFT JOIN o ON pe.session = o.session AND pe.pt >= o.t),
  b AS (SELECT a.*, o.t tb, o.rseq rb FROM a ASOF LEFT JOIN o ON a.session = o.session AND a.pt <= o.t)
  SELECT session, seq, CASE WHEN ta IS NOT NULL AND (tb IS NULL OR pt - ta < tb - pt OR (pt - ta = tb - pt AND ra <= rb)) THEN ra ELSE rb END ref_seq FROM b""")
def _(v):
    ref = v.track.select("session", "t", F.col("seq").alias("ref_seq"))
    df = temporal.nearest_time(probe_events(v), ref, ["session"], "pt", "t", "ref_seq")
    return df.select("session", "seq", F.col("near.ref_seq").alias("ref_seq"))


@query("jn_fifo_pair", f"""WITH {PROBE}, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) rn FROM pe),
  b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) rn FROM v_track) SELECT a.session, a.seq, b.seq odom FROM a JOIN b USING (session, rn)""")
def _(v):
    odom = v.track.select("session", F.col("seq").alias("odom"))
    return temporal.fifo_pair(probe_events(v), odom, ["session"], "seq", "odom").select("session", "seq", "odom")


@query("jn_imu_interval", f"""WITH {PROBE}, l AS (SELECT session, max(pt) m FROM pe GROUP BY session),
  e AS (SELECT session, scan_id, (scan_id + 1) * 25.6::DOUBLE te FROM v_poses), r AS (SELECT e.* FROM e JOIN l USING (session) WHERE te <= m)
  SELECT pe.session, pe.seq, r.scan_id FROM pe ASOF JOIN r ON pe.session = r.session AND pe.pt <= r.te""")
def _(v):
    scans = v.poses.select("session", "scan_id", ((F.col("scan_id") + 1) * 25.6).alias("te"))
    return temporal.imu_interval(probe_events(v), scans, ["session"], "pt", "te", "scan_id").select("session", "seq", "scan_id")


IMU = """im AS (SELECT (o_custkey % 3)::INT session, (o_orderkey // 256)::INT scan_id, (o_orderkey % 256) / 2560.0::DOUBLE off, (o_orderkey % 50) * 0.01::DOUBLE yaw,
  o_totalprice / 100000 px, (o_custkey % 100) * 0.01::DOUBLE vx, (o_custkey % 17) * 0.1::DOUBLE ax, (o_custkey % 13) * 0.1::DOUBLE gz FROM orders),
  h AS (SELECT *, lead(off) OVER w nf, lead(ax) OVER w nax, lead(gz) OVER w ngz FROM im WINDOW w AS (PARTITION BY session, scan_id ORDER BY off)),
  en AS (SELECT session, scan_id, arg_max(yaw, off) eyaw, arg_max(px, off) epx FROM im GROUP BY 1, 2),
  j AS (SELECT p.session, p.scan_id, p.point_idx, x, y, z, p.off, h.off hoff, yaw, px, vx, nax, ngz FROM (SELECT *, offset_ns / 1e9 off FROM v_points) p ASOF LEFT JOIN (SELECT * FROM h WHERE nf IS NOT NULL) h
    ON p.session = h.session AND p.scan_id = h.scan_id AND p.off > h.off)"""


def imu_poses(v):
    c = F.col
    yaw = c("o_orderkey") % 50 * 0.01
    zero = F.lit(0.0)
    rot = [F.cos(yaw), -F.sin(yaw), zero, F.sin(yaw), F.cos(yaw), zero, zero, zero, F.lit(1.0)]
    return v.table("orders").select(
        (c("o_custkey") % 3).cast("int").alias("session"), F.floor(c("o_orderkey") / 256).cast("int").alias("scan_id"),
        ((c("o_orderkey") % 256) / 2560.0).alias("offset_s"), *[r.alias(n) for r, n in zip(rot, g.ROT)],
        (c("o_totalprice") / 100000).alias("tx"), zero.alias("ty"), zero.alias("tz"),
        (c("o_custkey") % 100 * 0.01).alias("velx"), zero.alias("vely"), zero.alias("velz"),
        (c("o_custkey") % 17 * 0.1).alias("accx"), zero.alias("accy"), zero.alias("accz"),
        zero.alias("gyrx"), zero.alias("gyry"), (c("o_custkey") % 13 * 0.1).alias("gyrz"),
    )


@query("jn_point_imu_pose", f"WITH {IMU} SELECT session, scan_id, point_idx, {s('hoff')} head, {s('ngz')} gz FROM j WHERE hoff IS NOT NULL")
def _(v):
    pts = v.points.withColumn("offset_s", F.col("offset_ns") / 1e9)
    df = temporal.point_imu_pose(pts, imu_poses(v)).filter(F.col("prev").isNotNull())
    return df.select(*P, snap(F.col("prev.t")).alias("head"), snap(F.col("prev.gyrz")).alias("gz"))


@query("fn_undistort", f"""WITH {IMU}, u AS (SELECT j.*, eyaw, epx, yaw + ngz * (off - hoff) - eyaw turn, px + vx * (off - hoff) + 0.5 * nax * (off - hoff) * (off - hoff) - epx shift FROM j JOIN en USING (session, scan_id))
  SELECT session, scan_id, point_idx, {s('CASE WHEN hoff IS NULL THEN x ELSE cos(turn) * x - sin(turn) * y + cos(eyaw) * shift END', 5)} x,
  {s('CASE WHEN hoff IS NULL THEN y ELSE sin(turn) * x + cos(turn) * y - sin(eyaw) * shift END', 5)} y, {s('z', 5)} z FROM u""")
def _(v):
    poses = imu_poses(v)
    pts = v.points.withColumn("offset_s", F.col("offset_ns") / 1e9)
    ends = poses.groupBy("session", "scan_id").agg(F.max(F.struct("offset_s", *g.ROT, *g.TRANS)).alias("e")).select("session", "scan_id", "e.*")
    return temporal.undistort(pts, poses, ends).select(*P, *snapped("xyz", 5))


@query("ag_imu_mean", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) k FROM v_stream), f AS (SELECT *, avg(value) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING) m FROM k WHERE k <= 10)
  SELECT session, count(*)::BIGINT n, {s('avg(value)')} mean_ax, {s('sum((value - m) * (value - m) * (k - 1) / k) / count(*)')} cov_ax FROM f GROUP BY session""")
def _(v):
    df = v.stream.select("session", "t", *[F.col("value").alias(a) for a in imu.AXES])
    return imu.imu_start(df, 10).select("session", "n", *snapped(["mean_ax", "cov_ax"]))
