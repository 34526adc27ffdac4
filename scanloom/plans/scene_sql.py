"""SQL of the range images that scans of the views see, for the queries on moving points.

Scans of the views are a tenth of a second apart, so every scan is an image of its own; the
window of pixels is implied by the limits on angles and needs no join of its own.
"""

from __future__ import annotations

from scanloom.params import CaseParams, DynamicParams
from scanloom.plans.catalog_points import POSE_ROT

#: Keeps points off the seam at the back of the sensor, where a rounding error is a full turn.
SHIFT = 0.0131
POINT = "session, scan_id, point_idx"


def direction(frame: str, p: DynamicParams) -> str:
    """Pixel, angles and depth of (gx, gy, gz) in the pose ``frame``."""
    x, y, z = (f"({frame}.r0{i} * (gx - {frame}.tx) + {frame}.r1{i} * (gy - {frame}.ty) + {frame}.r2{i} * (gz - {frame}.tz))" for i in range(3))
    az, el = f"atan2({y}, {x})", f"atan2({z}, sqrt({x} * {x} + {y} * {y}))"
    return (
        f"floor(({az} + {p.half_turn}::DOUBLE) / {p.hor_res}::DOUBLE)::BIGINT hor, floor(({el} + 0.5 * {p.half_turn}::DOUBLE) / {p.ver_res}::DOUBLE)::BIGINT ver, "
        f"{az} azimuth, {el} elevation, sqrt({x} * {x} + {y} * {y} + {z} * {z}) depth"
    )


def scene(p: DynamicParams) -> str:
    """mp: images a scan sees; gl: global points; im, px: image points and pixels; pb: probes."""
    world = ", ".join(f"r{i}0 * x + r{i}1 * y + r{i}2 * z + t{a} AS g{a}" for i, a in enumerate("xyz"))
    return f"""{POSE_ROT},
  ep AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY scan_id) - 1 map_id, lag(t) OVER (PARTITION BY session ORDER BY scan_id) last_t FROM pr),
  se AS (SELECT a.session, a.scan_id, max(b.map_id) newest FROM ep a JOIN ep b ON b.session = a.session AND b.t <= a.last_t - {p.buffer_delay - p.frame_dur / 2} GROUP BY 1, 2),
  mp AS MATERIALIZED (SELECT se.session, se.scan_id, ep.map_id, ep.scan_id upto, newest - ep.map_id age FROM se JOIN ep ON ep.session = se.session AND ep.map_id BETWEEN newest - {p.max_maps - 1} AND newest),
  gl AS MATERIALIZED (SELECT session, scan_id, point_idx, x, y, t, {world} FROM (SELECT * REPLACE (y + {SHIFT} AS y) FROM v_points) v JOIN pr USING (session, scan_id) WHERE NOT (x * x + y * y + z * z < {p.blind} * {p.blind})),
  ia AS (SELECT gl.session, f.map_id, gl.scan_id, point_idx, gl.t, {direction('f', p)} FROM gl JOIN ep f ON f.session = gl.session AND f.scan_id = gl.scan_id),
  ic AS (SELECT *, row_number() OVER (PARTITION BY session, map_id, hor, ver ORDER BY scan_id, point_idx) rn FROM ia),
  im AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM ic WHERE rn <= {p.max_pixel_points} AND (session, map_id) IN (SELECT session, map_id FROM mp)),
  px AS MATERIALIZED (SELECT session, map_id, hor, ver, count(*) n, min(depth) lo, max(depth) hi, min(t) pt FROM im GROUP BY ALL),
  pb AS MATERIALIZED (SELECT gl.session, gl.scan_id, point_idx, x, y, gl.t, mp.map_id, mp.upto, age, {direction('f', p)} FROM gl JOIN mp USING (session, scan_id) JOIN ep f ON f.session = mp.session AND f.map_id = mp.map_id)"""


def entered(p: DynamicParams) -> str:
    """e1: probes in front of, or in a gap of, the depth of an image."""
    fov = f"p.ver <= {p.ver_pixel(p.fov_up)} AND p.ver > {p.ver_pixel(p.fov_down)} AND p.hor BETWEEN {p.hor_pixel(p.fov_right)} AND {p.hor_pixel(p.fov_left)}"
    return f"""co AS (SELECT session, map_id, hor, min(ver) low, max(ver) high FROM px WHERE ver BETWEEN {p.ver_pixel(p.fov_down)} AND {p.ver_pixel(p.fov_up)} GROUP BY 1, 2, 3),
  ho AS (SELECT p.* FROM pb p LEFT JOIN px q USING (session, map_id, hor, ver) LEFT JOIN co USING (session, map_id, hor) WHERE q.n IS NULL AND {fov} AND NOT coalesce(low <= p.ver AND high >= p.ver, false)),
  nb AS (SELECT h.session, h.map_id, h.scan_id, h.point_idx, min(q.lo) nlo, max(q.hi) nhi FROM ho h JOIN px q ON q.session = h.session AND q.map_id = h.map_id AND abs(q.hor - h.hor) <= {p.neighbour_range} AND abs(q.ver - h.ver) <= {p.neighbour_range} GROUP BY 1, 2, 3, 4),
  e0 AS (SELECT p.*, coalesce(q.lo, nlo, 0.0) l, coalesce(q.hi, nhi, 0.0) h, q.n, q.hi far FROM pb p LEFT JOIN px q USING (session, map_id, hor, ver) LEFT JOIN nb USING (session, map_id, scan_id, point_idx)),
  e1 AS MATERIALIZED (SELECT * FROM e0 WHERE depth < l - {p.enter_max} OR (l < depth - {p.enter_min} AND h > depth + {p.enter_max}) OR (n IS NOT NULL AND l < 1e-4 AND h < 1e-4 AND depth < far + 1.0))"""


def rejected(p: DynamicParams) -> str:
    """r1: entered probes with a point of like depth nearby."""
    wide = f"greatest({p.near_hor_dis} / greatest(e.depth, {p.blind}), {p.near_hor})"
    tall = f"greatest({p.near_ver_dis} / greatest(e.depth, {p.blind}), {p.near_ver})"
    return f"""r1 AS (SELECT DISTINCT e.session, e.map_id, e.scan_id, e.point_idx FROM e1 e JOIN im o ON o.session = e.session AND o.map_id = e.map_id
  WHERE abs(e.azimuth - o.azimuth) < {wide} AND abs(e.elevation - o.elevation) < {tall}
    AND (abs(e.depth - o.depth) < {p.near_depth} OR (e.depth - o.depth > {p.near_depth} AND e.depth - o.depth < {p.enter_min})))"""


def case_entered(c: CaseParams, approach: bool, source: str = "pb", name: str = "ce") -> str:
    edge = "q.lo" if approach else "q.hi"
    margin = f"(CASE WHEN q.n IS NULL THEN {c.occ_depth} ELSE least({c.occ_depth}, {c.v_min} * (p.t - q.pt)) END)"
    hit = f"p.depth < coalesce({edge}, 0.0) - {margin}" if approach else f"p.depth > coalesce({edge}, 0.0) + {margin}"
    return f"{name} AS MATERIALIZED (SELECT p.* FROM {source} p LEFT JOIN px q USING (session, map_id, hor, ver) WHERE age = 0 AND {hit})"


def case_consistent(c: CaseParams, p: DynamicParams, approach: bool, source: str, name: str) -> str:
    gap = "o.depth - p.depth"
    near = f"{gap} < {c.v_min} * abs(p.t - o.t)" if approach else f"abs({gap}) < {c.map_depth}"
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT p.session, p.map_id, p.scan_id, p.point_idx FROM {source} p JOIN im o ON o.session = p.session AND o.map_id = p.map_id
  JOIN px q ON q.session = o.session AND q.map_id = o.map_id AND q.hor = o.hor AND q.ver = o.ver
  WHERE abs(p.azimuth - o.azimuth) < {c.map_hor} AND abs(p.elevation - o.elevation) < {c.map_ver} AND abs(p.t - o.t) > {p.frame_dur} AND {near}
    AND NOT (q.hi > p.depth + {c.map_depth} AND q.lo < p.depth - {c.map_depth}))"""


def occluding(c: CaseParams, approach: bool, search: bool, source: str, name: str, keep: str) -> str:
    """Pairs of a probe and an earlier image point in its direction, in front of it or behind it."""
    margin = f"least({c.occ_depth}, {c.v_min} * (p.t - o.t))"
    hit = f"o.depth > p.depth + {margin}" if approach else f"p.depth > o.depth + {margin}"
    skip = " JOIN px q ON q.session = o.session AND q.map_id = o.map_id AND q.hor = o.hor AND q.ver = o.ver AND q.lo <= p.depth" if search and approach else ""
    return f"""{name} AS MATERIALIZED (SELECT {keep}, o.scan_id o_scan, o.point_idx o_pid, o.t o_t, o.depth o_d, o.azimuth o_az, o.elevation o_el, o.hor - p.hor dh, o.ver - p.ver dv
  FROM {source} p JOIN im o ON o.session = p.session AND o.map_id = p.map_id{skip}
  WHERE p.t - o.t > 0 AND {hit} AND abs(p.azimuth - o.azimuth) < {c.occ_hor} AND abs(p.elevation - o.elevation) < {c.occ_ver})"""


def consistent_depth(c: CaseParams, p: DynamicParams, name: str = "dc") -> str:
    """Image points whose surroundings lie on one side of them."""
    near = f"abs(a.depth - b.depth) < {c.cons_depth_max}"
    return f"""ds AS (SELECT a.session, a.map_id, a.scan_id o_scan, a.point_idx o_pid, any_value(a.depth) d, count(*) FILTER ({near}) num, coalesce(sum(abs(a.depth - b.depth)) FILTER ({near}), 0.0) total,
    count(*) FILTER (NOT {near} AND a.depth > b.depth) smaller, count(*) FILTER (NOT {near} AND a.depth <= b.depth) greater
    FROM im a JOIN im b ON b.session = a.session AND b.map_id = a.map_id WHERE abs(a.t - b.t) < {p.frame_dur} AND abs(a.azimuth - b.azimuth) < {c.cons_hor} AND abs(a.elevation - b.elevation) < {c.cons_ver} GROUP BY 1, 2, 3, 4),
  {name} AS MATERIALIZED (SELECT session, map_id, o_scan, o_pid FROM ds WHERE (num <= 1 OR total / (num - 1) <= greatest({c.cons_depth}, {c.k_depth} * d)) AND (greater = 0 OR smaller = 0))"""


def chain(c: CaseParams, p: DynamicParams, approach: bool) -> str:
    """Points with a chain of two links: one in the newest image, one in the image before."""
    spiral = lambda v: f"(CASE WHEN {v} > 0 THEN 2 * {v} - 1 ELSE -2 * {v} END)"
    far = "o.o_d > h.depth + " if approach else "h.depth > o.o_d + "
    return f"""{scene(p)}, {case_entered(c, approach)}, {case_consistent(c, p, approach, "ce", "cc")},
  op AS (SELECT * FROM ce ANTI JOIN cc USING (session, map_id, scan_id, point_idx)),
  {occluding(c, approach, False, "op", "f1", "p.session, p.map_id, p.scan_id, p.point_idx, p.t, p.depth")}, {consistent_depth(c, p)},
  ln AS MATERIALIZED (SELECT session, scan_id, point_idx, t, o_scan l_scan, o_pid l_pid, o_t l_t, (depth - o_d) / (t - o_t) v, (t + o_t) / 2 tm FROM f1 JOIN dc USING (session, map_id, o_scan, o_pid)),
  sb AS (SELECT * FROM pb SEMI JOIN ln USING (session, scan_id, point_idx) WHERE age = 1),
  {case_consistent(c, p, approach, "sb", "ca")},
  st AS (SELECT * FROM sb ANTI JOIN ca USING (session, map_id, scan_id, point_idx)),
  he AS MATERIALIZED (SELECT ln.*, st.map_id, st.hor, st.ver, st.azimuth, st.elevation, st.depth FROM ln JOIN st USING (session, scan_id, point_idx)),
  tg AS (SELECT DISTINCT session, map_id, l_scan, l_pid FROM he),
  sn AS (SELECT g.session, tg.map_id, l_scan, l_pid, g.t, {direction('f', p)} FROM tg JOIN gl g ON g.session = tg.session AND g.scan_id = l_scan AND g.point_idx = l_pid JOIN ep f ON f.session = tg.session AND f.map_id = tg.map_id),
  {occluding(c, approach, True, "sn", "bk", "p.session, p.map_id, p.l_scan, p.l_pid, p.depth p1_d")},
  pk AS (SELECT bk.*, row_number() OVER (PARTITION BY session, map_id, l_scan, l_pid ORDER BY {spiral("dh")}, {spiral("dv")}, o_scan, o_pid) rn FROM bk JOIN dc USING (session, map_id, o_scan, o_pid))
  SELECT DISTINCT h.session, h.scan_id, h.point_idx FROM he h JOIN pk o ON o.session = h.session AND o.map_id = h.map_id AND o.l_scan = h.l_scan AND o.l_pid = h.l_pid AND rn = 1
  WHERE h.t - o.o_t > 0 AND {far}least({c.occ_depth}, {c.v_min} * (h.t - o.o_t)) AND abs(h.azimuth - o.o_az) < {c.occ_hor} AND abs(h.elevation - o.o_el) < {c.occ_ver}
    AND abs(h.v - (o.p1_d - o.o_d) / (h.l_t - o.o_t)) < (h.tm - (h.l_t + o.o_t) / 2) * {c.acc}"""
