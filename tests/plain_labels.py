"""Moving points scan by scan, probe by probe: what the operators on whole tables must equal."""

import math

import numpy as np

from scanloom.operators.dynamic import enclosing_depth


def rotation(q):
    x, y, z, w = q
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def look(world, frame, p):
    """hor, ver, azimuth, elevation, depth of world points in an image's frame."""
    r, t = frame
    v = (world - t) @ r
    az, el = np.arctan2(v[:, 1], v[:, 0]), np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1]))
    return np.stack([np.floor((az + p.half_turn) / p.hor_res), np.floor((el + 0.5 * p.half_turn) / p.ver_res), az, el, np.sqrt((v**2).sum(1))], axis=1)


class Image:
    """The points of an image up to a scan: columns scan, point, time, x, y, hor, ver, azimuth, elevation, depth, static."""

    def __init__(self, rows, upto, frame):
        rows = rows[rows[:, 0] <= upto]
        self.frame = frame
        self.scan, self.pid, self.t, self.x, self.y = rows[:, :5].T
        self.hor, self.ver, self.az, self.el, self.d = rows[:, 5:10].T
        self.static = np.ones(len(rows), bool)
        self.pixel = {}
        for k, key in enumerate(zip(self.hor, self.ver)):
            self.pixel.setdefault(key, []).append(k)

    def window(self, v, hor, ver):
        return np.flatnonzero((np.abs(self.hor - v[0]) <= hor) & (np.abs(self.ver - v[1]) <= ver))


def spiral(step):
    return np.where(step > 0, 2 * step - 1, -2 * step)


class Walk:
    def __init__(self, points, scans, p):
        """points: {scan: array of (point, x, y, z)}; scans: {scan: (t, translation, quaternion)}; one session."""
        self.p, self.moving = p, {}
        self.scans = sorted(scans)
        self.time = {s: scans[s][0] for s in self.scans}
        self.frame = {s: (rotation(scans[s][2]), np.array(scans[s][1])) for s in self.scans}
        self.local, self.world = {}, {}
        for s in self.scans:
            v = points[s][(points[s][:, 1:] ** 2).sum(1) >= p.blind**2]
            self.local[s] = v
            self.world[s] = v[:, 1:] @ self.frame[s][0].T + self.frame[s][1]
        slack, start, epoch, self.epoch, first = p.frame_dur / 2, -np.inf, -1, {}, {}
        for s in self.scans:
            if self.time[s] - start >= p.map_dur - slack:
                start, epoch = self.time[s], epoch + 1
                first[epoch] = s
            self.epoch[s] = epoch
        self.rows, self.last, self.first = {}, {}, first
        for e, f in first.items():
            own = [s for s in self.scans if self.epoch[s] == e]
            self.last[e] = own[-1]
            rows = np.concatenate([np.column_stack([np.full(len(self.local[s]), s), self.local[s][:, 0], np.full(len(self.local[s]), self.time[s]), self.local[s][:, 1:3], look(self.world[s], self.frame[f], p)]) for s in own])
            kept, seen = [], {}
            for k, key in enumerate(zip(rows[:, 5], rows[:, 6])):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= p.max_pixel_points:
                    kept.append(k)
            self.rows[e] = rows[kept]

    def visible(self, s):
        """(age, image) of the images that scan s sees, labelled."""
        i, p = self.scans.index(s), self.p
        if not i:
            return []
        cutoff = self.time[self.scans[i - 1]] - (p.buffer_delay - p.frame_dur / 2)
        seen = [x for x in self.scans if self.time[x] <= cutoff]
        if not seen:
            return []
        newest, out = self.epoch[seen[-1]], []
        for e in range(max(0, newest - p.max_maps + 1), newest + 1):
            image = Image(self.rows[e], seen[-1] if e == newest else self.last[e], self.frame[self.first[e]])
            image.static = np.array([(a, b) not in self.moving for a, b in zip(image.scan, image.pid)], bool)
            out.append((newest - e, image))
        return out

    def case1(self, v, image):
        p, d = self.p, v[4]
        at = image.pixel.get((v[0], v[1]), [])
        still = [k for k in at if image.static[k]]
        low, high = (image.d[still].min(), image.d[still].max()) if still else (0.0, 0.0)
        if not at:
            fov = p.ver_pixel(p.fov_down) < v[1] <= p.ver_pixel(p.fov_up) and p.hor_pixel(p.fov_right) <= v[0] <= p.hor_pixel(p.fov_left)
            column = [b for a, b in image.pixel if a == v[0] and p.ver_pixel(p.fov_down) <= b <= p.ver_pixel(p.fov_up)]
            if fov and not (column and min(column) <= v[1] <= max(column)):
                near = [k for k in image.window(v, p.neighbour_range, p.neighbour_range) if image.static[k]]
                if near:
                    low, high = image.d[near].min(), image.d[near].max()
        enter = d < low - p.enter_max or (low < d - p.enter_min and high > d + p.enter_max)
        if p.stop_object and at:
            enter = enter or (low < 1e-4 and high < 1e-4 and d < image.d[at].max() + 1.0)
        if not enter:
            return False
        wide, tall = max(p.near_hor_dis / max(d, p.blind), p.near_hor), max(p.near_ver_dis / max(d, p.blind), p.near_ver)
        k = image.window(v, min(math.ceil(wide / p.hor_res), p.max_window), min(math.ceil(tall / p.ver_res), p.max_window))
        k = k[image.static[k] & (np.abs(image.az[k] - v[2]) < wide) & (np.abs(image.el[k] - v[3]) < tall)]
        gap = d - image.d[k]
        if ((np.abs(gap) < p.near_depth) | ((gap > p.near_depth) & (gap < p.enter_min))).any():
            return False
        return not self.explained(v, image)

    def interpolated(self, v, t, image, static_only):
        p = self.p
        k = image.window(v, math.ceil(p.interp_hor / p.hor_res), math.ceil(p.interp_ver / p.ver_res))
        k = k[(image.static[k] | (not static_only)) & (np.abs(image.t[k] - t) >= p.frame_dur) & (np.abs(image.az[k] - v[2]) < p.interp_hor) & (np.abs(image.el[k] - v[3]) < p.interp_ver)]
        if not len(k):
            return -1.0
        k = k[np.lexsort((image.pid[k], image.scan[k], spiral(image.ver[k] - v[1]), spiral(image.hor[k] - v[0])))]
        return enclosing_depth(np.column_stack([image.az[k] - v[2], image.el[k] - v[3]]), image.d[k])

    def explained(self, v, image):
        p = self.p
        if not p.case1_interp:
            return False
        depth = self.interpolated(v, self.now, image, True)
        limit = p.interp_threshold + ((v[4] - p.interp_start) * p.interp_slope + p.interp_offset if v[4] > p.interp_start else 0.0)
        return depth > 0 and abs(depth - v[4]) < limit

    def consistent(self, v, t, image, c, approach):
        p = self.p
        hn = math.ceil(c.map_hor / p.hor_res)
        k = image.window(v, hn, hn if approach else math.ceil(c.map_ver / p.ver_res))
        low = np.array([min(image.d[image.pixel[image.hor[i], image.ver[i]]]) for i in k])
        high = np.array([max(image.d[image.pixel[image.hor[i], image.ver[i]]]) for i in k])
        if not len(k):
            return False
        dt, gap = np.abs(t - image.t[k]), image.d[k] - v[4]
        ok = gap < c.v_min * dt if approach else np.abs(gap) < c.map_depth
        straddle = (high > v[4] + c.map_depth) & (low < v[4] - c.map_depth)
        return bool((image.static[k] & ~straddle & (dt > p.frame_dur) & ok & (np.abs(image.az[k] - v[2]) < c.map_hor) & (np.abs(image.el[k] - v[3]) < c.map_ver)).any())

    def occluders(self, v, t, image, c, approach, search):
        p = self.p
        k = image.window(v, math.ceil(c.occ_hor / p.hor_res), math.ceil(c.occ_ver / p.ver_res))
        dt = t - image.t[k]
        margin = np.minimum(c.occ_depth, c.v_min * dt)
        ok = image.d[k] > v[4] + margin if approach else v[4] > image.d[k] + margin
        ok &= (dt > 0) & (np.abs(image.az[k] - v[2]) < c.occ_hor) & (np.abs(image.el[k] - v[3]) < c.occ_ver)
        if search and approach:
            ok &= np.array([min(image.d[image.pixel[image.hor[i], image.ver[i]]]) <= v[4] for i in k], bool)
        return k[ok]

    def own_sides(self, image, i, c):
        p = self.p
        v = (image.hor[i], image.ver[i])
        k = image.window(v, math.ceil(c.cons_hor / p.hor_res), math.ceil(c.cons_ver / p.ver_res))
        k = k[(np.abs(image.t[k] - image.t[i]) < p.frame_dur) & (np.abs(image.az[k] - image.az[i]) < c.cons_hor) & (np.abs(image.el[k] - image.el[i]) < c.cons_ver) & image.static[k]]
        gap = image.d[i] - image.d[k]
        near, far = np.abs(gap) < c.cons_depth_max, np.abs(gap) >= c.cons_depth_max
        tight = near.sum() <= 1 or np.abs(gap[near]).sum() / (near.sum() - 1) <= max(c.cons_depth, c.k_depth * image.d[i])
        return tight and (not (far & (gap <= 0)).any() or not (far & (gap > 0)).any())

    def chain(self, world, t, seen, c, approach):
        by_age = dict(seen)
        if 0 not in by_age:
            return False
        image, p = by_age[0], self.p
        v = look(world[None], image.frame, p)[0]
        at = image.pixel.get((v[0], v[1]), [])
        if at:
            order = [(image.d[k] if approach else -image.d[k], image.scan[k], image.pid[k], k) for k in at]
            edge = min(order)[3]
            margin, base = min(c.occ_depth, c.v_min * (t - image.t[edge])), image.d[edge]
        else:
            margin, base = c.occ_depth, 0.0
        if not (v[4] < base - margin if approach else v[4] > base + margin) or self.consistent(v, t, image, c, approach):
            return False
        links = [(image, i, (v[4] - image.d[i]) / (t - image.t[i]), (t + image.t[i]) / 2) for i in self.occluders(v, t, image, c, approach, False) if self.own_sides(image, i, c)]
        for depth in range(1, c.min_times):
            if depth not in by_age:
                return False
            image = by_age[depth]
            v = look(world[None], image.frame, p)[0]
            if self.consistent(v, t, image, c, approach):
                return False
            further = []
            for old, i, speed, middle in links:
                s, pid = old.scan[i], old.pid[i]
                k = int(np.flatnonzero(self.local[s][:, 0] == pid)[0])
                w = look(self.world[s][k][None], image.frame, p)[0]
                back = [j for j in self.occluders(w, old.t[i], image, c, approach, True) if self.own_sides(image, j, c)]
                if not back:
                    continue
                j = min(back, key=lambda j: (spiral(image.hor[j] - w[0]), spiral(image.ver[j] - w[1]), image.scan[j], image.pid[j]))
                dt = t - image.t[j]
                margin = min(c.occ_depth, c.v_min * dt)
                ok = image.d[j] > v[4] + margin if approach else v[4] > image.d[j] + margin
                now, mid = (w[4] - image.d[j]) / (old.t[i] - image.t[j]), (old.t[i] + image.t[j]) / 2
                if dt > 0 and ok and abs(v[2] - image.az[j]) < c.occ_hor and abs(v[3] - image.el[j]) < c.occ_ver and abs(speed - now) < (middle - mid) * c.acc:
                    further.append((image, j, now, mid))
            links = further
        return bool(links)

    def run(self):
        """{(scan, point): kind} of the moving points."""
        for s in self.scans:
            seen, self.now, found = self.visible(s), self.time[s], {}
            for k, world in enumerate(self.world[s]):
                hits = sum(self.case1(look(world[None], image.frame, self.p)[0], image) for _, image in seen)
                if hits >= self.p.min_maps:
                    kind = 1
                elif self.chain(world, self.now, seen, self.p.case2, False):
                    kind = 2
                elif self.chain(world, self.now, seen, self.p.case3, True):
                    kind = 3
                else:
                    continue
                found[s, self.local[s][k, 0]] = kind
            self.moving |= found
        return {(int(a), int(b)): kind for (a, b), kind in self.moving.items()}
