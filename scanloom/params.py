"""Parameters of the pipeline, one frozen dataclass per stage.

The default values are fixed values of the configurations whose results we match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class PlaneParams:
    voxel_size: float = 1.0
    min_points: int = 10
    max_min_eigen: float = 0.01
    normal_threshold: float = 0.1
    distance_threshold: float = 0.3


@dataclass(frozen=True)
class KeypointParams:
    plane_count: int = 1
    resolution: float = 0.5
    slice_height: float = 0.1
    min_height: float = 0.0
    max_height: float = 5.0
    min_summary: int = 6
    line_filter: bool = True
    touch_filter: bool = False
    nms_radius: float = 2.0
    max_keypoints: int = 500
    block: int = 5

    @property
    def slices(self) -> int:
        return int((self.max_height - self.min_height) / self.slice_height)


@dataclass(frozen=True)
class TriangleParams:
    neighbours: int = 15
    min_side: float = 2.0
    max_side: float = 50.0
    resolution: float = 0.2
    flat_margin: float = 0.2


@dataclass(frozen=True)
class LoopParams:
    skip_near: int = 100
    candidates: int = 50
    similarity: float = 0.7
    side_ratio: float = 0.01
    vertex_distance: float = 3.0
    min_votes: int = 4
    max_hypotheses: int = 50
    normal_threshold: float = 0.2
    plane_distance: float = 0.5
    icp_point_distance: float = 3.0
    accept_score: float = 0.4
    frame_gap: int = 50


@dataclass(frozen=True)
class PoseGraphParams:
    odometry_variance: float = 1e-6
    loop_variance: float = 0.1
    prior_variance: float = 1e-12
    cauchy: float = 1.0
    sub_frames: int = 10


@dataclass(frozen=True)
class CaseParams:
    """Thresholds of one occlusion test family (receding or approaching)."""

    v_min: float
    acc: float
    map_depth: float
    map_hor: float
    map_ver: float
    occ_depth: float
    occ_hor: float
    occ_ver: float
    cons_depth: float
    cons_depth_max: float
    cons_hor: float
    cons_ver: float
    min_times: int
    k_depth: float = 0.005
    interp: bool = False
    interp_threshold: float = 0.25


@dataclass(frozen=True)
class DynamicParams:
    hor_res: float = 0.005
    ver_res: float = 0.007
    half_turn: float = 3.141593
    rows: int = 2095
    columns: int = 4190
    frame_dur: float = 0.1
    buffer_delay: float = 0.1
    map_dur: float = 0.1
    max_maps: int = 7
    max_pixel_points: int = 50
    max_window: int = 50  # pixels that the near test looks to each side at most
    blind: float = 0.3
    near_axis_box: bool = False
    ego_boxes: bool = True
    ego_x: tuple[float, float] = (-1.5, 2.5)
    ego_y: tuple[float, float] = (0.0, 0.0)
    fov_up: float = 2.0
    fov_down: float = -23.0
    fov_left: float = 180.0
    fov_right: float = -180.0
    neighbour_range: int = 1
    stop_object: bool = True
    enter_min: float = 1.0
    enter_max: float = 0.3
    near_depth: float = 0.3
    near_hor: float = 0.01
    near_ver: float = 0.015
    near_hor_dis: float = 0.15
    near_ver_dis: float = 0.15
    enlarge_elevation: float = -2.5
    enlarge_angle: float = 2.0
    enlarge_depth: float = 3.0
    min_maps: int = 2
    case1_interp: bool = True
    interp_hor: float = 0.015
    interp_ver: float = 0.007
    interp_threshold: float = 0.5
    interp_start: float = 10.0
    interp_slope: float = 0.1
    interp_offset: float = 0.5
    cluster_voxel: float = 0.3
    cluster_extend: int = 2
    cluster_min_voxels: int = 8
    cluster_trust: float = 0.3
    case2: CaseParams = CaseParams(
        v_min=0.5, acc=7.0, map_depth=0.2, map_hor=0.01, map_ver=0.01, occ_depth=10.15, occ_hor=0.01,
        occ_ver=0.015, cons_depth=0.1, cons_depth_max=0.5, cons_hor=0.01, cons_ver=0.01, min_times=2,
        interp_threshold=0.25,
    )
    case3: CaseParams = CaseParams(
        v_min=0.5, acc=15.0, map_depth=0.2, map_hor=0.01, map_ver=0.008, occ_depth=0.15, occ_hor=0.01,
        occ_ver=0.01, cons_depth=0.3, cons_depth_max=1.0, cons_hor=0.01, cons_ver=0.01, min_times=2,
        interp_threshold=0.05,
    )

    def hor_pixel(self, degrees: float) -> int:
        return math.floor((degrees / 180.0 * self.half_turn + self.half_turn) / self.hor_res)

    def ver_pixel(self, degrees: float) -> int:
        return math.floor((degrees / 180.0 * self.half_turn + 0.5 * self.half_turn) / self.ver_res)


@dataclass(frozen=True)
class LineFeatureParams:
    """Scan-line feature extraction; angles are cosines of degrees."""

    blind: float = 1.0
    inf_bound: float = 10.0
    group_size: int = 8
    dis_a: float = 0.1
    dis_b: float = 0.0
    line_ratio: float = 225.0
    max_mid: float = 6.25
    mid_min: float = 6.25
    max_min: float = 3.24
    mid_ratio_rule: bool = True
    jump_up: float = math.cos(math.radians(170.0))
    jump_down: float = math.cos(math.radians(8.0))
    cos160: float = math.cos(math.radians(160.0))
    edge_a: float = 2.0
    edge_b: float = 0.1
    small_intersect: float = math.cos(math.radians(172.5))
    small_ratio: float = 1.2
    keep_every: int = 1
    # fixed values of the rules
    min_points: int = 5  # shorter lines have plain points only
    tiny_step: float = 1e-16  # squared
    small_step: float = 1e-8  # squared
    min_direction: float = 0.1
    edge_turn: float = 0.707  # cosine
    jump_step: float = 0.0225  # squared
    jump_ratio: float = 4.0  # of squared steps


@dataclass(frozen=True)
class TrackParams:
    step: float = 0.02
    steps: int = 20
    match_tolerance: float = 0.05
