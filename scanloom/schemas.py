"""Explicit schemas of the input tables; nothing is inferred."""

POINTS = (
    "session INT, scan_id INT, point_idx BIGINT, x FLOAT, y FLOAT, z FLOAT, intensity FLOAT, "
    "r SMALLINT, g SMALLINT, b SMALLINT, ring SMALLINT, offset_ns BIGINT, tag SMALLINT"
)
POSES = (
    "session INT, scan_id INT, t DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE, "
    "qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE"
)
LABELS = "session INT, scan_id INT, point_idx BIGINT, label INT"
LOOP_TRUTH = "frame_id INT, x DOUBLE, y DOUBLE, z DOUBLE, is_loop INT, match_id INT, overlap DOUBLE"
IMU = (
    "session INT, t DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE"
)
SCAN_MESSAGES = (
    "ts TIMESTAMP, timebase BIGINT, point_num INT, lidar_id SMALLINT, points ARRAY<STRUCT<"
    "offset_time: BIGINT, x: FLOAT, y: FLOAT, z: FLOAT, reflectivity: SMALLINT, tag: SMALLINT, "
    "line: SMALLINT>>"
)
PACKETS = (
    "lidar_id SMALLINT, seq BIGINT, stamp BIGINT, stamp_type SMALLINT, data_type SMALLINT, "
    "time_rcv BIGINT, payload ARRAY<STRUCT<x: INT, y: INT, z: INT, reflectivity: SMALLINT>>"
)
