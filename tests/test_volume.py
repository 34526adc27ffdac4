"""What a query moves: bytes shuffled per point, and tasks of its widest stages."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
POINTS = 6000


def stages(spark, name):
    """(bytes written to shuffles, tasks, seconds of tasks) of every stage that a query runs."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    none = jvm.java.util.ArrayList()

    def listed():
        found = store.stageList(none, False, False, context._gateway.new_array(jvm.double, 0), none).iterator()
        while found.hasNext():
            yield found.next()

    before = max((s.stageId() for s in listed()), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        entry.queries()[name](spark, FOLDER).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [(s.shuffleWriteBytes(), s.numTasks(), s.executorRunTime() / 1000) for s in listed() if s.stageId() > before]


@pytest.mark.parametrize("name, limit", [("gr_plane_adjust", 220), ("ag_point_icp", 220), ("gr_dbscan", 600)])
def test_bytes_per_point(spark, name, limit):
    assert sum(s[0] for s in stages(spark, name)) < limit * POINTS


def test_cubes_of_few_sensors_take_many_tasks(spark):
    assert max(s[1] for s in stages(spark, "flt_fov_boxes")) >= 2 * spark.sparkContext.defaultParallelism


def test_lines_are_walked_together(spark):
    import numpy as np

    from scanloom.operators import scanlines
    from scanloom.plans.catalog_windows import LINE_P
    from scanloom.plans.views import Views

    plan = scanlines.flat_stretches(Views(spark, FOLDER).points, LINE_P)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, 80)
    xyz = np.cumsum(rng.normal(1, 2, (sizes.sum(), 3)), axis=0) % 60
    rows, lines = scanlines._walk(xyz, sizes, LINE_P)
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip(ends - sizes, ends)):
        one = scanlines._walk(xyz[a:b], sizes[k : k + 1], LINE_P)[0]
        np.testing.assert_array_equal(rows[lines == k], one)
    assert len(rows) > 50


@pytest.mark.parametrize("name", ["src_stream_scans", "src_pose_per_file", "src_scans"])
def test_files_are_written_by_many_tasks(spark, name):
    assert max(s[1] for s in stages(spark, name)) >= 2 * spark.sparkContext.defaultParallelism
