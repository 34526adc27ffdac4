"""A sample of registered queries against DuckDB on the smallest tables."""

import os

import pytest

import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["merged_map", "ag_voxel_moments", "ag_confusion", "jn_radius", "jn_nearest_time", "wn_map_epochs", "gr_voxel_cluster", "tk_line_reject", "ag_range_image", "st_gap_fill"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_sample_against_sql(spark):
    assert check.main([FOLDER, *SAMPLE]) == 0


def test_every_name_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
