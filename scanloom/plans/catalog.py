"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scanloom.plans import (  # noqa: F401
    catalog_cells,
    catalog_dynamic,
    catalog_files,
    catalog_loops,
    catalog_points,
    catalog_sinks,
    catalog_windows,
)
from scanloom.plans.views import Views


def flagship(v: Views) -> DataFrame:
    return catalog_cells.merged_map(v)
