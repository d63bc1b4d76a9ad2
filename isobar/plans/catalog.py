"""All queries of the storm engine by name."""

from isobar.plans import climate_queries, grid_queries, lifecycle_queries, mask_queries, moisture_queries, precip_queries, raster_queries, scalar_queries, source_queries, track_queries  # noqa: F401
from isobar.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
