"""Site maps, lake membership and weekly series by geography."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..operators import long_series, quality, seasonal, selection, spatial


def lake_site_ids(results: DataFrame, waterbodies: DataFrame) -> DataFrame:
    """Allow-list of the sites of ``results`` whose mean location is inside a lake or reservoir polygon."""
    return spatial.sites_in_waterbodies(selection.site_locations(results), waterbodies)


def projected_sites(sites: DataFrame) -> DataFrame:
    """(wqx_id, x, y) in metres."""
    placed = sites.select("wqx_id", F.col("dec_lon_va").alias("lon"), F.col("dec_lat_va").alias("lat"))
    return spatial.project_2163(placed).select("wqx_id", "x", "y")


def projected_polygons(vertices: DataFrame) -> DataFrame:
    """Polygons with their corners in metres, from corners in degrees."""
    moved = spatial.project_2163(vertices, "x", "y", "px", "py")
    return spatial.polygon_edges(moved, x="px", y="py")


def density_panel(
    results: DataFrame, sites: DataFrame, vertices: DataFrame, targets: Sequence[str] = lookups.PANEL_TARGETS
) -> DataFrame:
    """Sites per polygon and their class for each constituent, lakes and all sites."""
    chosen = selection.resolve_targets(results, sites, targets)
    return spatial.site_density_panel(chosen, projected_sites(sites), projected_polygons(vertices), targets)


def seasonal_by_geography(
    results: DataFrame, sites: DataFrame, polygons: DataFrame, regions: DataFrame, factors: DataFrame | None = None
) -> DataFrame:
    """Weekly and overall median depth per region, a site's state being the polygon it lies in."""
    depths = quality.date_parts(quality.convert_units(results, factors))
    points = sites.select("wqx_id", F.col("dec_lon_va").alias("lon"), F.col("dec_lat_va").alias("lat"))
    return seasonal.weekly_median_by_geography(depths, spatial.assign_polygon(points, polygons), regions)


def daily_by_geography(
    results: DataFrame, sites: DataFrame, polygons: DataFrame, regions: DataFrame, factors: DataFrame | None = None
) -> DataFrame:
    """Median depth per region and day of all years with its smoothed line."""
    depths = quality.convert_units(results, factors)
    points = sites.select("wqx_id", F.col("dec_lon_va").alias("lon"), F.col("dec_lat_va").alias("lat"))
    daily = seasonal.daily_median_by_geography(depths, spatial.assign_polygon(points, polygons), regions)
    return long_series.tukey_smooth_long(daily, ["area"])


def geography_from_results(
    results: DataFrame, sites: DataFrame, polygons: DataFrame, regions: DataFrame, factors: DataFrame | None = None
) -> DataFrame:
    """Weekly and overall median of named Secchi results at lake sites, per region of the polygon a site lies in."""
    named = selection.site_results(results, sites, lookups.SECCHI_NAMES)
    return seasonal_by_geography(selection.extract_by_state(named, sites), sites, polygons, regions, factors)


def smoothed_by_geography(weekly: DataFrame) -> DataFrame:
    """The weekly medians with their smoothed line; the overall median of a region is left out."""
    return seasonal.tukey_smooth(weekly.where(F.col("week").isNotNull()), ["area"])
