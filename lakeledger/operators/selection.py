"""Choosing sites and results: by constituent, site type and state."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..schema import RESULT_COLUMNS


def _wanted_sites(results: DataFrame, names: Iterable[str]) -> DataFrame:
    """Sites that hold a result of any of the names, reduced map-side before anything is joined to them."""
    return results.where(F.col("characteristicName").isin(*lookups.listed(names))).select("wqx_id").distinct()


def restricted(
    sites: DataFrame, site_type: str | Iterable[str] | None = None, states: str | Iterable[str] | None = None
) -> DataFrame:
    """Sites of one or several types and states; None stands for all."""
    if site_type is not None:
        sites = sites.where(F.col("siteType").isin(*lookups.listed(site_type)))
    if states is not None:
        sites = sites.where(F.col("StateCode").isin(*lookups.listed(states)))
    return sites


def select_sites(
    sites: DataFrame,
    results: DataFrame,
    names: Iterable[str],
    site_type: str | None = None,
    states: Iterable[str] | None = None,
) -> DataFrame:
    """Sites with at least one result of the named characteristics, as (wqx_id, lon, lat)."""
    return (
        restricted(sites, site_type, states)
        .join(_wanted_sites(results, names), "wqx_id", "left_semi")
        .select("wqx_id", F.col("dec_lon_va").alias("lon"), F.col("dec_lat_va").alias("lat"))
    )


def resolve_targets(
    results: DataFrame,
    sites: DataFrame,
    targets: Iterable[str] = lookups.MAP_TARGETS,
    constituents: Mapping[str, Iterable[str]] | None = None,
    scopes: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """The site set of every target at once, as distinct (target, wqx_id).

    Results shrink to (constituent, site) pairs first; every target is answered from those pairs.
    """
    spark = results.sparkSession
    names = lookups.constituent_names(spark, constituents or lookups.MAP_CONSTITUENTS)
    pairs = results.join(F.broadcast(names), "characteristicName").select("constituent", "wqx_id").distinct()
    typed = pairs.join(sites.select("wqx_id", "siteType"), "wqx_id")
    fits = F.col("neededType").isNull() | (F.col("neededType") == F.col("siteType"))
    return (
        typed.join(F.broadcast(lookups.map_targets(spark, targets, constituents, scopes)), "constituent")
        .where(fits)
        .select("target", "wqx_id")
        .distinct()
    )


def label_constituents(results: DataFrame, groups: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Results with the constituent group of their characteristic; a name in several groups yields several rows."""
    names = lookups.constituent_names(results.sparkSession, groups)
    return results.join(F.broadcast(names), "characteristicName")


def results_for_sites(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Results taken at any of the given sites."""
    return results.join(sites.select("wqx_id"), "wqx_id", "left_semi")


def site_results(
    results: DataFrame,
    sites: DataFrame,
    names: Iterable[str],
    site_type: str | None = lookups.LAKE_SITE_TYPE,
    states: Iterable[str] | None = None,
) -> DataFrame:
    """All results of the named characteristics at sites of one type.

    A site that holds such a result is a site with a row here, so the results themselves need no second pass.
    """
    named = results.where(F.col("characteristicName").isin(*lookups.listed(names)))
    return results_for_sites(named, restricted(sites, site_type, states))


def extract_by_state(results: DataFrame, sites: DataFrame, states: str | Iterable[str] = "All") -> DataFrame:
    """Results with ``state``, the state of their site as ``US:<code>``, for all states or the listed codes."""
    chosen = sites if states == "All" else restricted(sites, None, states)
    coded = chosen.select("wqx_id", F.concat(F.lit("US:"), F.col("StateCode")).alias("state")).distinct()
    return results.join(coded, "wqx_id")


def normalize_results(raw: DataFrame, sites: DataFrame, how: str = "left") -> DataFrame:
    """Raw service columns renamed, joined to their site and cast to the canonical result schema.

    A value that is no number becomes null. ``how='inner'`` drops results of sites that are not listed.
    """
    renamed = raw.withColumnsRenamed(
        {
            "ActivityStartDate": "Date",
            "ResultMeasureValue": "value",
            "ResultMeasure.MeasureUnitCode": "units",
            "MonitoringLocationIdentifier": "wqx_id",
        }
    )
    info = sites.select("wqx_id", "dec_lat_va", "dec_lon_va", "StateCode", "MonitoringLocationTypeName")
    casts = {
        "Date": F.col("Date").try_cast("date"),
        "value": F.col("value").try_cast("double"),
        **{
            name: F.col(name).cast("string")
            for name in (
                "StateCode", "ActivityTypeCode", "ActivityMediaName", "ResultStatusIdentifier",
                "MonitoringLocationTypeName",
            )
        },
    }
    return renamed.join(info, "wqx_id", how).withColumns(casts).select(*RESULT_COLUMNS)


def site_locations(results: DataFrame) -> DataFrame:
    """Mean coordinates of each site, ignoring nulls; sites without a coordinate are dropped.

    Where all results of a site agree its coordinate is taken as it is: a sum over many rows would move it by
    rounding, and a site on a polygon's edge with it.
    """

    def mean(name: str) -> Column:
        return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.avg(name))

    return (
        results.groupBy("wqx_id")
        .agg(mean("dec_lat_va").alias("lat"), mean("dec_lon_va").alias("lon"))
        .dropna(subset=["lat", "lon"])
    )
