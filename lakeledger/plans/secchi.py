"""Secchi depth: retrieval, cleaning and weekly quantiles by region."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..operators import paging, quality, selection, spatial, summaries

# What cleaning and the summaries after it read; everything else is pruned before duplicates are shuffled.
USED_COLUMNS = (
    "Date", "dec_lat_va", "dec_lon_va", "value", "ActivityTypeCode", "ActivityMediaName", "units", "wqx_id", "StateCode",
)


def retrieve_secchi(
    raw: DataFrame,
    sites: DataFrame,
    lo: str,
    hi: str,
    stride: str = "10 years",
    names: Iterable[str] = lookups.SECCHI_NAMES,
    site_type: str | None = lookups.LAKE_SITE_TYPE,
    states: str | Iterable[str] = "All",
    bounds: str = "closed",
) -> DataFrame:
    """Named results of one site type (None: all) in a period, normalised, with ``secchi`` in metres.

    Depths keep their sign here, and a unit outside the four retrieval units leaves a null depth. Facts meet sites
    once: the join that brings a site's columns also drops results of other sites.
    """
    chosen = selection.restricted(sites, site_type, None if states == "All" else states)
    named = raw.where(F.col("characteristicName").isin(*lookups.listed(names)))
    results = selection.normalize_results(named, chosen, how="inner")
    paged = paging.read_paged(results, lo, hi, stride, bounds).drop("page_start", "page_end")
    factors = F.broadcast(lookups.unit_factors(raw.sparkSession, lookups.RETRIEVAL_UNITS))
    return quality.convert_units(paged, factors, unmatched="null", absolute=False)


def clean_secchi(
    results: DataFrame,
    allowed: DataFrame | None = None,
    factors: DataFrame | None = None,
    states: DataFrame | None = None,
    regions: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Lake results without duplicates, quality-control rows, unknown units, implausible depths and regionless states.

    Duplicates go before quality-control rows do, so a control row that comes first takes its copy with it.
    """
    columns = list(dict.fromkeys([*USED_COLUMNS, *order]))
    lakes = quality.keep_lake_sites(results, allowed).select(*columns)
    first = quality.dedupe_first(lakes, quality.DUPLICATE_KEYS, order)
    metres = quality.convert_units(quality.drop_qa_activities(first), factors)
    return quality.date_parts(quality.assign_region(quality.plausible_range(metres), states, regions))


def retrieved_lakes(retrieved: DataFrame, waterbodies: DataFrame) -> DataFrame:
    """The allow-list of what was retrieved: sites whose mean location lies in a lake or reservoir polygon."""
    return spatial.sites_in_waterbodies(selection.site_locations(retrieved), waterbodies)


def secchi_from_raw(
    raw: DataFrame, sites: DataFrame, waterbodies: DataFrame, period: Sequence[str], **lookup_tables
) -> DataFrame:
    """From raw results to median and quartiles per week and region: retrieval, lake sites, cleaning, quantiles."""
    retrieved = retrieve_secchi(raw, sites, *period)
    return secchi_seasonality(retrieved, retrieved_lakes(retrieved, waterbodies), **lookup_tables)


def secchi_seasonality(results: DataFrame, allowed: DataFrame | None = None, **lookup_tables) -> DataFrame:
    """Median and quartiles of lake Secchi depth per in-season week and region."""
    return summaries.weekly_quantiles(clean_secchi(results, allowed, **lookup_tables))
