"""Extraction of named constituent groups at lake sites."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from .. import lookups
from ..operators import selection


def constituent_results(
    results: DataFrame,
    sites: DataFrame,
    groups: Mapping[str, Iterable[str]] | None = None,
    site_type: str | None = lookups.LAKE_SITE_TYPE,
    states: Iterable[str] | None = None,
) -> DataFrame:
    """All results of the groups' characteristics at sites of one type, labelled with their group."""
    groups = groups or lookups.CONSTITUENT_GROUPS
    names = sorted({name for members in groups.values() for name in lookups.listed(members)})
    found = selection.site_results(results, sites, names, site_type, states)
    return selection.label_constituents(found, groups)
