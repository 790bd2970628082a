"""Record inventory: share of site groups per characteristic and the trend over years."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import lookups
from ..operators import inventory
from ..sources.tables import kept


def yearly_counts(counts: DataFrame, start: int, end: int) -> DataFrame:
    """The full grid of units and years from sparse counts, zero where nothing was counted."""
    units = lookups.required_units(counts.sparkSession)
    return inventory.fill_counts(inventory.count_grid(counts, units, start, end))


def bar_table(counts: DataFrame, **style) -> DataFrame:
    """Shares per display type and site group, with the order to draw them in."""
    return inventory.display_order(inventory.records_share(counts, **style))


def trend_table(counts: DataFrame, start: int, end: int) -> DataFrame:
    """Yearly series per display type with the panel order of the bars.

    Both are made of one row a unit and year, kept in the shared folder so that the observations are read once.
    """
    counts = kept(counts, "unit-years")
    panels = bar_table(counts).select("display_charType", "panel_rank").distinct()
    return inventory.yearly_trend(counts, start, end).join(panels, "display_charType", "left")
