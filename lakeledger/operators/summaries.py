"""Summaries of cleaned Secchi depths by region, state and week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..functions.text import interval_text
from .quality import season
from .quantiles import exact_quantiles, roll_up, value_counts

QUARTILES = {"med": 0.5, "q25": 0.25, "q75": 0.75}


def region_summary(df: DataFrame, site: str = "wqx_id") -> DataFrame:
    """Sites, records, median and quartiles per region and, where ``area`` is null, over all of them."""
    per_site = df.groupBy("area", site).agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.col("area"), F.lit(None).cast("string")))
    sizes = (
        per_site.select(both.alias("area"), site, "n")
        .groupBy("area", site)
        .agg(F.sum("n").alias("n"))
        .groupBy("area")
        .agg(F.count(site).alias("nSites"), F.sum("n").alias("nRecords"))
    )
    counts = roll_up(value_counts(df, ["area"], "secchi"), ["area"], "secchi", away=["area"])
    depths = exact_quantiles(counts, ["area"], "secchi", QUARTILES)
    s, d = sizes.alias("s"), depths.alias("d")
    return s.join(d, F.col("s.area").eqNullSafe(F.col("d.area")), "left").select(
        "s.area", "nSites", "nRecords", "med", "q25", "q75", interval_text(F.col("q25"), F.col("q75")).alias("IQR")
    )


def state_counts(df: DataFrame, states: DataFrame | None = None, state: str = "StateCode") -> DataFrame:
    """Records per state with the state's name, most first."""
    states = F.broadcast(lookups.state_names(df.sparkSession)) if states is None else states
    counts = (
        df.where(F.col(state).isNotNull()).groupBy(F.col(state).alias("STATE")).agg(F.count(F.lit(1)).alias("Freq"))
    )
    return (
        counts.join(states.select("STATE", "STATE_NAME"), "STATE", "left")
        .select("STATE", "Freq", "STATE_NAME")
        .orderBy(F.desc("Freq"), "STATE")
    )


def _of_listed(df: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Fails on a row of a region that has no column, instead of leaving the row out."""
    message = F.concat(F.lit("no column for region "), F.col("area"))
    unlisted = F.col("area").isNotNull() & ~F.col("area").isin(*areas)
    return df.withColumn("area", F.when(unlisted, F.raise_error(message)).otherwise(F.col("area")))


def weekly_record_counts(df: DataFrame, areas: Sequence[str] = tuple(sorted(lookups.REGION_STATES))) -> DataFrame:
    """In-season records per week, one column per region; a week without records in a region is null there.

    A row of a region that ``areas`` does not list is an error.
    """
    tally = _of_listed(season(df), areas).groupBy("week", "area").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy("week").pivot("area", list(areas)).agg(F.first("n")).orderBy("week")


def weekly_site_counts(
    df: DataFrame, areas: Sequence[str] = tuple(sorted(lookups.REGION_STATES)), site: str = "wqx_id"
) -> DataFrame:
    """As ``weekly_record_counts`` for distinct sites."""
    tally = _of_listed(season(df), areas).groupBy("week", "area").agg(F.countDistinct(site).alias("n"))
    return tally.groupBy("week").pivot("area", list(areas)).agg(F.first("n")).orderBy("week")


def weekly_quantiles(df: DataFrame) -> DataFrame:
    """Median and quartiles per in-season week and region."""
    counts = value_counts(season(df), ["week", "area"], "secchi")
    return exact_quantiles(counts, ["week", "area"], "secchi", QUARTILES)
