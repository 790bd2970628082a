"""Weekly series by geography and their smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.smoothing import median_of_three, stages_3rs3r
from .quantiles import exact_quantiles, roll_up, value_counts


def weekly_median_by_geography(results: DataFrame, assigned: DataFrame, regions: DataFrame) -> DataFrame:
    """Median depth per region and week, and per region where ``week`` is null.

    ``assigned`` holds (wqx_id, poly_id), ``regions`` (poly_id, area). A result counts once per region of its site.
    """
    members = _members(assigned, regions)
    depths = results.select("wqx_id", "week", "secchi").join(members, "wqx_id")
    counts = roll_up(value_counts(depths, ["area", "week"], "secchi"), ["area", "week"], "secchi", away=["week"])
    return exact_quantiles(counts, ["area", "week"], "secchi", {"med": 0.5})


def daily_median_by_geography(results: DataFrame, assigned: DataFrame, regions: DataFrame) -> DataFrame:
    """Median depth per region and ``Date``; tables as for ``weekly_median_by_geography``."""
    depths = results.select("wqx_id", "Date", "secchi").join(_members(assigned, regions), "wqx_id")
    return exact_quantiles(value_counts(depths, ["area", "Date"], "secchi"), ["area", "Date"], "secchi", {"med": 0.5})


def _members(assigned: DataFrame, regions: DataFrame) -> DataFrame:
    """(wqx_id, area), once for each region of a site."""
    named = regions.select("poly_id", "area").where(F.col("area").isNotNull())
    return assigned.join(named, "poly_id").select("wqx_id", "area").distinct()


def smooth3(series: DataFrame, keys: Sequence[str], position: str = "week", value: str = "med") -> DataFrame:
    """One pass of the running median of three; the ends of a series are copied."""
    w = Window.partitionBy(*keys).orderBy(position)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    inner = median_of_three(before, F.col(value), after)
    return series.where(F.col(value).isNotNull()).withColumn(
        "smooth", F.when(before.isNull() | after.isNull(), F.col(value)).otherwise(inner)
    )


def tukey_smooth(series: DataFrame, keys: Sequence[str], position: str = "week", value: str = "med") -> DataFrame:
    """Tukey's 3RS3R smoother per series; null values are dropped first.

    A series is one value per week of the year, so the array that carries it has at most 53 entries.
    """
    path = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("double").alias("v"))))
    out = (
        series.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(path.alias("_path"))
        .withColumn("_series", F.transform("_path", lambda e: e["v"]))
    )
    for name, step in stages_3rs3r(F.col("_series")):
        out = out.withColumn(name, step)
    smooth = F.when(F.size("_series") < 3, F.col("_series")).otherwise(F.col("_smooth"))
    return out.select(*keys, F.inline(F.arrays_zip("_path", smooth.alias("smooth")))).select(
        *keys, F.col("_path.p").alias(position), F.col("_path.v").alias(value), "smooth"
    )
