"""Cleaning observations: site type, activity, duplicates, units, range, region, season."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..functions import dates
from ..functions.text import layer_name, title_case, without_spaces

DUPLICATE_KEYS = ("Date", "dec_lat_va", "dec_lon_va", "value")


def is_lake_type(types: Iterable[str] = lookups.LAKE_LOCATION_TYPES) -> Column:
    return F.col("MonitoringLocationTypeName").isin(*types)


def is_routine(
    activities: Iterable[str] = lookups.ROUTINE_ACTIVITIES, media: Iterable[str] = lookups.ROUTINE_MEDIA
) -> Column:
    return F.col("ActivityTypeCode").isin(*activities) & F.col("ActivityMediaName").isin(*media)


def is_plausible(low: float = 0.0, high: float = 46.0) -> Column:
    return (F.col("secchi") > low) & (F.col("secchi") < high)


def keep_lake_sites(
    df: DataFrame, allowed: DataFrame | None = None, types: Iterable[str] = lookups.LAKE_LOCATION_TYPES
) -> DataFrame:
    """Rows of lake location types whose site is in the allow-list.

    The allow-list may hold every lake of a continent, so it is joined, and broadcast only if the planner finds it
    small.
    """
    lakes = df.where(is_lake_type(types))
    return lakes if allowed is None else lakes.join(allowed.select("wqx_id"), "wqx_id", "left_semi")


def drop_qa_activities(df: DataFrame) -> DataFrame:
    """Keeps routine activities in kept media; quality-control activities go."""
    return df.where(is_routine())


def _with_depth(df: DataFrame, factors: DataFrame | None, how: str) -> DataFrame:
    """Adds ``factor`` of the unit without its spaces, and ``secchi``; the unit itself stays as it is."""
    factors = F.broadcast(lookups.unit_factors(df.sparkSession)) if factors is None else factors
    factors = factors.select(F.col("units").alias("_unit"), "factor")
    return df.join(factors, without_spaces(F.col("units")) == F.col("_unit"), how).withColumn(
        "secchi", F.col("value") * F.col("factor")
    )


def convert_units(
    df: DataFrame, factors: DataFrame | None = None, unmatched: str = "drop", absolute: bool = True
) -> DataFrame:
    """Adds (or replaces) ``secchi``, the value in metres, and removes all spaces from the unit.

    ``unmatched='drop'`` removes rows of unknown or null unit, ``'null'`` keeps them with a null depth.
    """
    if unmatched not in ("drop", "null"):
        raise ValueError(f"unmatched must be 'drop' or 'null', not {unmatched!r}")
    converted = _with_depth(df, factors, "inner" if unmatched == "drop" else "left")
    depth = F.abs("secchi") if absolute else F.col("secchi")
    return converted.withColumns({"units": without_spaces(F.col("units")), "secchi": depth}).select(
        *[name for name in df.columns if name != "secchi"], "secchi"
    )


def plausible_range(df: DataFrame, low: float = 0.0, high: float = 46.0) -> DataFrame:
    return df.where(is_plausible(low, high))


def assign_region(
    df: DataFrame, states: DataFrame | None = None, regions: DataFrame | None = None, keep_unassigned: bool = False
) -> DataFrame:
    """Adds (or replaces) ``STATE_NAME`` and ``area`` from the state code; rows outside every region are dropped."""
    spark = df.sparkSession
    df = df.drop("STATE_NAME", "area")
    states = F.broadcast(lookups.state_names(spark)) if states is None else states
    regions = F.broadcast(lookups.state_regions(spark)) if regions is None else regions
    named = df.join(states.select(F.col("STATE").alias("StateCode"), "STATE_NAME"), "StateCode", "left")
    placed = named.join(regions.select("STATE_NAME", "area"), "STATE_NAME", "left")
    placed = placed if keep_unassigned else placed.where(F.col("area").isNotNull())
    return placed.select(*df.columns, "STATE_NAME", "area")


def date_parts(df: DataFrame, date: str = "Date") -> DataFrame:
    day = F.col(date)
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "week": dates.week_of_year(day),
            "week2": dates.week_pair(day),
        }
    )


def season(df: DataFrame, after: int = 13, before: int = 47) -> DataFrame:
    return df.where(dates.in_season(F.col("week"), after, before))


def state_layers(fips: DataFrame, resolution: str = "M") -> DataFrame:
    """One water-body layer name per state from (polyname, fips), where polyname is ``state:part``."""
    name = title_case(F.split_part(F.col("polyname"), F.lit(":"), F.lit(1)))
    code = F.lpad(F.col("fips").cast("string"), 2, "0")
    return (
        fips.select(name.alias("state_name"), code.alias("fip"))
        .distinct()
        .withColumn("layer", layer_name(F.col("state_name"), F.col("fip"), resolution))
    )


def dedupe_first(df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, order: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in the given order, nulls being equal as keys and first in the order.

    Columns not named in ``order`` break ties, so the survivor never depends on partitioning. The minimum is taken
    map-side first: a key holding a third of the table leaves one row per task before the shuffle.
    """
    rest = [name for name in df.columns if name not in (*keys, *order)]
    if not (order or rest):
        return df.distinct()
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def duplicate_count(df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS) -> DataFrame:
    """Rows beyond the first of their key, as one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


FUNNEL_STAGES = (
    "all", "lake_type", "in_waterbody", "first_of_duplicates", "routine_activity", "known_unit", "plausible_in_region",
)


def qa_funnel(
    df: DataFrame,
    allowed: DataFrame | None = None,
    order: Sequence[str] = (),
    factors: DataFrame | None = None,
    states: DataFrame | None = None,
    regions: DataFrame | None = None,
    keys: Sequence[str] = DUPLICATE_KEYS,
) -> DataFrame:
    """Rows surviving each cleaning stage and rows dropped by it, in one pass.

    Every row is flagged; a row's later stages count only if it is the first of its duplicates, so one aggregate by
    duplicate key, partial before the shuffle, serves all stages.
    """
    flagged = df.withColumn("_lake", F.coalesce(is_lake_type(), F.lit(False)))
    if allowed is None:
        flagged = flagged.withColumn("_in", F.col("_lake"))
    else:
        marks = allowed.select("wqx_id").distinct().withColumn("_mark", F.lit(True))
        flagged = flagged.join(marks, "wqx_id", "left").withColumn("_in", F.col("_lake") & F.col("_mark").isNotNull())
    flagged = _with_depth(flagged, factors, "left").withColumn("secchi", F.abs("secchi"))
    flagged = assign_region(flagged, states, regions, keep_unassigned=True)
    flagged = flagged.withColumns(
        {
            "_routine": F.coalesce(is_routine(), F.lit(False)),
            "_known": F.col("factor").isNotNull(),
            "_final": F.coalesce(is_plausible(), F.lit(False)) & F.col("area").isNotNull(),
        }
    )
    rest = [name for name in df.columns if name not in (*keys, *order)]
    first = F.min(F.when(F.col("_in"), F.struct(*order, *rest, "_routine", "_known", "_final")))
    per_key = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if("_lake").alias("n_lake"),
        F.count_if("_in").alias("n_in"),
        first.alias("f"),
    )
    kept = F.col("f").isNotNull()
    routine = kept & F.col("f._routine")
    known = routine & F.col("f._known")
    total = per_key.agg(
        F.sum("n_all").alias("s0"),
        F.sum("n_lake").alias("s1"),
        F.sum("n_in").alias("s2"),
        F.count_if(kept).alias("s3"),
        F.count_if(routine).alias("s4"),
        F.count_if(known).alias("s5"),
        F.count_if(known & F.col("f._final")).alias("s6"),
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(stage).alias("stage"),
            F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("n_rows"),
            (F.coalesce(F.col(f"s{i - 1}") - F.col(f"s{i}"), F.lit(0)) if i else F.lit(0).cast("long")).alias("dropped"),
        )
        for i, stage in enumerate(FUNNEL_STAGES)
    ]
    return total.select(F.inline(F.array(*rows)))
