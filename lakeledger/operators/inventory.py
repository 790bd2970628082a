"""How many sites and results exist per characteristic, site type and year; shares and trends of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lookups
from ..functions.text import count_label
from ..schema import COUNT_SCHEMA
from ..sources.tables import kept, read_csv_if_exists, read_if_exists, write_csv

UNIT = ["characteristicType", "siteType"]


def summary_counts(results: DataFrame, date: str = "Date", site: str = "wqx_id") -> DataFrame:
    """Distinct sites and results per characteristic type, site type and calendar year."""
    return results.groupBy(*UNIT, F.year(date).alias("startYear")).agg(
        F.countDistinct(site).alias("numSites"), F.count(F.lit(1)).alias("numResults")
    )


def count_grid(counts: DataFrame, units: DataFrame, start: int, end: int) -> DataFrame:
    """One row per unit and year ``start..end`` inclusive, with null counts where nothing was counted.

    ``units`` lists the (characteristic type, site type) pairs; years unfold from a sequence, not from a join.
    """
    years = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("startYear")
    return (
        units.select(*UNIT, years)
        .join(counts, [*UNIT, "startYear"], "left")
        .select(
            *UNIT,
            F.make_date("startYear", F.lit(1), F.lit(1)).alias("startDate"),
            F.make_date("startYear", F.lit(12), F.lit(31)).alias("endDate"),
            "numSites",
            "numResults",
        )
        .orderBy(*UNIT, "startDate")
    )


def fill_counts(counts: DataFrame) -> DataFrame:
    return counts.fillna(0, ["numSites", "numResults"])


def missing_units(units: DataFrame, finished: DataFrame) -> DataFrame:
    """Units that still have to be counted."""
    return units.join(finished.select(*UNIT).distinct(), UNIT, "left_anti")


def incomplete_units(units: DataFrame, cached: DataFrame, start: int, end: int) -> DataFrame:
    """Units of which ``cached`` lacks any year ``start..end``."""
    years = cached.select(*UNIT, F.year("startDate").alias("y")).where(F.col("y").between(start, end)).distinct()
    whole = years.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == end - start + 1)
    return missing_units(units, whole)


def incremental_counts(
    results: DataFrame,
    cache_path: str,
    table_path: str,
    start: int,
    end: int,
    char_types: Iterable[str] = lookups.CHARACTERISTIC_TYPES,
    site_types: Iterable[str] = lookups.SITE_TYPES,
    force: bool = False,
) -> bool:
    """Count the units whose years the cache lacks, then write the whole table once every unit is there.

    A table that covers the request already is left as it is, unless ``force``, which counts everything anew. The cache
    is Parquet partitioned by unit, replaced unit by unit; an interrupted run goes on where it stopped. Years of a unit
    that the cache has beyond the request are counted again with the rest, so they stay in it. Returns whether the
    table covers the request.
    """
    spark = results.sparkSession
    units = lookups.required_units(spark, char_types, site_types)
    period = (F.year("startDate") >= start) & (F.year("startDate") <= end)
    table = None if force else read_csv_if_exists(spark, table_path, COUNT_SCHEMA)
    if table is not None and incomplete_units(units, table, start, end).isEmpty():
        return True
    cached = None if force else read_if_exists(spark, cache_path, COUNT_SCHEMA)
    todo, first, last = units, start, end
    if cached is not None:
        todo = incomplete_units(units, cached, start, end)
        span = cached.agg(F.min(F.year("startDate")), F.max(F.year("startDate"))).first()
        first, last = min([start, *span[:1]], default=start), max([end, *span[1:]], default=end)
    if cached is None or not todo.isEmpty():
        counts = summary_counts(_in_years(results, first, last).join(F.broadcast(todo), UNIT, "left_semi"))
        _replace_units(count_grid(counts, todo, first, last), cache_path)

    complete = read_if_exists(spark, cache_path, COUNT_SCHEMA).where(period).join(F.broadcast(units), UNIT, "left_semi")
    if not incomplete_units(units, complete, start, end).isEmpty():
        return False
    write_csv(complete.select(*COUNT_SCHEMA.fieldNames()).orderBy(*UNIT, "startDate"), table_path, mode="overwrite")
    return True


def _in_years(results: DataFrame, first: int, last: int) -> DataFrame:
    start, end = (F.make_date(F.lit(year), F.lit(1), F.lit(1)) for year in (first, last + 1))
    return results.where((F.col("Date") >= start) & (F.col("Date") < end))


def _replace_units(rows: DataFrame, path: str) -> None:
    write = rows.repartition(*UNIT).write.option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT)
    write.parquet(path, mode="overwrite")


DIGEST_SCHEMA = T.StructType([
    T.StructField("characteristicType", T.StringType()), T.StructField("siteType", T.StringType()),
    T.StructField("startYear", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("digest", T.DecimalType(38, 0)),
])


def unit_digests(results: DataFrame, columns: Iterable[str] = ("wqx_id",)) -> DataFrame:
    """Per unit and year the number of results and the sum of a hash of ``columns``, whatever order the rows come in.

    The default names what counts depend on beside unit and year. Where a null stands is part of the hash. Two sets of
    rows with one number and one sum are taken for equal: a chance of about 1 in 2^64 for each unit and year.
    """
    fields = [F.col(name) for name in columns]
    row = F.xxhash64(*fields, *[field.isNull() for field in fields]).cast("decimal(28,0)")
    return results.groupBy(*UNIT, F.year("Date").alias("startYear")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row).cast("decimal(38,0)").alias("digest")
    )


def refresh_counts(
    results: DataFrame,
    cache_path: str,
    start: int,
    end: int,
    char_types: Iterable[str] = lookups.CHARACTERISTIC_TYPES,
    site_types: Iterable[str] = lookups.SITE_TYPES,
) -> DataFrame:
    """Bring the cache of counts at ``cache_path`` up to date and return the units that were counted anew.

    The cache is that of ``incremental_counts``, with the digests of its input beside it (``-digests``): each run appends
    by how much they changed, and their sum is what was counted. Units are counted of which a year ``start..end`` is missing,
    which have no digest, or of which facts came late or were withdrawn: of these the digests differ. They take one pass
    over (unit, date, site) that leaves a row a unit and year and task; other units are neither counted nor written. Counts
    are written before digests, so a run cut off between them counts the same units again. Years the cache has beyond the
    request stay in it and are kept up to date with the rest.
    """
    spark = results.sparkSession
    units = lookups.required_units(spark, char_types, site_types)
    digest_path = f"{cache_path.rstrip('/')}-digests"
    cached = read_if_exists(spark, cache_path, COUNT_SCHEMA)
    stored = read_if_exists(spark, digest_path, DIGEST_SCHEMA)
    first, last, todo = start, end, units
    if cached is not None:
        span = cached.agg(F.min(F.year("startDate")), F.max(F.year("startDate"))).first()
        first, last = min([start, *[y for y in span[:1] if y is not None]]), max([end, *[y for y in span[1:] if y is not None]])
        todo = incomplete_units(units, cached, first, last)
    asked = _in_years(results, first, last).join(F.broadcast(units), UNIT, "left_semi")
    deltas, unknown = unit_digests(asked), units
    if stored is not None:
        old = stored.join(F.broadcast(units), UNIT, "left_semi").select(*UNIT, "startYear", -F.col("n"), -F.col("digest"))
        deltas = deltas.union(old).groupBy(*UNIT, "startYear").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
        deltas, unknown = deltas.where("n <> 0 OR digest <> 0"), missing_units(units, stored)
    # a unit without facts is known by a row of year 0
    empty = unknown.select(*UNIT, F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)"))
    deltas = kept(deltas.select(*DIGEST_SCHEMA.fieldNames()).union(empty).coalesce(1), "digests")
    todo = kept(todo.union(deltas.select(*UNIT)).distinct().coalesce(1), "recounted")
    if not todo.isEmpty():
        counts = summary_counts(asked.join(F.broadcast(todo), UNIT, "left_semi"))
        _replace_units(count_grid(counts, todo, first, last), cache_path)
        deltas.coalesce(1).write.parquet(digest_path, mode="append")
    return todo


def display_category(
    df: DataFrame, kinds: DataFrame | None = None, sites: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """Adds ``display_charType`` and ``display_siteType``; an unknown type fails, or is null if not strict."""
    spark = df.sparkSession
    kinds = F.broadcast(lookups.display_characteristics(spark)) if kinds is None else kinds
    sites = F.broadcast(lookups.display_sites(spark)) if sites is None else sites
    shown = df.join(kinds, "characteristicType", "left").join(sites, "siteType", "left")

    def known(shown_as: str, source: str) -> Column:
        column = F.col(shown_as)
        if not strict:
            return column
        message = F.concat(F.lit(f"no display name for {source} "), F.coalesce(F.col(source), F.lit("null")))
        return F.when(column.isNull(), F.raise_error(message)).otherwise(column)

    return shown.select(
        *df.columns,
        known("display_charType", "characteristicType").alias("display_charType"),
        known("display_siteType", "siteType").alias("display_siteType"),
    )


def records_share(
    counts: DataFrame, total_includes_unassigned: bool = False, plain_label: bool = False
) -> DataFrame:
    """Results per display type and site group, with the type's total, the percentage and a label.

    Adds a ``Total`` type over all others. Counts are summed to display groups before anything else, so all
    later steps see at most 15 types x 6 groups.
    """
    shown = display_category(fill_counts(counts)).where(F.col("display_siteType") != "NA")
    grouped = shown.groupBy("display_charType", "display_siteType").agg(F.sum("numResults").alias("n"))
    unassigned = F.col("display_charType") == "NA"
    series = F.array(F.col("display_charType"), F.lit("Total"))
    if total_includes_unassigned:
        series = F.when(unassigned, F.array(F.lit("Total"))).otherwise(series)
    else:
        grouped = grouped.where(~unassigned)
    totals = F.sum("numResults_siteType").over(Window.partitionBy("display_charType"))
    return (
        grouped.select(F.explode(series).alias("display_charType"), "display_siteType", "n")
        .groupBy("display_charType", "display_siteType")
        .agg(F.sum("n").alias("numResults_siteType"))
        .withColumn("totalnumResults", totals)
        .withColumn(
            "percentResults", F.try_divide(F.col("numResults_siteType"), F.col("totalnumResults")) * 100
        )
        .withColumn("charTypeLabels", count_label(F.col("display_charType"), F.col("totalnumResults"), plain_label))
    )


def yearly_trend(counts: DataFrame, start: int, end: int) -> DataFrame:
    """Sites and results per display type and year, ``start <= year < end``, plus a ``Total`` series."""
    year = F.year("startDate")
    shown = display_category(fill_counts(counts).where((year >= start) & (year < end)))
    grouped = (
        shown.where((F.col("characteristicType") != "Not Assigned") & (F.col("display_charType") != "NA"))
        .groupBy("display_charType", year.alias("year"))
        .agg(F.sum("numSites").alias("numSites"), F.sum("numResults").alias("numResults"))
    )
    return (
        grouped.withColumn("display_charType", F.explode(F.array(F.col("display_charType"), F.lit("Total"))))
        .groupBy("display_charType", "year")
        .agg(F.sum("numSites").alias("numSites"), F.sum("numResults").alias("numResults"))
    )


def display_order(share: DataFrame) -> DataFrame:
    """Adds the drawing order of bars (``bar_rank``), panels (``panel_rank``) and site groups (``site_rank``).

    Bars ascend by total, ties by name; panels run the other way round after ``Total``, which is 0.
    """
    spark = share.sparkSession
    sites = lookups.literal_frame(
        spark,
        [(name, rank) for rank, name in enumerate(lookups.DISPLAY_SITE_ORDER, 1)],
        display_siteType="string", site_rank="int",
    )
    # At most 15 display types, so one window over all of them is small by construction.
    by_total = Window.orderBy("totalnumResults", "display_charType")
    by_rank = Window.orderBy(F.col("display_charType") != "Total", F.desc("bar_rank"))
    ranks = (
        share.select("display_charType", "totalnumResults")
        .distinct()
        .select("display_charType", F.row_number().over(by_total).alias("bar_rank"))
        .withColumn("panel_rank", F.row_number().over(by_rank) - F.lit(1))
    )
    return (
        share.join(ranks, "display_charType")
        .join(F.broadcast(sites), "display_siteType", "left")
        .select(*share.columns, "bar_rank", "panel_rank", "site_rank")
    )
