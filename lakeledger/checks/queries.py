"""One query per operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lookups
from ..operators import inventory, merging, paging, quality, seasonal, selection, spatial, summaries
from ..plans import constituents, geography, secchi
from ..plans import inventory as inventory_plan
from ..schema import COUNT_SCHEMA
from ..sources import tables
from ..sources.star import PAGE_LENGTH, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[build.__name__] = lambda spark, directory: build(Star(spark, directory))
    return build


# --- shared inputs --------------------------------------------------------------------------------------------


def _points(star: Star) -> DataFrame:
    return star.sites().select("wqx_id", F.col("dec_lon_va").alias("lon"), F.col("dec_lat_va").alias("lat"))


def _polygons(star: Star) -> DataFrame:
    return spatial.polygon_edges(star.vertices(), keep=["ftype"])


def _allowed(star: Star) -> DataFrame:
    return spatial.sites_in_waterbodies(_points(star), _polygons(star))


def _lookup_tables(star: Star) -> dict[str, DataFrame]:
    return {"factors": star.units(), "states": star.state_names(), "regions": star.state_regions()}


def _clean(star: Star) -> DataFrame:
    return secchi.clean_secchi(star.results(), _allowed(star), **_lookup_tables(star))


def _grid(star: Star) -> DataFrame:
    return inventory.count_grid(star.counts(), lookups.required_units(star.spark), *star.years())


def _filled(star: Star) -> DataFrame:
    return inventory_plan.yearly_counts(star.counts(), *star.years())


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- sources, selection, ingestion ----------------------------------------------------------------------------


@query
def select_sites(star: Star) -> DataFrame:
    return selection.select_sites(
        star.sites(), star.results(), lookups.TEMPERATURE_NAMES, site_type=lookups.LAKE_SITE_TYPE
    )


@query
def target_sites(star: Star) -> DataFrame:
    return selection.resolve_targets(star.results(), star.sites())


@query
def target_sites_config(star: Star) -> DataFrame:
    """Targets given in the shape of a parsed configuration file."""
    constituents = {"phosphorus": {"characteristicName": "Phosphorus"}, "ph": {"characteristicName": ["pH"]}}
    scopes = {"lakes": {"siteType": lookups.LAKE_SITE_TYPE}, "all": None}
    targets = ["phosphorus_lakes", "phosphorus_all", "ph_lakes"]
    return selection.resolve_targets(star.results(), star.sites(), targets, constituents, scopes)


@query
def constituent_counts(star: Star) -> DataFrame:
    found = constituents.constituent_results(star.results(), star.sites())
    return found.groupBy("constituent", "StateCode").agg(
        F.countDistinct("wqx_id").alias("n_sites"), F.count(F.lit(1)).alias("n_results")
    )


@query
def page_windows(star: Star) -> DataFrame:
    """Pages of two years over the calendar years the data covers, with the results dated on each page."""
    years = star.table("lineitem").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b"))
    period = years.select(F.make_date("a", F.lit(1), F.lit(1)).alias("lo"), F.make_date(F.col("b") + 1, F.lit(1), F.lit(1)).alias("hi"))
    return paging.page_windows(period, PAGE_LENGTH).select("page", "start", "end")


@query
def paged_rows(star: Star) -> DataFrame:
    return paging.read_paged(star.results(), *star.period())


@query
def paged_rows_half_open(star: Star) -> DataFrame:
    return paging.read_paged(star.results(), *star.period(), bounds="half_open")


@query
def paged_rows_hourly(star: Star) -> DataFrame:
    events = star.table("events").select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "value")
    lo, hi = events.agg(F.min(F.to_date("minute")).cast("string"), F.date_add(F.max(F.to_date("minute")), 1).cast("string")).first()
    return paging.read_paged(events, lo, hi, "1 hour", date="minute")


@query
def normalize_results(star: Star) -> DataFrame:
    return selection.normalize_results(star.raw_results(), star.sites())


@query
def retrieve_secchi(star: Star) -> DataFrame:
    return secchi.retrieve_secchi(star.raw_results(), star.sites(), *star.period())


@query
def extract_by_state(star: Star) -> DataFrame:
    return selection.extract_by_state(star.results(), star.sites())


@query
def site_results(star: Star) -> DataFrame:
    return selection.site_results(star.results(), star.sites(), lookups.CONSTITUENT_GROUPS["phosphorus"])


@query
def summary_counts(star: Star) -> DataFrame:
    return inventory.summary_counts(star.results())


@query
def count_grid(star: Star) -> DataFrame:
    return _grid(star)


@query
def missing_units(star: Star) -> DataFrame:
    return inventory.missing_units(lookups.required_units(star.spark), star.counts())


@query
def incremental_counts(star: Star) -> DataFrame:
    """The table of a resumable run: first the organics, then everything that is missing."""
    cache = tables.scratch_path(star.spark, "count-units")
    table = tables.scratch_path(star.spark, "count-table")
    results = star.results()
    first, last = star.years()
    inventory.incremental_counts(results, cache, table, first, last, char_types="Organics, Pesticide")
    inventory.incremental_counts(results, cache, table, first, last)
    return tables.read_csv(star.spark, table)


@query
def incremental_counts_extended(star: Star) -> DataFrame:
    """A table of three years extended to all years on the same cache."""
    cache = tables.scratch_path(star.spark, "count-units")
    table = tables.scratch_path(star.spark, "count-table")
    results = star.results()
    first, last = star.years()
    inventory.incremental_counts(results, cache, table, first + 1, first + 3)
    inventory.incremental_counts(results, cache, table, first, last)
    return tables.read_csv(star.spark, table)


@query
def incremental_counts_changed(star: Star) -> DataFrame:
    """Counts after facts of one unit came late and facts of another were withdrawn, and which units were counted anew."""
    cache = tables.scratch_path(star.spark, "count-units")
    results = star.results()
    first, last = star.years()
    year = F.year("Date")
    late = (F.col("characteristicType") == "Nutrient") & (F.col("siteType") == "Stream") & (year == last)
    withdrawn = (F.col("characteristicType") == "Physical") & (F.col("siteType") == "Well") & (year == first)
    inventory.refresh_counts(results.where(~late).union(results.where(withdrawn)), cache, first, last)
    again = inventory.refresh_counts(results, cache, first, last).withColumn("recounted", F.lit(True))
    counts = tables.read_snapshot(star.spark, cache, COUNT_SCHEMA)
    return counts.join(F.broadcast(again), inventory.UNIT, "left").fillna(False, ["recounted"])


@query
def merged_counts(star: Star) -> DataFrame:
    """Counts of three batches that were counted one by one; two share a year."""
    state = tables.scratch_path(star.spark, "count-state")
    results = star.results()
    first, last = star.years()
    border, month = f"{(first + last) // 2}-07-01", f"{(first + last) // 2}-08-01"
    merging.append_counts(results.where(F.col("Date") < border), state, "history")
    merging.append_counts(results.where((F.col("Date") >= border) & (F.col("Date") < month)), state, "month")
    merging.append_counts(results.where(F.col("Date") >= month), state, "rest")
    return merging.merged_counts(star.spark, state)


@query
def csv_roundtrip(star: Star) -> DataFrame:
    path = tables.scratch_path(star.spark, "counts-csv")
    tables.write_csv(_grid(star), path)
    return tables.read_csv(star.spark, path)


#: Lines of a supplier table of which some are malformed: in a number, in length, in a quote.
SUPPLIER_LINE = """CASE s_suppkey % 10
    WHEN 3 THEN concat_ws(',', concat('n', s_suppkey), s_name, s_nationkey)
    WHEN 5 THEN concat_ws(',', s_suppkey, s_name)
    WHEN 7 THEN concat_ws(',', concat('"', s_suppkey), s_name, s_nationkey)
    ELSE concat_ws(',', s_suppkey, s_name, s_nationkey) END"""


@query
def csv_rejects(star: Star) -> DataFrame:
    path = tables.scratch_path(star.spark, "supplier-csv")
    star.table("supplier").selectExpr(f"{SUPPLIER_LINE} AS line").write.text(path)
    schema = T.StructType().add("s_suppkey", "long").add("s_name", "string").add("s_nationkey", "long")
    good, rejects = tables.read_csv_checked(star.spark, path, schema, header=False)
    fitting = good.select(F.concat_ws(",", *schema.names).alias("line"), F.lit(None).cast("string").alias("reason"))
    return fitting.unionByName(rejects.select("line", "reason"))


@query
def parquet_roundtrip(star: Star) -> DataFrame:
    path = tables.scratch_path(star.spark, "counts-parquet")
    tables.write_snapshot(_grid(star), path)
    return tables.read_snapshot(star.spark, path, COUNT_SCHEMA)


@query
def region_from_snapshot(star: Star) -> DataFrame:
    """Results of a box, read from a snapshot along a curve through place and time."""
    path = tables.scratch_path(star.spark, "results-clustered")
    results = star.results().select("Date", "value", "wqx_id", "dec_lon_va", "dec_lat_va")
    tables.write_clustered(results, path, ["dec_lon_va", "dec_lat_va", "Date"], files=64)
    return tables.read_region(star.spark, path, {"dec_lon_va": (-112.0, -96.0), "dec_lat_va": (30.0, 38.0)}, results.schema)


# --- projections, filters, scalar expressions -----------------------------------------------------------------


@query
def category_counts(star: Star) -> DataFrame:
    shown = inventory.display_category(star.counts())
    return shown.groupBy("display_charType", "display_siteType").agg(
        F.sum("numSites").alias("numSites"), F.sum("numResults").alias("numResults")
    )


@query
def fill_counts(star: Star) -> DataFrame:
    return inventory.fill_counts(_grid(star))


@query
def keep_lake_sites(star: Star) -> DataFrame:
    return quality.keep_lake_sites(star.results(), _allowed(star))


@query
def qa_activities(star: Star) -> DataFrame:
    return quality.drop_qa_activities(star.results())


@query
def convert_units(star: Star) -> DataFrame:
    return _rounded(quality.convert_units(star.results(), star.units()), 6, "secchi")


@query
def convert_units_keep_unmatched(star: Star) -> DataFrame:
    factors = lookups.unit_factors(star.spark, lookups.RETRIEVAL_UNITS)
    return _rounded(quality.convert_units(star.results(), factors, unmatched="null", absolute=False), 6, "secchi")


@query
def plausible_range(star: Star) -> DataFrame:
    metres = quality.convert_units(star.results(), star.units())
    return _rounded(quality.plausible_range(metres), 6, "secchi")


@query
def region_rows(star: Star) -> DataFrame:
    return quality.assign_region(star.results(), star.state_names(), star.state_regions())


@query
def date_parts(star: Star) -> DataFrame:
    return quality.date_parts(star.results().select("Date", "wqx_id", "value"))


@query
def season(star: Star) -> DataFrame:
    return quality.season(quality.date_parts(star.results().select("Date", "wqx_id", "value")))


@query
def site_locations(star: Star) -> DataFrame:
    return _rounded(selection.site_locations(star.results()), 6, "lat", "lon")


@query
def state_layers(star: Star) -> DataFrame:
    """Layer names of every state a site lies in, each state coming in two parts."""
    key = F.col("c_nationkey")
    names = star.table("customer").select(
        F.explode(
            F.array(*[F.concat(F.lit("nation "), key.cast("string"), F.lit(part)) for part in (":main", ":island")])
        ).alias("polyname"),
        key.alias("fips"),
    )
    return quality.state_layers(names)


# --- duplicates -----------------------------------------------------------------------------------------------


@query
def dedupe_first(star: Star) -> DataFrame:
    events = star.table("events").select(F.col("ts").cast("date").alias("day"), "user_id", "event_type", "event_id", "value")
    return quality.dedupe_first(events, ["day", "user_id", "event_type"], ["event_id"])


@query
def dedupe_results(star: Star) -> DataFrame:
    return quality.dedupe_first(star.results().select(*secchi.USED_COLUMNS))


@query
def duplicate_count(star: Star) -> DataFrame:
    return quality.duplicate_count(quality.keep_lake_sites(star.results(), _allowed(star)))


# --- aggregations ---------------------------------------------------------------------------------------------


@query
def qa_funnel(star: Star) -> DataFrame:
    results = star.results().select("MonitoringLocationTypeName", *secchi.USED_COLUMNS)
    return quality.qa_funnel(results, _allowed(star), secchi.USED_COLUMNS[4:], **_lookup_tables(star))


@query
def region_summary(star: Star) -> DataFrame:
    return _rounded(summaries.region_summary(_clean(star)), 6, "med", "q25", "q75")


@query
def state_counts(star: Star) -> DataFrame:
    return summaries.state_counts(_clean(star), star.state_names())


@query
def weekly_record_counts(star: Star) -> DataFrame:
    return summaries.weekly_record_counts(_clean(star), star.region_names())


@query
def weekly_site_counts(star: Star) -> DataFrame:
    return summaries.weekly_site_counts(_clean(star), star.region_names())


@query
def weekly_quantiles(star: Star) -> DataFrame:
    return _rounded(summaries.weekly_quantiles(_clean(star)), 6, "med", "q25", "q75")


@query
def records_share(star: Star) -> DataFrame:
    return _rounded(inventory.records_share(_filled(star)), 6, "percentResults")


@query
def records_share_with_unassigned(star: Star) -> DataFrame:
    share = inventory.records_share(_filled(star), total_includes_unassigned=True, plain_label=True)
    return _rounded(share, 6, "percentResults")


@query
def yearly_trend(star: Star) -> DataFrame:
    return inventory.yearly_trend(_filled(star), *star.years())


@query
def display_order(star: Star) -> DataFrame:
    ranked = inventory_plan.bar_table(_filled(star))
    return ranked.select("display_charType", "display_siteType", "bar_rank", "panel_rank", "site_rank")


@query
def trend_panels(star: Star) -> DataFrame:
    return inventory_plan.trend_table(_filled(star), *star.years())


# --- analyses from raw results to the figure's table -----------------------------------------------------------


def _retrieved(star: Star) -> DataFrame:
    return secchi.retrieve_secchi(star.raw_results(), star.sites(), *star.period())


@query
def secchi_pipeline(star: Star) -> DataFrame:
    weekly = secchi.secchi_from_raw(star.raw_results(), star.sites(), _polygons(star), star.period(), **_lookup_tables(star))
    return _rounded(weekly, 6, "med", "q25", "q75")


@query
def secchi_pipeline_funnel(star: Star) -> DataFrame:
    retrieved = _retrieved(star)
    allowed = secchi.retrieved_lakes(retrieved, _polygons(star))
    used = retrieved.select("MonitoringLocationTypeName", *secchi.USED_COLUMNS)
    return quality.qa_funnel(used, allowed, secchi.USED_COLUMNS[4:], **_lookup_tables(star))


def _from_results(star: Star) -> DataFrame:
    regions = star.states().select(F.col("STATE").cast("int").alias("poly_id"), "area")
    return geography.geography_from_results(star.results(), star.sites(), _polygons(star), regions, star.units())


@query
def geo_pipeline(star: Star) -> DataFrame:
    """The weekly medians with their smoothed line, and the overall median of each region where week is null."""
    weekly = _from_results(star)
    overall = weekly.where("week is null").select("area", "week", "med", F.lit(None).cast("double").alias("smooth"))
    smooth = geography.smoothed_by_geography(weekly).select("area", "week", "med", "smooth")
    return _rounded(smooth.unionByName(overall), 6, "med", "smooth")


# --- spatial --------------------------------------------------------------------------------------------------


@query
def project_sites(star: Star) -> DataFrame:
    return _rounded(spatial.project_2163(_points(star)), 3, "x", "y")


@query
def point_in_polygon(star: Star) -> DataFrame:
    return spatial.point_in_polygon(_points(star), _polygons(star), keep=["ftype"])


@query
def assign_polygon(star: Star) -> DataFrame:
    return spatial.assign_polygon(_points(star), _polygons(star))


@query
def sites_in_waterbodies(star: Star) -> DataFrame:
    return _allowed(star)


@query
def lake_membership(star: Star) -> DataFrame:
    """The allow-list from the mean location of each site's results."""
    return geography.lake_site_ids(star.results(), _polygons(star))


@query
def coverage_by_state(star: Star) -> DataFrame:
    """Sites inside water bodies by the state whose polygon that is."""
    kept = _polygons(star).where(F.col("ftype").isin(*lookups.WATERBODY_FTYPES))
    states = star.states().select(F.col("STATE").cast("int").alias("poly_id"), F.col("STATE_NAME").alias("state"))
    hits = spatial.point_in_polygon(_points(star), kept).join(states, "poly_id").select("state", "wqx_id")
    return spatial.coverage_by_state(hits, kept.join(states, "poly_id").select("state"))


@query
def huc_counts(star: Star) -> DataFrame:
    return spatial.count_per_polygon(
        geography.projected_sites(star.sites()), geography.projected_polygons(star.vertices())
    )


@query
def huc_bins(star: Star) -> DataFrame:
    return spatial.log_bin(huc_counts(star))


@query
def huc_bins_auto(star: Star) -> DataFrame:
    return spatial.log_bin_auto(huc_counts(star))


@query
def site_density_panel(star: Star) -> DataFrame:
    return geography.density_panel(star.results(), star.sites(), star.vertices())


@query
def region_polygons(star: Star) -> DataFrame:
    code = F.lpad(F.col("poly_id").cast("string"), 2, "0")
    names = star.state_names().select("STATE", F.lower("STATE_NAME").alias("region"))
    named = star.vertices().join(names, code == F.col("STATE")).drop("STATE")
    return spatial.region_polygons(named, star.state_regions())


# --- seasonal series ------------------------------------------------------------------------------------------


def _weekly_by_geography(star: Star) -> DataFrame:
    regions = star.states().select(F.col("STATE").cast("int").alias("poly_id"), "area")
    return geography.seasonal_by_geography(star.results(), star.sites(), _polygons(star), regions, star.units())


@query
def weekly_median_geo(star: Star) -> DataFrame:
    return _rounded(_weekly_by_geography(star), 6, "med")


@query
def smooth3(star: Star) -> DataFrame:
    weekly = _weekly_by_geography(star).where(F.col("week").isNotNull())
    return _rounded(seasonal.smooth3(weekly, ["area"]), 6, "med", "smooth")


@query
def tukey_smooth(star: Star) -> DataFrame:
    return _rounded(geography.smoothed_by_geography(_weekly_by_geography(star)), 6, "med", "smooth")


@query
def tukey_smooth_daily(star: Star) -> DataFrame:
    regions = star.states().select(F.col("STATE").cast("int").alias("poly_id"), "area")
    daily = geography.daily_by_geography(star.results(), star.sites(), _polygons(star), regions, star.units())
    return _rounded(daily, 6, "med", "smooth")
