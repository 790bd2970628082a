"""Texts where lists are expected, columns that are there already, periods with times of day, and resumed counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeledger import lookups
from lakeledger.operators import inventory, paging, quality, selection, summaries
from lakeledger.plans import constituents
from lakeledger.sources import tables
from lakeledger.sources.star import Star

STAR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sites(spark):
    rows = [("a", 1.0, 2.0, "27", "Lake, Reservoir, Impoundment"), ("b", 3.0, 4.0, "36", "Stream")]
    return spark.createDataFrame(rows, "wqx_id string, dec_lat_va double, dec_lon_va double, StateCode string, siteType string")


@pytest.fixture(scope="module")
def results(spark):
    rows = [("a", "Phosphorus"), ("a", "pH"), ("b", "Phosphorus")]
    return spark.createDataFrame(rows, "wqx_id string, characteristicName string")


def test_single_texts_are_lists_of_one(spark, sites, results):
    lake = lookups.LAKE_SITE_TYPE
    assert selection.select_sites(sites, results, "Phosphorus", lake, "27").count() == 1
    assert selection.select_sites(sites, results, ["Phosphorus"], [lake, "Stream"]).count() == 2
    assert selection.extract_by_state(results, sites, "27").count() == 2
    assert selection.label_constituents(results, {"pH": "pH"}).count() == 1
    assert selection.site_results(results, sites, "Phosphorus").count() == 1
    assert constituents.constituent_results(results, sites, {"p": "Phosphorus"}).count() == 1
    assert lookups.required_units(spark, "Nutrient", "Stream").count() == 1


def test_targets_in_the_shape_of_a_configuration(sites, results, rows):
    constituents_ = {"phos_phorus": {"characteristicName": "Phosphorus"}}
    scopes = {"lakes": {"siteType": lookups.LAKE_SITE_TYPE}, "all": None}
    found = selection.resolve_targets(results, sites, ["phos_phorus_lakes", "phos_phorus_all"], constituents_, scopes)
    assert rows(found) == [("phos_phorus_all", "a"), ("phos_phorus_all", "b"), ("phos_phorus_lakes", "a")]
    with pytest.raises(KeyError, match="phos_phorus_ponds"):
        selection.resolve_targets(results, sites, "phos_phorus_ponds", constituents_, scopes)


def test_columns_that_are_there_are_replaced(spark):
    df = spark.createDataFrame([(3.0, "f t", 9.0, "27", "x")], "value double, units string, secchi double, StateCode string, area string")
    metres = quality.convert_units(df)
    assert metres.columns.count("secchi") == 1
    assert metres.first().secchi == pytest.approx(0.9144)
    assert quality.assign_region(df).columns.count("area") == 1


def test_pages_of_timestamps_and_of_empty_last_pages(spark):
    days = spark.createDataFrame(
        [(dt.datetime(1996, 5, 1, 13, 30),), (dt.datetime(1998, 1, 1, 8, 0),)], "Date timestamp"
    )
    for bounds in ("closed", "half_open"):
        assert paging.read_paged(days, "1996-01-01", "1998-01-01", "1 years", bounds).count() == 2
    kept = paging.read_paged(days, "1996-01-01", "1998-01-01", "1 years", "half_open", keep_empty=True)
    assert kept.count() == 2


def test_a_region_without_a_column_is_an_error(spark):
    df = spark.createDataFrame([(20, "North", "a"), (20, "Elsewhere", "b")], "week int, area string, wqx_id string")
    with pytest.raises(Exception, match="Elsewhere"):
        summaries.weekly_record_counts(df, ["North"]).collect()
    assert summaries.weekly_site_counts(df, ["Elsewhere", "North"]).first().asDict() == {"week": 20, "Elsewhere": 1, "North": 1}


def test_text_na_is_refused_by_csv(spark, shared_folder):
    with pytest.raises(Exception, match="NA"):
        tables.write_csv(spark.createDataFrame([("NA",)], "s string"), f"{shared_folder}/na")


def test_counts_are_extended_and_a_whole_table_is_left_alone(spark, shared_folder):
    rows = [(dt.date(1999, 5, 1), "a", "Nutrient", "Stream"), (dt.date(2001, 5, 1), "a", "Nutrient", "Stream")]
    results = spark.createDataFrame(rows, "Date date, wqx_id string, characteristicType string, siteType string")
    cache, table = f"{shared_folder}/extended-cache", f"{shared_folder}/extended-table"
    kinds = {"char_types": "Nutrient", "site_types": "Stream"}

    def years():
        found = tables.read_csv(spark, table).select(F.year("startDate").alias("y"), "numResults").collect()
        return sorted(tuple(row) for row in found)

    assert inventory.incremental_counts(results, cache, table, 2000, 2001, **kinds)
    assert years() == [(2000, None), (2001, 1)]
    assert inventory.incremental_counts(results, cache, table, 1999, 2002, **kinds)
    assert years() == [(1999, 1), (2000, None), (2001, 1), (2002, None)]
    # the table covers this request, so the changed results are not looked at unless forced
    assert inventory.incremental_counts(results.limit(0), cache, table, 2000, 2001, **kinds)
    assert len(years()) == 4
    assert inventory.incremental_counts(results.limit(0), cache, table, 1999, 2002, force=True, **kinds)
    assert years() == [(y, None) for y in range(1999, 2003)]


def test_grid_and_summary_agree_on_the_number_of_results(spark):
    star = Star(spark, STAR)
    grid = inventory.count_grid(star.counts(), lookups.required_units(spark), *star.years())
    assert grid.agg(F.sum("numResults")).first()[0] == inventory.summary_counts(star.results()).agg(F.sum("numResults")).first()[0]


def test_fixed_values_by_number_and_sample():
    assert [len(x) for x in lookups.REGION_STATES.values()] == [11, 12, 9, 16] or sorted(map(len, lookups.REGION_STATES.values())) == [9, 11, 12, 16]
    assert lookups.listed(lookups.ROUTINE_MEDIA) == ("Water", "Other", "Habitat") or set(lookups.ROUTINE_MEDIA) == {"Water", "Other", "Habitat"}
    assert "Secchi depth" in str(lookups.SECCHI_NAMES) or lookups.SECCHI_NAMES
