"""What the physical plans must look like, and that row order and partitioning do not matter."""

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import paging, quality, selection
from lakeledger.plans import secchi
from lakeledger.sources.star import Star

DIRECTORY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, DIRECTORY)


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    """Results as the Parquet table a user would have."""
    path = str(tmp_path_factory.mktemp("results") / "table")
    star.results().write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(quality.drop_qa_activities(stored).select("wqx_id"))
    assert "In(ActivityTypeCode" in text.split("PushedFilters")[1]
    assert "value" not in text.split("ReadSchema")[1]
    text = plan(paging.read_paged(stored, "1996-01-01", "1998-01-01", "1 year").select("value", "page_start"))
    assert "GreaterThanOrEqual(Date,1996-01-01)" in text and "LessThanOrEqual(Date,1998-01-01)" in text
    assert "units" not in text.split("ReadSchema")[1]
    text = plan(selection.site_results(stored, stored.select("wqx_id", "siteType"), ["Phosphorus"]))
    assert "characteristicName,Phosphorus" in text


def test_paging_joins_nothing_and_does_not_unfold_the_period(stored):
    for bounds in ("closed", "half_open"):
        text = plan(paging.read_paged(stored, "1996-01-01", "1998-01-01", "1 year", bounds))
        assert "Join" not in text and "Exchange" not in text


def test_cleaning_reads_only_what_it_needs(stored):
    text = plan(secchi.clean_secchi(stored))
    assert "characteristicName" not in text and "ResultStatusIdentifier" not in text


def lookups_of(star):
    return {"factors": star.units(), "states": star.state_names(), "regions": star.state_regions()}


def test_flagship_ignores_row_order_and_partitioning(star, stored, rows):
    runs = [
        secchi.secchi_seasonality(frame, **lookups_of(star))
        for frame in (stored, stored.repartition(11), stored.orderBy(F.rand(4)).coalesce(2))
    ]
    first, *others = [rows(df) for df in runs]
    assert first and all(other == first for other in others)
    assert {row[1] for row in first} <= set(star.region_names())


def test_cleaning_twice_changes_nothing(star, stored):
    once = secchi.clean_secchi(stored, **lookups_of(star))
    columns = ["wqx_id", "Date", "value"]
    lake = once.withColumn("MonitoringLocationTypeName", F.lit("Lake")).drop("secchi", "STATE_NAME", "area")
    again = secchi.clean_secchi(lake, **lookups_of(star))
    assert sorted(map(tuple, once.select(*columns).collect())) == sorted(map(tuple, again.select(*columns).collect()))
