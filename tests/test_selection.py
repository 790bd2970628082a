import datetime as dt

import pytest
from pyspark.errors import PySparkException

from lakeledger import lookups
from lakeledger.operators import paging, selection
from lakeledger.plans import constituents, secchi
from lakeledger.schema import RESULT_COLUMNS

LAKE = lookups.LAKE_SITE_TYPE


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [("A", 1.0, 2.0, "01", "Lake", LAKE), ("B", 3.0, 4.0, "27", "Lake", LAKE), ("C", None, None, "27", "Stream", "Stream")],
        "wqx_id string, dec_lat_va double, dec_lon_va double, StateCode string, MonitoringLocationTypeName string, siteType string",
    )


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [("A", "Temperature", 1), ("A", "Temperature, water", 2), ("B", "Secchi depth", 3), ("C", "Temperature", 4),
         ("C", "Phosphorus", 5), ("A", "Organic carbon", 6), ("Q", "Temperature", 7)],
        "wqx_id string, characteristicName string, n int",
    )


def test_sites_by_constituent_type_and_state(sites, results, rows):
    assert rows(selection.select_sites(sites, results, lookups.TEMPERATURE_NAMES)) == [("A", 2.0, 1.0), ("C", None, None)]
    assert rows(selection.select_sites(sites, results, lookups.TEMPERATURE_NAMES, site_type=LAKE), "wqx_id") == [("A",)]
    assert rows(selection.select_sites(sites, results, ["Secchi depth"], states=["01"])) == []


def test_targets_resolve_to_their_site_sets(sites, results, rows):
    found = rows(selection.resolve_targets(results, sites))
    assert found == [
        ("doc_all", "A"), ("doc_lakes", "A"), ("phosphorus_all", "C"), ("secchi_all", "B"), ("secchi_lakes", "B"),
        ("temperature_all", "A"), ("temperature_all", "C"), ("temperature_lakes", "A"),
    ]
    with pytest.raises(KeyError):
        selection.resolve_targets(results, sites, ["gold_all"])


def test_targets_from_another_configuration(sites, results, rows):
    found = selection.resolve_targets(
        results, sites, ["clarity_streams", "heat_streams"],
        constituents={"clarity": ["Secchi depth"], "heat": ["Temperature"]}, scopes={"streams": "Stream"},
    )
    assert rows(found) == [("heat_streams", "C")]


def test_constituent_groups_have_their_sizes():
    assert {name: len(names) for name, names in lookups.CONSTITUENT_GROUPS.items()} == {
        "DOC": 5, "temperature": 3, "phosphorus": 16, "chlorophyll": 13, "DO": 4, "DIC": 2, "pH": 1,
    }
    assert len(lookups.MAP_TARGETS) == 15


def test_a_name_in_two_groups_yields_two_rows(results, rows):
    groups = {"one": ["Temperature"], "two": ["Temperature", "Phosphorus"]}
    assert rows(selection.label_constituents(results, groups), "constituent", "n") == [
        ("one", 1), ("one", 4), ("one", 7), ("two", 1), ("two", 4), ("two", 5), ("two", 7),
    ]


def test_constituents_at_lake_sites(sites, results, rows):
    found = constituents.constituent_results(results, sites)
    assert rows(found, "constituent", "wqx_id", "n") == [("DOC", "A", 6), ("temperature", "A", 1), ("temperature", "A", 2)]
    assert constituents.constituent_results(results, sites, states=["27"]).count() == 0


def test_extract_by_state(sites, results, rows):
    assert rows(selection.extract_by_state(results, sites, ["27"]), "state", "n") == [("US:27", 3), ("US:27", 4), ("US:27", 5)]
    assert selection.extract_by_state(results, sites).count() == 6


def test_normalised_results(spark, sites):
    raw = spark.createDataFrame(
        [("2001-02-03", "1.5", "m", "A", "Sample-Routine", "Water", "Final"), ("2001-02-03", "<5", None, "Q", None, None, None)],
        "ActivityStartDate string, ResultMeasureValue string, `ResultMeasure.MeasureUnitCode` string, "
        "MonitoringLocationIdentifier string, ActivityTypeCode string, ActivityMediaName string, ResultStatusIdentifier string",
    )
    out = selection.normalize_results(raw, sites)
    assert out.columns == RESULT_COLUMNS
    found = {r["wqx_id"]: r for r in out.collect()}
    assert (found["A"]["Date"], found["A"]["value"], found["A"]["StateCode"]) == (dt.date(2001, 2, 3), 1.5, "01")
    assert found["Q"]["value"] is None and found["Q"]["StateCode"] is None


def test_retrieval_keeps_sign_and_unmatched_units(spark, sites):
    raw = spark.createDataFrame(
        [("2001-02-03", "-2", "f t", "A", "Secchi depth"), ("2001-02-04", "3", "mi", "B", "Secchi depth"),
         ("2001-02-04", "3", "m", "C", "Secchi depth"), ("2001-02-04", "3", "m", "A", "pH"), ("1990-02-04", "3", "m", "A", "Secchi depth")],
        "ActivityStartDate string, ResultMeasureValue string, `ResultMeasure.MeasureUnitCode` string, "
        "MonitoringLocationIdentifier string, characteristicName string",
    ).selectExpr("*", "'a' as ActivityTypeCode", "'b' as ActivityMediaName", "'c' as ResultStatusIdentifier")
    found = secchi.retrieve_secchi(raw, sites, "2000-01-01", "2010-01-01")
    assert sorted((r["wqx_id"], r["secchi"]) for r in found.collect()) == [("A", pytest.approx(-0.6096)), ("B", None)]
    assert secchi.retrieve_secchi(raw, sites, "2000-01-01", "2010-01-01", site_type=None, states=["27"]).count() == 2


def periods(spark, lo, hi):
    return spark.createDataFrame([(dt.date.fromisoformat(lo), dt.date.fromisoformat(hi))], "lo date, hi date")


def test_pages_step_by_stride(spark):
    pages = [(str(r["start"]), str(r["end"])) for r in paging.page_windows(periods(spark, "1980-01-01", "2016-01-01"), "10 years").collect()]
    assert pages == [("1980-01-01", "1990-01-01"), ("1990-01-01", "2000-01-01"), ("2000-01-01", "2010-01-01"), ("2010-01-01", "2016-01-01")]


def test_pages_of_no_length_are_left_out_unless_asked_for(spark):
    exact = periods(spark, "2000-01-01", "2004-01-01")
    assert paging.page_windows(exact, "2 years").count() == 2
    assert paging.page_windows(exact, "2 years", keep_empty=True).count() == 3
    assert paging.page_windows(periods(spark, "2000-01-01", "2000-06-01"), "2 years").count() == 1
    assert paging.page_windows(periods(spark, "2000-01-01", "2000-01-01"), "2 years").count() == 0


def test_boundary_days_appear_on_both_closed_pages(spark):
    days = ["1999-12-31", "2000-01-01", "2001-06-01", "2002-01-01", "2003-12-31", "2004-01-01", "2004-01-02"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "Date date")

    def read(**options):
        return sorted((str(r["Date"]), str(r["page_start"])) for r in paging.read_paged(df, "2000-01-01", "2004-01-01", "2 years", **options).collect())

    half_open = [("2000-01-01", "2000-01-01"), ("2001-06-01", "2000-01-01"), ("2002-01-01", "2002-01-01"),
                 ("2003-12-31", "2002-01-01"), ("2004-01-01", "2002-01-01")]
    assert read(bounds="half_open") == half_open
    assert read() == sorted([*half_open, ("2002-01-01", "2000-01-01")])
    assert read(keep_empty=True) == sorted([*half_open, ("2002-01-01", "2000-01-01"), ("2004-01-01", "2004-01-01")])
    with pytest.raises(ValueError):
        read(bounds="open")


def test_day_strides(spark):
    df = spark.range(0, 800).selectExpr("date_add(date '2000-01-01', cast(id as int)) as Date")
    paged = paging.read_paged(df, "2000-01-01", "2002-01-01", "365 days", bounds="half_open")
    found = {str(r["page_start"]): r["count"] for r in paged.groupBy("page_start").count().collect()}
    assert found == {"2000-01-01": 365, "2000-12-31": 365, "2001-12-31": 2}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_hour_strides(spark, kind):
    df = spark.range(0, 96).selectExpr(f"cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int) * 30) as {kind}) as ts")

    def read(bounds, **options):
        found = paging.read_paged(df, "2024-01-01", "2024-01-02 12:00:00", "6 hours", bounds, date="ts", **options)
        return [(str(r.ts), str(r.page_start), str(r.page_end)) for r in found.orderBy("ts", "page_start").collect()]

    half_open = read("half_open")
    assert len(half_open) == 73 and len({x[1] for x in half_open}) == 6
    assert half_open[-1] == ("2024-01-02 12:00:00", "2024-01-02 06:00:00", "2024-01-02 12:00:00")
    assert half_open[12] == ("2024-01-01 06:00:00", "2024-01-01 06:00:00", "2024-01-01 12:00:00")
    closed = read("closed")
    assert len(closed) == 73 + 5  # the five inner boundaries are read twice
    assert ("2024-01-01 06:00:00", "2024-01-01 00:00:00", "2024-01-01 06:00:00") in closed
    assert len(read("closed", keep_empty=True)) == 73 + 6
    with pytest.raises(ValueError, match="no pages"):
        paging.read_paged(spark.range(1).selectExpr("date'2024-01-01' AS Date"), "2024-01-01", "2024-01-02", "6 hours")


def test_short_strides_of_a_long_period(spark):
    df = spark.createDataFrame([(dt.datetime(1999, 12, 31, 23, 59, 59),), (dt.datetime(1950, 1, 1),), (dt.datetime(1949, 1, 1),)], "ts timestamp_ntz")
    found = paging.read_paged(df, "1950-01-01", "2050-01-01", "1 hour", date="ts").collect()
    assert sorted(str(r.page_start) for r in found) == ["1950-01-01 00:00:00", "1999-12-31 23:00:00"]


def test_lines_that_do_not_fit_are_kept_apart(spark, rows, tmp_path):
    from lakeledger.sources import tables

    path = tmp_path / "counts.csv"
    good = ["1,Lake,2.5", "2,NA,NA", '3,"Lake, Reservoir",1.0']
    bad = [("x4,Lake,2.5", "value"), ("5,Lake", "fields"), ('"6,Lake,1.0', "quote"), ("7,Lake,1.0,more", "fields"), ("8,Lake,many", "value")]
    path.write_text("\n".join(["id,kind,value", good[0], *[line for line, _ in bad], *good[1:]]) + "\n")
    schema = spark.createDataFrame([], "id int, kind string, value double").schema
    read, rejects = tables.read_csv_checked(spark, str(path), schema)
    assert rows(read) == [(1, "Lake", 2.5), (2, None, None), (3, "Lake, Reservoir", 1.0)]
    assert rows(read, "id") == [(1,), (2,), (3,)] and read.count() == 3
    assert rows(rejects) == sorted(("counts.csv", line, reason) for line, reason in bad)
    with pytest.raises(ValueError, match="more than 4"):
        tables.read_csv_checked(spark, str(path), schema, max_rejects=4)
    assert tables.read_csv_checked(spark, str(path), schema, max_rejects=5)[0].count() == 3


def test_site_locations(spark, rows):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, None), ("B", None, 1.0)], "wqx_id string, dec_lat_va double, dec_lon_va double")
    assert rows(selection.site_locations(df)) == [("A", 2.0, 2.0)]
    same = spark.range(1000).selectExpr("'A' as wqx_id", "25.13D as dec_lat_va", "-99.97D as dec_lon_va")
    assert rows(selection.site_locations(same)) == [("A", 25.13, -99.97)]


def test_lookup_literals_survive_quotes(spark, rows):
    df = lookups.literal_frame(spark, [("it's", 1), ("back\\slash", None)], a="string", b="int")
    assert rows(df) == [("back\\slash", None), ("it's", 1)]
    with pytest.raises(PySparkException):
        df.select("missing").collect()
