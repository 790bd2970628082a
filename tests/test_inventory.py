import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeledger import lookups
from lakeledger.operators import inventory
from lakeledger.plans import inventory as plan
from lakeledger.schema import COUNT_SCHEMA
from lakeledger.sources import tables


def observations(spark):
    data = [
        ("Nutrient", "Stream", "A", dt.date(2000, 5, 1)), ("Nutrient", "Stream", "A", dt.date(2000, 6, 1)),
        ("Nutrient", "Stream", "B", dt.date(2000, 6, 1)), ("Nutrient", "Well", "C", dt.date(2001, 6, 1)),
        ("Population/Community", "Stream", "A", dt.date(2001, 6, 1)),
    ]
    return spark.createDataFrame(data, "characteristicType string, siteType string, wqx_id string, Date date")


def counts(spark, *data):
    rows = [(kind, site, dt.date(year, 1, 1), dt.date(year, 12, 31), n_sites, n) for kind, site, year, n_sites, n in data]
    return spark.createDataFrame(rows, COUNT_SCHEMA)


def test_counts_per_unit_and_year(spark, rows):
    assert rows(inventory.summary_counts(observations(spark))) == [
        ("Nutrient", "Stream", 2000, 2, 3), ("Nutrient", "Well", 2001, 1, 1), ("Population/Community", "Stream", 2001, 1, 1),
    ]


def test_grid_is_complete_with_null_counts_then_zero(spark):
    units = lookups.required_units(spark)
    grid = inventory.count_grid(inventory.summary_counts(observations(spark)), units, 2000, 2002)
    assert grid.count() == 18 * 15 * 3
    assert grid.where("numSites is null and numResults is null").count() == 18 * 15 * 3 - 3
    assert inventory.fill_counts(grid).where("numSites = 0 and numResults = 0").count() == 18 * 15 * 3 - 3
    assert grid.select("startDate", "endDate").distinct().count() == 3
    ordered = [tuple(r) for r in grid.select("characteristicType", "siteType", "startDate").collect()]
    assert ordered == sorted(ordered)


def test_resume_counts_only_what_is_missing(spark, tmp_path):
    cache, table = str(tmp_path / "cache"), str(tmp_path / "table")
    kinds, sites = ["Nutrient", "Population/Community"], ["Stream", "Well"]
    run = dict(cache_path=cache, table_path=table, start=2000, end=2001, site_types=sites)
    df = observations(spark)
    assert inventory.incremental_counts(df, char_types=kinds[:1], **run)
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert len(first) == 2

    # Finished units are kept even when the data changed; the others are added.
    assert inventory.incremental_counts(df.where("wqx_id = 'A'"), char_types=kinds, **run)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert len(after) == 4 and first.items() <= after.items()
    found = tables.read_csv(spark, table)
    assert found.schema == COUNT_SCHEMA and found.count() == 8
    assert found.where("numResults is not null").agg(F.sum("numResults")).first()[0] == 5
    assert found.where("characteristicType = 'Population/Community'").count() == 4

    # Forced, every unit is counted anew.
    assert inventory.incremental_counts(df.where("wqx_id = 'A'"), char_types=kinds, force=True, **run)
    assert tables.read_csv(spark, table).agg(F.sum("numResults")).first()[0] == 3


def test_missing_units(spark, rows):
    units = lookups.required_units(spark, ["a", "b"], ["x", "y"])
    done = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 1)], "characteristicType string, siteType string, n int")
    assert rows(inventory.missing_units(units, done)) == [("a", "y"), ("b", "x")]


def test_display_names_cover_every_type(spark):
    units = lookups.required_units(spark)
    shown = inventory.display_category(units)
    assert shown.select("display_charType").distinct().count() == 13
    assert {r[0] for r in shown.select("display_siteType").distinct().collect()} == {*lookups.DISPLAY_SITE_ORDER, "NA"}
    assert lookups.display_characteristics(spark).count() == 19
    assert lookups.display_sites(spark).count() == 15


def test_unknown_types_fail_or_are_null(spark):
    df = spark.createDataFrame([("Magic", "Stream")], "characteristicType string, siteType string")
    assert inventory.display_category(df, strict=False).first()["display_charType"] is None
    with pytest.raises(PySparkException, match="Magic"):
        inventory.display_category(df).collect()


SAMPLE = [
    ("Nutrient", "Stream", 2000, 1, 10), ("Nutrient", "Well", 2001, 2, 30), ("Nutrient", "Not Assigned", 2001, 9, 500),
    ("Organics, PCBs", "Estuary", 2000, 1, 1500), ("Organics, Other", "Ocean", 2000, 1, 500),
    ("Not Assigned", "Stream", 2000, 1, 7), ("Toxicity", "Stream", 2001, None, None),
]


def test_share_of_site_groups(spark):
    share = inventory.records_share(counts(spark, *SAMPLE))
    found = {(r["display_charType"], r["display_siteType"]): r for r in share.collect()}
    assert found["Nutrient", "Stream"]["percentResults"] == 25
    assert found["Organics", "Marine"]["charTypeLabels"] == "Organics\n (n=2,000)"
    assert found["Total", "Stream"]["totalnumResults"] == 2040
    assert found["Toxicity", "Stream"]["percentResults"] is None
    assert ("Nutrient", "NA") not in found and not any(kind == "NA" for kind, _ in found)
    sums = share.groupBy("display_charType").agg(F.sum("percentResults").alias("p")).where("p is not null").collect()
    assert all(r["p"] == pytest.approx(100) for r in sums)


def test_older_share_counts_unassigned_types_in_the_total_only(spark):
    share = inventory.records_share(counts(spark, *SAMPLE), total_includes_unassigned=True, plain_label=True)
    found = {(r["display_charType"], r["display_siteType"]): r for r in share.collect()}
    assert found["Total", "Stream"]["totalnumResults"] == 2047
    assert found["Organics", "Marine"]["charTypeLabels"] == "Organics\n (2000)"
    assert not any(kind == "NA" for kind, _ in found)


def test_trend_excludes_the_last_year_and_adds_a_total(spark, rows):
    assert rows(inventory.yearly_trend(counts(spark, *SAMPLE), 2000, 2001)) == [
        ("Nutrient", 2000, 1, 10), ("Organics", 2000, 2, 2000), ("Total", 2000, 3, 2010),
    ]
    whole = inventory.yearly_trend(counts(spark, *SAMPLE), 2000, 2002)
    assert rows(whole.where("display_charType = 'Total'")) == [("Total", 2000, 3, 2010), ("Total", 2001, 11, 530)]


def test_bars_ascend_and_panels_descend_after_the_total(spark):
    ranked = plan.bar_table(counts(spark, *SAMPLE))
    ranks = {r["display_charType"]: (r["bar_rank"], r["panel_rank"]) for r in ranked.collect()}
    assert ranks == {"Toxicity": (1, 3), "Nutrient": (2, 2), "Organics": (3, 1), "Total": (4, 0)}
    assert {r["display_siteType"]: r["site_rank"] for r in ranked.collect()} == {"Groundwater": 2, "Marine": 4, "Stream": 5}
    panels = {r["display_charType"]: r["panel_rank"] for r in plan.trend_table(counts(spark, *SAMPLE), 2000, 2002).collect()}
    assert panels["Total"] == 0 and panels["Nutrient"] == 2


def test_csv_and_parquet_keep_nulls_and_commas(spark, rows, tmp_path):
    df = counts(spark, *SAMPLE)
    tables.write_csv(df, str(tmp_path / "csv"))
    tables.write_snapshot(df, str(tmp_path / "parquet"), partition_by=("characteristicType",))
    assert rows(tables.read_csv(spark, str(tmp_path / "csv"))) == rows(df)
    assert rows(tables.read_snapshot(spark, str(tmp_path / "parquet"), COUNT_SCHEMA), *df.columns) == rows(df)
    assert tables.read_if_exists(spark, str(tmp_path / "nothing"), COUNT_SCHEMA) is None


def test_scratch_follows_the_shared_folder(spark, shared_folder):
    first, second = (tables.scratch_path(spark, "x") for _ in range(2))
    assert first.startswith(f"{shared_folder}/x-") and first != second
