import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeledger import lookups
from lakeledger.operators import quality
from lakeledger.schema import RESULT_SCHEMA

DAY = dt.date(2000, 7, 1)


def result(day=DAY, value=1.0, units="m", site="A", lat=40.0, lon=-90.0, state="27", activity="Sample-Routine",
           medium="Water", location="Lake"):
    return (day, value, units, site, lat, lon, state, activity, medium, "Final", location)


def frame(spark, *results):
    return spark.createDataFrame(list(results), RESULT_SCHEMA)


def test_week_counts_complete_periods_and_is_not_iso(spark, rows):
    days = [dt.date(2000, 1, 1), dt.date(2001, 1, 8), dt.date(2000, 12, 30), dt.date(2000, 12, 31), dt.date(2001, 12, 31)]
    df = quality.date_parts(frame(spark, *[result(day=d) for d in days]))
    assert {r["Date"]: (r["week"], r["week2"]) for r in df.collect()} == {
        days[0]: (1, 0), days[1]: (2, 2), days[2]: (53, 52), days[3]: (53, 52), days[4]: (53, 52),
    }


def test_season_bounds_are_exclusive(spark, rows):
    weeks = spark.createDataFrame([(w,) for w in (13, 14, 46, 47)], "week int")
    assert rows(quality.season(weeks)) == [(14,), (46,)]


def test_duplicates_with_null_coordinates_collapse(spark):
    df = frame(spark, result(lat=None, lon=None), result(lat=None, lon=None), result(lat=None, lon=None, value=2.0))
    assert quality.dedupe_first(df).count() == 2
    counted = quality.duplicate_count(df).first()
    assert (counted["n_rows"], counted["n_distinct"], counted["n_duplicates"]) == (3, 2, 1)


def test_two_sites_at_one_coordinate_collapse(spark, rows):
    df = frame(spark, result(site="B"), result(site="A"))
    assert rows(quality.dedupe_first(df), "wqx_id") == [("A",)]


def test_first_in_the_given_order_survives(spark, rows):
    df = spark.createDataFrame([(1, "x", 9, "late"), (1, "x", 3, "early"), (1, None, 1, "other")], "a int, b string, seq int, tag string")
    kept = quality.dedupe_first(df, ["a", "b"], ["seq"])
    assert kept.columns == df.columns
    assert rows(kept, "tag") == [("early",), ("other",)]


def test_a_control_row_that_comes_first_takes_its_copy_with_it(spark):
    df = frame(spark, result(activity="Quality Control Sample-Field Replicate"), result(activity="Sample-Routine"))
    assert quality.drop_qa_activities(quality.dedupe_first(df)).count() == 0


def test_dedupe_is_idempotent_and_independent_of_partitioning(spark, rows):
    base = [result(value=float(i % 5), site=f"S{i % 7}", activity=lookups.ROUTINE_ACTIVITIES[i % 6]) for i in range(200)]
    df = frame(spark, *base)
    once = quality.dedupe_first(df)
    assert rows(once) == rows(quality.dedupe_first(once))
    assert rows(once) == rows(quality.dedupe_first(df.repartition(7).orderBy(F.rand(3))))


def test_rows_that_are_all_key(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int")
    assert rows(quality.dedupe_first(df, ["a"])) == [(None,), (1,)]


def test_units_lose_spaces_and_unknown_ones_go(spark, rows):
    df = frame(spark, result(value=-3.0, units="f t"), result(value=2.0, units=" m"), result(units="NTU"), result(units=None))
    kept = quality.convert_units(df)
    assert [(u, round(s, 4)) for u, s in rows(kept, "units", "secchi")] == [("ft", 0.9144), ("m", 2.0)]


def test_unmatched_units_can_stay_with_null_depth(spark, rows):
    df = frame(spark, result(value=-3.0, units="ft"), result(units="NTU"), result(units=None))
    kept = quality.convert_units(df, unmatched="null", absolute=False)
    assert sorted((str(u), s if s is None else round(s, 4)) for u, s in rows(kept, "units", "secchi")) == [
        ("NTU", None), ("None", None), ("ft", -0.9144),
    ]
    with pytest.raises(ValueError):
        quality.convert_units(df, unmatched="keep")


def test_plausible_range_is_open(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.001,), (45.999,), (46.0,), (None,)], "secchi double")
    assert rows(quality.plausible_range(df)) == [(0.001,), (45.999,)]


def test_states_outside_every_region_are_dropped(spark, rows):
    df = frame(spark, result(state="27"), result(state="02"), result(state="99"), result(state=None))
    assert rows(quality.assign_region(df), "StateCode", "STATE_NAME", "area") == [("27", "Minnesota", "Midwest")]
    assert quality.assign_region(df, keep_unassigned=True).count() == 4


def test_regions_cover_48_states():
    assert {name: len(states) for name, states in lookups.REGION_STATES.items()} == {
        "West": 11, "Midwest": 12, "Northeast": 9, "South": 16,
    }
    named = {name for _, name in lookups.STATE_FIPS}
    assert all(state in named for states in lookups.REGION_STATES.values() for state in states)


def test_lake_sites_need_type_and_allow_list(spark, rows):
    df = frame(spark, result(site="A"), result(site="B"), result(site="A", location="River/Stream"))
    allowed = spark.createDataFrame([("A",), ("A",)], "wqx_id string")
    assert rows(quality.keep_lake_sites(df, allowed), "wqx_id") == [("A",)]
    assert quality.keep_lake_sites(df).count() == 2


def test_funnel_matches_the_stages_run_one_by_one(spark):
    df = frame(
        spark,
        result(), result(), result(value=2.0, activity="Other"), result(value=3.0, units="NTU"),
        result(value=4.0, units=None), result(value=99.0), result(value=5.0, location="Stream"),
        result(value=6.0, site="Z"), result(value=None), result(value=7.0, state="02"), result(value=8.0, medium="Air"),
        result(value=9.0, location=None), result(value=10.0, activity=None),
    )
    allowed = spark.createDataFrame([("A",)], "wqx_id string")
    lake = quality.keep_lake_sites(df)
    inside = quality.keep_lake_sites(df, allowed)
    first = quality.dedupe_first(inside)
    routine = quality.drop_qa_activities(first)
    known = quality.convert_units(routine)
    final = quality.plausible_range(quality.assign_region(known))
    expected = [stage.count() for stage in (df, lake, inside, first, routine, known, final)]
    funnel = quality.qa_funnel(df, allowed).orderBy("step").collect()
    assert [r["n_rows"] for r in funnel] == expected
    assert [r["stage"] for r in funnel] == list(quality.FUNNEL_STAGES)
    assert all(r["dropped"] >= 0 for r in funnel)
    assert sum(r["dropped"] for r in funnel) == expected[0] - expected[-1]


def test_funnel_of_nothing(spark):
    assert [r["n_rows"] for r in quality.qa_funnel(frame(spark)).collect()] == [0] * 7


def test_state_layers(spark, rows):
    fips = spark.createDataFrame(
        [("new york:manhattan", 36), ("new york:main", 36), ("alabama", 1), ("district of columbia", 11)],
        "polyname string, fips int",
    )
    assert rows(quality.state_layers(fips)) == [
        ("Alabama", "01", "NHD_M_01_Alabama_ST"),
        ("District of Columbia", "11", "NHD_M_11_District_of_Columbia_ST"),
        ("New York", "36", "NHD_M_36_New_York_ST"),
    ]
