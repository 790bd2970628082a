import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeledger.operators import quantiles, summaries

QUARTERS = {"q25": 0.25, "med": 0.5, "q75": 0.75}


def run(spark, data, probs=QUARTERS):
    df = spark.createDataFrame(data, "g string, v double")
    return {
        r["g"]: tuple(r[name] for name in probs)
        for r in quantiles.exact_quantiles(quantiles.value_counts(df, ["g"], "v"), ["g"], "v", probs).collect()
    }


def test_linear_interpolation_ignores_nulls(spark):
    assert run(spark, [("a", v) for v in (1.0, 2.0, 4.0, None, float("nan"))]) == {"a": (1.5, 2.0, 3.0)}


def test_single_value_and_extremes(spark):
    assert run(spark, [("a", 7.0)]) == {"a": (7.0, 7.0, 7.0)}
    data = [("a", float(v)) for v in range(11)]
    assert run(spark, data, {"lo": 0.0, "hi": 1.0, "p": 0.33}) == {"a": (0.0, 10.0, pytest.approx(3.3))}


def test_groups_may_be_null_and_groups_without_values_vanish(spark):
    assert run(spark, [(None, 1.0), (None, 3.0), ("a", None)]) == {None: (1.5, 2.0, 2.5)}


def test_matches_numpy_on_many_distinct_values_and_heavy_ties(spark):
    rng = random.Random(5)
    data = [("wide", rng.gauss(0, 1e6)) for _ in range(20000)]
    data += [("ties", float(rng.choice([1, 1, 1, 2, 50]))) for _ in range(5000)]
    data += [("skewed", math.exp(rng.gauss(0, 30))) for _ in range(3000)]
    probs = {f"p{int(p * 1000)}": p for p in (0.001, 0.25, 0.5, 0.75, 0.9, 0.999)}
    found = run(spark, data, probs)
    for group in ("wide", "ties", "skewed"):
        expected = np.quantile([v for g, v in data if g == group], list(probs.values()))
        assert np.allclose(found[group], expected, rtol=1e-12, atol=0)


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_exact_wherever_the_bins_begin(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(7)
    data = [("a", rng.random()) for _ in range(2000)]
    assert np.allclose(run(spark, data)["a"], np.quantile([v for _, v in data], [0.25, 0.5, 0.75]), rtol=1e-12)


def test_bins_follow_the_order_of_values(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)]
    values += [rng.choice([-1, 1]) * 2.0**k for k in range(-1074, 1024, 7)] + [rng.gauss(0, 10) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "_v double").selectExpr("_v", f"{quantiles._bin()} AS b")
    bins = [r.b for r in sorted(df.collect(), key=lambda r: r._v)]
    assert bins == sorted(bins) and len(set(bins)) > 1500
    spread = {"lo": 0.0, "med": 0.5, "hi": 1.0}
    assert run(spark, [("a", v) for v in (-math.inf, -3.0, -2.0, 0.0, math.inf)], spread) == {"a": (-math.inf, -2.0, math.inf)}


def test_few_exchanges(spark):
    counts = quantiles.value_counts(spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v"), ["g"], "v")
    plan = quantiles.exact_quantiles(counts, ["g"], "v", QUARTERS)._jdf.queryExecution().executedPlan().toString()
    shuffles = {line.split("plan_id=")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    assert len(shuffles) <= 5 and "percentile" not in plan


def test_agrees_with_percentile_and_ignores_partitioning(spark):
    df = spark.range(30000).select(
        (F.col("id") % 7).cast("string").alias("g"), (F.hash("id") % 9973).cast("double").alias("v")
    )
    expected = {
        r["g"]: tuple(r["p"]) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, QUARTERS.values()))).alias("p")).collect()
    }
    for frame in (df, df.repartition(13)):
        counts = quantiles.value_counts(frame, ["g"], "v")
        found = quantiles.exact_quantiles(counts, ["g"], "v", QUARTERS).collect()
        for r in found:
            assert tuple(r[n] for n in QUARTERS) == pytest.approx(expected[r["g"]], rel=1e-12)
        assert len(found) == 7


def test_roll_up_adds_the_grand_total(spark, rows):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 3.0)], "g string, w int, v double")
    counts = quantiles.roll_up(quantiles.value_counts(df, ["g", "w"], "v"), ["g", "w"], "v", away=["w"])
    assert rows(counts, "g", "w", "v", "n") == [
        ("a", None, 2.0, 2), ("a", 1, 2.0, 1), ("a", 2, 2.0, 1), ("b", None, 3.0, 1), ("b", 1, 3.0, 1),
    ]


def clean(spark):
    data = [("West", "A", 20, 1.0), ("West", "B", 20, 2.0), ("West", "A", 21, 4.0), ("South", "C", 20, 3.5), ("South", "C", 5, 9.0)]
    return spark.createDataFrame(data, "area string, wqx_id string, week int, secchi double")


def test_region_summary(spark, rows):
    assert rows(summaries.region_summary(clean(spark))) == [
        (None, 3, 5, 3.5, 2.0, 4.0, "[2, 4]"),
        ("South", 1, 2, 6.25, 4.875, 7.625, "[4.88, 7.62]"),
        ("West", 2, 3, 2.0, 1.5, 3.0, "[1.5, 3]"),
    ]


def test_weekly_tables_leave_absent_cells_null(spark):
    areas = ["Midwest", "South", "West"]
    records = [tuple(r) for r in summaries.weekly_record_counts(clean(spark), areas).collect()]
    assert records == [(20, None, 1, 2), (21, None, None, 1)]
    assert [tuple(r) for r in summaries.weekly_site_counts(clean(spark), areas).collect()] == records


def test_weekly_quantiles_keep_the_season(spark, rows):
    assert rows(summaries.weekly_quantiles(clean(spark)), "week", "area", "med") == [
        (20, "South", 3.5), (20, "West", 1.5), (21, "West", 4.0),
    ]


def test_state_counts(spark):
    df = spark.createDataFrame([("27",), ("27",), ("01",), (None,), ("99",)], "StateCode string")
    assert [tuple(r) for r in summaries.state_counts(df).collect()] == [("27", 2, "Minnesota"), ("01", 1, "Alabama"), ("99", 1, None)]
