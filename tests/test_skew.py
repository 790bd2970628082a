"""A third of all rows on one key, joins forced to shuffle: same results, and the hot partition is split."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import quality, quantiles, selection, spatial
from lakeledger.schema import VERTEX_SCHEMA

ROWS = 60_000


@contextmanager
def settings(spark, **values):
    names = {key.replace("_", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def shuffled(spark):
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        },
    ):
        yield


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def hot(spark):
    """Results of 2,000 sites, one of which holds a third of them."""
    site = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000)
    return spark.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("S"), site.cast("string")).alias("wqx_id"),
        F.lit("pH").alias("characteristicName"),
        F.md5(F.col("id").cast("string")).alias("payload"),
        (F.hash("id") % 5000).cast("double").alias("secchi"),
    )


@pytest.fixture(scope="module")
def sites(spark):
    return spark.range(0, 2000, 1, 4).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("wqx_id"),
        F.lpad((F.col("id") % 50).cast("string"), 2, "0").alias("StateCode"),
        F.lit("Lake").alias("siteType"),
    )


def test_semi_join_splits_the_hot_site(spark, hot, sites):
    with shuffled(spark):
        df = selection.results_for_sites(hot, sites)
        plan = final_plan(df)
        assert "skew=true" in plan
        assert df.count() == ROWS


def test_state_join_splits_the_hot_site(spark, hot, sites):
    with shuffled(spark):
        df = selection.extract_by_state(hot, sites)
        assert "skew=true" in final_plan(df)
        assert df.count() == ROWS


def test_duplicates_shrink_before_the_shuffle(spark, hot):
    df = quality.dedupe_first(hot.select("wqx_id", "secchi"), ["wqx_id"], ["secchi"])
    plan = final_plan(df)
    assert "partial_min" in plan and df.count() == hot.select("wqx_id").distinct().count()


def test_quantiles_of_a_hot_group(spark, hot):
    with shuffled(spark):
        group = F.when(F.col("wqx_id") == "S0", F.lit("hot")).otherwise(F.col("wqx_id"))
        df = hot.select(group.alias("g"), (F.col("secchi") + F.hash("payload") % 97 / 100).alias("v"))
        expected = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("p")).collect()}
        counts = quantiles.value_counts(df, ["g"], "v")
        found = {r["g"]: r["med"] for r in quantiles.exact_quantiles(counts, ["g"], "v", {"med": 0.5}).collect()}
    assert found.keys() == expected.keys()
    assert all(found[g] == pytest.approx(expected[g], rel=1e-12) for g in found)


def test_only_one_bin_of_a_hot_group_is_sorted(spark):
    df = spark.range(0, 200_000, 1, 8).select(
        F.struct(F.lit("a").alias("g")).alias("_g"), F.col("id").cast("double").alias("_v"), F.lit(1).cast("long").alias("_n")
    )
    sorted_rows = quantiles._candidates(df, [0.5]).count()
    # A bin is a four-thousandth of an octave, which has half of these values; the median may touch two.
    assert 1 <= sorted_rows < 200_000 / quantiles.BINS * 4


def test_points_piled_up_in_one_cell(spark):
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    vertices = [(p, 390, 0, k, x + p * 2.0, float(y)) for p in range(20) for k, (x, y) in enumerate(corners)]
    polys = spatial.polygons_from_vertices(spark.createDataFrame(vertices, VERTEX_SCHEMA))
    pts = spark.range(0, 30_000, 1, 8).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("wqx_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") % 4000) / 100.0).alias("lon"),
        F.lit(0.5).alias("lat"),
    )
    expected = pts.where("lon % 2 > 0 and lon % 2 < 1").count()
    with shuffled(spark):
        df = spatial.point_in_polygon(pts, polys)
        assert "skew=true" in final_plan(df)
        assert df.count() == expected
