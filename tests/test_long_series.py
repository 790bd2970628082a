import random

import pytest
from test_seasonal import plain_3rs3r

from lakeledger.operators.long_series import tukey_smooth_long

SCHEMA = "area string, day long, med double"


def smooth(spark, series, block):
    """{area: smoothed values} of {area: values}."""
    data = [(area, day, None if v is None else float(v)) for area, values in series.items() for day, v in enumerate(values)]
    random.Random(5).shuffle(data)
    out = {}
    result = tukey_smooth_long(spark.createDataFrame(data, SCHEMA), ["area"], "day", block=block)
    assert result.columns == ["area", "day", "med", "smooth"]
    for r in sorted(result.collect(), key=lambda r: (r["area"] or "", r["day"])):
        out.setdefault(r["area"], []).append(r["smooth"])
    return out


def test_series_of_all_lengths_across_blocks_match_the_straight_line_version(spark):
    rng = random.Random(8)
    lengths = [1, 2, 3, 4, 5, 6, 15, 16, 17, 18, 31, 33, 49, 64, 200, 500]
    series = {f"s{n}": [rng.randint(0, 6) for _ in range(n)] for n in lengths}
    series["rough"] = [rng.random() for _ in range(700)]
    series[None] = [rng.randint(0, 3) for _ in range(90)]
    assert smooth(spark, series, 16) == {area: plain_3rs3r(values) for area, values in series.items()}


def test_a_series_that_swings_all_along_settles_from_its_ends(spark):
    swing = [k % 2 for k in range(301)]
    assert smooth(spark, {"a": swing, "b": [0, 0, 5, 5, 0, 0] * 20}, 32) == {
        "a": plain_3rs3r(swing), "b": plain_3rs3r([0, 0, 5, 5, 0, 0] * 20),
    }


def test_nulls_repeated_positions_and_empty_tables(spark):
    values = [4, None, 1, 3, 6, 6, None, 4, 1, 6, 2, 4, 2] * 5
    present = [v for v in values if v is not None]
    assert smooth(spark, {"a": values}, 16) == {"a": plain_3rs3r(present)}
    data = [("a", k // 3, float(v)) for k, v in enumerate(sorted(present))] + [("a", 40, 1.0)] * 30
    found = tukey_smooth_long(spark.createDataFrame(data, SCHEMA), ["area"], "day", block=16).collect()
    assert [r["smooth"] for r in sorted(found, key=lambda r: (r["day"], r["med"]))] == plain_3rs3r([v for _, _, v in data])
    assert tukey_smooth_long(spark.createDataFrame([], SCHEMA), ["area"], "day").collect() == []


def test_no_row_holds_more_than_a_block(spark):
    with pytest.raises(ValueError):
        tukey_smooth_long(spark.createDataFrame([], SCHEMA), ["area"], "day", block=8)
    from lakeledger.operators.long_series import _blocks

    long = spark.range(5000).selectExpr("'a' as area", "id as day", "double(id % 7) as med")
    sizes = [r[0] for r in _blocks(long, ["area"], "day", "med", 64).selectExpr("size(_path)").collect()]
    assert sum(sizes) == 5000 and max(sizes) == 64
