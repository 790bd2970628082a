import random

from lakeledger.operators import seasonal

GOLDEN = [4, 1, 3, 6, 6, 4, 1, 6, 2, 4, 2]
GOLDEN_3RS3R = [3, 3, 3, 3, 4, 4, 4, 4, 2, 2, 2]


def smooth(spark, *series):
    data = [(f"s{i}", week + 1, None if v is None else float(v)) for i, values in enumerate(series) for week, v in enumerate(values)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "area string, week int, med double")
    out = {}
    for r in sorted(seasonal.tukey_smooth(df, ["area"]).collect(), key=lambda r: (r["area"], r["week"])):
        out.setdefault(r["area"], []).append(r["smooth"])
    return [out.get(f"s{i}", []) for i in range(len(series))]


def median3(a, b, c):
    return sorted((a, b, c))[1]


def plain_3rs3r(x):
    """Straight-line version of the smoother to compare with."""
    n = len(x)
    if n < 3:
        return list(x)

    def settle(source):
        y = list(source)
        while True:
            z = [y[0]] + [median3(*y[i - 1:i + 2]) for i in range(1, n - 1)] + [y[-1]]
            if z == y:
                break
            y = z
        return [median3(3 * y[1] - 2 * y[2], source[0], y[1])] + y[1:-1] + [median3(y[-2], source[-1], 3 * y[-2] - 2 * y[-3])]

    y = settle(x)
    z = list(y)
    for i in range(2, n - 3):
        up, down = y[i - 1] <= y[i] and y[i + 1] <= y[i + 2], y[i - 1] >= y[i] and y[i + 1] >= y[i + 2]
        if y[i] == y[i + 1] and not up and not down:
            z[i] = median3(y[i], y[i - 1], 3 * y[i - 1] - 2 * y[i - 2])
            z[i + 1] = median3(y[i + 1], y[i + 2], 3 * y[i + 2] - 2 * y[i + 3])
    return settle(z)


def test_golden_vector_and_short_series(spark):
    assert smooth(spark, GOLDEN, [5], [5, 1], [1, 9, 2]) == [GOLDEN_3RS3R, [5], [5, 1], plain_3rs3r([1, 9, 2])]


def test_monotone_interior_is_unchanged(spark):
    line = [v * v for v in range(12)]
    assert smooth(spark, line)[0][1:-1] == line[1:-1]


def test_nulls_are_dropped_first(spark):
    assert smooth(spark, [4, 1, None, 3, 6, 6, 4, 1, 6, None, 2, 4, 2])[0] == GOLDEN_3RS3R


def test_many_random_series_match_the_straight_line_version(spark):
    rng = random.Random(3)
    series = [[rng.randint(0, 9) for _ in range(rng.randint(1, 53))] for _ in range(150)]
    assert smooth(spark, *series) == [plain_3rs3r(s) for s in series]


def test_one_pass(spark, rows):
    df = spark.createDataFrame([("a", w, float(v)) for w, v in enumerate(GOLDEN)], "area string, week int, med double")
    smooth_once = [r[-1] for r in sorted(rows(seasonal.smooth3(df, ["area"])), key=lambda t: t[1])]
    assert smooth_once == [4, 3, 3, 6, 6, 4, 4, 2, 4, 2, 2]


def test_medians_by_geography_count_a_result_once_per_region(spark, rows):
    results = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 3.0), ("B", 2, 10.0), ("C", 1, 99.0)], "wqx_id string, week int, secchi double")
    assigned = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2), ("C", None), ("D", 3)], "wqx_id string, poly_id int")
    regions = spark.createDataFrame([(1, "west"), (2, "west"), (3, None)], "poly_id int, area string")
    assert rows(seasonal.weekly_median_by_geography(results, assigned, regions)) == [
        ("west", None, 3.0), ("west", 1, 2.0), ("west", 2, 10.0),
    ]
