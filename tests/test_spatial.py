import math
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import spatial
from lakeledger.schema import VERTEX_SCHEMA


def ring(poly, corners, number=0, ftype=390, closed=True):
    path = corners + corners[:1] if closed else corners
    return [(poly, ftype, number, k, float(x), float(y)) for k, (x, y) in enumerate(path)]


def polygons(spark, *rings, keep=("ftype",)):
    return spatial.polygons_from_vertices(spark.createDataFrame([v for r in rings for v in r], VERTEX_SCHEMA), keep)


def points(spark, *coordinates):
    data = [(f"P{i}", None if x is None else float(x), None if y is None else float(y)) for i, (x, y) in enumerate(coordinates)]
    return spark.createDataFrame(data, "wqx_id string, lon double, lat double")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2)]


def hits(points_df, polys, **options):
    return sorted((r["wqx_id"], r["poly_id"]) for r in spatial.point_in_polygon(points_df, polys, **options).collect())


def test_edges_vertices_and_holes_are_outside(spark):
    polys = polygons(spark, ring(1, SQUARE), ring(1, HOLE, number=1))
    probe = points(spark, (3, 3), (0, 2), (4, 2), (2, 0), (2, 4), (0, 0), (4, 4), (1.5, 1.5), (1, 1.5), (1, 1), (5, 1), (None, 1))
    assert hits(probe, polys) == [("P0", 1)]


def test_a_ring_that_is_not_closed_is_closed(spark):
    probe = points(spark, (0.5, 3.9), (0, 2), (-1, 2))
    assert hits(probe, polygons(spark, ring(1, SQUARE, closed=False))) == [("P0", 1)]


def test_overlapping_polygons_each_match_once(spark):
    polys = polygons(spark, ring(2, SQUARE), ring(1, [(1, 1), (9, 1), (9, 9), (1, 9)]))
    probe = points(spark, (2.5, 2.5), (8, 8), (None, None), (100, 100))
    assert hits(probe, polys) == [("P0", 1), ("P0", 2), ("P1", 1)]
    assigned = {r["wqx_id"]: r["poly_id"] for r in spatial.assign_polygon(probe, polys).collect()}
    assert assigned == {"P0": 1, "P1": 1, "P2": None, "P3": None}


def crossing_parity(rings, x, y):
    inside = False
    for corners in rings:
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


@pytest.mark.parametrize("grid", [
    spatial.DEGREES,
    spatial.Grid((0.5, 4.0), max_cells=16),
    spatial.Grid((1.0,), max_cells=1),
    spatial.Grid((0.01, 0.1, 1.0), max_cells=5000),
])
def test_grid_agrees_with_brute_force_on_ragged_polygons(spark, grid):
    rng = random.Random(11)
    shapes, rings = {}, []
    for poly in range(12):
        cx, cy, size = rng.uniform(-8, 8), rng.uniform(-8, 8), rng.choice([0.05, 0.7, 3.0, 6.0])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 40)))
        outer = [(cx + size * rng.uniform(0.4, 1) * math.cos(t), cy + size * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]
        shapes[poly] = [outer]
        rings.append(ring(poly, outer))
        if poly % 3 == 0:
            hole = [(cx + size * 0.2 * dx, cy + size * 0.2 * dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            shapes[poly].append(hole)
            rings.append(ring(poly, hole, number=1))
    probes = [(rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(1500)]
    # Points on cell borders, and points close to each polygon.
    probes += [(x * 0.4, y * 0.4) for x in range(-20, 20) for y in range(-20, 20)]
    probes += [(c[0][0][0] + rng.uniform(-0.1, 0.1), c[0][0][1] + rng.uniform(-0.1, 0.1)) for c in shapes.values() for _ in range(20)]
    expected = sorted(
        (f"P{i}", poly) for i, (x, y) in enumerate(probes) for poly, rs in shapes.items() if crossing_parity(rs, x, y)
    )
    assert len(expected) > 300
    assert hits(points(spark, *probes), polygons(spark, *rings), grid=grid) == expected


def test_a_large_polygon_covers_few_cells_and_inner_cells_carry_no_edges(spark):
    polys = polygons(spark, ring(1, [(-170, -80), (170, -80), (170, 80), (-170, 80)]), ring(2, [(0, 0), (0.02, 0), (0, 0.02)]))
    cells = spatial.polygon_cells(polys, spatial.DEGREES).groupBy("poly_id").agg(
        F.count("*").alias("n"), F.count_if(F.size("_edges") == 0).alias("inner")
    )
    found = {r["poly_id"]: (r["n"], r["inner"]) for r in cells.collect()}
    assert found[1][0] <= 28 * 14 and found[1][1] > found[1][0] / 2
    assert found[2][0] <= 4


def test_counts_and_bins_include_empty_polygons(spark, rows):
    polys = polygons(spark, ring(1, SQUARE), ring(2, [(10, 10), (11, 10), (11, 11)]))
    probe = points(spark, (1, 1), (2, 2), (3, 3), (20, 20))
    counts = spatial.count_per_polygon(probe, polys, "lon", "lat", spatial.DEGREES)
    assert rows(counts) == [(1, 3), (2, 0)]
    assigned = spatial.assign_polygon(probe, polys).where("poly_id is null").count()
    assert sum(n for _, n in rows(counts)) + assigned == 4


def test_log_bins(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 7, 8, 1000, 5000)], "n_sites long")
    found = {r["n_sites"]: r["bin"] for r in spatial.log_bin(counts).collect()}
    assert found == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4, 5: 4, 7: 4, 8: 5, 1000: 11, 5000: 11}


def test_a_tie_in_log_space_takes_the_first_edge(spark):
    counts = spark.createDataFrame([(2,)], "n_sites long")
    assert spatial.log_bin(counts, bins=(0, 1, 4)).first()["bin"] == 2


def test_automatic_edges_follow_the_largest_count(spark):
    def edges(largest):
        return spark.range(1).select(spatial.log_edges(repr(largest) + "D").alias("e")).first()["e"]

    assert edges(40.0) == [10.0, 20.0, 50.0, 100.0, 200.0, 500.0]
    assert edges(20.0) == [10.0, 20.0, 50.0]
    assert edges(90000.0) == [10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
    counts = spark.createDataFrame([(0,), (1,), (30,), (200,)], "n_sites long")
    assert {r["n_sites"]: r["bin"] for r in spatial.log_bin_auto(counts).collect()} == {0: 1, 1: 2, 30: 3, 200: 6}


def test_projection_is_centred_and_keeps_area(spark):
    def xy(*lonlat):
        df = spark.createDataFrame([tuple(map(float, p)) for p in lonlat], "lon double, lat double")
        return [(r["x"], r["y"]) for r in spatial.project_2163(df).collect()]

    assert xy((-100, 45))[0] == pytest.approx((0, 0), abs=1e-6)
    west, east = xy((-110, 40), (-90, 40))
    assert west[0] == pytest.approx(-east[0]) and west[1] == pytest.approx(east[1])
    # A small cell of latitude and longitude keeps its area on the sphere.
    d = 0.01
    corner = xy((-80, 30), (-80 + d, 30), (-80 + d, 30 + d), (-80, 30 + d))
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corner, corner[1:] + corner[:1]))) / 2
    sphere = 6370997.0**2 * math.radians(d) * (math.sin(math.radians(30 + d)) - math.sin(math.radians(30)))
    assert area == pytest.approx(sphere, rel=1e-6)


def test_coverage_runs_over_states_in_order(spark, rows):
    hits_df = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (2, "B"), (4, "C")], "state int, wqx_id string")
    states = spark.createDataFrame([(1,), (2,), (3,), (4,)], "state int")
    assert rows(spatial.coverage_by_state(hits_df, states)) == [(1, 1, 1), (2, 2, 2), (3, 0, 2), (4, 1, 3)]


def test_region_polygons_keep_vertices_without_region(spark, rows):
    vertices = spark.createDataFrame([("minnesota", 1), ("alaska", 2)], "region string, k int")
    assert rows(spatial.region_polygons(vertices), "region", "area") == [("alaska", None), ("minnesota", "Midwest")]


def _outline(spark, rings):
    rows = [(1, ring, k, float(x), float(y)) for ring, corners in rings for k, (x, y) in enumerate(corners)]
    return spatial.polygons_from_vertices(spark.createDataFrame(rows, "poly_id int, ring int, k int, x double, y double"))


def _coast(spark, corners):
    """The corners of one jagged ring about the origin, as rows made by Spark."""
    turn = f"(2 * pi() * id / {corners})"
    reach = "(10D + 0.1D * (id % 2))"
    return spark.range(0, corners, 1, 8).selectExpr(
        "1 AS poly_id", "0 AS ring", "CAST(id AS INT) AS k", f"{reach} * cos{turn} AS x", f"{reach} * sin{turn} AS y"
    )


def test_stored_edges_follow_the_corners_of_a_long_coast(spark):
    most = {}
    for corners in (10_000, 40_000):
        edges = spatial.polygon_edges(_coast(spark, corners))
        assert edges.count() == corners
        cells = spatial.polygon_cells(edges, spatial.DEGREES)
        stored, most[corners], n = cells.selectExpr("sum(size(_edges))", "max(size(_edges))", "count(*)").first()
        assert stored <= 2 * corners and n <= max(corners, spatial.DEGREES.max_cells)
    assert most[40_000] < 40_000 / 10
    probe = points(spark, (0, 0.1), (9.9, 0.1), (10.5, 0.1), (-9, 0.1), (-11, 0.1), (7, 7), (7.2, 7.2))
    assert [name for name, _ in hits(probe, edges)] == ["P0", "P1", "P3", "P5"]


def test_a_ring_is_spread_over_tasks_and_its_gaps_are_errors(spark):
    with_settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in with_settings}
    try:
        for name, value in with_settings.items():
            spark.conf.set(name, value)
        edges = spatial.polygon_edges(_coast(spark, 100_000))
        sizes = [r.n for r in edges.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 100_000 and max(sizes) < 40_000
    gap = _coast(spark, 10).where("k <> 4")
    with pytest.raises(Exception, match="without gaps"):
        spatial.polygon_edges(gap).collect()


@pytest.mark.parametrize("grid", [spatial.Grid((0.5, 4.0)), spatial.Grid((1.0,), max_cells=4), spatial.Grid((0.25, 8.0), max_cells=4)])
def test_corners_edges_and_points_on_the_lattice_of_cells(spark, grid):
    rng = random.Random(3)
    shapes = {}
    for poly in range(30):
        corners = [(rng.randint(-6, 6), rng.randint(-6, 6)) for _ in range(rng.randint(3, 9))]
        shapes[poly] = [corners]
    vertices = spark.createDataFrame([v for poly, rings in shapes.items() for v in ring(poly, rings[0])], VERTEX_SCHEMA)
    probes = [(x / 2, y / 2) for x in range(-13, 14) for y in range(-13, 14)]

    def on_edge(corners, x, y):
        return any(
            min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])
            and (b[0] - a[0]) * (y - a[1]) == (x - a[0]) * (b[1] - a[1])
            for a, b in zip(corners, corners[1:] + corners[:1])
        )

    expected = sorted(
        (f"P{i}", poly) for i, (x, y) in enumerate(probes) for poly, rings in shapes.items()
        if crossing_parity(rings, x, y) and not on_edge(rings[0], x, y)
    )
    found = hits(points(spark, *probes), spatial.polygon_edges(vertices, ["ftype"]), grid=grid, keep=["ftype"])
    assert found == expected and len(found) > 1000
    assert hits(points(spark, *probes), spatial.polygons_from_vertices(vertices, ["ftype"]), grid=grid) == expected


def test_many_rings(spark):
    islands = [(i, [(i % 200 * 0.05, i // 200 * 0.05 + y) for y in (0, 0.02)] + [(i % 200 * 0.05 + 0.02, i // 200 * 0.05)]) for i in range(20_000)]
    assert _outline(spark, islands).selectExpr("size(rings) AS n").first().n == 20_000


def test_metres_on_a_grid_of_degrees_are_an_error(spark):
    square = _outline(spark, [(0, [(0, 0), (0, 20_000), (20_000, 20_000), (20_000, 0)])])
    points = spark.createDataFrame([(1, 10.0, 10.0)], "wqx_id int, lon double, lat double")
    with pytest.raises(Exception, match="too large for the grid"):
        spatial.point_in_polygon(points, square).collect()
    assert spatial.point_in_polygon(points, square, grid=spatial.METRES).count() == 1
