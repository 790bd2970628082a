"""Points in polygons, and what is counted from it.

The join is an equi-join on grid cells followed by an exact test. Each polygon is listed under the cells of one grid
level, chosen so that it has few cells for its corners; a point looks up its one cell per level, so a pair of point and
polygon comes up at most once.

Edges are rows, dealt to the cells they cross. A cell keeps only those, and one bit: whether its lower left corner is
inside, the parity of the crossings to the left along its row of cells. A point is inside if the path from that corner to
it, along the bottom of the cell and then straight up, turns the bit to true. Cells that have no edge and are not inside
are dropped before the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups
from ..functions.projection import equal_area_xy
from .ordered import running_total


@dataclass(frozen=True)
class Grid:
    """Cell sizes in coordinate units, finest first.

    A polygon is listed at the finest size at which its box has at most ``max_cells`` cells, or no more cells than the
    polygon has edges and no edge crosses more than two on average; else at the coarsest. One whose box has more than
    ``most_cells`` even there, and more than it has edges, has coordinates of another kind than the grid and is an error.
    """

    sizes: tuple[float, ...]
    max_cells: int = 256
    most_cells: int = 4096


DEGREES = Grid((0.05, 0.8, 12.8))
METRES = Grid((5_000.0, 80_000.0, 1_280_000.0))


def project_2163(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Adds equal-area coordinates in metres."""
    east, north = equal_area_xy(F.col(lon), F.col(lat))
    return df.withColumns({x: east, y: north})


def polygons_from_vertices(vertices: DataFrame, keep: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """One row per polygon from (poly_id, ring, k, x, y): rings in vertex order and the bounding box.

    ``keep`` names polygon attributes. Rings are gathered first and then joined to polygons, so the work is in
    proportion to the corners however many rings they form. What is gathered per row is the outline of one polygon.
    """
    ring = vertices.groupBy("poly_id", *keep, "ring").agg(
        F.expr(f"array_sort(collect_list(struct(k, `{x}` AS x, `{y}` AS y)))").alias("_path"),
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"),
    )
    ring = ring.withColumn("_path", F.expr("transform(_path, p -> struct(p.x AS x, p.y AS y))"))
    return ring.groupBy("poly_id", *keep).agg(
        F.expr("transform(array_sort(collect_list(struct(ring, _path))), r -> r._path)").alias("rings"),
        F.struct(
            F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax")
        ).alias("bbox"),
    )


def polygon_edges(vertices: DataFrame, keep: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """(poly_id, kept attributes, x1, y1, x2, y2): one row an edge, from (poly_id, ring, k, x, y).

    A ring's numbers ``k`` have no gaps; a ring that is not closed is closed by its last edge. Every corner meets the next
    one by a join, so a ring of any length is spread over many tasks; no outline is gathered. Functions of this module
    take these rows wherever they take polygons.
    """
    place = ["poly_id", *keep, "ring"]
    ends = vertices.groupBy(*place).agg(F.min("k").alias("_first"), F.max("k").alias("_last"), F.count(F.lit(1)).alias("_n"))
    gap = "raise_error('ring ' || ring || ' of polygon ' || poly_id || ': corners are not numbered without gaps')"
    ends = ends.selectExpr(*place, f"IF(_last - _first + 1 = _n, _first, {gap}) AS _first", "_last")
    same = [F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")) for name in place]
    corners = vertices.alias("a").join(ends.alias("b"), same).selectExpr(
        *[f"a.`{name}`" for name in place], f"a.`{x}` AS x1", f"a.`{y}` AS y1", "IF(k = _last, _first, k + 1) AS _next"
    )
    following = vertices.selectExpr(*[f"`{name}`" for name in place], "k AS _next", f"`{x}` AS x2", f"`{y}` AS y2")
    same = [F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")) for name in [*place, "_next"]]
    return corners.alias("a").join(following.alias("b"), same).selectExpr(
        *[f"a.`{name}`" for name in ("poly_id", *keep)], "x1", "y1", "x2", "y2"
    )


# The geometry below is SQL text over column names: it is all lambdas, which read better so than nested calls.

# All edges of all rings; a ring that is not closed is closed by its last edge.
EDGES = """
    flatten(transform(rings, r -> transform(r, (p, i) ->
        struct(p.x AS x1, p.y AS y1, get(r, (i + 1) % size(r)).x AS x2, get(r, (i + 1) % size(r)).y AS y2))))"""

# Parts of a cell that a border counts as its own, so that rounding can only list an edge once too often, never lose it.
WIDENED = 1e-8
NO_EDGE = "CAST(NULL AS struct<x1: double, y1: double, x2: double, y2: double>)"


def _crossing(e: str, along: str, at: str, of: str) -> str:
    """The coordinate ``of`` (x or y) at which an edge crosses the line on which ``along`` is ``at``; exact at its ends.

    ANSI mode would refuse to divide by the height of a level edge, which never crosses: try_divide.
    """
    slope = f"({e}{of}2 - {e}{of}1) * try_divide({at} - {e}{along}1, {e}{along}2 - {e}{along}1)"
    return f"CASE WHEN {at} = {e}{along}1 THEN {e}{of}1 WHEN {at} = {e}{along}2 THEN {e}{of}2 ELSE {e}{of}1 + {slope} END"


def _spans(e: str, along: str, at: str) -> str:
    """Is one end of the edge beyond a line and the other not? Ends on the line count as not beyond."""
    return f"({e}{along}1 > {at}) <> ({e}{along}2 > {at})"


def _column(e: str) -> str:
    """The column of cells in which an edge crosses the bottom of the row of cells _cy."""
    return f"CAST(floor(greatest({_crossing(e, 'y', '(_cy * _size)', 'x')}, bbox.xmin) / _size) AS BIGINT)"


def _odd_turns(x: str, y: str) -> str:
    """Does the path from a cell's lower left corner to a point in it cross an odd number of the cell's edges?

    The path runs just above the cell's bottom to just right of the point's x, then up. An edge that passes the bend itself
    is to the left of it if it leans to the left going up.
    """
    bottom = "(_cy * _size)"
    at = _crossing("e.", "y", bottom, "x")
    level = f"""{_spans('e.', 'y', bottom)} AND {_column('e.')} >= _cx
            AND ({at} < {x} OR ({at} = {x} AND (e.x2 - e.x1) * (e.y2 - e.y1) <= 0))"""
    at = _crossing("e.", "x", x, "y")
    up = f"{_spans('e.', 'x', x)} AND {at} > {bottom} AND {at} < {y}"
    return f"aggregate(_edges, false, (odd, e) -> odd <> (({level}) <> ({up})))"


def _on_edge(edges: str, x: str, y: str) -> str:
    return f"""
        exists({edges}, e -> {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
            AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
            AND (e.x2 - e.x1) * ({y} - e.y1) = ({x} - e.x1) * (e.y2 - e.y1))"""


def _cell(value: str, size: str | float) -> str:
    divisor = f"{size!r}D" if isinstance(size, float) else size
    return f"CAST(floor({value} / {divisor}) AS BIGINT)"


def _cell_range(axis: str, size: str | float) -> tuple[str, str]:
    return _cell(f"bbox.{axis}min", size), _cell(f"bbox.{axis}max", size)


def _level(grid: Grid) -> str:
    """Index of the finest cell size that suits a polygon, else of the coarsest, else an error (see ``Grid``)."""
    cases = []
    for i, size in enumerate(grid.sizes):
        (x0, x1), (y0, y1) = _cell_range("x", size), _cell_range("y", size)
        cells = f"({x1} - {x0} + 1) * ({y1} - {y0} + 1)"
        most = grid.most_cells if i + 1 == len(grid.sizes) else grid.max_cells
        few = f"{cells} <= {grid.max_cells}" if i + 1 < len(grid.sizes) else f"{cells} <= greatest({most}, _n)"
        cases.append(f"WHEN {few} OR ({cells} <= _n AND _extent <= _n * {float(size)!r}D) THEN {i}")
    message = "'polygon ' || poly_id || ' is too large for the grid: coordinates of another kind?'"
    return f"CASE WHEN bbox.xmin IS NULL OR bbox.ymin IS NULL THEN NULL {' '.join(cases)} ELSE raise_error({message}) END"


def _edge_rows(polygons: DataFrame, keep: Sequence[str]) -> DataFrame:
    names = [f"`{name}`" for name in ("poly_id", *keep)]
    if "rings" in polygons.columns:
        return polygons.selectExpr(*names, f"inline({EDGES})")
    return polygons.selectExpr(*names, "x1", "y1", "x2", "y2")


def polygon_cells(polygons: DataFrame, grid: Grid, keep: Sequence[str] = ()) -> DataFrame:
    """Polygons listed under the cells they may contain points in: the cell's edges, and is its lower left corner inside?

    Edges are dealt to cells row by row. All rows of cells of a polygon are put together by one shuffle; the window that
    sums crossings runs over the cells of one row, of which there are no more than the grid allows.
    """
    sizes = ", ".join(f"{float(size)!r}D" for size in grid.sizes)
    edges = _edge_rows(polygons, keep).where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    boxes = edges.groupBy("poly_id").agg(
        *[F.first(name).alias(name) for name in keep],
        F.expr("struct(min(least(x1, x2)) AS xmin, min(least(y1, y2)) AS ymin, max(greatest(x1, x2)) AS xmax, max(greatest(y1, y2)) AS ymax)").alias("bbox"),
        F.count(F.lit(1)).alias("_n"), F.sum(F.expr("abs(x2 - x1) + abs(y2 - y1)")).alias("_extent"),
    )
    boxes = boxes.selectExpr("poly_id", *[f"`{name}`" for name in keep], "bbox", f"{_level(grid)} AS _level")
    boxes = boxes.selectExpr("*", f"get(array({sizes}), _level) AS _size")
    rows = (
        edges.select("poly_id", "x1", "y1", "x2", "y2")
        .join(boxes.select("poly_id", "bbox", "_size"), "poly_id")
        .selectExpr("*", f"explode(sequence({_cell(f'(least(y1, y2) - {WIDENED}D * _size)', '_size')}, {_cell(f'(greatest(y1, y2) + {WIDENED}D * _size)', '_size')})) AS _cy")
    )
    # within a row of cells an edge has the columns between its crossings of the row's borders, or all if it is nearly level
    low, high = (f"{end}(greatest(y1, y2), greatest(least(y1, y2), ((_cy + {side}) * _size)))" for end, side in (("least", "0"), ("least", "1")))
    level = "abs(y2 - y1) < 1e-3D * _size"
    ends = [f"IF({level}, {edge}, {_crossing('', 'y', at, 'x')})" for edge, at in (("x1", low), ("x2", high))]
    slack = f"{WIDENED}D * (_size + abs(x2 - x1))"
    columns = [_cell(f"({end}({ends[0]}, {ends[1]}) {sign} {slack})", "_size") for end, sign in (("least", "-"), ("greatest", "+"))]
    listed = f"transform(sequence({columns[0]}, {columns[1]}), c -> struct(c AS _cx, struct(x1, y1, x2, y2) AS _edge, 0L AS _turns))"
    turn = f"filter(array(struct({_column('')} AS _cx, {NO_EDGE} AS _edge, 1L AS _turns)), t -> {_spans('', 'y', '(_cy * _size)')})"
    dealt = rows.selectExpr("poly_id", "_cy", f"inline(concat({listed}, {turn}))")
    (x0, x1), (y0, y1) = _cell_range("x", "_size"), _cell_range("y", "_size")
    empty = boxes.where("_size IS NOT NULL").selectExpr("poly_id", f"explode(sequence({y0}, {y1})) AS _cy", f"sequence({x0}, {x1}) AS _all").selectExpr(
        "poly_id", "_cy", "explode(_all) AS _cx", f"{NO_EDGE} AS _edge", "0L AS _turns"
    )
    cells = dealt.union(empty).repartition("poly_id", "_cy").groupBy("poly_id", "_cy", "_cx").agg(
        F.collect_list("_edge").alias("_edges"), F.sum("_turns").alias("_turns")
    )
    before = Window.partitionBy("poly_id", "_cy").orderBy("_cx").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_inside", F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2 == 1)
    cells = cells.where("_inside OR size(_edges) > 0").drop("_turns")
    return cells.join(boxes, "poly_id").selectExpr(
        "poly_id", *[f"`{name}`" for name in keep], "bbox", "_level", "_size", "_cx", "_cy", "_inside", "_edges"
    )


def point_in_polygon(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "lon",
    y: str = "lat",
    grid: Grid = DEGREES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each point with each polygon it lies strictly inside of: not on an edge, not in a hole.

    Returns the point's columns, ``poly_id`` and the polygon attributes named in ``keep``. The planner broadcasts the
    polygon cells only if it finds them small; otherwise crowded cells are left to the adaptive skew join.
    """
    probes = ", ".join(
        f"struct({i} AS _level, {_cell(f'`{x}`', float(size))} AS _cx, {_cell(f'`{y}`', float(size))} AS _cy)"
        for i, size in enumerate(grid.sizes)
    )
    probing = points.where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL").selectExpr("*", f"inline(array({probes}))")
    cells = polygon_cells(polygons, grid, keep).withColumnsRenamed({name: f"_c_{name}" for name in keep})
    qx, qy = f"`{x}`", f"`{y}`"
    matches = f"""
        p._level = c._level AND p._cx = c._cell_x AND p._cy = c._cell_y
        AND p.{qx} > c.bbox.xmin AND p.{qx} < c.bbox.xmax AND p.{qy} > c.bbox.ymin AND p.{qy} < c.bbox.ymax"""
    joined = (
        probing.alias("p")
        .join(cells.withColumnsRenamed({"_cx": "_cell_x", "_cy": "_cell_y", "poly_id": "_poly"}).alias("c"), F.expr(matches))
        .drop("_cell_x", "_cell_y")
    )
    tested = joined.where(f"size(_edges) = 0 OR (_inside <> {_odd_turns(qx, qy)} AND NOT {_on_edge('_edges', qx, qy)})")
    return tested.selectExpr(*[f"`{name}`" for name in points.columns], "_poly AS poly_id", *[f"`_c_{name}` AS `{name}`" for name in keep])


def assign_polygon(
    points: DataFrame, polygons: DataFrame, id: str = "wqx_id", x: str = "lon", y: str = "lat", grid: Grid = DEGREES
) -> DataFrame:
    """Every point with the lowest id of the polygons it lies in, or null."""
    hits = point_in_polygon(points.select(id, x, y), polygons, x, y, grid).groupBy(id).agg(F.min("poly_id").alias("poly_id"))
    return points.join(hits, id, "left")


def sites_in_waterbodies(
    sites: DataFrame,
    polygons: DataFrame,
    ftypes: Sequence[int] = lookups.WATERBODY_FTYPES,
    x: str = "lon",
    y: str = "lat",
    grid: Grid = DEGREES,
) -> DataFrame:
    """Ids of sites strictly inside any water body of the kept feature types: the allow-list of lake sites."""
    kept = polygons.where(F.col("ftype").isin(*ftypes))
    return point_in_polygon(sites.select("wqx_id", x, y), kept, x, y, grid).select("wqx_id").distinct()


def coverage_by_state(hits: DataFrame, states: DataFrame) -> DataFrame:
    """Sites hit per state and distinct sites hit up to that state, in state order.

    ``hits`` holds (state, wqx_id); ``states`` lists every state, so one without hits shows too.
    """
    pairs = hits.select("state", "wqx_id").distinct()
    per_state = pairs.groupBy("state").agg(F.count(F.lit(1)).alias("n_sites"))
    first_seen = (
        pairs.groupBy("wqx_id").agg(F.min("state").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n_new"))
    )
    every = (
        states.select("state")
        .distinct()
        .join(per_state, "state", "left")
        .join(first_seen, "state", "left")
        .fillna(0, ["n_sites", "n_new"])
    )
    return running_total(every, ["state"], "n_new", "n_sites_so_far").select("state", "n_sites", "n_sites_so_far")


def count_per_polygon(
    points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", grid: Grid = METRES
) -> DataFrame:
    """Points per polygon, zero included."""
    hits = point_in_polygon(points.select(x, y), polygons, x, y, grid)
    counts = hits.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return polygons.select("poly_id").distinct().join(counts, "poly_id", "left").fillna(0, ["n_sites"])


def _nearest_bin(count: str, edges: str) -> Column:
    """1 for zero; otherwise 2 plus the index of the edge nearest in log space, the first one on a tie."""
    distances = f"transform({edges}, (e, i) -> struct(abs(ln(`{count}`) - ln(e)) AS distance, i AS i))"
    return F.expr(f"CAST(IF(`{count}` = 0, 1, array_min({distances}).i + 2) AS INT)")


def log_bin(counts: DataFrame, bins: Sequence[int] = lookups.COUNT_BINS, count: str = "n_sites") -> DataFrame:
    """Adds ``bin``: 1 is the class without sites, then one class per edge after the leading zero of ``bins``."""
    edges = ", ".join(f"{float(edge)!r}D" for edge in bins[1:])
    return counts.withColumn("bin", _nearest_bin(count, f"array({edges})"))


def log_edges(largest: str, lo: float = 10.0, hi: float = 1000.0) -> Column:
    """1-2-5 series within ``lo..hi``, up to 5 times the power of ten nearest to ``largest`` in log space."""
    decades = f"sequence(-1, greatest(-1, CAST(round(log10({largest})) AS INT)))"
    series = f"flatten(transform({decades}, d -> transform(array(1D, 2D, 5D), m -> m * power(10D, d))))"
    return F.expr(f"filter({series}, e -> e BETWEEN {lo!r}D AND {hi!r}D)")


def log_bin_auto(counts: DataFrame, lo: float = 10.0, hi: float = 1000.0, count: str = "n_sites") -> DataFrame:
    """As ``log_bin`` with edges derived from the largest count, which is read once as a scalar subquery."""
    largest = counts.where(F.col(count) > 0).agg(F.max(count)).scalar()
    return (
        counts.withColumn("_largest", largest)
        .withColumn("_edges", log_edges("_largest", float(lo), float(hi)))
        .withColumn("bin", _nearest_bin(count, "_edges"))
        .drop("_largest", "_edges")
    )


def site_density_panel(
    target_sites: DataFrame,
    sites: DataFrame,
    polygons: DataFrame,
    targets: Sequence[str] = lookups.PANEL_TARGETS,
    bins: Sequence[int] = lookups.COUNT_BINS,
    x: str = "x",
    y: str = "y",
    grid: Grid = METRES,
) -> DataFrame:
    """Site counts and bins of every polygon for every target, zero included, from one spatial join."""
    placed = point_in_polygon(sites.select("wqx_id", x, y), polygons, x, y, grid).select("wqx_id", "poly_id")
    counts = (
        target_sites.where(F.col("target").isin(*targets))
        .join(placed, "wqx_id")
        .groupBy("target", "poly_id")
        .agg(F.count(F.lit(1)).alias("n_sites"))
    )
    every = polygons.select("poly_id").distinct().select("poly_id", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    filled = every.join(counts, ["target", "poly_id"], "left").fillna(0, ["n_sites"])
    return log_bin(filled, bins)


def region_polygons(vertices: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Polygon vertices with the area of their ``region``, the lower-case state name; null outside every area."""
    regions = F.broadcast(lookups.state_regions(vertices.sparkSession)) if regions is None else regions
    return vertices.join(regions.select("region", "area"), "region", "left")
