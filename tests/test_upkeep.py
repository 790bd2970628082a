"""Counts that are kept up to date, sums along an order, and snapshots along a curve."""

import datetime as dt
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lakeledger.operators import inventory, merging, ordered, spatial
from lakeledger.schema import COUNT_SCHEMA
from lakeledger.sources import tables

FACT = "characteristicType string, siteType string, wqx_id string, Date date"


def facts(seed, n, first=dt.date(2000, 1, 1), days=700, sites=40):
    draw = random.Random(seed)
    site = lambda: None if draw.random() < 0.02 else f"S{0 if draw.random() < 0.33 else draw.randrange(sites)}"
    return [
        (draw.choice(["Nutrient", "Physical"]), draw.choice(["Stream", "Well"]), site(), first + dt.timedelta(draw.randrange(days)))
        for _ in range(n)
    ]


def test_running_total_matches_a_loop(spark):
    draw = random.Random(1)
    data = [(draw.choice([None, *range(20)]), draw.choice([None, 1, 5, -2])) for _ in range(500)]
    for ranges in (1, 7, None):
        df = spark.createDataFrame(data, "k int, n int")
        found = ordered.running_total(df, ["k"], "n", "total", ranges)
        place = lambda k: -1 if k is None else k
        wanted = sorted((place(k), n or 0, sum(m or 0 for j, m in data if place(j) <= place(k))) for k, n in data)
        assert sorted((place(r.k), r.n or 0, r.total) for r in found.collect()) == wanted
    assert ordered.running_total(spark.createDataFrame([], "k int, n int"), ["k"], "n", "total").count() == 0


def test_coverage_of_many_areas_has_no_window_over_the_table(spark):
    areas = spark.range(100_000).selectExpr("lpad(id, 6, '0') AS state")
    hits = spark.range(100_000).selectExpr("lpad(id % 50000 * 2, 6, '0') AS state", "concat('s', id % 30000) AS wqx_id")
    covered = spatial.coverage_by_state(hits, areas)
    plan = covered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("collect_list")[0] and "_range" in plan
    first = {}
    for i in range(100_000):
        first[i % 30000] = min(first.get(i % 30000, 10**9), i % 50000 * 2)
    by_state = {}
    for state in first.values():
        by_state[state] = by_state.get(state, 0) + 1
    found = {int(r.state): r for r in covered.collect()}
    total = 0
    for state in range(100_000):
        total += by_state.get(state, 0)
        assert found[state].n_sites_so_far == total
    assert found[0].n_sites == 2 and found[1].n_sites == 0


def test_appended_batches_equal_a_recount(spark, rows, tmp_path):
    state = str(tmp_path / "state")
    old, month = facts(1, 3000), facts(2, 400, dt.date(2001, 6, 1), 30, sites=60)
    merging.append_counts(spark.createDataFrame(old, FACT), state, "old")
    merging.append_counts(spark.createDataFrame(month, FACT), state, "month")
    whole = rows(inventory.summary_counts(spark.createDataFrame(old + month, FACT)))
    assert rows(merging.merged_counts(spark, state)) == whole
    # a repeated batch replaces itself; numbers of sites are unique and without gaps
    merging.append_counts(spark.createDataFrame(month, FACT), state, "month")
    assert rows(merging.merged_counts(spark, state)) == whole
    numbers = sorted(r.number for r in spark.read.parquet(f"{state}/sites").collect())
    assert numbers == list(range(1, len({f[2] for f in old + month} - {None}) + 1))
    # an empty batch and one without dates or sites
    merging.append_counts(spark.createDataFrame([], FACT), state, "empty")
    merging.append_counts(spark.createDataFrame([("Nutrient", "Well", None, None)], FACT), state, "odd")
    assert [r for r in rows(merging.merged_counts(spark, state)) if r not in whole] == [("Nutrient", "Well", None, 0, 1)]


def test_distinct_sites_beyond_one_bitmap(spark, rows, tmp_path):
    many = spark.range(70_000).selectExpr("'Nutrient' AS characteristicType", "'Well' AS siteType", "concat('s', id) AS wqx_id", "date'2000-01-01' AS Date")
    for batch in ("a", "b"):
        merging.append_counts(many, str(tmp_path), batch)
    assert rows(merging.merged_counts(spark, str(tmp_path))) == [("Nutrient", "Well", 2000, 70_000, 140_000)]


def test_changed_input_recounts_exactly_its_units(spark, rows, tmp_path):
    cache = str(tmp_path / "cache")
    data = facts(3, 2000)
    run = dict(start=2000, end=2001, char_types=["Nutrient", "Physical"], site_types=["Stream", "Well"])
    refresh = lambda data, **other: sorted(tuple(r) for r in inventory.refresh_counts(spark.createDataFrame(data, FACT), cache, **(run | other)).collect())
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    counts = lambda: rows(tables.read_snapshot(spark, cache, COUNT_SCHEMA).where("numResults > 0").select(
        "characteristicType", "siteType", F.year("startDate"), "numSites", "numResults"))

    def wanted(data):
        return rows(inventory.summary_counts(spark.createDataFrame(data, FACT)).where("startYear between 2000 and 2001"))

    assert len(refresh(data)) == 4 and counts() == wanted(data)
    before = files()
    assert refresh(data[::-1]) == [] and files() == before

    late = data + [("Nutrient", "Well", "S1", dt.date(2000, 3, 3))]
    assert refresh(late) == [("Nutrient", "Well")] and counts() == wanted(late)
    assert sum(files().get(p) == t for p, t in before.items()) == 3

    # one site in place of another: as many results as before
    moved = late[:-1] + [("Nutrient", "Well", "S999", dt.date(2000, 3, 3))]
    assert refresh(moved) == [("Nutrient", "Well")] and counts() == wanted(moved)

    gone = [f for f in moved if f[:2] != ("Physical", "Stream")]
    assert refresh(gone) == [("Physical", "Stream")] and counts() == wanted(gone)
    assert refresh(gone) == []
    # another year: every unit lacks it
    assert len(refresh(gone, end=2002)) == 4 and counts() == wanted(gone)


def test_box_of_a_clustered_snapshot_skips_files(spark, rows, tmp_path):
    df = spark.range(40_000).selectExpr(
        "id", "cast(if(id % 3 = 0, 5.0, hash(id) % 10000 / 100.0) AS double) AS lon", "cast(if(id % 3 = 0, 5.0, hash(id, 1) % 5000 / 100.0) AS double) AS lat",
        "date_add(date'2000-01-01', cast(pmod(hash(id, 2), 3000) AS int)) AS day")
    df = df.union(spark.createDataFrame([(-1, None, None, None), (-2, float("nan"), float("inf"), dt.date(1900, 1, 1))], df.schema))
    box = {"lon": (20.0, 35.0), "lat": (10.0, 20.0)}
    touched = {}
    for name, write in {
        "plain": lambda p: df.repartition(128).write.parquet(p),
        "curve": lambda p: tables.write_clustered(df, p, ["lon", "lat", "day"], 128),
    }.items():
        write(str(tmp_path / name))
        touched[name] = 0
        for path in (tmp_path / name).glob("*.parquet"):
            group = pq.ParquetFile(path).metadata
            stats = [{group.row_group(i).column(j).path_in_schema: group.row_group(i).column(j).statistics for j in range(4)} for i in range(group.num_row_groups)]
            touched[name] += any(all(s[c].has_min_max and s[c].max >= lo and s[c].min <= hi for c, (lo, hi) in box.items()) for s in stats)
    assert 4 * touched["curve"] <= touched["plain"]
    back = tables.read_snapshot(spark, str(tmp_path / "curve"))
    assert back.schema.simpleString() == df.schema.simpleString() and rows(back.where("id > 0")) == rows(df.where("id > 0")) and back.count() == df.count()
    region = tables.read_region(spark, str(tmp_path / "curve"), box)
    assert rows(region) == rows(df.where("lon between 20 and 35 and lat between 10 and 20"))
    tables.write_clustered(df.limit(0), str(tmp_path / "none"), ["lon", "day"], 4)
    assert tables.read_snapshot(spark, str(tmp_path / "none"), df.schema).count() == 0
