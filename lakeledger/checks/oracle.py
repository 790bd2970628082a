"""DuckDB SQL that each registered query is compared with.

Written apart from the operators: brute-force containment instead of a grid, ``quantile_cont`` instead of slices,
``row_number`` instead of a struct minimum, recursive passes over rows instead of array functions.
"""

from __future__ import annotations

import re

from .. import lookups


def _quoted(names) -> str:
    return ", ".join("'" + name.replace("'", "''") + "'" for name in names)


def _values(rows) -> str:
    def cell(value):
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


# Each view may use the ones above it.
VIEWS: dict[str, str] = {}

VIEWS["fx_sites"] = """
select concat('SITE-', cast(c_custkey as varchar(20))) as wqx_id, c_custkey,
 case when c_custkey % 50 = 0 then null else 25 + ((c_custkey*7919) % 2400)/100.0e0 end as dec_lat_va,
 case when c_custkey % 50 = 0 then null else -124 + ((c_custkey*104729) % 5700)/100.0e0 end as dec_lon_va,
 lpad(cast(c_nationkey as varchar(10)), 2, '0') as StateCode,
 case c_mktsegment when 'BUILDING' then 'Lake' when 'AUTOMOBILE' then 'Reservoir'
   when 'MACHINERY' then 'Lake, Reservoir, Impoundment' when 'FURNITURE' then 'Great Lake'
   else 'River/Stream' end as MonitoringLocationTypeName,
 case c_custkey % 15 when 0 then 'Aggregate groundwater use' when 1 then 'Aggregate surface-water-use'
   when 2 then 'Atmosphere' when 3 then 'Estuary' when 4 then 'Facility' when 5 then 'Glacier'
   when 6 then 'Lake, Reservoir, Impoundment' when 7 then 'Land' when 8 then 'Not Assigned' when 9 then 'Ocean'
   when 10 then 'Spring' when 11 then 'Stream' when 12 then 'Subsurface' when 13 then 'Well'
   else 'Wetland' end as siteType
from customer"""

VIEWS["fx_results"] = """
select cast(l_shipdate as date) as Date,
 case when l_linenumber = 7 then -l_quantity else l_quantity end as value,
 case l_partkey % 10 when 0 then 'm' when 1 then 'm' when 2 then 'm' when 3 then 'ft' when 4 then 'ft' when 5 then 'f t'
   when 6 then 'in' when 7 then 'cm' when 8 then 'mi'
   else (case when l_suppkey % 2 = 0 then null else 'NTU' end) end as units,
 s.wqx_id, s.dec_lat_va, s.dec_lon_va, s.StateCode,
 case o_orderpriority when '1-URGENT' then 'Field Msr/Obs' when '2-HIGH' then 'Sample-Routine'
   when '3-MEDIUM' then 'Sample-Other' when '4-NOT SPECIFIED' then 'Sample-Field Split'
   else 'Quality Control Sample-Field Replicate' end as ActivityTypeCode,
 case l_returnflag when 'R' then 'Water' when 'A' then 'Habitat' else 'Sediment' end as ActivityMediaName,
 case l_linestatus when 'F' then 'Final' else 'Preliminary' end as ResultStatusIdentifier,
 s.MonitoringLocationTypeName, s.siteType,
 case p_brand when 'Brand#1' then 'Phosphorus' when 'Brand#2' then 'Nitrogen' when 'Brand#3' then 'Arsenic'
   when 'Brand#4' then 'Secchi depth' when 'Brand#5' then 'Depth, Secchi disk depth' when 'Brand#6' then 'Temperature'
   when 'Brand#7' then 'Temperature, water' when 'Brand#8' then 'Organic carbon' when 'Brand#9' then 'Chlorophyll a'
   when 'Brand#10' then 'pH' when 'Brand#11' then 'Dissolved oxygen (DO)' when 'Brand#12' then 'Inorganic carbon'
   when 'Brand#13' then 'Glyphosate' else concat('Other ', p_brand) end as characteristicName,
 case p_type when 'MEDIUM' then 'Nutrient' when 'STANDARD' then 'Physical' when 'LARGE' then 'Inorganics, Major, Metals'
   when 'PROMO' then 'Inorganics, Minor, Non-metals' when 'SMALL' then 'Not Assigned'
   else 'Organics, Pesticide' end as characteristicType
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
 join fx_sites s on o_custkey = s.c_custkey"""

VIEWS["fx_states"] = """
select lpad(cast(n_nationkey as varchar(10)), 2, '0') as STATE, n_name as STATE_NAME,
 case when n_nationkey = 24 then null else r_name end as area
from nation left join region on n_regionkey = r_regionkey"""

VIEWS["fx_units"] = """
select * from (values ('m',1e0),('in',0.0254e0),('ft',0.3048e0),('cm',0.01e0),('mm',0.001e0),('mi',1609.34e0))
 as u(units, factor)"""

VIEWS["fx_vertices"] = """
select n_nationkey as poly_id,
 case n_nationkey % 4 when 0 then 390 when 1 then 436 when 2 then 361 else 460 end as ftype, 0 as ring, k,
 -124 + 11.4e0*(n_nationkey % 5) + (case k when 0 then 0.3e0 when 1 then 10.7e0 when 2 then 11.3e0 when 3 then 0.9e0 else 0.3e0 end) as x,
 25 + 4.8e0*floor(n_nationkey/5) + (case k when 0 then 0.2e0 when 1 then 0.5e0 when 2 then 4.5e0 when 3 then 4.3e0 else 0.2e0 end) as y
from nation cross join (values (0),(1),(2),(3),(4)) as t(k)
union all
select n_nationkey, case n_nationkey % 4 when 0 then 390 when 1 then 436 when 2 then 361 else 460 end, 1, k,
 -124 + 11.4e0*(n_nationkey % 5) + 5.5e0 + (case k when 0 then -2e0 when 2 then 2e0 when 4 then -2e0 else 0e0 end),
 25 + 4.8e0*floor(n_nationkey/5) + 2.4e0 + (case k when 1 then 1e0 when 3 then -1e0 else 0e0 end)
from nation cross join (values (0),(1),(2),(3),(4)) as t(k) where n_nationkey % 2 = 1"""

VIEWS["fx_counts"] = """
select characteristicType, siteType, cast(year(Date) as int) as startYear,
 count(distinct wqx_id) as numSites, count(*) as numResults
from fx_results
group by characteristicType, siteType, year(Date)"""

# --- lookup tables

VIEWS["units_needed"] = f"""
select c as characteristicType, s as siteType
from (select unnest([{_quoted(lookups.CHARACTERISTIC_TYPES)}]) as c)
cross join (select unnest([{_quoted(lookups.SITE_TYPES)}]) as s)"""

VIEWS["groups"] = f"""
select * from (values {_values((g, n) for g, names in lookups.CONSTITUENT_GROUPS.items() for n in names)})
 as t(constituent, characteristicName)"""

VIEWS["map_names"] = f"""
select * from (values {_values((g, n) for g, names in lookups.MAP_CONSTITUENTS.items() for n in names)})
 as t(constituent, characteristicName)"""

VIEWS["targets"] = f"""
select target, split_part(target, '_', 1) as constituent, split_part(target, '_', 2) as scope
from (select unnest([{_quoted(lookups.MAP_TARGETS)}]) as target)"""

VIEWS["target_sites"] = """
select distinct t.target, s.wqx_id
from targets t join map_names n using (constituent) join fx_results r using (characteristicName)
 join fx_sites s on s.wqx_id = r.wqx_id
where t.scope = 'all' or s.siteType = 'Lake, Reservoir, Impoundment'"""

# --- record counts

VIEWS["bounds"] = "select min(year(l_shipdate)) as y0, max(year(l_shipdate)) as y1 from lineitem"
VIEWS["all_years"] = "select unnest(range(y0, y1 + 1))::int as y from bounds"
VIEWS["pages"] = """
select s as page_start, coalesce(lead(s) over (order by s), hi) as page_end, hi as period_end
from (select hi, unnest(range(make_date(y0, 1, 1), hi, interval 2 year))::date as s
 from (select y0, make_date(y1 + 1, 1, 1) as hi from bounds))"""

VIEWS["grid"] = """
select u.characteristicType, u.siteType, make_date(y, 1, 1) as startDate, make_date(y, 12, 31) as endDate,
 c.numSites, c.numResults
from units_needed u cross join all_years
left join fx_counts c on c.characteristicType = u.characteristicType and c.siteType = u.siteType and c.startYear = y"""

VIEWS["shown"] = """
select *, year(startDate) as yr,
 case when characteristicType like 'Inorganics%' then 'Inorganics' when characteristicType like 'Organics%' then 'Organics'
  when characteristicType = 'Not Assigned' then 'NA' else characteristicType end as display_charType,
 case when siteType in ('Estuary', 'Ocean') then 'Marine'
  when siteType in ('Aggregate groundwater use', 'Spring', 'Subsurface', 'Well') then 'Groundwater'
  when siteType = 'Lake, Reservoir, Impoundment' then 'Lake' when siteType in ('Stream', 'Facility') then siteType
  when siteType = 'Not Assigned' then 'NA' else 'Other' end as display_siteType,
 coalesce(numSites, 0) as n_sites, coalesce(numResults, 0) as n_results
from grid"""

VIEWS["share"] = """
with long as (
 select display_charType, display_siteType, n_results from shown
  where display_siteType <> 'NA' and characteristicType <> 'Not Assigned'
 union all
 select 'Total', display_siteType, n_results from shown
  where display_siteType <> 'NA' and characteristicType <> 'Not Assigned')
select display_charType, display_siteType, cast(sum(n_results) as bigint) as numResults_siteType,
 cast(sum(sum(n_results)) over (partition by display_charType) as bigint) as totalnumResults
from long group by display_charType, display_siteType"""

VIEWS["trend"] = """
select case when grouping(display_charType) = 1 then 'Total' else display_charType end as display_charType,
 cast(yr as int) as year, cast(sum(n_sites) as bigint) as numSites, cast(sum(n_results) as bigint) as numResults
from shown where characteristicType <> 'Not Assigned' and yr < (select y1 from bounds)
group by grouping sets ((display_charType, yr), (yr))"""

VIEWS["ranks"] = """
select display_charType, bar_rank,
 row_number() over (order by case when display_charType = 'Total' then 0 else 1 end, bar_rank desc) - 1 as panel_rank
from (select display_charType, row_number() over (order by totalnumResults, display_charType) as bar_rank
 from (select distinct display_charType, totalnumResults from share))"""

# --- points and polygons


def _inside(points: str, edges: str) -> str:
    return f"""
select p.wqx_id, e.poly_id, e.ftype
from {points} p join {edges} e on p.px is not null and p.py is not null and e.x2 is not null
group by p.wqx_id, e.poly_id, e.ftype
having sum(case when (e.y1 > p.py) <> (e.y2 > p.py)
   and p.px < (e.x2 - e.x1) * (p.py - e.y1) / (e.y2 - e.y1) + e.x1 then 1 else 0 end) % 2 = 1
 and sum(case when (e.x2 - e.x1) * (p.py - e.y1) = (p.px - e.x1) * (e.y2 - e.y1)
   and p.px between least(e.x1, e.x2) and greatest(e.x1, e.x2)
   and p.py between least(e.y1, e.y2) and greatest(e.y1, e.y2) then 1 else 0 end) = 0"""


def _projected(lon: str, lat: str) -> tuple[str, str]:
    t = f"radians({lon} + 100e0)"
    p = f"radians({lat})"
    k = (
        f"(6370997e0 * sqrt(2e0 / (1e0 + sin(radians(45e0)) * sin({p})"
        f" + cos(radians(45e0)) * cos({p}) * cos({t}))))"
    )
    return (
        f"{k} * cos({p}) * sin({t})",
        f"{k} * (cos(radians(45e0)) * sin({p}) - sin(radians(45e0)) * cos({p}) * cos({t}))",
    )


def _edges(x: str, y: str) -> str:
    return f"""
select poly_id, ftype, {x} as x1, {y} as y1,
 lead({x}) over (partition by poly_id, ring order by k) as x2, lead({y}) over (partition by poly_id, ring order by k) as y2
from fx_vertices"""


VIEWS["points"] = "select wqx_id, dec_lon_va as px, dec_lat_va as py from fx_sites"
VIEWS["edges"] = _edges("x", "y")
VIEWS["inside"] = _inside("points", "edges")
VIEWS["projected_points"] = "select wqx_id, {} as px, {} as py from fx_sites".format(
    *_projected("dec_lon_va", "dec_lat_va")
)
VIEWS["projected_edges"] = _edges(*_projected("x", "y"))
VIEWS["projected_inside"] = _inside("projected_points", "projected_edges")
VIEWS["polys"] = "select distinct poly_id, ftype from fx_vertices"
VIEWS["allowed"] = "select distinct wqx_id from inside where ftype in (390, 436, 361)"
VIEWS["huc"] = """
select poly_id, count(i.wqx_id) as n_sites from polys left join projected_inside i using (poly_id) group by poly_id"""


def _binned(counts: str, edges: str, keys: str) -> str:
    """Nearest edge in log space; the edges are rows (i, edge)."""
    return f"""
select {keys}, n_sites,
 cast(case when n_sites = 0 then 1 else 1 + (select arg_min(i, abs(ln(c.n_sites) - ln(edge)) * 1e6 + i * 1e-9)
  from {edges} where c.n_sites > 0) end as int) as bin
from {counts} c"""


VIEWS["bin_edges"] = """
select * from (values (1,1),(2,2),(3,5),(4,10),(5,20),(6,50),(7,100),(8,200),(9,500),(10,1000)) as t(i, edge)"""
VIEWS["auto_edges"] = """
select row_number() over (order by edge) as i, edge from (
 select m * power(10, d) as edge from (select unnest([1, 2, 5]) as m) cross join
  (select unnest(range(-1, (select cast(round(log10(max(n_sites))) as bigint) + 1 from huc where n_sites > 0))) as d))
where edge between 10 and 1000"""

# --- Secchi cleaning

_SURVIVOR = """row_number() over (partition by Date, dec_lat_va, dec_lon_va, value
  order by ActivityTypeCode nulls first, ActivityMediaName nulls first, units nulls first, wqx_id nulls first,
  StateCode nulls first)"""
_LAKE = "MonitoringLocationTypeName in ('Lake', 'Reservoir', 'Lake, Reservoir, Impoundment', 'Great Lake')"
_ROUTINE = f"""ActivityTypeCode in ({_quoted(lookups.ROUTINE_ACTIVITIES)})
 and ActivityMediaName in ('Water', 'Other', 'Habitat')"""
_WEEK = "cast(floor((dayofyear(Date) - 1) / 7) + 1 as int)"

VIEWS["lakes"] = f"select * from fx_results where {_LAKE} and wqx_id in (select wqx_id from allowed)"
VIEWS["survivors"] = f"select * exclude (rn) from (select *, {_SURVIVOR} as rn from lakes) where rn = 1"
VIEWS["routine"] = f"select * from survivors where {_ROUTINE}"
VIEWS["metres"] = """
select r.* replace (replace(r.units, ' ', '') as units), abs(r.value * u.factor) as secchi
from routine r join fx_units u on replace(r.units, ' ', '') = u.units"""
VIEWS["clean"] = f"""
select m.*, s.STATE_NAME, s.area, {_WEEK} as week
from metres m join fx_states s on m.StateCode = s.STATE where s.area is not null and secchi > 0 and secchi < 46"""
VIEWS["all_metres"] = """
select r.* replace (replace(r.units, ' ', '') as units), abs(r.value * u.factor) as secchi
from fx_results r join fx_units u on replace(r.units, ' ', '') = u.units"""

# --- the same from raw results of the Secchi names at lake sites

VIEWS["raw_pages"] = f"""
select r.* replace (replace(r.units, ' ', '') as units) from fx_results r join pages on Date between page_start and page_end
where siteType = 'Lake, Reservoir, Impoundment' and characteristicName in ({_quoted(lookups.SECCHI_NAMES)})"""
VIEWS["raw_lakes"] = f"""
select * from raw_pages where {_LAKE} and wqx_id in (select wqx_id from allowed)"""
VIEWS["raw_survivors"] = f"select * exclude (rn) from (select *, {_SURVIVOR} as rn from raw_lakes) where rn = 1"
VIEWS["raw_metres"] = f"""
select r.*, abs(r.value * u.factor) as secchi from raw_survivors r join fx_units u using (units) where {_ROUTINE}"""
VIEWS["raw_clean"] = f"""
select m.*, s.STATE_NAME, s.area, {_WEEK} as week
from raw_metres m join fx_states s on m.StateCode = s.STATE where s.area is not null and secchi > 0 and secchi < 46"""

# --- weekly series by geography

VIEWS["geo_depths"] = f"""
select s.area, {_WEEK} as week, m.secchi, m.Date
from all_metres m join (select wqx_id, min(poly_id) as poly_id from inside group by wqx_id) i on m.wqx_id = i.wqx_id
 join fx_states s on cast(s.STATE as int) = i.poly_id where s.area is not null"""
VIEWS["named_depths"] = f"""
select s.area, {_WEEK} as week, m.secchi
from (select * from all_metres where siteType = 'Lake, Reservoir, Impoundment'
 and characteristicName in ({_quoted(lookups.SECCHI_NAMES)})) m
 join (select wqx_id, min(poly_id) as poly_id from inside group by wqx_id) i on m.wqx_id = i.wqx_id
 join fx_states s on cast(s.STATE as int) = i.poly_id where s.area is not null"""
VIEWS["named_series"] = """
select area, week, med as x, row_number() over (partition by area order by week) as i, count(*) over (partition by area) as n
from (select area, week, quantile_cont(secchi, 0.5) as med from named_depths group by area, week)"""
VIEWS["daily_series"] = """
select area, Date, med as x, row_number() over (partition by area order by Date) as i, count(*) over (partition by area) as n
from (select area, Date, quantile_cont(secchi, 0.5) as med from geo_depths group by area, Date)"""
VIEWS["weekly"] = "select area, week, quantile_cont(secchi, 0.5) as med from geo_depths group by area, week"
VIEWS["series"] = """
select area, week, med as x, row_number() over (partition by area order by week) as i,
 count(*) over (partition by area) as n from weekly"""

_MED3 = "greatest(least({0}, {1}), least(greatest({0}, {1}), {2}))"


def _settle(name: str, source: str) -> str:
    """27 passes of the running median over rows; 27 is past half the weeks of a year."""
    before, after = "lag(y) over (partition by area order by i)", "lead(y) over (partition by area order by i)"
    return f"""
 {name}(pass, area, i, n, x, y) as (
  select 0, area, i, n, x, x from {source}
  union all
  select pass + 1, area, i, n, x, case when i = 1 or i = n then y else {_MED3.format(before, "y", after)} end
  from {name} where pass < 27)"""


def _end_rule(source: str) -> str:
    def reach(k, fn):
        return f"{fn}(y, {k}) over (partition by area order by i)"

    left = _MED3.format(f"3 * {reach(1, 'lead')} - 2 * {reach(2, 'lead')}", "x", reach(1, "lead"))
    right = _MED3.format(f"3 * {reach(1, 'lag')} - 2 * {reach(2, 'lag')}", "x", reach(1, "lag"))
    return f"""select area, i, n, case when i = 1 then {left} when i = n then {right} else y end as x
  from {source} where pass = 27"""


_TUKEY = f"""with recursive {{views}},
{_settle("first_pass", "series")},
 ended as ({_end_rule("first_pass")}),
 around as (select *, lag(x, 1) over w as l1, lag(x, 2) over w as l2, lag(x, 3) over w as l3, lead(x, 1) over w as r1,
  lead(x, 2) over w as r2, lead(x, 3) over w as r3 from ended window w as (partition by area order by i)),
 split as (select area, i, n, case
  when i > 2 and i < n - 2 and x = r1 and not (l1 <= x and r1 <= r2) and not (l1 >= x and r1 >= r2)
   then {_MED3.format("x", "l1", "3 * l1 - 2 * l2")}
  when i > 3 and i < n - 1 and l1 = x and not (l2 <= l1 and x <= r1) and not (l2 >= l1 and x >= r1)
   then {_MED3.format("x", "r1", "3 * r1 - 2 * r2")}
  else x end as x from around),
{_settle("second_pass", "split")},
 smoothed as ({_end_rule("second_pass")})
select s.area, s.week, round(s.x, 6) as med, round(t.x, 6) as smooth from series s join smoothed t using (area, i)"""

#: Days need more passes than weeks do: 200 are far past the last change.
_TUKEY_DAILY = (
    _TUKEY.replace("pass < 27", "pass < 200").replace("pass = 27", "pass = 200").replace("s.week", "s.Date")
    .replace("from series", "from daily_series")
)

RESULT_FIELDS = (
    "Date, value, units, wqx_id, dec_lat_va, dec_lon_va, StateCode, ActivityTypeCode, ActivityMediaName, "
    "ResultStatusIdentifier, MonitoringLocationTypeName"
)
_PAGES = "pages"
_GRID = "select characteristicType, siteType, startDate, endDate, numSites, numResults from grid"
_SHORT = "cast({} as double)"
_TRIMMED = r"regexp_replace(printf('%.2f', {}), '\.?0+$', '')"
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _pivot(measure: str) -> str:
    cells = ", ".join(
        f"""nullif({measure.format(f"case when area = '{name}' then wqx_id end")}, 0) as "{name}\"""" for name in _REGIONS
    )
    return f"select week, {cells} from clean where week > 13 and week < 47 group by week"


ORACLE: dict[str, str] = {
    "select_sites": f"""select wqx_id, dec_lon_va as lon, dec_lat_va as lat from fx_sites
        where siteType = 'Lake, Reservoir, Impoundment' and wqx_id in
        (select wqx_id from fx_results where characteristicName in ({_quoted(lookups.TEMPERATURE_NAMES)}))""",
    "target_sites": "select target, wqx_id from target_sites",
    "constituent_counts": """select constituent, r.StateCode, count(distinct r.wqx_id) as n_sites, count(*) as n_results
        from fx_results r join groups g using (characteristicName)
        where r.wqx_id in (select wqx_id from fx_sites where siteType = 'Lake, Reservoir, Impoundment')
        group by constituent, r.StateCode""",
    "page_windows": """select cast(row_number() over (order by s) as int) as page, s as start,
        coalesce(lead(s) over (order by s), hi) as "end"
        from (select hi, unnest(range(lo, hi, interval 2 year))::date as s from
         (select make_date(min(year(l_shipdate)), 1, 1) as lo, make_date(max(year(l_shipdate)) + 1, 1, 1) as hi
          from lineitem))""",
    "paged_rows": f"select r.*, page_start, page_end from fx_results r join {_PAGES} on Date between page_start and page_end",
    "paged_rows_half_open": f"""select r.*, page_start, page_end from fx_results r join {_PAGES}
        on Date >= page_start and (Date < page_end or (Date = page_end and page_end = period_end))""",
    "paged_rows_hourly": """select event_id, minute, value, s as page_start, s + interval 1 hour as page_end
        from (select event_id, date_trunc('minute', ts) as minute, value from events) join
         (select unnest(range(min(ts)::date::timestamp, max(ts)::date::timestamp + interval 1 day, interval 1 hour)) as s from events)
        on minute between s and s + interval 1 hour""",
    "csv_rejects": """select case s_suppkey % 10 when 3 then concat('n', s_suppkey, ',', s_name, ',', s_nationkey)
         when 5 then concat(s_suppkey, ',', s_name) when 7 then concat('"', s_suppkey, ',', s_name, ',', s_nationkey)
         else concat(s_suppkey, ',', s_name, ',', s_nationkey) end as line,
        case s_suppkey % 10 when 3 then 'value' when 5 then 'fields' when 7 then 'quote' end as reason from supplier""",
    "normalize_results": f"select {RESULT_FIELDS} from fx_results",
    "retrieve_secchi": f"""select r.{RESULT_FIELDS.replace("units, ", "").replace(", ", ", r.")},
        replace(r.units, ' ', '') as units, r.value * u.factor as secchi
        from fx_results r join {_PAGES} on Date between page_start and page_end
        left join (select * from fx_units where units in ('m', 'in', 'ft', 'cm')) u on replace(r.units, ' ', '') = u.units
        where siteType = 'Lake, Reservoir, Impoundment' and characteristicName in ({_quoted(lookups.SECCHI_NAMES)})""",
    "extract_by_state": """select r.*, concat('US:', s.StateCode) as state
        from fx_results r join fx_sites s using (wqx_id)""",
    "site_results": f"""select * from fx_results where characteristicName in
        ({_quoted(lookups.CONSTITUENT_GROUPS["phosphorus"])}) and wqx_id in
        (select wqx_id from fx_sites where siteType = 'Lake, Reservoir, Impoundment')""",
    "summary_counts": """select characteristicType, siteType, cast(year(Date) as int) as startYear,
        count(distinct wqx_id) as numSites, count(*) as numResults from fx_results group by all""",
    "count_grid": _GRID,
    "missing_units": """select characteristicType, siteType from units_needed except
        select characteristicType, siteType from fx_counts""",
    "incremental_counts": """select u.characteristicType, u.siteType, make_date(years.y, 1, 1) as startDate,
        make_date(years.y, 12, 31) as endDate, c.numSites, c.numResults
        from units_needed u cross join all_years as years
        left join (select characteristicType, siteType, year(Date) as y, count(distinct wqx_id) as numSites,
         count(*) as numResults from fx_results group by all) c
        on c.characteristicType = u.characteristicType and c.siteType = u.siteType and c.y = years.y""",
    "incremental_counts_extended": _GRID,
    "incremental_counts_changed": """select g.characteristicType, g.siteType, g.startDate, g.endDate, g.numSites, g.numResults,
        exists (select 1 from fx_results r where r.characteristicType = g.characteristicType and r.siteType = g.siteType
         and (r.characteristicType = 'Nutrient' and r.siteType = 'Stream'
          and year(r.Date) = (select max(year(l_shipdate)) from lineitem)
          or r.characteristicType = 'Physical' and r.siteType = 'Well'
          and year(r.Date) = (select min(year(l_shipdate)) from lineitem))) as recounted
        from grid g""",
    "merged_counts": """select characteristicType, siteType, year(Date) as startYear, count(distinct wqx_id) as numSites,
        count(*) as numResults from fx_results group by all""",
    "target_sites_config": """select distinct t.target, r.wqx_id from (values ('phosphorus_lakes', 'Phosphorus', true),
        ('phosphorus_all', 'Phosphorus', false), ('ph_lakes', 'pH', true)) as t(target, characteristicName, lakes)
        join fx_results r using (characteristicName)
        where not t.lakes or r.siteType = 'Lake, Reservoir, Impoundment'""",
    "csv_roundtrip": _GRID,
    "parquet_roundtrip": _GRID,
    "region_from_snapshot": """select Date, value, wqx_id, dec_lon_va, dec_lat_va from fx_results
        where dec_lon_va between -112 and -96 and dec_lat_va between 30 and 38""",
    "category_counts": """select display_charType, display_siteType, cast(sum(numSites) as bigint) as numSites,
        cast(sum(numResults) as bigint) as numResults from shown where numResults is not null
        group by display_charType, display_siteType""",
    "fill_counts": """select characteristicType, siteType, startDate, endDate, coalesce(numSites, 0) as numSites,
        coalesce(numResults, 0) as numResults from grid""",
    "keep_lake_sites": "select * from lakes",
    "qa_activities": f"select * from fx_results where {_ROUTINE}",
    "convert_units": "select * replace (round(secchi, 6) as secchi) from all_metres",
    "convert_units_keep_unmatched": """select r.* replace (replace(r.units, ' ', '') as units),
        round(r.value * u.factor, 6) as secchi from fx_results r
        left join (select * from fx_units where units in ('m', 'in', 'ft', 'cm')) u on replace(r.units, ' ', '') = u.units""",
    "plausible_range": "select * replace (round(secchi, 6) as secchi) from all_metres where secchi > 0 and secchi < 46",
    "region_rows": """select r.*, s.STATE_NAME, s.area from fx_results r join fx_states s on r.StateCode = s.STATE
        where s.area is not null""",
    "date_parts": f"""select Date, wqx_id, value, cast(year(Date) as int) as year, cast(month(Date) as int) as month,
        {_WEEK} as week, cast(2 * floor({_WEEK} / 2) as int) as week2 from fx_results""",
    "season": f"""select Date, wqx_id, value, cast(year(Date) as int) as year, cast(month(Date) as int) as month,
        {_WEEK} as week, cast(2 * floor({_WEEK} / 2) as int) as week2 from fx_results
        where {_WEEK} > 13 and {_WEEK} < 47""",
    "site_locations": """select wqx_id, round(avg(dec_lat_va), 6) as lat, round(avg(dec_lon_va), 6) as lon
        from fx_results group by wqx_id having avg(dec_lat_va) is not null and avg(dec_lon_va) is not null""",
    "state_layers": """select distinct concat('Nation ', c_nationkey) as state_name,
        lpad(cast(c_nationkey as varchar), 2, '0') as fip,
        concat('NHD_M_', lpad(cast(c_nationkey as varchar), 2, '0'), '_Nation_', c_nationkey, '_ST') as layer
        from customer""",
    "dedupe_first": """select day, user_id, event_type, event_id, value from (
        select cast(ts as date) as day, user_id, event_type, event_id, value, row_number() over
        (partition by cast(ts as date), user_id, event_type order by event_id) as rn from events) where rn = 1""",
    "dedupe_results": f"""select Date, dec_lat_va, dec_lon_va, value, ActivityTypeCode, ActivityMediaName, units, wqx_id,
        StateCode from (select *, {_SURVIVOR} as rn from fx_results) where rn = 1""",
    "duplicate_count": """select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct,
        cast(sum(n - 1) as bigint) as n_duplicates
        from (select count(*) as n from lakes group by Date, dec_lat_va, dec_lon_va, value)""",
    "qa_funnel": f"""with stages as (
        select 1 as step, 'all' as stage, (select count(*) from fx_results) as n_rows
        union all select 2, 'lake_type', (select count(*) from fx_results where {_LAKE})
        union all select 3, 'in_waterbody', (select count(*) from lakes)
        union all select 4, 'first_of_duplicates', (select count(*) from survivors)
        union all select 5, 'routine_activity', (select count(*) from routine)
        union all select 6, 'known_unit', (select count(*) from metres)
        union all select 7, 'plausible_in_region', (select count(*) from clean))
        select cast(step as int) as step, stage, n_rows,
         cast(coalesce(lag(n_rows) over (order by step) - n_rows, 0) as bigint) as dropped from stages""",
    "region_summary": f"""select area, nSites, nRecords, round(med, 6) as med, round(q25, 6) as q25, round(q75, 6) as q75,
        concat('[', {_TRIMMED.format("q25")}, ', ', {_TRIMMED.format("q75")}, ']') as IQR from (
        select area, count(distinct wqx_id) as nSites, count(*) as nRecords, quantile_cont(secchi, 0.5) as med,
         quantile_cont(secchi, 0.25) as q25, quantile_cont(secchi, 0.75) as q75
        from clean group by grouping sets ((area), ()))""",
    "state_counts": """select StateCode as STATE, count(*) as Freq, any_value(STATE_NAME) as STATE_NAME
        from clean group by StateCode""",
    "weekly_record_counts": _pivot("count({})"),
    "weekly_site_counts": _pivot("count(distinct {})"),
    "weekly_quantiles": """select week, area, round(quantile_cont(secchi, 0.5), 6) as med,
        round(quantile_cont(secchi, 0.25), 6) as q25, round(quantile_cont(secchi, 0.75), 6) as q75
        from clean where week > 13 and week < 47 group by week, area""",
    "records_share": """select display_charType, display_siteType, numResults_siteType, totalnumResults,
        round(case when totalnumResults = 0 then null else numResults_siteType / totalnumResults end * 100, 6)
         as percentResults,
        concat(display_charType, chr(10), ' (n=', format('{:,}', totalnumResults), ')') as charTypeLabels from share""",
    "records_share_with_unassigned": """with long as (
         select display_charType, display_siteType, n_results from shown where characteristicType <> 'Not Assigned'
         union all select 'Total', display_siteType, n_results from shown),
        s as (select display_charType, display_siteType, cast(sum(n_results) as bigint) as numResults_siteType,
          cast(sum(sum(n_results)) over (partition by display_charType) as bigint) as totalnumResults
         from long where display_siteType <> 'NA' group by display_charType, display_siteType)
        select display_charType, display_siteType, numResults_siteType, totalnumResults,
         round(case when totalnumResults = 0 then null else numResults_siteType / totalnumResults end * 100, 6)
          as percentResults,
         concat(display_charType, chr(10), ' (', totalnumResults, ')') as charTypeLabels from s""",
    "yearly_trend": "select display_charType, year, numSites, numResults from trend",
    "display_order": """select display_charType, display_siteType, cast(bar_rank as int) as bar_rank,
        cast(panel_rank as int) as panel_rank, cast(list_position(['Facility', 'Groundwater', 'Lake', 'Marine', 'Stream',
        'Other'], display_siteType) as int) as site_rank from share join ranks using (display_charType)""",
    "trend_panels": """select display_charType, year, numSites, numResults, cast(panel_rank as int) as panel_rank
        from trend join ranks using (display_charType)""",
    "project_sites": """select s.wqx_id, dec_lon_va as lon, dec_lat_va as lat, round(px, 3) as x, round(py, 3) as y
        from fx_sites s join projected_points p using (wqx_id)""",
    "point_in_polygon": """select i.wqx_id, px as lon, py as lat, poly_id, ftype from inside i join points using (wqx_id)""",
    "assign_polygon": """select wqx_id, px as lon, py as lat, min(poly_id) as poly_id
        from points left join inside using (wqx_id) group by all""",
    "sites_in_waterbodies": "select wqx_id from allowed",
    "lake_membership": "select wqx_id from allowed where wqx_id in (select wqx_id from fx_results)",
    "coverage_by_state": """select p.state, count(i.wqx_id) as n_sites,
        (select count(distinct j.wqx_id) from inside j join fx_states t on cast(t.STATE as int) = j.poly_id
         where j.ftype in (390, 436, 361) and t.STATE_NAME <= p.state) as n_sites_so_far
        from (select poly_id, ftype, STATE_NAME as state from polys join fx_states on cast(STATE as int) = poly_id) p
        left join inside i using (poly_id) where p.ftype in (390, 436, 361) group by p.state""",
    "huc_counts": "select poly_id, n_sites from huc",
    "huc_bins": _binned("huc", "bin_edges", "poly_id"),
    "huc_bins_auto": _binned("huc", "auto_edges", "poly_id"),
    "site_density_panel": f"""with counts as (
         select t.target, p.poly_id, count(i.wqx_id) as n_sites
         from (select unnest([{_quoted(lookups.PANEL_TARGETS)}]) as target) t cross join polys p
         left join (target_sites s join projected_inside i using (wqx_id)) on s.target = t.target and i.poly_id = p.poly_id
         group by t.target, p.poly_id)
        {_binned("counts", "bin_edges", "target, poly_id")}""",
    "region_polygons": """select v.*, lower(s.STATE_NAME) as region, s.area
        from fx_vertices v join fx_states s on cast(s.STATE as int) = v.poly_id""",
    "weekly_median_geo": """select area, week, round(quantile_cont(secchi, 0.5), 6) as med
        from geo_depths group by grouping sets ((area, week), (area))""",
    "smooth3": f"""select area, week, round(x, 6) as med, round(case when i = 1 or i = n then x else
        {_MED3.format("lag(x) over (partition by area order by i)", "x", "lead(x) over (partition by area order by i)")}
        end, 6) as smooth from series""",
    "tukey_smooth": _TUKEY,
    "tukey_smooth_daily": _TUKEY_DAILY,
    "secchi_pipeline": """select week, area, round(quantile_cont(secchi, 0.5), 6) as med,
        round(quantile_cont(secchi, 0.25), 6) as q25, round(quantile_cont(secchi, 0.75), 6) as q75
        from raw_clean where week > 13 and week < 47 group by week, area""",
    "secchi_pipeline_funnel": f"""with stages as (
        select 1 as step, 'all' as stage, (select count(*) from raw_pages) as n_rows
        union all select 2, 'lake_type', (select count(*) from raw_pages where {_LAKE})
        union all select 3, 'in_waterbody', (select count(*) from raw_lakes)
        union all select 4, 'first_of_duplicates', (select count(*) from raw_survivors)
        union all select 5, 'routine_activity', (select count(*) from raw_survivors where {_ROUTINE})
        union all select 6, 'known_unit', (select count(*) from raw_metres)
        union all select 7, 'plausible_in_region', (select count(*) from raw_clean))
        select cast(step as int) as step, stage, n_rows,
         cast(coalesce(lag(n_rows) over (order by step) - n_rows, 0) as bigint) as dropped from stages""",
    "geo_pipeline": _TUKEY.replace('"series"', '"named_series"').replace("series", "named_series") + """
        union all select area, cast(null as int), round(quantile_cont(secchi, 0.5), 6), null from named_depths group by area""",
}


def _used(sql: str, chosen: set[str]) -> set[str]:
    for name in VIEWS:
        if name not in chosen and re.search(rf"\b{name}\b", sql):
            chosen.add(name)
            _used(VIEWS[name], chosen)
    return chosen


def oracle_sql() -> dict[str, str]:
    """Every statement with the views it needs in front."""
    full = {}
    for name, sql in ORACLE.items():
        chosen = _used(sql, set())
        views = ",\n".join(f"{view} as ({VIEWS[view]})" for view in VIEWS if view in chosen)
        if sql.startswith("with recursive {views}"):
            full[name] = sql.replace("{views}", views)
        elif sql.lstrip().startswith("with "):
            full[name] = f"with {views},\n" + sql.lstrip()[len("with "):]
        else:
            full[name] = f"with {views}\n{sql}" if views else sql
    return full
