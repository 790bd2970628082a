"""Views that give the star-schema test tables the shape of water-quality data (see FIXTURES.md section 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lookups import SITE_TYPES, unit_factors

# How codes of the star schema stand for codes of the observation data.
LOCATION_OF_SEGMENT = {
    "BUILDING": "Lake",
    "AUTOMOBILE": "Reservoir",
    "MACHINERY": "Lake, Reservoir, Impoundment",
    "FURNITURE": "Great Lake",
}
UNIT_OF_DIGIT = {0: "m", 1: "m", 2: "m", 3: "ft", 4: "ft", 5: "f t", 6: "in", 7: "cm", 8: "mi"}
ACTIVITY_OF_PRIORITY = {
    "1-URGENT": "Field Msr/Obs",
    "2-HIGH": "Sample-Routine",
    "3-MEDIUM": "Sample-Other",
    "4-NOT SPECIFIED": "Sample-Field Split",
}
NAME_OF_BRAND = {
    "Brand#1": "Phosphorus",
    "Brand#2": "Nitrogen",
    "Brand#3": "Arsenic",
    "Brand#4": "Secchi depth",
    "Brand#5": "Depth, Secchi disk depth",
    "Brand#6": "Temperature",
    "Brand#7": "Temperature, water",
    "Brand#8": "Organic carbon",
    "Brand#9": "Chlorophyll a",
    "Brand#10": "pH",
    "Brand#11": "Dissolved oxygen (DO)",
    "Brand#12": "Inorganic carbon",
    "Brand#13": "Glyphosate",
}
TYPE_OF_PART = {
    "MEDIUM": "Nutrient",
    "STANDARD": "Physical",
    "LARGE": "Inorganics, Major, Metals",
    "PROMO": "Inorganics, Minor, Non-metals",
    "SMALL": "Not Assigned",
}
# (ring, position, dx, dy): the outline and, for odd polygons, the hole.
POLYGON_CORNERS = (
    (0, 0, 0.3, 0.2), (0, 1, 10.7, 0.5), (0, 2, 11.3, 4.5), (0, 3, 0.9, 4.3), (0, 4, 0.3, 0.2),
    (1, 0, -2.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 2.0, 0.0), (1, 3, 0.0, -1.0), (1, 4, -2.0, 0.0),
)
PAGE_LENGTH = "2 years"


def _recode(code: str, table: dict, otherwise: str) -> Column:
    """CASE over a fixed code table; ``code`` and ``otherwise`` are SQL expressions."""

    def literal(value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    cases = " ".join(f"WHEN {literal(key)} THEN {literal(value)}" for key, value in table.items())
    return F.expr(f"CASE {code} {cases} ELSE {otherwise} END")


def _padded(key: Column) -> Column:
    return F.lpad(key.cast("string"), 2, "0")


class Star:
    """The views over one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._tables[name]

    def sites(self) -> DataFrame:
        key = F.col("c_custkey")
        unlocated = key % 50 == 0
        return self.table("customer").select(
            F.concat(F.lit("SITE-"), key.cast("string")).alias("wqx_id"),
            key,
            F.when(~unlocated, 25 + ((key * 7919) % 2400) / 100.0).alias("dec_lat_va"),
            F.when(~unlocated, -124 + ((key * 104729) % 5700) / 100.0).alias("dec_lon_va"),
            _padded(F.col("c_nationkey")).alias("StateCode"),
            _recode("c_mktsegment", LOCATION_OF_SEGMENT, "'River/Stream'").alias("MonitoringLocationTypeName"),
            _recode("c_custkey % 15", dict(enumerate(SITE_TYPES[:-1])), f"'{SITE_TYPES[-1]}'").alias("siteType"),
        )

    def results(self) -> DataFrame:
        quantity = F.col("l_quantity")
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.sites(), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("l_shipdate").cast("date").alias("Date"),
                F.when(F.col("l_linenumber") == 7, -quantity).otherwise(quantity).alias("value"),
                _recode("l_partkey % 10", UNIT_OF_DIGIT, "if(l_suppkey % 2 = 0, NULL, 'NTU')").alias("units"),
                "wqx_id",
                "dec_lat_va",
                "dec_lon_va",
                "StateCode",
                _recode("o_orderpriority", ACTIVITY_OF_PRIORITY, "'Quality Control Sample-Field Replicate'").alias(
                    "ActivityTypeCode"
                ),
                _recode("l_returnflag", {"R": "Water", "A": "Habitat"}, "'Sediment'").alias("ActivityMediaName"),
                _recode("l_linestatus", {"F": "Final"}, "'Preliminary'").alias("ResultStatusIdentifier"),
                "MonitoringLocationTypeName",
                "siteType",
                _recode("p_brand", NAME_OF_BRAND, "concat('Other ', p_brand)").alias("characteristicName"),
                _recode("p_type", TYPE_OF_PART, "'Organics, Pesticide'").alias("characteristicType"),
            )
        )

    def raw_results(self) -> DataFrame:
        """Results under the names the remote service uses, with values as text and no site columns."""
        return self.results().select(
            F.col("Date").alias("ActivityStartDate"),
            F.col("value").cast("string").alias("ResultMeasureValue"),
            F.col("units").alias("ResultMeasure.MeasureUnitCode"),
            F.col("wqx_id").alias("MonitoringLocationIdentifier"),
            "ActivityTypeCode",
            "ActivityMediaName",
            "ResultStatusIdentifier",
            "characteristicName",
        )

    def years(self) -> tuple[int, int]:
        """The first and the last calendar year with a result; one row reaches the driver."""
        row = self.table("lineitem").agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
        return (row[0], row[1]) if row[0] is not None else (1970, 1970)

    def period(self) -> tuple[str, str, str]:
        """Those years as first day, day after the last one, and length of a page."""
        first, last = self.years()
        return f"{first}-01-01", f"{last + 1}-01-01", PAGE_LENGTH

    def region_names(self) -> list[str]:
        """Regions that states are in; one row a region reaches the driver."""
        return sorted(row.area for row in self.states().select("area").where("area is not null").distinct().collect())

    def states(self) -> DataFrame:
        area = F.when(F.col("n_nationkey") != 24, F.col("r_name"))
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(_padded(F.col("n_nationkey")).alias("STATE"), F.col("n_name").alias("STATE_NAME"), area.alias("area"))
        )

    def state_names(self) -> DataFrame:
        return self.states().select("STATE", "STATE_NAME")

    def state_regions(self) -> DataFrame:
        return self.states().select("STATE_NAME", "area", F.lower("STATE_NAME").alias("region"))

    def units(self) -> DataFrame:
        return unit_factors(self.spark)

    def vertices(self) -> DataFrame:
        key = F.col("n_nationkey")
        # Every polygon has the same ten corners, so they unfold from a constant array.
        corners = F.array(*[F.struct(*map(F.lit, corner)) for corner in POLYGON_CORNERS])
        hole = F.col("ring") == 1
        west, south = -124 + 11.4 * (key % 5), 25 + 4.8 * F.floor(key / 5)
        return (
            self.table("nation")
            .select(key, F.inline(corners).alias("ring", "k", "dx", "dy"))
            .where(~hole | (key % 2 == 1))
            .select(
                key.alias("poly_id"),
                _recode("n_nationkey % 4", {0: 390, 1: 436, 2: 361}, "460").alias("ftype"),
                "ring",
                "k",
                F.when(hole, west + 5.5 + F.col("dx")).otherwise(west + F.col("dx")).alias("x"),
                F.when(hole, south + 2.4 + F.col("dy")).otherwise(south + F.col("dy")).alias("y"),
            )
        )

    def counts(self) -> DataFrame:
        year = F.year("Date").alias("startYear")
        return (
            self.results()
            .groupBy("characteristicType", "siteType", year)
            .agg(F.countDistinct("wqx_id").alias("numSites"), F.count(F.lit(1)).alias("numResults"))
        )
