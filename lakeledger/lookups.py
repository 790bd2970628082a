"""Small fixed tables and the helper that turns them into DataFrames.

Every table here is a constant of this module, so its size is known and the planner may broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def listed(names: str | Iterable[str] | None) -> tuple[str, ...]:
    """Names given as one text, as a list, or as a mapping whose values are names (as a configuration file has them)."""
    if names is None:
        return ()
    if isinstance(names, str):
        return (names,)
    if isinstance(names, Mapping):
        return tuple(name for value in names.values() for name in listed(value))
    return tuple(names)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def literal_frame(spark: SparkSession, rows: Iterable[Sequence], **columns: str) -> DataFrame:
    """A DataFrame over constants; ``columns`` maps name to SQL type.

    Inline VALUES become a local relation: no Python worker, and the optimizer knows the exact size.
    """
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns.items())
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(columns)})")


# --- fixed values: names the data and its consumers use -------------------------------------------------------

CHARACTERISTIC_TYPES = (
    "Physical",
    "Inorganics, Major, Metals",
    "Inorganics, Major, Non-metals",
    "Inorganics, Minor, Metals",
    "Inorganics, Minor, Non-metals",
    "Not Assigned",
    "Nutrient",
    "Organics, Other",
    "Organics, PCBs",
    "Organics, Pesticide",
    "Microbiological",
    "Biological",
    "Information",
    "Sediment",
    "Radiochemical",
    "Stable Isotopes",
    "Population/Community",
    "Toxicity",
)

SITE_TYPES = (
    "Aggregate groundwater use",
    "Aggregate surface-water-use",
    "Atmosphere",
    "Estuary",
    "Facility",
    "Glacier",
    "Lake, Reservoir, Impoundment",
    "Land",
    "Not Assigned",
    "Ocean",
    "Spring",
    "Stream",
    "Subsurface",
    "Well",
    "Wetland",
)

# Display name of a characteristic type where it differs from the type itself.
MERGED_CHARACTERISTICS = {
    "Inorganics": (
        "Inorganics, Major, Metals",
        "Inorganics, Major, Non-metals",
        "Inorganics, Minor, Metals",
        "Inorganics, Minor, Non-metals",
    ),
    "Organics": ("Organics, Other", "Organics, PCBs", "Organics, Pesticide"),
    "NA": ("Not Assigned",),
}

DISPLAY_SITES = {
    "Facility": ("Facility",),
    "Groundwater": ("Aggregate groundwater use", "Spring", "Subsurface", "Well"),
    "Lake": ("Lake, Reservoir, Impoundment",),
    "Marine": ("Estuary", "Ocean"),
    "Stream": ("Stream",),
    "Other": ("Aggregate surface-water-use", "Atmosphere", "Glacier", "Land", "Wetland"),
    "NA": ("Not Assigned",),
}

DISPLAY_SITE_ORDER = ("Facility", "Groundwater", "Lake", "Marine", "Stream", "Other")

LAKE_SITE_TYPE = "Lake, Reservoir, Impoundment"
LAKE_LOCATION_TYPES = ("Lake", "Reservoir", "Lake, Reservoir, Impoundment", "Great Lake")
WATERBODY_FTYPES = (390, 436, 361)

ROUTINE_ACTIVITIES = (
    "Field Msr/Obs",
    "Sample-Routine",
    "Field Msr/Obs-Portable Data Logger",
    "Sample-Composite Without Parents",
    "Sample-Field Split",
    "Sample-Other",
)
ROUTINE_MEDIA = ("Water", "Other", "Habitat")

METRES_PER_UNIT = {"m": 1.0, "in": 0.0254, "ft": 0.3048, "cm": 0.01, "mm": 0.001, "mi": 1609.34}
RETRIEVAL_UNITS = ("m", "in", "ft", "cm")

SECCHI_NAMES = (
    "Depth, Secchi disk depth",
    "Depth, Secchi disk depth (choice list)",
    "Secchi Reading Condition (choice list)",
    "Secchi depth",
    "Water transparency, Secchi disc",
)
TEMPERATURE_NAMES = ("Temperature", "Temperature, sample", "Temperature, water")
CHLOROPHYLL_NAMES = (
    "Chlorophyll",
    "Chlorophyll A",
    "Chlorophyll a",
    "Chlorophyll a (probe relative fluorescence)",
    "Chlorophyll a (probe)",
    "Chlorophyll a - Periphyton (attached)",
    "Chlorophyll a - Phytoplankton (suspended)",
    "Chlorophyll a, corrected for pheophytin",
    "Chlorophyll a, free of pheophytin",
    "Chlorophyll a, uncorrected for pheophytin",
    "Chlorophyll b",
    "Chlorophyll c",
    "Chlorophyll/Pheophytin ratio",
)

# Characteristic names behind a site-map target.
MAP_CONSTITUENTS = {
    "phosphorus": ("Phosphorus",),
    "nitrogen": ("Nitrogen",),
    "temperature": TEMPERATURE_NAMES,
    "arsenic": ("Arsenic",),
    "chlorophyll": CHLOROPHYLL_NAMES,
    "doc": ("Organic carbon", "Total Particulate Organic Carbon"),
    "secchi": SECCHI_NAMES,
    "glyphosate": ("Glyphosate", "AMPA (glyphosate metabolite)"),
}
MAP_SCOPES = {"lakes": LAKE_SITE_TYPE, "all": None}
MAP_TARGETS = (
    "phosphorus_lakes",
    "phosphorus_all",
    "nitrogen_lakes",
    "nitrogen_all",
    "arsenic_lakes",
    "arsenic_all",
    "chlorophyll_lakes",
    "chlorophyll_all",
    "temperature_lakes",
    "temperature_all",
    "doc_lakes",
    "doc_all",
    "secchi_all",
    "secchi_lakes",
    "glyphosate_all",
)
PANEL_TARGETS = (
    "arsenic_lakes",
    "arsenic_all",
    "nitrogen_lakes",
    "nitrogen_all",
    "phosphorus_lakes",
    "phosphorus_all",
    "secchi_lakes",
    "secchi_all",
    "temperature_lakes",
    "temperature_all",
)
COUNT_BINS = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)

# Characteristic names behind a named constituent group of the carbon extraction.
CONSTITUENT_GROUPS = {
    "DOC": (
        "Hydrophilic fraction of organic carbon",
        "Hydrophobic fraction of organic carbon",
        "Organic carbon",
        "Total Particulate Organic Carbon",
        "Transphilic fraction of organic carbon",
    ),
    "temperature": TEMPERATURE_NAMES,
    "phosphorus": (
        "Exchangeable phosphorus",
        "Inorganic phosphorus",
        "Non-apatite inorganic phosphorus",
        "Organic phosphorus",
        "Ortho-Phosphate-Phosphorus",
        "Phosphate-phosphorus",
        "Phosphate-phosphorus as P",
        "Phosphate-phosphorus as PO4",
        "Phosphorus",
        "Phosphorus as P",
        "Phosphorus, Particulate Organic",
        "Phosphorus, hydrolyzable",
        "Phosphorus, hydrolyzable plus orthophosphate",
        "Phosphorus, phosphate (PO4) as orthophosphate",
        "Soluble Reactive Phosphorus (SRP)",
        "Total Particulate Phosphorus",
    ),
    "chlorophyll": CHLOROPHYLL_NAMES,
    "DO": (
        "Dissolved oxygen",
        "Dissolved oxygen (DO)",
        "Dissolved oxygen saturation",
        "Dissolved oxygen uptake",
    ),
    "DIC": ("Inorganic carbon", "Particulate Inorganic Carbon"),
    "pH": ("pH",),
}

REGION_STATES = {
    "West": (
        "Montana", "Wyoming", "Idaho", "Washington", "Oregon", "California", "Nevada", "Arizona",
        "New Mexico", "Colorado", "Utah",
    ),
    "Midwest": (
        "Ohio", "Indiana", "Illinois", "Wisconsin", "Missouri", "Iowa", "Minnesota", "Kansas",
        "Nebraska", "South Dakota", "North Dakota", "Michigan",
    ),
    "Northeast": (
        "Maine", "New Hampshire", "Vermont", "Massachusetts", "Rhode Island", "Connecticut",
        "New Jersey", "Pennsylvania", "New York",
    ),
    "South": (
        "Florida", "Georgia", "Louisiana", "Arkansas", "Oklahoma", "Texas", "South Carolina",
        "North Carolina", "Virginia", "Kentucky", "Tennessee", "West Virginia", "Maryland",
        "Delaware", "Alabama", "Mississippi",
    ),
}

# FIPS 5-2 numeric codes of the states and the District of Columbia.
STATE_FIPS = (
    ("01", "Alabama"), ("02", "Alaska"), ("04", "Arizona"), ("05", "Arkansas"), ("06", "California"),
    ("08", "Colorado"), ("09", "Connecticut"), ("10", "Delaware"), ("11", "District of Columbia"),
    ("12", "Florida"), ("13", "Georgia"), ("15", "Hawaii"), ("16", "Idaho"), ("17", "Illinois"),
    ("18", "Indiana"), ("19", "Iowa"), ("20", "Kansas"), ("21", "Kentucky"), ("22", "Louisiana"),
    ("23", "Maine"), ("24", "Maryland"), ("25", "Massachusetts"), ("26", "Michigan"), ("27", "Minnesota"),
    ("28", "Mississippi"), ("29", "Missouri"), ("30", "Montana"), ("31", "Nebraska"), ("32", "Nevada"),
    ("33", "New Hampshire"), ("34", "New Jersey"), ("35", "New Mexico"), ("36", "New York"),
    ("37", "North Carolina"), ("38", "North Dakota"), ("39", "Ohio"), ("40", "Oklahoma"), ("41", "Oregon"),
    ("42", "Pennsylvania"), ("44", "Rhode Island"), ("45", "South Carolina"), ("46", "South Dakota"),
    ("47", "Tennessee"), ("48", "Texas"), ("49", "Utah"), ("50", "Vermont"), ("51", "Virginia"),
    ("53", "Washington"), ("54", "West Virginia"), ("55", "Wisconsin"), ("56", "Wyoming"),
)


# --- the same tables as DataFrames ----------------------------------------------------------------------------


def unit_factors(spark: SparkSession, units: Iterable[str] = tuple(METRES_PER_UNIT)) -> DataFrame:
    rows = [(unit, METRES_PER_UNIT[unit]) for unit in units]
    return literal_frame(spark, rows, units="string", factor="double")


def display_characteristics(spark: SparkSession) -> DataFrame:
    shown = {kind: name for name, kinds in MERGED_CHARACTERISTICS.items() for kind in kinds}
    rows = [(kind, shown.get(kind, kind)) for kind in (*CHARACTERISTIC_TYPES, "Total")]
    return literal_frame(spark, rows, characteristicType="string", display_charType="string")


def display_sites(spark: SparkSession) -> DataFrame:
    rows = [(kind, name) for name, kinds in DISPLAY_SITES.items() for kind in kinds]
    return literal_frame(spark, rows, siteType="string", display_siteType="string")


def constituent_names(spark: SparkSession, groups=None) -> DataFrame:
    rows = [(group, name) for group, names in (groups or CONSTITUENT_GROUPS).items() for name in listed(names)]
    return literal_frame(spark, rows, constituent="string", characteristicName="string")


def map_targets(
    spark: SparkSession, targets: Iterable[str] = MAP_TARGETS, constituents=None, scopes=None
) -> DataFrame:
    """``<constituent>_<scope>`` names resolved to (target, constituent, required site type or null).

    The scope follows the last underscore. A scope is a site type, several, none (null), or a mapping to them.
    """
    constituents, scopes = constituents or MAP_CONSTITUENTS, scopes or MAP_SCOPES
    rows = []
    for target in listed(targets):
        constituent, _, scope = target.rpartition("_")
        if constituent not in constituents:
            raise KeyError(f"unknown constituent in target {target!r}")
        if scope not in scopes:
            raise KeyError(f"unknown scope in target {target!r}")
        rows += [(target, constituent, kind) for kind in listed(scopes[scope]) or (None,)]
    return literal_frame(spark, rows, target="string", constituent="string", neededType="string")


def state_names(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, STATE_FIPS, STATE="string", STATE_NAME="string")


def state_regions(spark: SparkSession) -> DataFrame:
    rows = [(state, area, state.lower()) for area, states in REGION_STATES.items() for state in states]
    return literal_frame(spark, rows, STATE_NAME="string", area="string", region="string")


def required_units(spark: SparkSession, char_types=CHARACTERISTIC_TYPES, site_types=SITE_TYPES) -> DataFrame:
    """Every (characteristic type, site type) unit of the inventory."""
    rows = [(char, site) for char in listed(char_types) for site in listed(site_types)]
    return literal_frame(spark, rows, characteristicType="string", siteType="string")
