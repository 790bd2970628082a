"""CSV and Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from math import isfinite
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import sorted_position
from ..schema import COUNT_SCHEMA


def read_csv(spark: SparkSession, path: str, schema: T.StructType = COUNT_SCHEMA) -> DataFrame:
    """CSV with a header line and ``NA`` for missing values, read with a declared schema."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA")


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType = COUNT_SCHEMA, *, header: bool = True, max_rejects: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV table that fit its schema, and the lines that do not: (file, line, reason).

    reason: ``quote`` for a line whose quotes do not pair, ``fields`` for one with too few or too many fields, ``value`` for one
    with a field that is not of its column's type. A field that is missing by rule (``NA``) is no fault. Every line but
    empty ones and, with ``header``, those that are the names of the schema, is in one of the two. More than ``max_rejects`` of them are an error.
    """
    names = [field.name for field in schema.fields]
    raw = "_rejected_line"
    while raw in names:
        raw = "_" + raw
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    if header:
        lines = lines.where(F.replace("line", F.lit('"'), F.lit("")) != ",".join(names))
    # each line is parsed whole, whatever columns are asked for later: a reader would test only those
    declared = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in [*schema.fields, T.StructField(raw, T.StringType())])
    parsed = lines.withColumn("row", F.from_csv("line", declared, {"nullValue": "NA", "columnNameOfCorruptRecord": raw}))
    rejected = F.col("row").isNull() | F.col(f"row.{raw}").isNotNull()
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    fields = F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), ","))
    reason = F.when(quotes % 2 == 1, "quote").when(fields != len(names), "fields").otherwise("value")
    rejects = parsed.where(rejected).select("file", "line", reason.alias("reason"))
    if max_rejects is not None:
        found = rejects.limit(max_rejects + 1).count()
        if found > max_rejects:
            raise ValueError(f"more than {max_rejects} lines of {path} do not fit the schema")
    return parsed.where(~rejected).select(*[F.col(f"row.`{name}`") for name in names]), rejects


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header line and ``NA`` for nulls; a field is quoted only where it holds a separator.

    The text ``NA`` would come back as null, so it is refused.
    """
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            text = F.col(f"`{field.name}`")
            refused = F.raise_error(F.lit(f"column {field.name} holds the text NA, which CSV keeps for nulls"))
            df = df.withColumn(field.name, F.when(text == "NA", refused).otherwise(text))
    df.write.csv(path, header=True, nullValue="NA", mode=mode)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_snapshot(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    df.write.parquet(path, mode=mode, partitionBy=list(partition_by) or None)


def _place(df: DataFrame, name: str) -> str:
    """SQL for a column as a double that keeps its order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return f"cast(unix_date(`{name}`) AS double)"
    if isinstance(kind, T.TimestampType):
        return f"cast(unix_micros(`{name}`) AS double)"
    if isinstance(kind, T.NumericType):
        return f"cast(`{name}` AS double)"
    raise TypeError(f"{name}: a number, a date or a timestamp is wanted")


def write_clustered(df: DataFrame, path: str, by: Sequence[str], files: int, mode: str = "error", bits: int = 8) -> None:
    """A snapshot of about ``files`` files in which rows that are near each other in all of ``by`` share a file.

    Each column of ``by`` is cut into 2^bits slices of about equal numbers of rows (approximate percentiles in one aggregate; a
    row of bounds reaches the driver), so crowded places get as many slices as they have rows. The bits of the slice
    numbers take turns in one key, the place on a Z curve, by which rows are ranged and sorted; Parquet's minima and maxima then
    let a filter on any of the columns skip files. Rows of one place are spread by a hash of the row, so only copies of one row
    must share a task. Nulls lie in the first slice, NaN in the last. The columns are those of ``df``.
    """
    cuts = ", ".join(f"{i / (1 << bits)}D" for i in range(1, 1 << bits))
    found = df.selectExpr(*[f"percentile_approx({_place(df, name)}, array({cuts}), 10000) AS c{j}" for j, name in enumerate(by)]).first()
    ranks = []
    for name, bounds in zip(by, found):
        bounds = sorted({bound for bound in bounds or [] if isfinite(bound)})
        literal = f"array({', '.join(f'{bound!r}D' for bound in bounds)})" if bounds else "cast(array() AS array<double>)"
        ranks.append(sorted_position(literal, _place(df, name), len(bounds) + 1))
    terms = [f"shiftleft(cast((shiftright(_rank{j}, {b}) & 1) AS bigint), {b * len(by) + j})" for b in range(bits) for j in range(len(by))]
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
    keyed = df.selectExpr("*", *[f"{rank} AS _rank{j}" for j, rank in enumerate(ranks)]).selectExpr("*", f"{' + '.join(terms)} AS _curve")
    ranged = keyed.withColumn("_spread", spread).repartitionByRange(files, "_curve", "_spread").sortWithinPartitions("_curve")
    ranged.select(*[F.col(f"`{name}`") for name in df.columns]).write.parquet(path, mode=mode)


def read_region(spark: SparkSession, path: str, bounds: dict[str, tuple], schema: T.StructType | None = None) -> DataFrame:
    """Rows of a snapshot whose columns lie within ``bounds`` (column: lowest, highest), both included."""
    inside = [F.col(f"`{name}`").between(low, high) for name, (low, high) in bounds.items()]
    return read_snapshot(spark, path, schema).where(reduce(and_, inside, F.lit(True)))


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written yet."""
    try:
        return read_snapshot(spark, path, schema)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_csv_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The CSV table at ``path``, or None where nothing has been written yet."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    write_snapshot(df, path)
    return read_snapshot(df.sparkSession, path, df.schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share: ``spark.checkpoint.dir``, else the warehouse.

    A cluster that names neither has no such folder, as the warehouse is then on the driver's machine: an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
