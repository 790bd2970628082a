"""Counts that can be merged: a new batch of facts is counted alone, and distinct sites stay exact.

The state is a folder of two tables. ``sites`` numbers every site seen, from 1 without gaps. ``parts`` has for each batch,
unit, year and block of 32,768 site numbers a bitmap of the sites and the number of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import kept, read_if_exists, read_snapshot, write_snapshot
from .inventory import UNIT
from .ordered import running_total

KEY = [*UNIT, "startYear"]


def number_sites(sites: DataFrame, path: str, site: str = "wqx_id") -> DataFrame:
    """(site, number) of every site ever passed; sites new to the table at ``path`` get the numbers after its last."""
    spark = sites.sparkSession
    schema = T.StructType([sites.schema[site], T.StructField("number", T.LongType())])
    known = read_if_exists(spark, path, schema)
    last = 0 if known is None else known.agg(F.max("number")).first()[0] or 0
    new = sites.select(site).where(F.col(site).isNotNull()).distinct()
    if known is not None:
        new = new.join(known, site, "left_anti")
    numbered = running_total(new.withColumn("one", F.lit(1)), [site], "one", "number")
    write_snapshot(numbered.select(site, (F.col("number") + last).alias("number")), path, mode="append")
    return read_snapshot(spark, path, schema)


def append_counts(facts: DataFrame, state_path: str, batch: str, date: str = "Date", site: str = "wqx_id") -> None:
    """Count ``facts``, which no other batch has, into the state; older facts are not read.

    A batch that is counted again replaces what it left before, so a run that was cut off is simply repeated; sites keep
    their numbers. One batch at a time. Results without a site or a date count as results, in the null year without one.
    """
    pairs = kept(facts.groupBy(*UNIT, F.year(date).alias("startYear"), site).agg(F.count(F.lit(1)).alias("n")), "count-batch")
    numbers = number_sites(pairs, f"{state_path}/sites", site)
    block = F.bitmap_bucket_number("number").alias("block")
    parts = pairs.join(numbers, site, "left").groupBy(*KEY, block).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("sites"), F.sum("n").alias("numResults")
    )
    write = parts.withColumn("batch", F.lit(batch)).write.option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    write.parquet(f"{state_path}/parts", mode="overwrite")


def merged_counts(spark: SparkSession, state_path: str) -> DataFrame:
    """What ``summary_counts`` says of all facts appended so far, from the state alone."""
    parts = read_snapshot(spark, f"{state_path}/parts")
    blocks = parts.groupBy(*KEY, "block").agg(F.bitmap_or_agg("sites").alias("sites"), F.sum("numResults").alias("numResults"))
    return blocks.groupBy(*KEY).agg(
        F.sum(F.bitmap_count("sites")).alias("numSites"), F.sum("numResults").alias("numResults")
    )
