"""Sums along an order over tables of any size: ranges first, then rows within a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Ranges at most, which bounds the table of their sums.
MOST_RANGES = 1024


def running_total(df: DataFrame, order: Sequence[str], amount: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` (whole numbers, null counts 0) over all rows up to each in ascending ``order``.

    Rows that tie in ``order`` all get the sum up to the last of them; nulls come first. Rows are put into ranges of the
    order and written with the number of their range, so a repeated task cannot draw other borders. Each range is summed;
    these sums, at most MOST_RANGES, become the start of each range. No window runs over the whole table.
    """
    spark = df.sparkSession
    ranges = min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    number, start = "_range", "_range_start"
    placed = kept(df.repartitionByRange(ranges, *order).withColumn(number, F.spark_partition_id()), "ranges")
    value = F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long"))
    sums = placed.groupBy(number).agg(F.sum(value).alias("n")).agg(F.sort_array(F.collect_list(F.struct(number, "n"))).alias("all"))
    starts = sums.selectExpr(
        f"inline(transform(all, (r, i) -> struct(r.{number}, aggregate(slice(all, 1, i), 0L, (s, x) -> s + x.n) AS {start})))"
    )
    upto = Window.partitionBy(number).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.join(F.broadcast(starts), number).withColumn(name, F.col(start) + F.sum(value).over(upto))
    return summed.select(*[F.col(f"`{column}`") for column in df.columns if column != name], name)
