"""Date pages: cutting a period into windows and reading observations by window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import sorted_position


def page_starts(lo: Column, hi: Column, stride: str, keep_empty: bool = False) -> Column:
    """First day of each page: ``lo`` stepped by ``stride`` (as in ``'5 years'``) up to ``hi``.

    A page that would start on ``hi`` has no length and is left out unless ``keep_empty``.
    """
    starts = F.sequence(lo, hi, F.expr(f"interval {stride}"))
    return starts if keep_empty else F.filter(starts, lambda day: day < hi)


def page_windows(
    periods: DataFrame, stride: str, lo: str = "lo", hi: str = "hi", keep_empty: bool = False
) -> DataFrame:
    """Each period of ``periods`` unfolded into its pages (page, start, end); a page ends where the next starts."""
    starts = page_starts(F.col(lo), F.col(hi), stride, keep_empty)
    return periods.select(*periods.columns, starts.alias("_starts")).select(
        *periods.columns,
        F.inline(
            F.transform(
                "_starts",
                lambda day, i: F.struct(
                    (i + 1).alias("page"),
                    day.alias("start"),
                    F.coalesce(F.get("_starts", i + 1), F.col(hi)).alias("end"),
                ),
            )
        ),
    )


#: Strides of these units cut a day into pages.
_SHORT = re.compile(r"hour|minute|second", re.IGNORECASE)


def read_paged(
    results: DataFrame,
    lo: str,
    hi: str,
    stride: str,
    bounds: str = "closed",
    keep_empty: bool = False,
    date: str = "Date",
) -> DataFrame:
    """Rows of the period with the page they are read on.

    ``closed`` pages share their boundaries, whose rows appear on both; ``half_open`` pages partition the period, whose end
    belongs to the last page. A timestamp counts by its day, so the last day is whole; where the stride is shorter than a
    day, or ``lo`` or ``hi`` has a time, it counts by itself.

    The starts of pages are one constant array, in which each row looks up its page by a binary search: nothing is joined,
    and neither a long period nor a short stride unfolds. The period reaches the scan as a plain filter.
    """
    if bounds not in ("closed", "half_open"):
        raise ValueError(f"bounds must be 'closed' or 'half_open', not {bounds!r}")
    kind = results.schema[date].dataType
    by_day = isinstance(kind, T.DateType) or not (_SHORT.search(stride) or ":" in lo + hi)
    if isinstance(kind, T.DateType) and _SHORT.search(stride):
        raise ValueError(f"a date has no pages of {stride!r}")
    unit = "date" if by_day else kind.simpleString()
    first, last = (F.lit(end).cast(unit) for end in (lo, hi))
    if isinstance(kind, T.DateType) or not by_day:
        inside = F.col(date).between(first, last)
    else:
        inside = (F.col(date) >= first) & (F.col(date) < F.date_add(last, 1))
    starts = page_starts(first, last, stride, keep_empty)
    pages = results.sparkSession.range(1).select(F.size(starts)).first()[0]
    # the last page that has a length: the period's end belongs to it
    longest = pages - 1 if pages and not keep_empty else F.size(F.filter(starts, lambda start: start < last)) - 1
    place = (
        results.where(inside)
        .withColumns({"_starts": starts, "_at": F.col(date).cast(unit)})
        .withColumn("_below", F.expr(sorted_position("_starts", "_at", max(pages, 1))))
    )
    on_start = F.coalesce(F.get("_starts", "_below") == F.col("_at"), F.lit(False))
    place = place.withColumn("_page", F.col("_below") - F.when(on_start, 0).otherwise(1))

    def page(number: Column) -> Column:
        end = F.coalesce(F.get("_starts", number + 1), last)
        return F.struct(F.get("_starts", number).alias("page_start"), end.alias("page_end"))

    if bounds == "closed":
        both = on_start & (F.col("_page") > 0)
        found = F.when(both, F.array(page(F.col("_page") - 1), page(F.col("_page")))).otherwise(F.array(page(F.col("_page"))))
        placed = place.where("_page >= 0").select(*results.columns, F.inline(found))
    else:
        own = F.when(F.col("_at") == last, longest).otherwise(F.col("_page"))
        placed = place.withColumn("_page", own).where("_page >= 0").select(*results.columns, page(F.col("_page")).alias("_p"))
        placed = placed.select(*results.columns, "_p.page_start", "_p.page_end")
    return placed
