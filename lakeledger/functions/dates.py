"""Calendar parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_year(day: Column) -> Column:
    """Complete seven-day periods since 1 January, plus one: 1..53, and not the ISO week."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")


def week_pair(day: Column) -> Column:
    return (F.floor(week_of_year(day) / 2) * 2).cast("int")


def in_season(week: Column, after: int = 13, before: int = 47) -> Column:
    """Weeks strictly between the two bounds."""
    return (week > after) & (week < before)
