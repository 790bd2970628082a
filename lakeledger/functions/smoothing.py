"""Tukey's 3RS3R running-median smoother over an array column (Tukey, Exploratory Data Analysis, 1977).

The passes are higher-order functions over one series held in one array, so a series never leaves its row and
thousands of series are smoothed side by side. A series is one value per calendar week (at most 53); longer ones are
cut into blocks (``operators/long_series.py``), which use the same passes.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def running_three(series: Column) -> Column:
    """Median of each value and its two neighbours; the ends are copied."""
    last = F.size(series) - 1

    def smooth(value, i):
        inner = median_of_three(F.get(series, i - 1), value, F.get(series, i + 1))
        return F.when((i == 0) | (i == last), value).otherwise(inner)

    return F.transform(series, smooth)


def _settle(series: Column) -> Column:
    """Repeat the running median until stable: half the length is always enough, more passes change nothing."""
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(series) / 2).cast("int")))
    return F.aggregate(passes, series, lambda state, _: running_three(state))


def fix_ends(settled: Column, source: Column) -> Column:
    """Tukey's end rule: median of the end, its neighbour and the line through the next two."""
    last = F.size(settled) - 1

    def fix(value, i):
        step = F.when(i == 0, F.lit(1)).otherwise(F.lit(-1))
        near, far = F.get(settled, i + step), F.get(settled, i + 2 * step)
        ended = median_of_three(3 * near - 2 * far, F.get(source, i), near)
        return F.when((i == 0) | (i == last), ended).otherwise(value)

    return F.transform(settled, fix)


def split_flats(series: Column) -> Column:
    """Replace each two-point peak or valley by what its outer neighbours extrapolate to."""
    size = F.size(series)

    def at(i):
        return F.get(series, i)

    def is_flat(i):
        rising = (at(i - 1) <= at(i)) & (at(i + 1) <= at(i + 2))
        falling = (at(i - 1) >= at(i)) & (at(i + 1) >= at(i + 2))
        return (i >= 2) & (i < size - 3) & (at(i) == at(i + 1)) & ~rising & ~falling

    def split(value, i):
        left = median_of_three(value, at(i - 1), 3 * at(i - 1) - 2 * at(i - 2))
        right = median_of_three(value, at(i + 1), 3 * at(i + 1) - 2 * at(i + 2))
        return F.when(is_flat(i), left).when(is_flat(i - 1), right).otherwise(value)

    return F.when(size > 4, F.transform(series, split)).otherwise(series)


def stages_3rs3r(series: Column) -> list[tuple[str, Column]]:
    """The smoother as named steps, each reading the column the previous one produced.

    Steps rather than one nested expression: nesting would repeat a sub-expression at every use.
    """
    c = F.col
    return [
        ("_settled", _settle(series)),
        ("_ended", fix_ends(c("_settled"), series)),
        ("_split", split_flats(c("_ended"))),
        ("_settled2", _settle(c("_split"))),
        ("_smooth", fix_ends(c("_settled2"), c("_split"))),
    ]
