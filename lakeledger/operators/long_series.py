"""Tukey's 3RS3R smoother over series of any length: a series is many rows of bounded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.smoothing import fix_ends, running_three, split_flats
from ..sources.tables import kept
from .ordered import running_total

#: Values of a series in one row.
BLOCK = 1024
#: Neighbours that the end rule and the splitting of flats may look at, with room to spare.
NEAR = 8


def tukey_smooth_long(
    series: DataFrame, keys: Sequence[str], position: str = "Date", value: str = "med", block: int = BLOCK
) -> DataFrame:
    """(keys, position, value, smooth): the result of ``tukey_smooth``, for series of any length.

    Rows get numbers along (keys, position) by sums in two levels, so no series is gathered; ``block`` consecutive numbers
    of one series are a row. Null values are dropped first. Rows of one position are taken in ascending value, equal ones
    next to each other. Null keys are a series of their own.

    In each round a block borrows as many values of both neighbours as it makes passes of the running median, which
    leaves its own part exact. Passes go on until no block changes; blocks that are at rest between neighbours at rest
    are left alone. The number of passes doubles from round to round until it nears ``block``: a series that swings over
    all its length takes half its length in passes, as by definition, but few rounds otherwise. Each round is written to
    the shared folder; one row a round reaches the driver.
    """
    if block < 2 * NEAR:
        raise ValueError(f"a block holds {2 * NEAR} values at least, not {block}")
    paths = kept(_blocks(series, keys, position, value, block), "series")
    source = paths.select(*keys, "_block", F.transform("_path", lambda e: e[value]).alias("_source"))
    start = source.withColumn("_x", F.col("_source"))

    settled = _settle(start, keys, block)
    spread = _with_neighbours(settled, keys, NEAR)
    spread = spread.withColumn("_ended", fix_ends(_wide("_x"), _wide("_source")))
    spread = spread.withColumn("_split", split_flats(F.col("_ended")))
    flat = spread.select(*keys, "_block", _centre(F.col("_split")).alias("_x"), _centre(F.col("_split")).alias("_source"))

    again = _settle(kept(flat, "series"), keys, block)
    spread = _with_neighbours(again, keys, NEAR)
    ended = _centre(fix_ends(_wide("_x"), _wide("_source")))
    done = spread.select(*keys, "_block", (F.size(_wide("_x")) < 3).alias("_short"), ended.alias("_smooth"))

    same = [F.col(f"s.{name}").eqNullSafe(F.col(f"d.{name}")) for name in [*keys, "_block"]]
    both = paths.alias("s").join(done.alias("d"), same)
    smooth = F.when(F.col("_short"), F.transform("_path", lambda e: e[value])).otherwise(F.col("_smooth"))
    rows = both.select(*[f"s.{name}" for name in keys], F.inline(F.arrays_zip("_path", smooth.alias("smooth"))))
    return rows.select(*keys, F.col(f"_path.{position}"), F.col(f"_path.{value}"), "smooth")


def _blocks(series: DataFrame, keys: Sequence[str], position: str, value: str, block: int) -> DataFrame:
    """(keys, _block, _path): positions and values of consecutive rows of one series, in order."""
    order = [*keys, position, value]
    present = series.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    counted = present.groupBy(*order).agg(F.count(F.lit(1)).alias("_copies"))
    ends = running_total(counted, order, "_copies", "_end")
    each = ends.select(*order, F.explode(F.sequence(F.col("_end") - F.col("_copies"), F.col("_end") - 1)).alias("_at"))
    path = F.array_sort(F.collect_list(F.struct("_at", position, value)))
    return each.groupBy(*keys, F.expr(f"_at div {block}").alias("_block")).agg(path.alias("_path"))


def _with_neighbours(blocks: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Every block (``own``) with the ends of its series' blocks ``before`` and ``after`` it, ``reach`` values of each.

    Only the last block after and the first block before can be shorter than that, and there the series ends.
    """
    columns = [name for name in blocks.columns if name not in (*keys, "_block")]

    def part(name: str, side: str) -> Column:
        if name == "_moving" or side == "own":
            return F.col(name)
        first = F.greatest(F.lit(1), F.size(name) - reach + 1) if side == "before" else F.lit(1)
        return F.slice(name, first, F.lit(reach))

    sides = {"own": 0, "before": 1, "after": -1}
    sent = [
        F.struct(
            (F.col("_block") + step).alias("_block"),
            F.lit(side).alias("side"),
            F.struct(*[part(name, side).alias(name) for name in columns]).alias("part"),
        )
        for side, step in sides.items()
    ]
    dealt = blocks.select(*keys, F.explode(F.array(*sent)).alias("to")).select(*keys, "to.*")
    met = [F.first(F.when(F.col("side") == side, F.col("part")), ignorenulls=True).alias(side) for side in sides]
    return dealt.groupBy(*keys, "_block").agg(*met).where(F.col("own").isNotNull())


def _wide(name: str) -> Column:
    """The block's array between what its neighbours lend."""
    nothing = F.array().cast("array<double>")
    return F.concat(F.coalesce(f"before.{name}", nothing), F.col(f"own.{name}"), F.coalesce(f"after.{name}", nothing))


def _centre(wide: Column) -> Column:
    """The block's own part of such an array."""
    return F.slice(wide, F.coalesce(F.size("before._x"), F.lit(0)) + 1, F.size("own._x"))


def _settle(blocks: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """``_x`` after running medians of three until nothing changes; ``_source`` is passed on."""
    state, passes = blocks.withColumn("_moving", F.lit(True)), NEAR
    while True:
        spread = _with_neighbours(state, keys, passes + 1)
        flags = [F.coalesce(f"{side}._moving", F.lit(False)) for side in ("own", "before", "after")]
        rounds = F.sequence(F.lit(1), F.lit(passes))
        moved = F.aggregate(rounds, _wide("_x"), lambda x, _: running_three(x))
        spread = spread.withColumn("_busy", flags[0] | flags[1] | flags[2])
        spread = spread.withColumn("_wide", F.when(F.col("_busy"), moved).otherwise(_wide("_x")))
        changes = F.when(F.col("_busy"), _centre(running_three(F.col("_wide"))) != _centre(F.col("_wide"))).otherwise(False)
        state = spread.select(
            *keys, "_block", F.col("own._source").alias("_source"), _centre(F.col("_wide")).alias("_x"), changes.alias("_moving")
        )
        state = kept(state, "series")
        if not state.where("_moving").limit(1).count():
            return state.drop("_moving")
        passes = min(2 * passes, block - 1)
