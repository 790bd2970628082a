"""Exact quantiles per group that never gather a group in one place.

Values are first counted: (group, value, n), with map-side combining. Values are then binned by a fixed rule that follows
their order, and one aggregate weighs the bins of all groups: a few thousand bins an octave, so a bin holds a small share of
a group's values whatever the group holds. Only values of bins that hold a wanted rank go on and are sorted. The bins decide
where to look, never what the answer is.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins for each doubling of a value.
BINS = 4096


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) over the rows that have a value."""
    present = F.col(value).isNotNull() & ~F.isnan(value)
    return df.where(present).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def roll_up(counts: DataFrame, keys: Sequence[str], value: str, away: Sequence[str]) -> DataFrame:
    """Counts at the given keys together with counts over all ``away`` keys, which are null there.

    Runs on counted values, so adding a grand total costs no second pass over the observations.
    """
    kept = [name for name in keys if name not in away]
    fine = F.struct(*[F.col(name) for name in away])
    coarse = F.struct(*[F.lit(None).cast(counts.schema[name].dataType).alias(name) for name in away])
    return (
        counts.select(*kept, value, "n", F.inline(F.array(fine, coarse)))
        .groupBy(*keys, value)
        .agg(F.sum("n").alias("n"))
    )


def _ranks(prob: float) -> tuple[str, str, str]:
    """Zero-based position of a quantile among the group's values and the two ranks around it, as SQL."""
    place = f"((_total - 1) * {float(prob)!r}D)"
    return place, f"floor({place})", f"ceil({place})"


def _bin() -> str:
    """The number of a value's bin: it never falls as the value grows. Zero is a bin of its own, infinities have the last ones."""

    def of(size: str) -> str:
        return f"CAST(floor(greatest(-1100D, least(1100D, log2({size}))) * {BINS}) AS BIGINT) + {1200 * BINS}"

    return f"CASE WHEN _v > 0 THEN {of('_v')} WHEN _v < 0 THEN - ({of('- _v')}) ELSE 0L END"


def _candidates(v: DataFrame, probs: Iterable[float]) -> DataFrame:
    """The values of the bins that hold a wanted rank, with the weight before their bin."""
    ranks = ", ".join(rank for p in probs for rank in _ranks(p)[1:])
    binned = v.selectExpr("*", f"{_bin()} AS _bin")
    # the window runs over the bins of a group: tens of thousands at most in ordinary data
    wanted = (
        binned.groupBy("_g", "_bin")
        .agg(F.sum("_n").alias("_weight"))
        .selectExpr(
            "_g", "_bin", "_weight", "sum(_weight) OVER (PARTITION BY _g) AS _total",
            "sum(_weight) OVER (PARTITION BY _g ORDER BY _bin ROWS UNBOUNDED PRECEDING) - _weight AS _before",
        )
        .selectExpr(
            "_g", "_bin", "_total", "_before",
            f"filter(array_distinct(array({ranks})), r -> r >= _before AND r < _before + _weight) AS _ranks",
        )
        .where("size(_ranks) > 0")
    )
    return binned.join(wanted, ["_g", "_bin"])


def exact_quantiles(counts: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (the default of R, ``percentile`` of Spark) from counted values.

    ``probs`` maps output column to probability. One row per group of ``keys``, which may be null.
    """
    if not keys:
        raise ValueError("name the group's columns; roll_up gives quantiles over all groups")
    # A struct is equal to itself when its fields are null, so null keys group and join like any other.
    group = ", ".join(f"`{name}`" for name in keys)
    v = counts.selectExpr(f"struct({group}) AS _g", f"CAST(`{value}` AS DOUBLE) AS _v", "n AS _n")
    upto = "_before + sum(_n) OVER (PARTITION BY _g, _bin ORDER BY _v ROWS UNBOUNDED PRECEDING)"

    def value_at(rank: str) -> str:
        return f"max(IF({rank} >= _upto - _n AND {rank} < _upto, _v, NULL))"

    around = [
        F.expr(f"{value_at(rank)}").alias(f"_{end}{i}")
        for i, p in enumerate(probs.values())
        for end, rank in zip(("low", "high"), _ranks(p)[1:])
    ]
    picked = (
        _candidates(v, probs.values())
        .repartition("_g")  # serves the window and the aggregate
        .selectExpr("_g", "_v", "_n", "_total", "_ranks", f"{upto} AS _upto")
        .where("exists(_ranks, r -> r >= _upto - _n AND r < _upto)")
        .groupBy("_g", "_total")
        .agg(*around)
    )

    def interpolated(i: int, prob: float) -> str:
        place, low, _ = _ranks(prob)
        return f"IF(_low{i} = _high{i}, _low{i}, _low{i} + (_high{i} - _low{i}) * ({place} - {low}))"

    return picked.selectExpr(
        *[f"_g.`{name}` AS `{name}`" for name in keys],
        *[f"{interpolated(i, p)} AS `{name}`" for i, (name, p) in enumerate(probs.items())],
    )
