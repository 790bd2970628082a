"""Document fingerprints by randomised edit embedding: shared random walks over characters."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import sorted_position
from .components import connected_components
from .support import cut, grouped, quoted, shuffle_partitions, text_or_empty, tidied, unused, without

#: Samples a fingerprint aims at; it has up to twice as many.
SAMPLES = 128
#: Sampled characters in a band.
BAND = 4
#: Fingerprints of fewer digits are also cut into pieces of one digit less than a band.
SHORT = 16
#: Fingerprints of a band that are compared in one cell, and with as many of another cell.
CELL = 1024
#: Characters of each text over which walks advance before the table of moves is made anew, and the table's entries at most.
BLOCK, MOVES = 512, 1 << 21
#: Bytes of text walked over at a time, and bytes of text in a part of documents that follow each other.
GROUP, PART = 8_000_000, 128 << 20


class _Steps:
    """The randomness that all walks share, by step: whether a character moves the walk, its digit, the step's level."""

    def __init__(self) -> None:
        self.size = 0
        self.extend(1 << 16)

    def extend(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = 1 << int(size - 1).bit_length()
        mixed = [_mix(np.arange(self.size, dtype=np.uint64) + np.uint64(k << 40)) for k in range(1, 4)]
        self.factor = (mixed[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.offset = mixed[1].astype(np.uint32)
        self.digit = (mixed[1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = mixed[2] & (~mixed[2] + np.uint64(1))
        self.level = np.bitwise_count(low - np.uint64(1)).astype(np.int64)  # trailing zeros: half of the steps a level
        self._of_level: dict[int, np.ndarray] = {}

    def of_level(self, level: int) -> np.ndarray:
        """The steps known so far of at least ``level``."""
        if level not in self._of_level:
            self._of_level[level] = np.flatnonzero(self.level >= level)
        return self._of_level[level]

    def sampled(self, level: int, among: int) -> np.ndarray:
        """The first steps of at least ``level``, enough for 2 * ``among`` digits."""
        self.extend((among + 64) << level + 1)
        return self.of_level(level)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEPS = _Steps()
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def sample_level(n_chars: int) -> int:
    """A walk over n characters takes about 2n steps; of these one in 2 ** level is sampled."""
    return max(0, (2 * n_chars // SAMPLES).bit_length() - 1)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts: two hex digits of the level, one for each sampled step.

    At step j a walk shows the character it stands on and moves on by one or stays, as the shared random function of
    step and character says. Two texts walk alike up to an edit and, after the steps that the edit costs, alike again,
    so few edits leave most steps equal. Every text is walked to its end; steps are sampled, the same ones for all.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    arrivals = _arrivals(points, starts, lengths)
    found = []
    for k, (start, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        level = sample_level(n)
        own = arrivals[start + k : start + k + n + 1]
        steps = STEPS.of_level(level)
        steps = steps[: np.searchsorted(steps, own[-1])]
        here = points[start : start + n][np.searchsorted(own, steps.astype(own.dtype), side="right") - 1]
        digits = (here * STEPS.digit[steps] + STEPS.offset[steps]) >> np.uint32(28)
        found.append(f"{level:02x}{_HEX[digits].tobytes().decode()}")
    return found


def _arrivals(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text the steps at which its walk arrives at its characters and, one more, at its end."""
    longest = int(lengths.max(initial=0))
    STEPS.extend(4 * longest + 4096)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(points) + len(lengths), np.int32 if longest < 1 << 28 else np.int64)
    places = starts + np.arange(len(starts))
    tasks = [(order[: np.count_nonzero(lengths)], 0)]
    while tasks:
        chosen, begin = tasks.pop()
        while len(chosen):
            width = BLOCK
            while not _advance(points, starts[chosen], lengths[chosen], places[chosen], begin, width, out):
                if width > 32:
                    width //= 2
                else:  # too many characters, or walks too far apart, for one table
                    half = len(chosen) // 2
                    tasks.append((chosen[half:], begin))
                    chosen = chosen[:half]
            begin += width
            chosen = chosen[: np.searchsorted(-lengths[chosen], -begin, side="left")]
    return out


def _advance(
    points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: np.ndarray, begin: int, width: int, out: np.ndarray
) -> bool:
    """Walks over ``width`` characters of all texts (longest first, longer than ``begin``); False if the table would be too large.

    The table says, for a character and the step at which a walk arrives there, at which step the walk moves on.
    """
    m = len(starts)
    at = begin + np.arange(width)
    inside = at < lengths[:, None]
    block = points[np.where(inside, starts[:, None] + at, starts[:, None] + begin)]
    seen = np.zeros(int(block.max()) + 1, bool)
    seen[block] = True
    alphabet = np.flatnonzero(seen)
    arrived = out[places + begin].astype(np.int64)
    low, high = int(arrived.min()), int(arrived.max())
    steps = high - low + 2 * width + 8 * math.isqrt(width) + 64
    number = np.zeros(len(seen), np.int64)
    # walks that are still on their way: those of texts that hold so many characters
    walking = inside.sum(axis=0).tolist()
    while True:
        if m > 1 and len(alphabet) * (steps + 1) > MOVES:
            return False
        STEPS.extend(low + steps + 1)
        span = slice(low, low + steps)
        moves = (alphabet.astype(np.uint32)[:, None] * STEPS.factor[span] + STEPS.offset[span]) >> np.uint32(31)
        table = np.full((len(alphabet), steps + 1), steps, np.int64)
        np.copyto(table[:, :-1], np.arange(1, steps + 1), where=moves.astype(bool))
        table = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
        number[alphabet] = np.arange(len(alphabet)) * (steps + 1)
        base = np.ascontiguousarray(number[block].T)
        walk = np.empty((width + 1, m), np.int64)
        walk[0] = arrived - low
        index = np.empty(m, np.int64)
        for p, n in enumerate(walking):
            if not n:
                break
            np.add(base[p, :n], walk[p, :n], out=index[:n])
            table.take(index[:n], out=walk[p + 1, :n], mode="clip")
        moved = walk[1:].T[inside]
        if int(moved.max()) < steps:
            break
        steps *= 2  # a walk stayed longer than the table goes
    out[(places[:, None] + at + 1)[inside]] = moved + low
    return True


def _at_level(fingerprint: str, level: int) -> np.ndarray:
    """The digits of those steps that a text of this level samples too."""
    own = int(fingerprint[:2], 16)
    digits = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    if level == own:
        return digits
    steps = STEPS.sampled(own, len(digits))[: len(digits)]
    return digits[STEPS.level[steps] >= level]


def likeness(first: str, second: str) -> float:
    """Share of equal digits among the steps both sample, less what chance makes equal: 0 to 1, 1 for equal ones."""
    if first == second:
        return 1.0
    level = max(int(first[:2], 16), int(second[:2], 16))
    a, b = _at_level(first, level), _at_level(second, level)
    n, m = max(len(a), len(b)), min(len(a), len(b))
    if not m:
        return 0.0
    share = float((a[:m] == b[:m]).sum()) / n
    return max(0.0, (share - 1 / 16) / (15 / 16))


def bands(fingerprint: str) -> list[str]:
    """Keys of BAND sampled digits each, at the text's level and at the next, so texts of about one length meet."""
    own = int(fingerprint[:2], 16)
    keys = []
    for level in (own, own + 1):
        digits = _at_level(fingerprint, level).tobytes().decode()
        keys += [f"{level:02x}.{k}.{digits[k : k + BAND]}" for k in range(0, len(digits) - BAND + 1, BAND)]
    return keys


# --- DataFrames ----------------------------------------------------------------------------------------------


def edit_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``. A null text is empty and has no digits; equal texts have equal fingerprints.

    No shuffle; a worker walks over a bounded amount of text plus the longest document at a time. A column named
    ``fingerprint`` is replaced.
    """
    docs = without(docs, "fingerprint")
    (body,) = unused(docs, "body_")
    width = len(docs.columns)
    fields = [*docs.schema.fields, T.StructField("fingerprint", T.StringType())]
    inner = T.StructType([T.StructField(f"c{k}", field.dataType) for k, field in enumerate(fields)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, body, GROUP):
            for batch in pa.Table.from_batches(group).combine_chunks().to_batches():
                columns = [*batch.columns[:width], pa.array(fingerprints(batch.column(width).to_pylist()), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    source = docs.select(*[quoted(x).alias(f"c{k}") for k, x in enumerate(docs.columns)], text_or_empty(text).alias(body))
    names = [*docs.columns, "fingerprint"]
    return source.mapInArrow(tidied(compute), inner).select(*[F.col(f"c{k}").alias(x) for k, x in enumerate(names)])


def _keys(fingerprint: str, least_share: float) -> list[tuple[str, int, int]]:
    """(key, level, spare) of bands; two fingerprints of at least this share of equal digits have more than ``spare`` in common.

    Of n digits at most (1 - share) * n differ, and each breaks one band. Where few digits leave no whole band for sure,
    pieces of one digit less are keys too.
    """
    own, keys = int(fingerprint[:2], 16), defaultdict(list)
    for key in bands(fingerprint):
        keys[int(key[:2], 16)].append(key)
    found = []
    for level in (own, own + 1):
        digits = _at_level(fingerprint, level).tobytes().decode()
        sure = (least_share - 1 + 1 / BAND) * len(digits) - (BAND - 1) / BAND
        if len(digits) < SHORT:
            keys[level] += [f"{level:02x}s{k}.{digits[k : k + BAND - 1]}" for k in range(0, len(digits) - BAND + 2, BAND - 1)]
        found += [(key, level, max(0, math.ceil(sure - 1e-9) - 1)) for key in keys[level]]
    return found


def _links(values: list[str], sides: list[int], level: int, min_likeness: float) -> list[tuple[str, str]]:
    """Links among fingerprints that share a band of this level (of two sides: across), less those that others imply."""
    digits = [_at_level(value, level) for value in values]
    lengths = np.fromiter(map(len, digits), np.int64, len(values))
    own = np.fromiter((int(value[:2], 16) for value in values), np.int64, len(values))
    side = np.array(sides)
    across = len(set(sides)) > 1
    table = np.zeros((len(values), int(lengths.max(initial=0))), np.uint8)
    for k, row in enumerate(digits):
        table[k, : len(row)] = row
    group = np.arange(len(values))
    links = []
    for k in range(len(values) - 1):
        # two texts of a lower level are compared under that level's bands
        fit = (np.maximum(own[k + 1 :], own[k]) == level) & (group[k + 1 :] != group[k])
        others = np.flatnonzero(fit & (side[k + 1 :] != side[k]) if across else fit) + k + 1
        if not len(others):
            continue
        n = np.maximum(lengths[others], lengths[k])
        equal = (table[others] == table[k]).sum(axis=1) - (table.shape[1] - n)
        near = np.maximum(0.0, (equal / n - 1 / 16) / (15 / 16)) >= min_likeness
        for other in others[near].tolist():
            if group[other] != group[k]:
                links.append((values[k], values[other]))
                group[group == group[other]] = group[k]
    return links


def fingerprint_groups(fingerprinted: DataFrame, min_likeness: float = 0.8, fingerprint: str = "fingerprint") -> DataFrame:
    """(fingerprint, group): each distinct fingerprint and the smallest one it is linked with, over links.

    Distinct fingerprints that share a band are candidates, all pairs of them. Candidates of at least ``min_likeness``
    are links; groups are the connected components. From a likeness of 0.8 on, two fingerprints have about a quarter of
    their bands in common at least, so no link is missed; far below, banding can miss one.

    For the same reason a fingerprint leaves out its most crowded bands, one less than it surely shares with any other
    that is like it: of common bands the least crowded stays on both sides. Bands that are still crowded are compared
    in cells of two times CELL fingerprints, so that one band is spread over many tasks; the comparisons of such a band
    grow with the square of its fingerprints. Texts whose levels differ by two or more are never candidates: one is at
    least twice as long as the other.
    """
    known = cut(fingerprinted.select(quoted(fingerprint).alias("f")).where("f is not null").distinct())
    least_share = min_likeness * 15 / 16 + 1 / 16

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                keys = _keys(value, least_share)
                columns = [[x[k] for x in keys] for k in range(3)]
                kinds = [pa.string(), pa.int32(), pa.int32()]
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([value] * len(keys), pa.string())], ["band", "level", "spare", "f"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values, sides = None, [], []

        def linked() -> pa.RecordBatch:
            links = _links(values, sides, cell[1], min_likeness)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *key, side, value in zip(*(column.to_pylist() for column in batch.columns)):
                if key != cell:
                    if len(values) > 1:
                        yield linked()
                    cell, values, sides = key, [], []
                values.append(value)
                sides.append(side)
        if len(values) > 1:
            yield linked()

    rows = cut(known.mapInArrow(spread, "band string, level int, spare int, f string"))
    crowds = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("band", "crowd")
    rows = rows.join(crowds, F.col("band") == F.col("crowd"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("f", "level").orderBy(F.desc("n"), "band")))
    blocks = F.ceil(F.col("n") / CELL)
    dealt = ranked.where("rank > spare and n > 1").select("band", "level", "f", blocks.alias("blocks"), F.pmod(F.xxhash64("f"), blocks).alias("side"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("band", "level", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "f")
    cells = cells.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "f")
    links = cells.mapInArrow(tidied(compare), "a string, b string").distinct()
    roots = connected_components(links).withColumnRenamed("node", "f")
    return known.join(roots, "f", "left").select(F.col("f").alias("fingerprint"), F.coalesce("root", "f").alias("group"))


def with_successors(docs: DataFrame, id: str = "doc_id", text: str = "text", part_bytes: int = PART) -> DataFrame:
    """(part, extra, id, text): partitions in which each row is followed by its successor in descending id.

    Rows are dealt out by ranges of ids into parts of about ``part_bytes`` of text; the first row of each part comes again,
    marked ``extra``, at the end of the part before (of the last part before the first, so the order is a circle). Bounds and
    first rows, a few numbers a part, are all that reaches the driver. Null ids come last; rows of equal id, which are
    one part, follow a hash of their text.
    """
    source = docs.select(quoted(id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    cuts = [k / n for k in range(1, n)]
    bounds = sorted({int(x) for x in source.select("id").approxQuantile("id", cuts, 0.2 / n)}) if cuts else []
    # part 0 has the largest ids; a row lies above the bounds that are less than its id
    bound = source.withColumn("bounds", F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>"))
    below = F.expr(sorted_position("bounds", "id", len(bounds))) if bounds else F.lit(0)
    part = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - below)
    dealt = bound.withColumn("part", part).drop("bounds")
    # a part's first row; the complement of an id falls as the id grows
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.bitwise_not("id").alias("from_top"), "tie"))
    found = sorted((x.part, x["first"]["from_top"], x["first"]["tie"]) for x in dealt.groupBy("part").agg(first.alias("first")).collect())
    heads = [(number, top, tie, found[k - 1][0]) for k, (number, top, tie) in enumerate(found)]
    table = docs.sparkSession.createDataFrame(heads, "at int, top long, head_tie long, copy int")
    is_head = (F.col("part") == F.col("at")) & F.bitwise_not("id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("head_tie"))
    rows = dealt.join(F.broadcast(table), is_head, "left")
    target = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    again = F.struct(F.col("copy").alias("part"), F.lit(1).alias("extra"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("copy").isNull(), F.array(target)).otherwise(F.array(target, again))))
    rows = rows.select("to.part", "to.extra", "id", "text", "tie")
    rows = rows.repartition(max(n, shuffle_partitions(docs.sparkSession)), "part")
    return rows.sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), "tie").drop("tie")


def edited_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint held against that of its edited text and that of the next document.

    The edited text has the last half of its code points replaced by as many (or all) of the first ones of the next
    document in descending id, after the last one the first. (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, bands_edited, bands_next): likenesses, and the number of bands shared.
    """
    names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"]
    schema = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, bands_edited int, bands_next int"
    )

    def edit(text: str, following: str) -> str:
        half = len(text) // 2
        return text[: len(text) - half] + following[:half]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """rows of (part, extra, id, text); a row is compared with the next one of its part."""
        texts = [row[3] for row in rows]
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
        edits = [edit(texts[k], texts[k + 1]) for k in pairs]
        prints = fingerprints(texts + edits)
        out = []
        for k, changed, other in zip(pairs, edits, prints[len(texts) :]):
            own, following = prints[k], prints[k + 1]
            keys = set(bands(own))
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append(
                (rows[k][2], len(texts[k]), digest, own, other, likeness(own, other), likeness(own, following),
                 len(keys.intersection(bands(other))), len(keys.intersection(bands(following))))
            )
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(9)], ["id", *names[1:]])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for group in grouped(batches, "text", GROUP):
            rows = last + [row for batch in group for row in zip(*(column.to_pylist() for column in batch.columns))]
            yield compare(rows)
            last = rows[-1:]

    return with_successors(docs, id, text).mapInArrow(tidied(stream), schema).toDF(*names)
