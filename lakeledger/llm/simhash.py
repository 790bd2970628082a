"""Near-duplicates by SimHash, found with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .support import cut, quoted, stored, text_or_empty, tidied, unused, without

ADDED = ("fingerprint", "component_id")
SEED = 42
#: The fingerprint's bits dealt into segments of at most 23 bits: (lowest bit, bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Fingerprints under one key that are compared with each other; more are looked up by their neighbours.
COMPARED = 1024


# --- the code ------------------------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    """The 11-bit syndrome: the remainder by the generator over GF(2)."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a word; for each syndrome its errors of at most 4 bits."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    errors = np.full((2048, 6), -1, np.int32)
    filled = [0] * 2048
    for count in range(5):
        for places in combinations(range(23), count):
            pattern = sum(1 << p for p in places)
            syndrome = int(low[pattern & 4095] ^ high[pattern >> 12])
            errors[syndrome, filled[syndrome]] = pattern
            filled[syndrome] += 1
    return low, high, errors


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of the codewords at most 4 bits away, -1 where there are fewer than 6.

    The code is perfect: every word is at most 3 bits from exactly one codeword. A word exactly 3 bits away has five
    more at 4 bits, others none. Two words that differ in at most 2 bits share at least one of these codewords: the
    nearest of one, or, if both flips lead away from it, one of the five. A codeword's index is its upper 12 bits.
    """
    low, high, errors = _decoder()
    found = errors[low[words & 4095] ^ high[words >> 12]]
    return np.where(found >= 0, (words[:, None] ^ found) >> 11, -1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, indices into ``prints``): two fingerprints that differ in at most 2 bits share a key.

    Of three segments at least one has no error, and then any other has at most 2: each segment is taken exactly once,
    with the Golay indices of the next one.
    """
    parts = [(prints >> np.uint64(low)) & np.uint64((1 << bits) - 1) for low, bits in SEGMENTS]
    keys, rows = [], []
    for k, exact in enumerate(parts):
        near = golay_keys(parts[(k + 1) % len(parts)].astype(np.int64))
        row, column = np.nonzero(near >= 0)
        keys.append(np.int64(k) << 40 | exact.astype(np.int64)[row] << 12 | near[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


# --- fingerprints --------------------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint: bit b is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[start : start + 100_000], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number in a new last column."""
    width = len(docs.columns)
    (body,) = unused(docs, "body_")
    fields = [*docs.schema.fields, T.StructField(name, T.LongType())]
    inner = T.StructType([T.StructField(f"c{k}", field.dataType) for k, field in enumerate(fields)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = np.array([simhash(x, shingle) for x in part.column(width).to_pylist()], np.uint64)
                columns = [*part.columns[:width], pa.array(found.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    source = docs.select(*[quoted(x).alias(f"c{k}") for k, x in enumerate(docs.columns)], text_or_empty(text).alias(body))
    return source.mapInArrow(tidied(compute), inner).select(*[F.col(f"c{k}").alias(x) for k, x in enumerate([*docs.columns, name])])


# --- links ---------------------------------------------------------------------------------------------------


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            prints = batch.column(0).slice(start, 20_000).to_numpy().view(np.uint64)
            keys, rows = fuzzy_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows].view(np.int64))], ["key", "print"])


def _roots(prints: np.ndarray, distance: int) -> np.ndarray:
    """For sorted distinct fingerprints of one key the first one reachable by links of at most ``distance`` bits."""
    n = len(prints)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)

    if n <= COMPARED:
        left, right = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance)
        union(left[left < right], right[left < right])
    else:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for errors in range(1, distance + 1):
            for flipped in combinations(bits.tolist(), errors):
                other = prints ^ np.uint64(sum(flipped))
                at = np.minimum(np.searchsorted(prints, other), n - 1)
                found = np.flatnonzero((prints[at] == other) & (at > np.arange(n)))
                union(found, at[found])
    return np.array([find(i) for i in range(n)], np.int64)


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, print): a link from each fingerprint to the first of those it is linked with."""
        held_key, held = None, []

        def close() -> pa.RecordBatch | None:
            prints = np.concatenate(held).view(np.uint64)
            if len(prints) < 2:
                return None
            prints = np.unique(prints)
            roots = prints[_roots(prints, distance)]
            linked = roots != prints
            return pa.RecordBatch.from_arrays([pa.array(prints[linked].view(np.int64)), pa.array(roots[linked].view(np.int64))], ["a", "b"])

        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if start == end:
                    continue
                if held_key is not None and keys[start] != held_key:
                    if (out := close()) is not None:
                        yield out
                    held = []
                held_key = keys[start]
                held.append(prints[start:end])
        if held and (out := close()) is not None:
            yield out

    return link


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, shingle: int = 3, distance: int = 2, with_text: bool = True
) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; shingles of ``shingle`` words count as often as they
    occur; a text of fewer words is one shingle, one of none has fingerprint zero. Fingerprints that differ in at most
    ``distance`` (0 to 2) bits are linked.

    Documents fold into distinct fingerprints first, so a group of copies is one row. Each fingerprint gets up to 18
    keys (see ``fuzzy_keys``) of about 35 bits; those that share a key are verified bit by bit, and each points to the
    first of the ones it is linked with: links grow with the rows of a key, not with their pairs. Under a key of more
    than COMPARED fingerprints their neighbours are looked up instead of all pairs compared. Connected components of
    the links end it. The join that hands them to documents is by fingerprint; a fingerprint that very many documents
    share can be split there.

    A null text is empty. A null id is no smallest one; a component of null ids only has a null component_id. Repeated
    rows get equal results; equal ids of different texts are different documents. Columns named like an added one are
    replaced. ``with_text``: False leaves the text column out, so texts are not shuffled. Fingerprints are computed once
    and written with their rows to the shared folder.
    """
    docs = without(docs, *ADDED)
    chosen = docs.columns if with_text else [name for name in docs.columns if name.lower() != text.lower()]
    found, root = _with_roots(docs, id, text, shingle, distance, chosen)
    return found.drop(root)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", *, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group of near-duplicates (see ``near_duplicates``), one a group.

    A null id is larger than all others. Of rows with one id in one group the smallest one by its columns, in order,
    stays; so repeated rows stay once.
    """
    names = docs.columns
    columns = [f"c{k}" for k in range(len(names))]
    inner = {name.lower(): column for name, column in zip(names, columns)}
    id, text = inner[id.lower()], inner[text.lower()]
    found, root = _with_roots(docs.toDF(*columns), id, text, shingle, distance, columns)
    first = found.where(F.col(id).eqNullSafe(F.col("component_id")))
    # ids that come twice in a group are few or none; only their rows are aggregated
    crowded = cut(first.groupBy(root).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(root).alias(root + "_")))
    if crowded.isEmpty():
        return first.select(*columns).toDF(*names)
    same = F.col(root) == F.col(root + "_")
    least = first.join(crowded, same, "left_semi").groupBy(root).agg(F.min(F.struct(*columns)).alias("row"))
    alone = first.join(crowded, same, "left_anti").select(*columns)
    return alone.unionByName(least.select("row.*")).toDF(*names)


def _with_roots(docs: DataFrame, id: str, text: str, shingle: int, distance: int, chosen: list[str]) -> tuple[DataFrame, str]:
    """The chosen columns of ``docs``, the added ones, and the group's root fingerprint, whose column is named second."""
    if not 0 <= distance <= 2:
        raise ValueError("distance: 0 to 2 bits")
    value, root, least, node = unused(docs, "print_", "root_", "least_", "node_")
    source = stored(fingerprints(docs, value, text, shingle).select(*[quoted(name) for name in chosen], value))
    known = cut(source.groupBy(value).agg(F.min(quoted(id)).alias(least)))

    keys = known.select(value).mapInArrow(tidied(_keyed), "key long, print long")
    links = keys.repartition("key").sortWithinPartitions("key", "print").mapInArrow(tidied(_linker(distance)), "a long, b long")
    roots = connected_components(links.distinct()).select(F.col("node").alias(node), F.col("root").alias(root))
    rooted = known.join(roots, F.col(value) == F.col(node), "left").select(value, least, F.coalesce(root, value).alias(root))
    smallest = rooted.groupBy(F.col(root).alias(node)).agg(F.min(least).alias("component_id"))
    found = rooted.join(smallest, F.col(root) == F.col(node)).select(F.col(value).alias(node), root, "component_id")
    digits = F.lower(F.lpad(F.hex(value), 16, "0")).alias("fingerprint")
    joined = source.join(found, F.col(value) == F.col(node))
    return joined.select(*[quoted(name) for name in chosen], digits, "component_id", root), root
