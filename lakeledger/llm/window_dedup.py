"""Removal of passages of words that also stand elsewhere, by anchors at the positions of a difference cover.

A difference cover modulo a period holds, for any two positions, one shift below the period that takes both into the
cover. So if only the positions of the cover (counted from the start of each document) are hashed, over ``words`` -
``period`` + 1 words, two equal windows of ``words`` words share at least one aligned anchor. Anchors that occur once lead
nowhere; around the others every window that holds the anchor is extended to its whole length and compared by 96 bits.

Documents are worked on in chunks. What leaves a chunk is aggregated in it: an anchor or window that a third of all
documents have leaves each chunk once. What comes back is one bit for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import give_back, quoted, without
from .words import _powers

ADDED = ("n_words", "n_removed", "kept_sha256")
#: Bytes of text in a chunk, and bytes of text whose hashes go into one bucket.
CHUNK, BUCKET = 4 << 20, 16 << 20
#: Bytes, and words, hashed together.
PIECE, RUN = 1 << 19, 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FACTORS = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)

HASHES = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "checks": pa.binary(), "several": pa.binary()}
BITS = {"chunk": pa.int32(), "bucket": pa.int32(), "bits": pa.binary()}


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set, in the order of its members, whose differences are all residues of ``period``."""

    def grown(chosen: list[int], missing: frozenset[int], size: int) -> list[int] | None:
        if not missing:
            return chosen
        left = size - len(chosen)
        # each further member gives two differences with every one before it
        if sum(2 * (len(chosen) + k) for k in range(left)) < len(missing):
            return None
        for new in range(chosen[-1] + 1, period):
            given = {(new - x) % period for x in chosen} | {(x - new) % period for x in chosen}
            found = grown([*chosen, new], missing - given, size)
            if found:
                return found
        return None

    size = 1
    while True:
        found = grown([0], frozenset(range(1, period)), size)
        if found:
            return tuple(found)
        size += 1


# --- hashes of words and of runs of words --------------------------------------------------------------------


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64), FACTORS[0]), FACTORS[1])
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of about PIECE bytes that end behind a blank."""
    begin = 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data) and not _IS_BLANK[data[end - 1]]:
            step = np.frombuffer(data, np.uint8, min(4096, len(data) - end), end)
            blanks = np.flatnonzero(_IS_BLANK[step])
            end += int(blanks[0]) + 1 if len(blanks) else len(step)
        yield begin, data[begin:end]
        begin = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of each word."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin, piece in _pieces(data):
        octets = np.frombuffer(piece, np.uint8)
        inside = np.r_[False, ~_IS_BLANK[octets], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        power, inverse = _powers(1 << max(19, len(octets).bit_length()), BASES[0])
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(_BYTE[octets] * power[: len(octets)], out=sums[1:])
        places.append(starts + begin)
        hashes.append(_mixed((sums[stops] - sums[starts]) * inverse[starts], FACTORS[0]))
    return np.concatenate(places), np.concatenate(hashes)


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int, kind: int) -> np.ndarray:
    """The hash of the ``length`` words from each start (ascending) on."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _powers(1 << max(19, (RUN + length).bit_length()), BASES[kind])
    for begin in range(0, len(words), RUN):
        first, last = np.searchsorted(starts, (begin, begin + RUN)).tolist()
        if first == last:
            continue
        part = _mixed(words[begin : begin + RUN + length], FACTORS[kind])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        at = starts[first:last] - begin
        out[first:last] = _mixed((sums[at + length] - sums[at]) * inverse[at], FACTORS[1])
    return out


class Chunk:
    """The texts of a chunk in an order of their own (that of their bytes), and the words of all."""

    def __init__(self, texts: pa.ChunkedArray):
        values = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(values)), key=values.__getitem__)
        self.texts = [values[k] for k in self.order]
        bounds = np.cumsum([0, *(len(x) + 1 for x in self.texts)])
        place, self.words = word_hashes(b"\n".join(self.texts) + b"\n")
        #: The first word of each text, and of the one behind the last.
        self.begin = np.searchsorted(place, bounds)
        counts = np.diff(self.begin)
        self.text_begin = np.repeat(self.begin[:-1], counts)
        self.text_end = np.repeat(self.begin[1:], counts)

    def anchors(self, words: int, period: int) -> np.ndarray:
        """The words at positions of the cover that have a whole anchor before their text ends."""
        in_cover = np.zeros(period, bool)
        in_cover[list(difference_cover(period))] = True
        at = np.arange(len(self.words))
        return np.flatnonzero(in_cover[(at - self.text_begin) % period] & (at + (words - period + 1) <= self.text_end))

    def windows_around(self, anchors: np.ndarray, words: int, period: int) -> np.ndarray:
        """The starts of all windows that hold one of the anchors at a distance below the period."""
        low = np.maximum(anchors - (period - 1), self.text_begin[anchors])
        high = np.minimum(anchors, self.text_end[anchors] - words)
        fits = high >= low
        return np.flatnonzero(_covered(low[fits], high[fits] + 1, len(self.words)))


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, stop, -1)
    return np.cumsum(depth[:-1]) > 0


class Keys:
    """Distinct (key, check) pairs in a fixed order, dealt out to buckets: the same from the same input."""

    def __init__(self, key: np.ndarray, check: np.ndarray, buckets: int):
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((check, key, bucket))
        key, check, bucket = key[order], check[order], bucket[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(key)]
        begin = np.flatnonzero(new)
        self.key, self.check, self.bucket = key[begin], check[begin], bucket[begin]
        self.count = np.diff(np.r_[begin, len(key)])
        #: The number of each pair of the input.
        self.number = np.empty(len(key), np.int64)
        self.number[order] = np.cumsum(new) - 1
        edge = np.flatnonzero(np.diff(self.bucket)) + 1
        self.spans = list(zip(np.r_[0, edge].tolist(), np.r_[edge, len(self.key)].tolist())) if len(begin) else []

    def rows(self, chunk: int, with_check: bool) -> dict[str, list]:
        out = {name: [] for name in HASHES}
        for a, b in self.spans:
            out["bucket"].append(int(self.bucket[a]))
            out["chunk"].append(chunk)
            out["keys"].append(self.key[a:b].astype("<u8").tobytes())
            out["checks"].append(self.check[a:b].astype("<u4").tobytes() if with_check else b"")
            out["several"].append(np.packbits(self.count[a:b] > 1).tobytes())
        return out

    def shared(self, bits: dict[int, bytes]) -> np.ndarray:
        """Which pairs of the input occur more than once, from the bits that came back by bucket."""
        known = np.zeros(len(self.key), bool)
        for a, b in self.spans:
            found = np.frombuffer(bits.get(int(self.bucket[a]), b""), np.uint8)
            if len(found):
                known[a:b] = np.unpackbits(found, count=b - a)
        return known[self.number]


# --- the steps -----------------------------------------------------------------------------------------------


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[name], kind) for name, kind in kinds.items()], list(kinds))


def _anchors_of(width: int, words: int, period: int, buckets: int) -> Callable:
    def anchors(docs: pa.Table) -> pa.Table:
        """The distinct anchors of a chunk by bucket."""
        chunk = Chunk(docs.column(width))
        key = run_hashes(chunk.words, chunk.anchors(words, period), words - period + 1, 0)
        found = Keys(key, np.zeros(len(key), np.uint32), buckets)
        give_back(every=8)
        return _table(found.rows(docs.column(width + 1)[0].as_py(), False), HASHES)

    return anchors


def _occurring_twice(bucket: pa.Table) -> pa.Table:
    """For each chunk's hashes in this bucket one bit: whether the hash occurs more than once in all."""
    keys = [np.frombuffer(x, "<u8") for x in bucket.column("keys").to_pylist()]
    sizes = [len(x) for x in keys]
    checks = [np.frombuffer(x, "<u4") for x in bucket.column("checks").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(bucket.column("several").to_pylist(), sizes)]
    key, twice = np.concatenate(keys), np.concatenate(several).astype(bool)
    check = np.concatenate(checks) if len(checks[0]) else np.zeros(len(key), np.uint32)
    order = np.lexsort((check, key))
    same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    parts = np.split(twice, np.cumsum(sizes)[:-1])
    out = {
        "chunk": bucket.column("chunk").to_pylist(), "bucket": bucket.column("bucket").to_pylist(),
        "bits": [np.packbits(x).tobytes() for x in parts],
    }
    give_back(every=8)
    return _table(out, BITS)


def _by_bucket(bits: pa.Table) -> dict[int, bytes]:
    return dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))


def _window_keys(chunk: Chunk, starts: np.ndarray, words: int, buckets: int) -> Keys:
    check = (run_hashes(chunk.words, starts, words, 1) >> np.uint64(32)).astype(np.uint32)
    return Keys(run_hashes(chunk.words, starts, words, 0), check, buckets)


def _windows_of(width: int, words: int, period: int, buckets: int) -> Callable:
    def windows(docs: pa.Table, bits: pa.Table) -> pa.Table:
        """The distinct windows around a chunk's shared anchors by bucket, and in a row of its own where they start."""
        if not docs.num_rows or not bits.num_rows:
            return _table({name: [] for name in HASHES}, HASHES)
        number = docs.column(width + 1)[0].as_py()
        chunk = Chunk(docs.column(width))
        at = chunk.anchors(words, period)
        key = run_hashes(chunk.words, at, words - period + 1, 0)
        shared = Keys(key, np.zeros(len(key), np.uint32), buckets).shared(_by_bucket(bits))
        starts = chunk.windows_around(at[shared], words, period)
        out = _window_keys(chunk, starts, words, buckets).rows(number, True)
        marks = np.zeros(len(chunk.words), bool)
        marks[starts] = True
        # negative: these rows pass the next step as they are, each chunk's by itself
        values = (-1 - number, number, zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes()), b"", b"")
        for name, value in zip(HASHES, values):
            out[name].append(value)
        give_back(every=8)
        return _table(out, HASHES)

    return windows


def _window_bits(bucket: pa.Table) -> pa.Table:
    if bucket.column("bucket")[0].as_py() < 0:
        return bucket.select(["chunk", "bucket", "keys"]).rename_columns(list(BITS))
    return _occurring_twice(bucket)


def _result_of(names: list[str], width: int, words: int, buckets: int, with_kept: bool) -> Callable:
    def result(docs: pa.Table, bits: pa.Table) -> pa.Table:
        """A chunk's rows with what is left of each."""
        chunk = Chunk(docs.column(width))
        n = len(chunk.words)
        covered = np.zeros(n, bool)
        known = _by_bucket(bits)
        marks = next((x for bucket, x in known.items() if bucket < 0), None)
        if marks is not None and n:
            marked = np.frombuffer(zstandard.ZstdDecompressor().decompress(marks), np.uint8)
            starts = np.flatnonzero(np.unpackbits(marked, count=n))
            twice = starts[_window_keys(chunk, starts, words, buckets).shared(known)]
            covered = _covered(twice, twice + words, n)
        counted = np.zeros((2, len(chunk.texts)), np.int64)
        digests, left = [""] * len(chunk.texts), [b""] * len(chunk.texts)
        bounds = chunk.begin.tolist()
        for k, text in enumerate(chunk.texts):
            mask = covered[bounds[k] : bounds[k + 1]]
            removed = int(mask.sum())
            split = text.split()
            kept = b" ".join(compress(split, (~mask).tolist()) if removed else split)
            target = chunk.order[k]
            counted[:, target] = len(split), removed
            digests[target] = hashlib.sha256(kept).hexdigest()
            left[target] = kept if with_kept else b""
        out = [docs.column(name) for name in names]
        if with_kept:
            was_null = docs.column(width).is_null().to_pylist()
            out.append(pa.array([None if null else x.decode() for null, x in zip(was_null, left)], pa.string()))
        out += [*(pa.array(x) for x in counted), pa.array(digests, pa.string())]
        give_back(every=8)
        return pa.Table.from_arrays(out, [f"c{k}" for k in range(len(out))])

    return result


def _schema(kinds: dict[str, pa.DataType]) -> T.StructType:
    types = {pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()])


def remove_repeated_windows(
    docs: DataFrame, text: str = "text", *, words: int = 35, period: int = 21, replace_text: bool = True
) -> DataFrame:
    """``docs`` without words of passages that stand elsewhere too: n_words, n_removed, kept_sha256 are added.

    Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D), unchanged. Every word covered by a window of
    ``words`` words whose sequence also starts anywhere else, in the same document or another, is removed; windows are
    those of the input and never cross documents, so all copies of a passage go. kept_sha256 is of the words left,
    joined by blanks. ``period``: of the difference cover; a longer one hashes fewer positions over fewer words.
    ``replace_text``: the text becomes the words left, joined by blanks; otherwise the text column is left out.

    A null text has no words and stays null. Repeated rows are each other's copies. A document of fewer words than a
    window keeps all. Columns named like an added one are replaced.

    Texts are shuffled once, by chunk, and that exchange is used three times; the other shuffles carry 8 bytes for each
    distinct anchor of a chunk, 12 for each distinct window around a shared anchor, and one bit for each on the way
    back. A worker holds a chunk or a bucket of hashes at a time. Equal rows of one input partition share a chunk. The
    sum of text lengths, which sets how many chunks and buckets there are, is all that reaches the driver.
    """
    if not 1 <= period <= words:
        raise ValueError("period: from 1 to the number of words of a window")
    docs = without(docs, *ADDED)
    total = docs.agg(F.sum(F.octet_length(quoted(text).cast("string")))).first()[0] or 0
    chunks, buckets = (max(1, -(-total // size)) for size in (CHUNK, BUCKET))
    names = [name for name in docs.columns if name.lower() != text.lower()]
    width = len(names)
    value = quoted(text).cast("string")
    dealt = F.pmod(F.xxhash64(value, F.spark_partition_id(), *[quoted(x) for x in names if _hashable(docs.schema[x].dataType)]), F.lit(chunks))
    source = docs.select(
        *[quoted(name).alias(f"c{k}") for k, name in enumerate(names)], value.alias("body"), dealt.cast("int").alias("chunk")
    )
    by_chunk = source.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_anchors_of(width, words, period, buckets), _schema(HASHES))
    shared = anchors.groupBy("bucket").applyInArrow(_occurring_twice, _schema(BITS))
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_windows_of(width, words, period, buckets), _schema(HASHES))
    twice = windows.groupBy("bucket").applyInArrow(_window_bits, _schema(BITS))
    kinds = [docs.schema[name].dataType for name in names] + [T.StringType()] * replace_text + [T.LongType()] * 2 + [T.StringType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])
    result = _result_of([f"c{k}" for k in range(width)], width, words, buckets, replace_text)
    found = by_chunk.cogroup(twice.groupBy("chunk")).applyInArrow(result, schema)
    found = found.toDF(*names, *([text] if replace_text else []), *ADDED)
    original = [name for name in docs.columns if replace_text or name in names]
    return found.select(*[quoted(name if name in names else text) for name in original], *ADDED)


def _hashable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))
