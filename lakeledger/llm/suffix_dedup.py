"""Removal of passages that an earlier document has, by interval expansion on a Burrows-Wheeler transform.

A string of ``length`` bytes that two documents share has, in both, the same smallest gram (by hash) at the same place.
Strings are therefore dealt out by that gram: a run of strings with one smallest gram, a context, goes where all
contexts of the gram go, and a gram that one document alone has goes nowhere. In each block the contexts that may have
a string of another one are suffix sorted and their common prefixes derived by breadth-first backward extension on the
transform, up to ``length``.

Documents are worked on in chunks, dealt out by a hash of id and text. What leaves a chunk is aggregated in it: a gram
or context that a third of all documents have leaves each chunk once. A chunk has a row for each block, so chunks and
blocks grow with the root of the text, as far as a worker holds them: else rows would grow with its square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import give_back, quoted, without
from .words import _powers

ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Bytes of a gram.
GRAM = 18
#: Bytes of text in a chunk, bytes of text whose grams go into one bucket, and whose contexts go into one block.
CHUNK, BUCKET, BLOCK = 4 << 20, 16 << 20, 2 << 20
#: Bytes of text from which chunks and blocks grow, and how many times they may.
GROWS, CHUNK_TIMES, BLOCK_TIMES = 1 << 30, 2, 4
#: Bytes of text whose grams are computed together, and bytes of contexts sorted together.
PIECE, SORTED = 1 << 16, 1 << 19
#: Documents with one gram beyond which its strings are dealt out one by one, each by its own hash.
HOT = 50_000
NULL_ID = np.iinfo(np.int64).min
BASE = 0x9E3779B97F4A7C15


# --- grams and contexts --------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


def _spans_hashed(sums: np.ndarray, starts: np.ndarray, length: int, inverse: np.ndarray) -> np.ndarray:
    return _mixed((sums[starts + length] - sums[starts]) * inverse[starts])


def _each(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each of several ranges, n of them."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Contexts:
    """The contexts of a group of texts: gram hash, row, and first and last string start within the row's text."""

    def __init__(self, rows: list[bytes], length: int):
        self.length = length
        found: list[tuple[np.ndarray, ...]] = []
        group: list[tuple[int, int, bytes]] = []
        size = 0
        for row, text in enumerate(rows):
            for start in range(0, max(len(text) - length + 1, 0), PIECE):
                piece = text[start : start + PIECE + length - 1]
                group.append((row, start, piece))
                size += len(piece)
                if size >= PIECE:
                    found.append(self._of(group))
                    group, size = [], 0
        if group:
            found.append(self._of(group))
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        empty = tuple(np.empty(0, kind) for kind in kinds)
        self.key, self.row, self.first, self.last = (np.concatenate(x) for x in zip(*(found or [empty])))

    def _of(self, group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        length, width = self.length, self.length - GRAM + 1
        data = np.frombuffer(b"".join(piece for *_, piece in group), np.uint8)
        n = len(data)
        lengths = np.array([len(piece) for *_, piece in group], np.int64)
        ends = np.cumsum(lengths)
        power, inverse = _powers(1 << max(19, n.bit_length()), BASE)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        # smallest gram of each string, the leftmost of equal ones: hash above, place below
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        covered = 1
        while covered * 2 <= width:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < width:
            least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
        whole = np.ones(len(least), bool)
        for end in ends.tolist():
            whole[max(end - length + 1, 0) : end] = False
        at = np.flatnonzero(whole)
        place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
        begin, stop = np.r_[0, edge], np.r_[edge, len(at)] - 1
        first, last = at[begin], at[stop]
        piece = np.searchsorted(ends, first, side="right")
        shift = np.array([start for _, start, _ in group], np.int64)[piece] - (ends - lengths)[piece]
        row = np.array([row for row, *_ in group], np.int64)[piece]
        return grams[place[begin]], row, first + shift, last + shift


def _narrow(keys: np.ndarray) -> bytes:
    """The upper 48 bits of hashes; what is only alike in them is told apart later by its bytes."""
    return np.ascontiguousarray((keys >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widened(blob: bytes) -> np.ndarray:
    full = np.zeros((len(blob) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return full.view("<u8").reshape(-1)


# --- the transform -------------------------------------------------------------------------------------------


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The stable order by (high, low), both below 2 ** 31: plain sorts of numbers that carry their places."""
    place = np.arange(len(high))
    by_low = np.sort(low << 32 | place) & 0xFFFFFFFF
    return by_low[np.sort(high[by_low] << 32 | place) & 0xFFFFFFFF]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` symbols (below 512), by prefix doubling of unsettled groups."""
    n = len(symbols)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = symbols
    keys = []
    for begin in (0, 3):
        key = padded[begin : begin + n] << 18
        key |= padded[begin + 1 : begin + 1 + n] << 9
        key |= padded[begin + 2 : begin + 2 + n]
        keys.append(key)
    order = _order(*keys)
    key = (keys[0] << 27 | keys[1])[order]
    head = np.r_[True, key[1:] != key[:-1]]
    known = 6
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while known < depth:
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_)  # places of suffixes whose group is larger than one
        if not len(at):
            break
        suffix = order[at]
        group = rank[suffix]
        following = suffix + known
        second = np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        inner = _order(group, second)
        suffix, key = suffix[inner], group[inner] << 32 | second[inner]
        order[at] = suffix
        new = np.r_[True, key[1:] != key[:-1]]
        head[at] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        known *= 2
    return order


def prefix_classes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, a number that changes where the common prefix is shorter than ``length``.

    Breadth-first backward extension: the interval of a string w on the transform is extended by every symbol c in it to
    that of cw. The end of an interval first reached at step l has a common prefix of l; so the values come in ascending
    order, and the search stops at ``length``: ends not reached have longer ones. An interval whose end is known is not
    extended again. Symbols 0 and 1 end and separate the texts; strings with them are not extended.
    """
    n = len(symbols)
    transform = symbols[order - 1].astype(np.uint16)
    back = np.argsort(transform, kind="stable").astype(np.int32)  # from a suffix to the one a symbol shorter
    forward = np.empty(n, np.int32)
    forward[back] = np.arange(n, dtype=np.int32)
    first = transform[back]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        sizes = high - low
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        inside = np.repeat(low - (ends - sizes), sizes) + np.arange(total)
        owner = np.repeat(np.arange(len(low)), sizes)
        pairs = np.sort(forward[inside].astype(np.int64) << 32 | owner)
        place, owner = pairs >> 32, pairs & 0xFFFFFFFF
        symbol = first[place]
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) + 1
        begin, stop = np.r_[0, edge], np.r_[edge, total] - 1
        new_low, new_high = place[begin], place[stop] + 1
        fresh = ~known[new_high]
        known[new_high[fresh]] = True
        keep = fresh & (symbol[begin] > 1)
        low, high = new_low[keep], new_high[keep]
        if not len(low):
            break
    return np.cumsum(known[:n])


def smallest_holders(contexts: list[bytes], holders: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context and each string of ``length`` bytes in it, the smallest holder of a context with that string."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1)
    data[ends - 1] = 1
    data[-1] = 0
    order = suffix_array(data, length)
    classes = np.empty(len(data), np.int64)
    classes[order] = prefix_classes(data, order, length)
    counts = sizes - length + 1
    bounds = np.cumsum(counts)
    at = np.repeat(ends - sizes - 1 - (bounds - counts), counts) + np.arange(int(bounds[-1]))
    kinds = classes[at]
    least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kinds, np.repeat(holders, counts))
    return np.split(least[kinds], bounds[:-1])


def may_meet(contexts: list[bytes], length: int) -> np.ndarray:
    """Whether each context may have a string of ``length`` bytes that another one has: no other can have one, by hashes."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    power, inverse = _powers(1 << max(19, len(data).bit_length()), BASE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    counts = sizes - length + 1
    hashes = _spans_hashed(sums, _each(np.cumsum(sizes) - sizes, counts), length, inverse)
    # hash above, number of the context below: equal hashes of unlike contexts are neighbours
    bits = np.uint64(len(contexts).bit_length())
    tagged = np.sort((hashes >> bits << bits) | np.repeat(np.arange(len(contexts), dtype=np.uint64), counts))
    apart = tagged[1:] ^ tagged[:-1]
    both = np.flatnonzero((apart != 0) & (apart >> bits == 0))
    found = np.zeros(len(contexts), bool)
    low = (np.uint64(1) << bits) - np.uint64(1)
    found[(tagged[both] & low).astype(np.int64)] = True
    found[(tagged[both + 1] & low).astype(np.int64)] = True
    return found


# --- the four steps ------------------------------------------------------------------------------------------


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of a chunk: the order of its rows by (id, text), their texts as bytes and their ids, both in that order."""
    texts = [x or b"" for x in table.column(width + 1).cast(pa.binary()).to_pylist()]
    ids = table.column(width).fill_null(int(NULL_ID)).to_numpy()
    order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
    return np.array(order, np.int64), [texts[k] for k in order], ids[order]


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row, united where they overlap or touch."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    wide = np.int64(int(stop.max()) + 2)
    reach = np.maximum.accumulate(row * wide + stop)
    new = np.r_[True, row[1:] * wide + start[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:], len(row)] - 1
    return row[new], start[new], reach[last] - row[new] * wide


def _squeezed(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def _expanded(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _packed(*arrays: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed for the way: their lengths, then all first bytes, all second ones, and so on."""
    planes = np.concatenate(arrays).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return _squeezed(np.array([len(arrays), *map(len, arrays)], "<i8").tobytes() + planes.tobytes())


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(_expanded(blob), np.uint8)
    lengths = data[8 : 8 + 8 * int(data[:8].view("<i8")[0])].view("<i8")
    values = np.ascontiguousarray(data[8 + 8 * len(lengths) :].reshape(8, -1).T).view("<i8").reshape(-1)
    ends = np.cumsum(lengths).tolist()
    return [values[end - n : end] for end, n in zip(ends, lengths.tolist())]


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in kinds.items()], list(kinds))


GRAMS = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "several": pa.binary()}
SHARED = {"chunk": pa.int32(), "keys": pa.binary(), "hot": pa.binary()}
#: numbers: of contexts the lower half of the gram's hash, holder and size, of their places the row, start and context; of
#: what is decided (a block below 0) row, start and stop, as in spans.
PLACED = {"block": pa.int32(), "chunk": pa.int32(), "numbers": pa.binary(), "context": pa.binary()}
SPANS = {"chunk": pa.int32(), "spans": pa.binary()}


def _tidied(work):
    """The same function over groups, giving memory back after every eighth one of a worker."""

    def of_one(table: pa.Table) -> pa.Table:
        found = work(table)
        give_back(every=8)
        return found

    def of_two(docs: pa.Table, other: pa.Table) -> pa.Table:
        found = work(docs, other)
        give_back(every=8)
        return found

    return of_one if work.__code__.co_argcount == 1 else of_two


def _schema(kinds: dict[str, pa.DataType]) -> T.StructType:
    types = {pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()])


def _grams_of(width: int, length: int, buckets: int):
    def grams(table: pa.Table) -> pa.Table:
        """The distinct grams of a chunk by bucket, and how many rows have those that several have."""
        _, texts, _ = _rows(table, width)
        contexts = Contexts(texts, length)
        order = np.argsort(contexts.key, kind="stable")
        key, row = contexts.key[order], contexts.row[order]
        new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
        new_row = new_key | np.r_[True, row[1:] != row[:-1]][: len(key)]
        begin = np.flatnonzero(new_key)
        holders = np.add.reduceat(new_row.astype(np.int64), begin) if len(begin) else np.empty(0, np.int64)
        key = key[begin]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        key, holders, bucket = key[by], holders[by], bucket[by]
        edge = np.flatnonzero(np.diff(bucket)) + 1
        out = {name: [] for name in GRAMS}
        for a, b in zip(np.r_[0, edge].tolist() if len(key) else [], np.r_[edge, len(key)].tolist()):
            several = np.flatnonzero(holders[a:b] > 1)
            out["bucket"].append(int(bucket[a]))
            out["chunk"].append(table.column(width + 2)[0].as_py())
            out["keys"].append(_narrow(key[a:b]))
            out["several"].append(np.stack([several, holders[a:b][several]]).astype("<i8").tobytes())
        return pa.Table.from_batches([_batch(out, GRAMS)])

    return grams


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk the grams of this bucket that it has and another document has too."""
    chunks = table.column("chunk").to_pylist()
    keys = [_widened(x) for x in table.column("keys").to_pylist()]
    counts = []
    for own, blob in zip(keys, table.column("several").to_pylist()):
        count = np.ones(len(own), np.int32)
        at, n = np.frombuffer(blob, "<i8").reshape(2, -1)
        count[at] = np.minimum(n, 1 << 20)
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    source = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    order = np.argsort(key, kind="stable")
    key, count, source = key[order], count[order], source[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total = np.repeat(np.add.reduceat(count.astype(np.int64), begin), np.diff(np.r_[begin, len(key)]))
    take = total > 1
    key, source, hot = key[take], source[take], total[take] > HOT
    order = np.argsort(source, kind="stable")
    key, source, hot = key[order], source[order], hot[order]
    bounds = np.searchsorted(source, np.arange(len(keys) + 1)).tolist()
    out = {name: [] for name in SHARED}
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b > a:
            out["chunk"].append(chunks[k])
            out["keys"].append(key[a:b].astype("<u8").tobytes())
            out["hot"].append(hot[a:b].tobytes())
    return pa.Table.from_batches([_batch(out, SHARED)])


def _contexts_of(width: int, length: int, blocks: int):
    def contexts(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """A chunk's contexts of shared grams by block, each once, and its spans that are decided in the chunk."""
        out = {name: [] for name in PLACED}
        if not docs.num_rows or not shared.num_rows:
            return pa.Table.from_batches([_batch(out, PLACED)])
        chunk = docs.column(width + 2)[0].as_py()
        _, texts, ids = _rows(docs, width)
        known = np.concatenate([np.frombuffer(x, "<u8") for x in shared.column("keys").to_pylist()])
        hot = np.concatenate([np.frombuffer(x, bool) for x in shared.column("hot").to_pylist()])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        found = Contexts(texts, length)
        narrow = found.key >> np.uint64(16)
        at = np.minimum(np.searchsorted(known, narrow), len(known) - 1)
        several = known[at] == narrow
        plain, heated = np.flatnonzero(several & ~hot[at]), np.flatnonzero(several & hot[at])
        # uses in ascending order of id, hot contexts string by string after the others: they have no context in common
        n = found.last[heated] - found.first[heated] + 1
        row = np.r_[found.row[plain], np.repeat(found.row[heated], n)]
        start = np.r_[found.first[plain], _each(found.first[heated], n)]
        stop = np.r_[found.last[plain], start[len(plain) :]] + length
        key = np.r_[found.key[plain], np.repeat(found.key[heated], n)]
        del found, narrow, at, several
        place: dict[bytes, int] = {}
        uses = zip(row.tolist(), start.tolist(), stop.tolist())
        number = np.fromiter((place.setdefault(texts[k][a:b], len(place)) for k, a, b in uses), np.int64, len(row))
        strings = list(place)
        del place
        # first occurrence of each context; later ones are places with its id, or covered whole
        first = np.flatnonzero(np.r_[True, number[1:] > np.maximum.accumulate(number)[:-1]][: len(number)])
        holder, key = ids[row[first]], key[first]
        for k in range(int(np.searchsorted(first, len(plain))), len(strings)):
            key[k] = int.from_bytes(hashlib.blake2b(strings[k], digest_size=8).digest(), "little")
        same = ids[row] == holder[number]
        covered = _merged(row[~same], start[~same], stop[~same])
        for name, value in zip(out, (-1 - chunk, chunk, _packed(*covered), b"")):
            out[name].append(value)
        block = ((key >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((key, block))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner = rank[number[same]]
        by = np.argsort(owner, kind="stable")
        owner, row, start = owner[by], row[same][by], start[same][by]
        block, holder = block[order], holder[order]
        key = (key[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))[order]
        edge = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(1, np.int64)
        place_edge = np.searchsorted(owner, edge).tolist()
        order, edge = order.tolist(), edge.tolist()
        for a, b, x, y in zip(edge, edge[1:], place_edge, place_edge[1:]):
            # places are in the order of their contexts: steps from one to the next are short
            numbers = _packed(key[a:b], holder[a:b], sizes[a:b], row[x:y], start[x:y], np.diff(owner[x:y], prepend=a))
            for name, value in zip(out, (int(block[a]), chunk, numbers, _squeezed(b"".join([strings[k] for k in order[a:b]])))):
                out[name].append(value)
        return pa.Table.from_batches([_batch(out, PLACED)])

    return contexts


def _spans_of(length: int):
    def spans(table: pa.Table) -> pa.Table:
        """Of a block: the spans of each chunk's contexts that a smaller id has too; spans decided before pass through."""
        out = {name: [] for name in SPANS}
        if table.num_rows and table.column("block")[0].as_py() < 0:
            return table.select(["chunk", "numbers"]).rename_columns(list(SPANS))
        place: dict[bytes, int] = {}
        number, columns, before = [], [], 0
        for packed, squeezed in zip(table.column("numbers").to_pylist(), table.column("context").to_pylist()):
            key, holder, sizes, row, start, step = _unpacked(packed)
            text, ends = _expanded(squeezed), np.cumsum(sizes)
            number += [place.setdefault(text[x:y], len(place)) for x, y in zip((ends - sizes).tolist(), ends.tolist())]
            columns.append((key, holder, row, start, before + np.cumsum(step)))
            before += len(key)
        which = np.repeat(np.arange(len(columns)), [len(x[2]) for x in columns])
        key, holder, row, start, owner = (np.concatenate(x) for x in zip(*columns))
        strings, numbers = list(place), np.array(number, np.int64)
        del place, number, columns
        keys, least = np.empty(len(strings), np.int64), np.full(len(strings), np.iinfo(np.int64).max)
        keys[numbers] = key
        np.minimum.at(least, numbers, holder)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        count = sizes - length + 1
        begin = np.cumsum(count) - count
        smallest = np.repeat(least, count)
        for part in _parts(keys, sizes, _meeting(strings, keys, sizes, length)):
            for k, found in zip(part.tolist(), smallest_holders([strings[k] for k in part.tolist()], least[part], length)):
                smallest[begin[k] : begin[k] + len(found)] = found
        # of all uses of contexts those of which a string has a smaller holder, whole or in part
        used, own = numbers[owner], holder[owner]
        some = np.minimum.reduceat(smallest, begin)[used] < own
        which, row, start, used, own = which[some], row[some], start[some], used[some], own[some]
        every = np.maximum.reduceat(smallest, begin)[used] < own
        n = count[used[~every]]
        hit = smallest[_each(begin[used[~every]], n)] < np.repeat(own[~every], n)
        first = _each(start[~every], n)[hit]
        wide = int(row.max(initial=0)) + 1
        at = which * wide + row
        at, start, stop = _merged(
            np.r_[at[every], np.repeat(at[~every], n)[hit]], np.r_[start[every], first],
            np.r_[start[every] + sizes[used[every]], first + length],
        )
        chunks = table.column("chunk").to_pylist()
        bounds = np.searchsorted(at, np.arange(len(chunks) + 1) * wide).tolist()
        for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if y > x:
                out["chunk"].append(chunks[k])
                out["spans"].append(_packed(at[x:y] - k * wide, start[x:y], stop[x:y]))
        return pa.Table.from_batches([_batch(out, SPANS)])

    return spans


def _meeting(strings: list[bytes], keys: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The contexts that may have a string of another one: none of those that are alone with their gram has."""
    order = np.argsort(keys, kind="stable")
    alike = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(strings), bool)
    for part in _parts(keys, sizes, np.sort(order[np.r_[alike, False] | np.r_[False, alike]])):
        found[part] = may_meet([strings[k] for k in part.tolist()], length)
    return np.flatnonzero(found)


def _parts(keys: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
    """Some of the contexts in parts of about SORTED bytes; contexts of one gram stay together."""
    some = some[np.argsort(keys[some], kind="stable")]
    if not len(some):
        return
    begin = np.flatnonzero(np.r_[True, keys[some][1:] != keys[some][:-1]])
    ends = np.cumsum(sizes[some] + 1)
    full = (ends[begin] - sizes[some][begin] - 1) // SORTED
    edge = begin[np.r_[True, full[1:] != full[:-1]]]
    yield from np.split(some, edge[1:])


def _result_of(names: list[str], text_at: int, width: int, with_kept: bool):
    def result(docs: pa.Table, spans: pa.Table) -> pa.Table:
        """A chunk's rows with what is left of each."""
        order, texts, _ = _rows(docs, width)
        parts = [_unpacked(x) for x in spans.column("spans").to_pylist()]
        row, start, stop = _merged(*(np.concatenate(x) for x in zip(*(parts or [(np.empty(0, np.int64),) * 3]))))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        counted = np.zeros((3, len(texts)), np.int64)
        digests, left = [""] * len(texts), [b""] * len(texts)
        for k, text in enumerate(texts):
            at, parts, removed = 0, [], 0
            for s, e in zip(start[bounds[k] : bounds[k + 1]].tolist(), stop[bounds[k] : bounds[k + 1]].tolist()):
                parts.append(text[at:s])
                removed += e - s
                at = e
            kept = b"".join([*parts, text[at:]])
            target = order[k]
            counted[:, target] = len(text), removed, bounds[k + 1] - bounds[k]
            digests[target] = hashlib.sha256(kept).hexdigest()
            left[target] = kept
        out = [docs.column(name) for name in names]
        if with_kept:
            was_null = docs.column(width + 1).is_null().to_pylist()
            strings = [None if null else x.decode("utf-8", "ignore") for null, x in zip(was_null, left)]
            out.append(pa.array(strings, pa.string()))
        out += [*(pa.array(x) for x in counted), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(out, [f"c{k}" for k in range(len(out))])

    return result


def _sizes(total: int) -> tuple[int, int]:
    """Bytes of text in a chunk and in a block, for so many in all."""
    root = math.sqrt(total / GROWS)
    return int(CHUNK * min(max(1, root), CHUNK_TIMES)), int(BLOCK * min(max(1, root), BLOCK_TIMES))


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = 50, replace_text: bool = True
) -> DataFrame:
    """``docs`` without passages that a document of smaller id has: n_bytes, n_removed, n_spans, kept_sha256 are added.

    Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed;
    strings are those of the input texts in UTF-8 and never cross documents; n_spans counts maximal removed runs.
    ``replace_text``: the text becomes what is left; a character that a cut splits is dropped, though the digest and
    counts have its bytes. Otherwise the text column is left out.

    Ids are integers. A null id is smaller than all others; rows of equal id (repeated rows too) do not remove from each
    other. A null text is empty and stays null. Columns named like an added one are replaced.

    Texts are shuffled once, by chunk, and that exchange is used three times; the other shuffles carry hashes of grams,
    contexts of shared grams, and spans. A worker holds a chunk, a bucket of hashes or a block of contexts at a time.
    The sum of text lengths, which sets how many of each there are, is all that reaches the driver.
    """
    if length <= GRAM:
        raise ValueError(f"length: more than {GRAM} bytes")
    docs = without(docs, *ADDED)
    total = docs.agg(F.sum(F.octet_length(quoted(text).cast("string")))).first()[0] or 0
    wide, deep = _sizes(total)
    chunks, buckets, blocks = (max(1, -(-total // size)) for size in (wide, BUCKET, deep))
    names = [name for name in docs.columns if name.lower() != text.lower()]
    width = len(names)
    columns = [quoted(name).alias(f"c{k}") for k, name in enumerate(names)]
    key, body, chunk = "id", "body", "chunk"
    value = quoted(text).cast("string")
    source = docs.select(
        *columns, quoted(id).cast("long").alias(key), value.alias(body),
        F.pmod(F.xxhash64(quoted(id), value, F.spark_partition_id()), F.lit(chunks)).cast("int").alias(chunk),
    )
    by_chunk = source.groupBy(chunk)
    grams = by_chunk.applyInArrow(_tidied(_grams_of(width, length, buckets)), _schema(GRAMS))
    shared = grams.groupBy("bucket").applyInArrow(_tidied(_shared), _schema(SHARED))
    placed = by_chunk.cogroup(shared.groupBy(chunk)).applyInArrow(_tidied(_contexts_of(width, length, blocks)), _schema(PLACED))
    spans = placed.groupBy("block").applyInArrow(_tidied(_spans_of(length)), _schema(SPANS))
    fields = [docs.schema[name].dataType for name in names] + [T.StringType()] * replace_text
    fields += [T.LongType()] * 3 + [T.StringType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(fields)])
    result = _result_of([f"c{k}" for k in range(width)], width + 1, width, replace_text)
    found = by_chunk.cogroup(spans.groupBy(chunk)).applyInArrow(_tidied(result), schema)
    named = [*names, *([text] if replace_text else []), *ADDED]
    found = found.toDF(*named)
    original = [name for name in docs.columns if replace_text or name in names]
    return found.select(*[quoted(name if name in names else text) for name in original], *ADDED)
