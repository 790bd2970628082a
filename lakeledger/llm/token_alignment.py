"""Alignment of the tokens of two vocabularies, by anchors at tokens that are marked with a space.

Both vocabularies write a space in front of a word into the word's first token. Where a token of each starts with a space at
the same byte, and the tokens before end there too, the text is cut: what lies between two such anchors is a window, a
tuple of ids of each vocabulary. Windows are few and come again and again, so each is aligned once.

A task numbers the windows of the text it holds and keeps documents as numbers of windows; how many documents hold a pair
of ids comes back to it once for each distinct pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .support import give_back, grouped, quoted, stored, text_or_empty, tidied
from .words import WordIds, _powers

ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Bytes of text worked on together (arrays take about 65 times as much for a moment, and workers share an executor), and
#: bytes of text or distinct windows after which a chunk ends.
TOGETHER, CHUNK, WINDOWS = 500_000, 32_000_000, 200_000
#: Distinct words and distinct segments a worker remembers.
MOST = 250_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

ROWS = {"chunk": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
        "groups_sha256": pa.string(), "windows": pa.binary(), "times": pa.binary(), "pairs": pa.binary(), "docs": pa.binary(),
        "bounds": pa.binary()}


# --- the two vocabularies ------------------------------------------------------------------------------------


class Tokens:
    """Bytes of all tokens of a vocabulary one after another, and what is asked of each."""

    def __init__(self, values: list[bytes]):
        self.length = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(self.length) - self.length
        self.octets = np.frombuffer(b"".join(values), np.uint8)
        self.spaced = np.fromiter((x[:1] == b" " for x in values), bool, len(values))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after another."""
        return self.octets[_spread(self.start[ids], self.length[ids])]


def check_byte_vocabulary(path: str) -> None:
    """Raises an error unless the file splits texts by the byte-level rule and changes nothing before it."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    rule = content.get("pre_tokenizer") or {}
    expected = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    if not expected or content.get("normalizer"):
        raise ValueError("vocabulary: its rule to split or normalize texts is not the byte-level one")


@lru_cache(maxsize=2)
def _byte_vocabulary(path: str) -> tuple[WordIds, Tokens]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True  # their strings in a text are plain text

    def encode(words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    letters = byte_letters()
    vocabulary = tokenizer.get_vocab()
    values = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        values[k] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
    return WordIds(encode, most=MOST), Tokens(values)


class Numbers(dict):
    """Gives each key that is asked for the next number."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class SegmentIds:
    """Ids of texts by a SentencePiece vocabulary: each distinct run of spaces with the word behind it is encoded once.

    A piece holds a space mark at its start only (or is nothing but marks), so no merge crosses the start of a run.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in pieces):
            raise ValueError("vocabulary: a piece holds a space mark behind another character")
        self.mark = self.model.piece_to_id("▁")
        values = [
            bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)
        ]
        self.tokens = Tokens(values)
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbers()
        self.flat = np.empty(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each of which starts with the space that the vocabulary adds, and how many each has."""
        if len(self.numbers) > MOST:
            self._clear()
        numbers = self.numbers
        number_of = numbers.__getitem__
        found = []
        for text in texts:
            segments = re.findall(" +[^ ]*", text)
            found.append(np.fromiter(map(number_of, segments), np.int64, len(segments)))
        known = len(self.at) - 1
        if len(numbers) > known:
            fresh = list(islice(numbers, known, None))
            encoded = self.model.encode([x[1:] for x in fresh], num_threads=1)
            encoded = [[self.mark] if x == " " else ids for x, ids in zip(fresh, encoded)]
            self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(encoded), np.int32)]
            self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in encoded])]
        number = np.concatenate(found) if found else np.empty(0, np.int64)
        sizes = self.at[number + 1] - self.at[number]
        ends = np.cumsum(sizes)
        ids = self.flat[_spread(self.at[number], sizes)]
        counts = np.diff(np.r_[0, ends][np.cumsum([0, *map(len, found)])])
        return ids, counts


@lru_cache(maxsize=2)
def _piece_vocabulary(path: str) -> SegmentIds:
    return SegmentIds(path)


# --- windows -------------------------------------------------------------------------------------------------


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of spans that start at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def _written(size: int) -> list[Tokens]:
    """Ids below ``size`` in decimals, with what follows an id: another one of its side, the other side, another group."""
    return [Tokens([b"%d%b" % (k, mark) for k in range(size)]) for mark in (b",", b"|", b";")]


class Aligned:
    """The links and groups of windows one after another; each window has the same bytes on both sides.

    Every byte offset at which a token ends closes the overlap of one token of each side, and no two overlaps of the same
    tokens exist: so links are ends, and groups are ends of both.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_tokens: Tokens, b_tokens: Tokens, ends: np.ndarray):
        """ends: of windows, in tokens of ``a``."""
        end_a, end_b = np.cumsum(a_tokens.length[a]), np.cumsum(b_tokens.length[b])
        marks = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.uint8)
        marks[end_a] = 1
        marks[end_b] |= 2
        place = np.flatnonzero(marks)
        kind = marks[place]
        in_a, in_b = (np.cumsum(kind & side > 0) - (kind & side > 0) for side in (1, 2))
        self.pairs = a[in_a].astype(np.int64) << 32 | b[in_b].astype(np.int64)
        last = np.searchsorted(place, end_a[ends - 1])
        self.n_links = np.diff(np.r_[0, last + 1])
        self.n_groups = np.diff(np.r_[0, np.cumsum(kind == 3)[last]])
        # tokens by group, side and order: within a group the a tokens come first
        shared = place[kind == 3]
        group = np.r_[np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)]
        order = np.argsort(group, kind="stable")
        side, group = (order >= len(a)).astype(np.int8), group[order]
        mark = np.zeros(len(order), np.int8)
        mark[:-1][side[1:] != side[:-1]] = 1
        mark[np.r_[np.flatnonzero(group[1:] != group[:-1]), len(order) - 1] if len(order) else []] = 2
        ids = np.r_[a, b][order]
        tables = _written(1 << int(max(len(a_tokens.length), len(b_tokens.length)) - 1).bit_length())
        width = len(tables[0].length)
        coded = ids.astype(np.int64) + mark.astype(np.int64) * width
        size = np.concatenate([x.length for x in tables])[coded]
        shift = np.cumsum([0, *(len(x.octets) for x in tables[:-1])])
        start = np.concatenate([x.start + k for x, k in zip(tables, shift.tolist())])[coded]
        written = np.concatenate([x.octets for x in tables])[_spread(start, size)].tobytes()
        tokens = np.cumsum(np.bincount(np.searchsorted(shared[np.cumsum(self.n_groups) - 1], shared[group]), minlength=len(ends)))
        stops = np.cumsum(size)[tokens - 1].tolist() if len(ends) else []
        self.groups = [written[x : y - 1] for x, y in zip([0, *stops], stops)]


class Numbered:
    """Numbers of distinct 64-bit keys by the order in which they come, in two arrays that are sorted by key."""

    def __init__(self, kind: type):
        self.keys, self.numbers, self.size = np.empty(0, kind), np.empty(0, np.int32), 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, each of which is given once."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        if len(self.keys):
            old = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        numbers = np.empty(len(keys), np.int64)
        numbers[old] = self.numbers[at[old]]
        fresh = np.flatnonzero(~old)
        numbers[fresh] = self.size + np.arange(len(fresh))
        fresh = fresh[np.argsort(keys[fresh])]
        self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        self.numbers = np.insert(self.numbers, at[fresh], numbers[fresh])
        self.size += len(fresh)
        return numbers

    def in_order(self) -> np.ndarray:
        """The keys by number."""
        return self.keys[np.argsort(self.numbers)]


class Windows:
    """The distinct windows of a chunk by their tuples of ids, each aligned once, and the distinct pairs they link."""

    def __init__(self, a: Tokens, b: Tokens):
        self.tokens = (a, b)
        self.known, self.pairs = Numbered(np.uint64), Numbered(np.int64)
        self.groups: list[bytes] = []
        empty = np.empty(0, np.int64)
        self.n_groups, self.linked, self.docs, self.bounds = empty, empty, empty, np.zeros(1, np.int64)
        #: The ids of the windows on both sides, and where each window starts.
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def numbered(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The numbers of windows, given ids and each window's first place among them."""
        spans = [(ids, at, np.diff(np.r_[at, len(ids)])) for ids, at in ((a, at_a), (b, at_b))]
        key = np.zeros(len(at_a), np.uint64)
        for (ids, start, size), base in zip(spans, BASES):
            power, inverse = _powers(1 << max(20, len(ids).bit_length()), base)
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(31)
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(mixed * power[: len(ids)], out=sums[1:])
            key = (key ^ (key >> np.uint64(29))) * np.uint64(base) + (sums[start + size] - sums[start]) * inverse[start]
        codes, distinct = pd.factorize(key)
        sample = np.zeros(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first window of each code
        before = len(self.groups)
        numbers = self.known(distinct)
        fresh = numbers >= before
        self._add([(ids, start[sample[fresh]], size[sample[fresh]]) for ids, start, size in spans])
        numbers = numbers[codes]
        same = np.ones(len(codes), bool)
        for (ids, start, size), held, begin in zip(spans, self.ids, self.starts):
            like = np.diff(begin)[numbers] == size
            same &= like
            places = np.repeat(np.where(like, begin[numbers] - start, 0), size) + np.arange(len(ids))
            unlike = held[np.minimum(places, len(held) - 1)] != ids
            same &= ~np.logical_or.reduceat(unlike, start)
        others = np.flatnonzero(~same)  # windows that share a hash only: each is a window of its own
        if len(others):
            numbers[others] = len(self.groups) + np.arange(len(others))
            self._add([(ids, start[others], size[others]) for ids, start, size in spans])
            self.known.size += len(others)
        return numbers

    def _add(self, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Aligns new windows."""
        if not len(spans[0][1]):
            return
        new = [ids[_spread(start, size)] for ids, start, size in spans]
        found = Aligned(*new, *self.tokens, np.cumsum(spans[0][2]))
        for k, (ids, (_, _, size)) in enumerate(zip(new, spans)):
            self.ids[k] = np.r_[self.ids[k], ids]
            self.starts[k] = np.r_[self.starts[k], self.starts[k][-1] + np.cumsum(size)]
        codes, distinct = pd.factorize(found.pairs)
        self.linked = np.r_[self.linked, self.pairs(distinct)[codes]]
        self.bounds = np.r_[self.bounds, self.bounds[-1] + np.cumsum(found.n_links)]
        self.n_groups = np.r_[self.n_groups, found.n_groups]
        self.groups += found.groups

    def count(self, owner: np.ndarray, number: np.ndarray) -> None:
        """Counts a document for each pair that its windows, of distinct (owner, number), link."""
        sizes = np.diff(self.bounds)[number]
        pair = self.linked[_spread(self.bounds[number], sizes)]
        held = np.sort(np.repeat(owner, sizes) * self.pairs.size + pair)
        held = held[np.r_[True, held[1:] != held[:-1]][: len(held)]] % max(self.pairs.size, 1)
        counted = np.bincount(held, minlength=self.pairs.size)
        counted[: len(self.docs)] += self.docs
        self.docs = counted


def _window_starts(a: np.ndarray, b: np.ndarray, a_tokens: Tokens, b_tokens: Tokens, text_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The tokens of each side at which windows start, for texts of equal bytes on both sides one after another."""
    sizes_a, sizes_b = a_tokens.length[a], b_tokens.length[b]
    start_a, start_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    # a start is an end of the token before; 1 and 2: a token of a or b starts there with a space
    marks = np.zeros(int(sizes_a.sum()) + 1, np.uint8)
    marks[start_a[a_tokens.spaced[a]]] = 1
    marks[start_b[b_tokens.spaced[b]]] |= 2
    marks[text_starts] = 3
    return np.flatnonzero(marks[start_a] == 3), np.flatnonzero(marks[start_b] == 3)


# --- the steps -----------------------------------------------------------------------------------------------


def _squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _expanded(blob: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _agree(flat: np.ndarray, counts: np.ndarray, tokens: Tokens, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For which texts the tokens' bytes are those expected; sizes: bytes of each text."""
    owner = np.repeat(np.arange(len(sizes)), counts)
    given = np.bincount(owner, tokens.length[flat], len(sizes)).astype(np.int64)
    good = given == sizes
    octets = tokens.joined(flat[good[owner]])
    wanted = expected[np.repeat(good, sizes)]
    bad = np.bincount(np.repeat(np.arange(int(good.sum())), sizes[good])[octets != wanted], minlength=int(good.sum())) > 0
    good[np.flatnonzero(good)[bad]] = False
    return good


def _align_group(texts: list[str | None], words: WordIds, a_tokens: Tokens, segments: SegmentIds, windows: Windows) -> dict[str, list]:
    """The columns of some texts' rows; windows become known to ``windows``."""
    n = len(texts)
    filled = [k for k, text in enumerate(texts) if text]
    spaced = [" " + texts[k] for k in filled]
    parts = list(words(spaced))
    a_counts = np.fromiter(map(len, parts), np.int64, len(parts))
    a = np.concatenate(parts) if parts else np.empty(0, np.int32)
    b, b_counts = segments(spaced)
    encoded = [x.encode() for x in spaced]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    expected = np.frombuffer(b"".join(encoded), np.uint8)
    good = _agree(a, a_counts, a_tokens, expected, sizes) & _agree(b, b_counts, segments.tokens, expected, sizes)
    out = {
        "n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64),
        "groups_sha256": [""] * n, "windows": [b""] * n, "times": [b""] * n,
    }
    rows = np.array(filled, np.int64)[good]
    if not len(rows):
        return out
    a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
    out["n_a"][rows], out["n_b"][rows] = a_counts[good], b_counts[good]
    text_starts = np.cumsum(sizes[good]) - sizes[good]
    at_a, at_b = _window_starts(a, b, a_tokens, segments.tokens, text_starts)
    number = windows.numbered(a, b, at_a, at_b)
    text_ends = np.cumsum(a_counts[good])
    owner = np.searchsorted(text_ends, at_a, side="right")
    for name, values in (("n_groups", windows.n_groups), ("n_links", np.diff(windows.bounds))):
        out[name][rows] = np.bincount(owner, values[number], len(rows)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
    listed, groups = number.tolist(), windows.groups
    wide = len(windows.groups)
    held, times = np.unique(owner * wide + number, return_counts=True)
    holder, held = held // wide, held % wide
    windows.count(holder, held)
    edges = np.searchsorted(holder, np.arange(len(rows) + 1)).tolist()
    for k, row in enumerate(rows.tolist()):
        text = b";".join([groups[x] for x in listed[bounds[k] : bounds[k + 1]]])
        out["groups_sha256"][row] = hashlib.sha256(text).hexdigest()
        out["windows"][row] = held[edges[k] : edges[k + 1]].astype("<u4").tobytes()
        out["times"][row] = times[edges[k] : edges[k + 1]].astype("<u4").tobytes()
    return out


def _aligner(kind: pa.DataType, byte_vocabulary: str, piece_vocabulary: str):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and for each chunk one with its windows and pairs."""
        words, a_tokens = _byte_vocabulary(byte_vocabulary)
        segments = _piece_vocabulary(piece_vocabulary)
        chunk = TaskContext.get().partitionId() << 24
        windows, size = Windows(a_tokens, segments.tokens), 0

        def dictionary() -> pa.RecordBatch:
            pairs = windows.pairs.in_order()
            values = {
                "chunk": chunk, "pairs": _squeezed(np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF])), "docs": _squeezed(windows.docs, "<i8"),
                "bounds": _squeezed(windows.bounds), "windows": _squeezed(windows.linked),
            }
            columns = [pa.nulls(1, kind), *[pa.array([values.get(name)], of) for name, of in ROWS.items()]]
            return pa.RecordBatch.from_arrays(columns, ["id", *ROWS])

        for group in grouped(batches, "text", TOGETHER):
            table = pa.Table.from_batches(group).combine_chunks()
            texts = table.column("text")
            out = _align_group(texts.to_pylist(), words, a_tokens, segments, windows)
            ids = table.column("id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            columns = [
                pa.array(np.full(len(ids), chunk), pa.int64()) if name == "chunk"
                else pa.array(out[name], of) if name in out else pa.nulls(len(ids), of)
                for name, of in ROWS.items()
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *ROWS])
            size += texts.nbytes
            if size > CHUNK or len(windows.groups) > WINDOWS:
                yield dictionary()
                windows, size = Windows(a_tokens, segments.tokens), 0
                chunk += 1
        if windows.groups:
            yield dictionary()

    return rows_of


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, a, b, docs): the pairs of each chunk, numbered in it."""
    for batch in batches:
        for chunk, pairs, docs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            a, b = _expanded(pairs).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), chunk)), pa.array(np.arange(len(a), dtype=np.int32)), pa.array(a.astype(np.int32)),
                 pa.array(b.astype(np.int32)), pa.array(_expanded(docs, "<i8"))],
                ["chunk", "pair", "a", "b", "docs"],
            )


def _summed(kept: list[str]):
    def sums(rows: pa.Table, counts: pa.Table) -> pa.Table:
        """A chunk's documents with the sums over their links of the pairs' counts."""
        is_dictionary = rows.column("pairs").is_valid()
        dictionary = rows.filter(is_dictionary)
        docs = rows.filter(rows.column("pairs").is_null())
        sums = [[0] * docs.num_rows, [0] * docs.num_rows]
        if dictionary.num_rows:
            bounds, linked = (_expanded(dictionary.column(x)[0].as_py()).astype(np.int64) for x in ("bounds", "windows"))
            order = counts.column("pair").to_numpy()
            of_window = []
            for name in ("best", "count"):
                by_pair = np.zeros(len(order), np.int64)
                by_pair[order] = counts.column(name).to_numpy().astype(np.int64)
                total = np.r_[0, np.cumsum(by_pair[linked])]
                of_window.append(total[bounds[1:]] - total[bounds[:-1]])
            held, repeated = (docs.column(name).to_pylist() for name in ("windows", "times"))
            for k, (blob, number) in enumerate(zip(held, repeated)):
                at, n = np.frombuffer(blob, "<u4"), np.frombuffer(number, "<u4").astype(np.int64)
                for kind in (0, 1):
                    sums[kind][k] = int((of_window[kind][at] * n).sum())
        give_back(every=8)
        columns = [docs.column(x) for x in kept] + [pa.array(x, pa.int64()) for x in sums]
        return pa.Table.from_arrays(columns, [*kept, "n_best", "count_sum"])

    return sums


def align_tokens(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): each text's tokens by two vocabularies, aligned.

    A: a space and the text by ``byte_vocabulary`` (tokenizers library, byte-level); B: the text by ``piece_vocabulary``
    (sentencepiece, which adds the space). Strings of special tokens are plain text. Byte offsets at which tokens of both
    end cut the tokens into groups; tokens whose bytes overlap are linked. The count of a pair of ids is the number of
    documents that hold it linked. n_best: links whose count is the highest that their A id has, ties included;
    count_sum: counts over all links; groups_sha256: of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or whose tokens' bytes are not those of space and text, have zeros and ``''``. Rows of
    equal or null id are documents of their own; no other column of ``docs`` reaches the result.

    Texts are not shuffled: a task numbers windows and pairs in chunks of a bounded amount of text, and its rows (a few
    bytes for each distinct window of a document) are written to the shared folder. Pairs are counted in their chunk
    first; a pair of every document is one row a chunk, and an A id has no more pairs than B has ids.
    """
    check_byte_vocabulary(byte_vocabulary)
    kind = docs.schema[id].dataType
    types = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(x, types[of]) for x, of in ROWS.items()]])
    source = docs.select(quoted(id).alias("id"), text_or_empty(text).alias("text"))
    arrow = source.select("id").limit(0).toArrow().schema.field(0).type
    rows = stored(source.mapInArrow(tidied(_aligner(arrow, byte_vocabulary, piece_vocabulary)), schema))

    dictionaries = rows.where("pairs IS NOT NULL").select("chunk", "pairs", "docs")
    pairs = dictionaries.mapInArrow(_pairs_of, "chunk long, pair int, a int, b int, docs long")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    best = F.max("count").over(Window.partitionBy("a"))
    counts = counts.select("a", "b", "count", (F.col("count") == best).alias("best"))
    returned = pairs.join(counts, ["a", "b"]).select("chunk", "pair", "count", "best")

    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    held = rows.select(*kept, "chunk", "windows", "times", "pairs", "bounds")
    result = T.StructType([rows.schema[x] for x in kept] + [T.StructField(x, T.LongType()) for x in ("n_best", "count_sum")])
    found = held.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(_summed(kept), result)
    return found.select(F.col("id").alias(id), *ADDED)
