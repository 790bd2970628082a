"""Cutting many texts at once into the words of a byte-level vocabulary, and counting each distinct word once.

The rule that splits a text is the public one of byte-level BPE vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. It is applied with array operations:
words start where the class of the code points changes, with the exceptions the rule makes for blanks and contractions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import regex

BLANK, LETTER, NUMBER, OTHER = range(4)
#: Code points worked on at a time; a longer text is cut where a word starts whatever stands before.
PIECE = 250_000


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.r_[np.arange(0xD800), np.arange(0xE000, 0x110000)]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for match in regex.finditer(pattern, text):
            table[points[match.start() : match.end()]] = kind
    return table


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices at which words start. points: code points of texts one after another; first: whether a text starts there."""
    n = len(points)
    kind = _classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    begins = np.flatnonzero(run)
    ends = np.append(begins[1:], n)
    blank = kind[begins] == BLANK
    # a run of blanks that is not the end of its text gives its last blank away
    inner = blank & (ends < n)
    inner[inner] = ~first[ends[inner]]
    last = ends[inner] - 1
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # contractions: an apostrophe that starts a word, is alone in its run, and stands before certain letters
    alone = np.flatnonzero((kind[begins] == OTHER) & (ends - begins == 1) & (points[begins] == 39) & start[begins])
    at = begins[alone]
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    one = points[at + 1]
    has_two = at + 2 < n
    two = np.where(has_two, points[np.minimum(at + 2, n - 1)], 0)
    two[first[np.minimum(at + 2, n - 1)]] = 0
    r, v, l, e = map(ord, "rvle")
    long = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
    short = np.isin(one, [ord(x) for x in "stmd"])
    start[at[short | long] + 1] = False
    for found, length in ((at[short], 2), (at[long], 3)):
        after = found + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that are split into words alike alone and together."""
    begin = 0
    while len(text) - begin > PIECE:
        cut = _safe_cut(text, begin + PIECE)
        if cut is None:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:] if begin else text


def _safe_cut(text: str, start: int) -> int | None:
    """A place from start on where a single blank stands between two letters: a word starts there."""
    match = regex.compile(r"(?<=\p{L})(?= \p{L})").search(text, start)
    return match.start() if match else None


class WordTable:
    """Distinct words seen so far, each with a number; a worker keeps it from batch to batch, up to a size."""

    def __init__(self, special: Iterable[str] = ()):
        self.special = tuple(sorted(special, key=len, reverse=True))  # the longest that fits is taken
        self.numbers: dict[str, int] = {}

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts in order, and for each word the index of its text."""
        groups: list[list[tuple[int, str, bool]]] = [[]]
        size = 0
        for at, text in enumerate(texts):
            for part, special in self._parts(text):
                if size >= PIECE:
                    groups.append([])
                    size = 0
                groups[-1].append((at, part, special))
                size += len(part)
        found = [_hashed_words(group) for group in groups if group]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        spans = [np.concatenate([x[k] for x in found]) for k in range(1, 6)]
        bounds = np.cumsum([len(x[1]) for x in found])
        return self._lookup([x[0] for x in found], bounds, *spans[:4]), spans[4]

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        if not any(word in text for word in self.special):
            for part in pieces(text):
                if part:
                    yield part, False
            return
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
            if part in self.special:
                yield part, True
            elif part:
                for piece in pieces(part):
                    yield piece, False

    def _lookup(
        self, blocks: list[str], bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray
    ) -> np.ndarray:
        codes, distinct = pd.factorize(keys)
        sample = np.zeros(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first word of each code
        same = (checks == checks[sample[codes]]) & (ends - starts == (ends - starts)[sample[codes]])
        others = np.flatnonzero(~same)  # words that share a hash with another one

        def word(at: np.ndarray) -> list[str]:
            block = np.searchsorted(bounds, at, side="right").tolist()
            return [blocks[k][a:b] for k, a, b in zip(block, starts[at].tolist(), ends[at].tolist())]

        known = self.numbers
        numbers = np.fromiter((known.setdefault(x, len(known)) for x in word(sample)), np.int64, len(sample))[codes]
        for i, x in zip(others.tolist(), word(others)):
            numbers[i] = known.setdefault(x, len(known))
        return numbers


def _hashed_words(group: list[tuple[int, str, bool]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text of (index, part, is special) triples; starts, ends, two hashes and indices of its words."""
    text = "".join(part for _, part, _ in group)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(part) for _, part, _ in group), np.int64, len(group))
    offsets = np.r_[0, np.cumsum(lengths)]
    first = np.zeros(len(points), bool)
    first[offsets[:-1]] = True
    starts = word_starts(points, first)
    for k, (_, _, special) in enumerate(group):
        if special:
            starts = starts[(starts <= offsets[k]) | (starts >= offsets[k + 1])]
    ends = np.append(starts[1:], len(points))
    part = np.searchsorted(offsets, starts, side="right") - 1
    owner = np.fromiter((at for at, _, _ in group), np.int64, len(group))[part]
    return text, starts, ends, *_hashes(points, starts, ends), owner


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.empty(size + 1, np.uint64)
    power[0] = 1
    power[1:] = base
    inverse = np.empty(size + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = pow(base, -1, 1 << 64)
    return np.cumprod(power), np.cumprod(inverse)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial hashes of each word, by differences of running sums."""
    size = 1 << max(20, int(len(points)).bit_length())
    found = []
    values = points.astype(np.uint64) + np.uint64(1)
    for base, factor in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407)):
        power, inverse = _powers(size, base)
        mixed = values * np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed * power[: len(points)], out=sums[1:])
        found.append((sums[ends] - sums[starts]) * inverse[starts])
    return found[0], found[1]


class WordIds:
    """Token ids of words: every distinct word is encoded once by ``encode``, which takes a list of new words."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], special: Iterable[str] = (), most: int = 500_000):
        """most: distinct words after which the table starts anew."""
        self.encode, self.special, self.most = encode, tuple(special), most
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable(self.special)
        self.flat = np.empty(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.table.numbers) > self.most:
            self._clear()
        numbers, owner = self.table.split(texts)
        fresh = list(islice(self.table.numbers, len(self.at) - 1, None))
        if fresh:
            encoded = self.encode(fresh)
            self.flat = np.concatenate([self.flat, *encoded])
            self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in encoded])]
        counts = self.at[numbers + 1] - self.at[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[numbers] - (ends - counts), counts) + np.arange(total)]
        words = np.searchsorted(owner, np.arange(len(texts) + 1))  # each text's first word
        bounds = np.r_[0, ends][words].tolist()
        for begin, end in zip(bounds, bounds[1:]):
            yield ids[begin:end]
