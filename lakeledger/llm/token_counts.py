"""Token counts by greedy longest match in linear time, without building pieces."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import quoted, text_or_empty, unused, without

ADDED = ("n_words", "n_tokens", "n_unknown")
NOWHERE = -1


class MatchAutomaton:
    """A trie of pieces with failure links; each link carries how many pieces it pops.

    ``pieces``: what words are cut into, as bytes. With ``continuing`` (such as b"##") pieces with that prefix match
    after a word's start only, all others at its start only; without, every piece matches everywhere. From a node
    without a fitting child the failure link leads to the node of what is left after the pieces popped, so each byte is
    read once. A word that no pieces cover counts as one unknown token.
    """

    def __init__(self, pieces: Iterable[bytes], continuing: bytes | None = None):
        children: list[dict[int, int]] = [{}, {}] if continuing else [{}]
        self.start, self.inside = 0, 1 if continuing else 0
        final = {}
        for piece in pieces:
            node = self.start
            if continuing and piece.startswith(continuing):
                node, piece = self.inside, piece[len(continuing) :]
            if not piece:
                continue
            for byte in piece:
                step = children[node].get(byte)
                if step is None:
                    step = len(children)
                    children[node][byte] = step
                    children.append({})
                node = step
            final[node] = True
        n = len(children)
        self.fail = np.full(n, NOWHERE, np.int32)
        self.popped = np.zeros(n, np.int32)
        queue = deque(range(self.inside + 1))
        fail, popped = self.fail.tolist(), self.popped.tolist()
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if node in final:
                    fail[node], popped[node] = self.inside, 1
                    continue
                count, back = popped[parent], fail[parent]
                while back != NOWHERE and byte not in children[back]:
                    count, back = count + popped[back], fail[back]
                if back != NOWHERE:
                    fail[node], popped[node] = children[back][byte], count
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        # what the links pop from a node until the inner root; NOWHERE where they do not lead there
        self.rest = np.full(n, NOWHERE, np.int32)
        self.rest[[self.start, self.inside]] = 0
        known = self.rest.tolist()
        for node in range(n):
            path, at = [], node
            while at != NOWHERE and known[at] == NOWHERE:
                path.append(at)
                at = fail[at]
            value = known[at] if at != NOWHERE else NOWHERE
            for at in reversed(path):
                value = value + popped[at] if value != NOWHERE else NOWHERE
                known[at] = value
        self.rest = np.array(known, np.int32)
        # one row of 256 children for each node that has any
        inner = [node for node in range(n) if children[node]]
        self.row = np.full(n, len(inner), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.child = np.full((len(inner) + 1, 256), NOWHERE, np.int32)
        for k, node in enumerate(inner):
            self.child[k, list(children[node])] = list(children[node].values())

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; NOWHERE for a word that no pieces cover. All words advance byte by byte together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts = np.r_[0, np.cumsum(lengths)][:-1][order]
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = lengths[order]
        node = np.full(len(words), self.start, np.int32)
        count = np.zeros(len(words), np.int32)
        longest = int(lengths[0]) if len(words) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for j in range(longest):
            m = int(active[j])
            if m < 16:  # few long words: one by one
                for k in range(m):
                    node[k], count[k] = self._walk(data[starts[k] + j : starts[k] + lengths[k]].tobytes(), int(node[k]), int(count[k]))
                break
            byte = data[starts[:m] + j]
            here = node[:m]
            step = np.where(here == NOWHERE, NOWHERE, self.child[self.row[here], byte])
            stuck = np.flatnonzero((step == NOWHERE) & (here != NOWHERE))
            while len(stuck):
                count[stuck] += self.popped[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                stuck = stuck[node[stuck] != NOWHERE]
                step[stuck] = self.child[self.row[node[stuck]], byte[stuck]]
                stuck = stuck[step[stuck] == NOWHERE]
            node[:m] = step
        rest = np.where(node == NOWHERE, NOWHERE, self.rest[node])
        result = np.empty(len(words), np.int32)
        result[order] = np.where(rest == NOWHERE, NOWHERE, count + rest)
        return result

    def _walk(self, word: bytes, node: int, count: int) -> tuple[int, int]:
        for byte in word:
            while node != NOWHERE and self.child[self.row[node], byte] == NOWHERE:
                count, node = count + int(self.popped[node]), int(self.fail[node])
            if node == NOWHERE:
                break
            node = int(self.child[self.row[node], byte])
        return node, count


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


class WordCounter:
    """Counts of words, each distinct word matched once; forgets all after ``most`` words."""

    def __init__(self, automaton: MatchAutomaton, before: bytes, most: int = 2_000_000):
        self.automaton, self.before, self.most = automaton, before, most
        self.numbers, self.known = _Numbers(), np.empty(0, np.int32)

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        if len(self.numbers) > self.most:
            self.numbers, self.known = _Numbers(), np.empty(0, np.int32)
        seen = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            seen.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        fresh = list(self.numbers)[len(self.known) :]
        if fresh:
            self.known = np.r_[self.known, self.automaton.counts([self.before + word for word in fresh])]
        found = [self.known[numbers] for numbers in seen]
        unknown = [int((counts == NOWHERE).sum()) for counts in found]
        tokens = [int(np.abs(counts).sum(dtype=np.int64)) for counts in found]
        return [len(x) for x in seen], tokens, unknown


@lru_cache(maxsize=4)
def _counter(path: str, continuing: bytes | None, before: bytes) -> WordCounter:
    return WordCounter(MatchAutomaton(read_pieces(path), continuing), before)


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a vocabulary file: lines of base64 and rank (.tiktoken), or one piece a line."""
    with open(path, "rb") as file:
        lines = file.read().splitlines()
    if path.endswith(".tiktoken"):
        return [base64.b64decode(line.split()[0]) for line in lines if line]
    return [line for line in lines if line]


def token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", continuing: bytes | None = None, before: bytes = b" "
) -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown of each whole text.

    Words are runs of anything but ASCII blanks; ``before`` is put before each, as vocabularies mark a word's start.
    A word's tokens are the pieces of the greedy longest match; a word that no pieces cover is one unknown token.
    ``vocabulary`` is the path of a file of pieces on every machine. No shuffle; a worker keeps the automaton and the
    counts of words it has seen, up to a fixed number. A null or blank text has no words. Repeated rows count alike.
    Columns named like an added one are replaced.
    """
    docs = without(docs, *ADDED)
    (body,) = unused(docs, "body_")
    width = len(docs.columns)
    added = [T.StructField(name, T.LongType()) for name in ADDED]
    inner = T.StructType([T.StructField(f"c{k}", field.dataType) for k, field in enumerate([*docs.schema.fields, *added])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary, continuing, before)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = counter(part.column(width).to_pylist())
                columns = [*part.columns[:width], *(pa.array(x, pa.int64()) for x in found)]
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    source = docs.select(*[quoted(name).alias(f"c{k}") for k, name in enumerate(docs.columns)], text_or_empty(text).alias(body))
    names = [*docs.columns, *ADDED]
    return source.mapInArrow(count, inner).select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(names)])
