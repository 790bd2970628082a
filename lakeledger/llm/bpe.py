"""Byte-pair encoding of whole texts and back, by an index of pair occurrences."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import grouped, quoted, text_or_empty, tidied, unused, without
from .vocabularies import check_merging
from .words import WordIds

ADDED = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
#: Bytes of text encoded together: their new words share one pair index. Workers share an executor with its heap.
TOGETHER = 1_000_000
#: Distinct words a worker remembers, from one task and stage to the next.
MOST = 250_000


def byte_letters() -> dict[str, int]:
    """The public one-letter names of bytes in byte-level vocabularies: printable bytes are themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        as_bytes = {word: bytes(letters[x] for x in word) for word in content["model"]["vocab"]}
        ids = content["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.bytes_of = {ids[word]: value for word, value in as_bytes.items()}
        self.bytes_of.update({number: word.encode() for word, number in self.special.items()})
        self.of_byte = np.zeros(256, np.int64)
        for number, value in self.bytes_of.items():
            if len(value) == 1:
                self.of_byte[value[0]] = number
        pairs = [x.split(" ") if isinstance(x, str) else x for x in content["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no merge joins it."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. All positions of a pair are merged at once, pairs in ascending rank."""
        if not words:
            return []
        data = [word.encode("utf-8", "surrogatepass") for word in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(lengths)
        symbols = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        n = len(symbols)
        # neighbours by position; -1 outside of the word
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enter the pairs that start at these places."""
            ranks = self.rank(symbols[places], symbols[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = [0, *cuts.tolist()] if len(ranks) else []
            for begin, end in zip(firsts, [*firsts[1:], len(ranks)]):
                rank = int(ranks[begin])
                if rank in index:
                    index[rank].append(places[begin:end])
                else:
                    index[rank] = [places[begin:end]]
                    heapq.heappush(active, rank)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            left, right = self.left[rank], self.right[rank]
            found = index.pop(rank)
            at = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
            following = after[at]
            live = (symbols[at] == left) & (following >= 0)
            live[live] = symbols[following[live]] == right
            at = at[live]
            if len(at) > 1:
                at = at[np.r_[True, at[1:] != at[:-1]]]
            if left == right and len(at) > 1:
                at = at[_every_other(at, after[at])]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at] = self.made[rank]
            symbols[gone] = -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            touched = np.concatenate([before[at], at[beyond >= 0]])
            note(touched[touched >= 0])
        left_over = symbols >= 0
        counts = np.add.reduceat(left_over, ends - lengths, dtype=np.int64)
        return np.split(symbols[left_over].astype(np.int32), np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _every_other(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places of one symbol twice, those that the leftmost-first rule merges: every other one of each chain."""
    chained = np.r_[False, following[:-1] == at[1:]]
    place = np.arange(len(at))
    chain_start = np.maximum.accumulate(np.where(chained, 0, place))
    return (place - chain_start) % 2 == 0


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[Vocabulary, WordIds]:
    vocabulary = Vocabulary(path)

    def encode(words: list[str]) -> list[np.ndarray]:
        special = [k for k, word in enumerate(words) if word in vocabulary.special]
        plain = [word for word in words if word not in vocabulary.special]
        found = vocabulary.encode_words(plain)
        for k in special:
            found.insert(k, np.array([vocabulary.special[words[k]]], np.int32))
        return found

    return vocabulary, WordIds(encode, vocabulary.special, most=MOST)


def _encoding(vocabulary: str, body: str, width: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the columns of ``encode_documents`` to the first ``width`` of batches; the next, ``body``, has the texts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids_of = _encoder(vocabulary)
        names = [str(number).encode() for number in range(max(words.bytes_of) + 1)]
        for group in grouped(batches, body, TOGETHER):
            table = pa.Table.from_batches(group)
            texts = table.column(width).to_pylist()
            rows = []
            for ids in ids_of(texts):
                numbers = ids.tolist()
                joined = b",".join(map(names.__getitem__, numbers))
                decoded = b"".join(map(words.bytes_of.__getitem__, numbers)).decode("utf-8", "replace").encode()
                rows.append((ids, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [column.combine_chunks() for column in table.columns[:width]]
            if keep_ids:
                offsets = np.r_[0, np.cumsum([row[1] for row in rows])].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([row[0] for row in rows])))
            columns.append(pa.array([row[1] for row in rows], pa.int64()))
            columns += [pa.array([row[k] for row in rows], pa.string()) for k in (2, 3)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, [*(f"c{k}" for k in range(len(columns)))])

    return encode


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with the ids of each whole text, their number, and digests of the ids and of the text decoded from them.

    ``vocabulary`` is the path of a byte-level BPE in the JSON form of the tokenizers library, on every machine.
    ids array<int> (left out if not ``keep_ids``), n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    A bounded amount of text is encoded together: each new word enters an index from pairs to all their positions;
    merges apply to all positions of a pair, in ascending rank; lists of the pairs that change are extended. A worker
    remembers words it has encoded, up to a fixed number. No shuffle; memory is bounded by a fixed amount of text plus
    the longest document. Special tokens in a text become their ids; decoding keeps them. A file with another rule to
    split, normalize or merge is an error.

    A null text is empty and has no ids. Repeated rows are encoded alike. Columns named like an added one are replaced.
    """
    check_merging(vocabulary)
    docs = without(docs, *ADDED)
    (body,) = unused(docs, "body_")
    kept = docs.schema
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if keep_ids else []
    added += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    inner = T.StructType([T.StructField(f"c{k}", field.dataType) for k, field in enumerate([*kept.fields, *added])])
    source = docs.select(*[quoted(name).alias(f"c{k}") for k, name in enumerate(docs.columns)], text_or_empty(text).alias(body))
    names = [*docs.columns, *[field.name for field in added]]
    return source.mapInArrow(tidied(_encoding(vocabulary, body, len(kept), keep_ids)), inner).select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(names)])
