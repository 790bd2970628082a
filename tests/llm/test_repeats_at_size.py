"""Removal of repeated passages: what is sorted and what leaves a chunk, as the text grows."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lakeledger.llm import suffix_dedup

LENGTH = 50


def removed(texts):
    """For each text the bytes covered by strings of earlier ones, by looking at every string."""
    seen, found = set(), []
    for text in texts:
        covered = bytearray(len(text))
        own = [text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)]
        for i, string in enumerate(own):
            if string in seen:
                covered[i : i + LENGTH] = b"\1" * LENGTH
        seen.update(own)
        found.append(bytes(covered))
    return found


def chunk_of(texts, chunk=0, first=0):
    ids = pa.array(range(first, first + len(texts)), pa.int64())
    return pa.table({"c0": ids, "id": ids, "body": pa.array([x.decode() for x in texts]), "chunk": pa.array([chunk] * len(texts), pa.int32())})


def placed(chunks):
    grams = pa.concat_tables([suffix_dedup._grams_of(1, LENGTH, 1)(x) for x in chunks])
    shared = suffix_dedup._shared(grams)
    own = [shared.filter(pc.equal(shared["chunk"], k)) for k in range(len(chunks))]
    return [suffix_dedup._contexts_of(1, LENGTH, 1)(x, y) for x, y in zip(chunks, own)]


def covered_by(tables, texts, rows_of):
    """The bytes of each text that the spans in these tables cover. rows_of: the first text of each chunk."""
    found = [bytearray(len(x)) for x in texts]
    for table, name in tables:
        for chunk, blob in zip(table["chunk"].to_pylist(), table[name].to_pylist()):
            for row, start, stop in zip(*(x.tolist() for x in suffix_dedup._unpacked(blob))):
                found[rows_of[chunk] + row][start:stop] = b"\1" * (stop - start)
    return [bytes(x) for x in found]


def texts_with(rng, common, n):
    word = lambda: bytes(rng.integers(97, 123, 40, dtype=np.uint8))
    return [word() + common + word() for _ in range(n)]


@pytest.mark.parametrize("chunks", [1, 3])
def test_only_contexts_with_a_string_in_common_are_sorted(monkeypatch, chunks):
    rng = np.random.default_rng(7)
    phrase, passage = b"a phrase of thirty-six bytes at most", b"a passage that is longer than fifty bytes, so a string of it may repeat. "
    texts = texts_with(rng, phrase, 60) + texts_with(rng, passage, 6) + texts_with(rng, b"", 10)
    texts = [texts[k] for k in rng.permutation(len(texts))]
    cut = [len(texts) * k // chunks for k in range(chunks + 1)]
    tables = placed([chunk_of(texts[a:b], k, a) for k, (a, b) in enumerate(zip(cut, cut[1:]))])
    given, sort = [], suffix_dedup.smallest_holders
    monkeypatch.setattr(suffix_dedup, "smallest_holders", lambda contexts, *rest: given.extend(contexts) or sort(contexts, *rest))
    table = pa.concat_tables(tables)
    decided = pc.less(table["block"], 0)
    spans = [suffix_dedup._spans_of(LENGTH)(table.filter(x)) for x in (decided, pc.invert(decided))]
    assert covered_by([(x, "spans") for x in spans], texts, cut) == removed(texts)
    assert given and len(set(given)) == len(given)
    assert not any(phrase in x for x in given)


def test_texts_of_few_letters():
    rng = np.random.default_rng(11)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 40) * 3, dtype=np.uint8)) * 3 for _ in range(30)]
    texts += [texts[3] + b"xyz" + texts[5], b"ab" * 200, b"ba" * 90, b"a" * 300, b"a" * 51]
    tables = placed([chunk_of(texts[:15], 0, 0), chunk_of(texts[15:], 1, 15)])
    table = pa.concat_tables(tables)
    decided = pc.less(table["block"], 0)
    spans = [suffix_dedup._spans_of(LENGTH)(table.filter(x)) for x in (decided, pc.invert(decided))]
    # rows of a chunk are in the order of id, as the texts are
    assert covered_by([(x, "spans") for x in spans], texts, [0, 15]) == removed(texts)


def test_rows_between_chunks_and_blocks_follow_the_text():
    def rows(gb):
        total = gb << 30
        chunk, block = suffix_dedup._sizes(total)
        return (total / chunk) * (total / block) / gb

    assert rows(1) == (1 << 30) / suffix_dedup.CHUNK * ((1 << 30) / suffix_dedup.BLOCK)
    assert rows(4) <= 1.01 * rows(1)
    assert rows(12) <= 2 * rows(1)
    assert suffix_dedup._sizes(0) == (suffix_dedup.CHUNK, suffix_dedup.BLOCK)


def test_numbers_come_back():
    for columns in ([[], [], []], [[-1 << 63, 5, (1 << 63) - 1], [], [7]], [[0], [1], [2]]):
        arrays = [np.array(x, np.int64) for x in columns]
        assert [x.tolist() for x in suffix_dedup._unpacked(suffix_dedup._packed(*arrays))] == columns
