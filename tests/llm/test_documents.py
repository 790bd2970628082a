"""Document operators against brute-force versions on the smallest table."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeledger.llm import edit_fingerprints, simhash, suffix_dedup, token_counts
from lakeledger.llm.bpe import Vocabulary
from lakeledger.llm.queries import QUERIES
from lakeledger.llm.token_files import pack_ids, unpack_ids
from lakeledger.llm.words import WordTable

DIRECTORY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: {row[0]: row for row in QUERIES[name](spark, DIRECTORY).collect()}


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def repeats(rows, length=50):
    """(id, bytes) rows in ascending id: for each (removed, spans, what is left), by looking at every string."""
    seen, found = set(), []
    for _, data in rows:
        covered = bytearray(len(data))
        own = [data[i : i + length] for i in range(len(data) - length + 1)]
        for i, string in enumerate(own):
            if string in seen:
                covered[i : i + length] = b"\1" * length
        seen.update(own)
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        found.append((sum(covered), spans, bytes(x for x, gone in zip(data, covered) if not gone)))
    return found


def test_suffix_dedup(run, documents):
    rows = [(id_, (text or "").encode()) for id_, text, *_ in documents]
    found = run("op1_suffix_dedup")
    for (id_, data), (removed, spans, left) in zip(rows, repeats(rows)):
        assert tuple(found[id_])[:5] == (id_, len(data), removed, spans, sha(left))
    assert sum(row.n_removed for row in found.values()) > 10_000


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes_of_random_contexts(seed):
    rng = np.random.default_rng(seed)
    contexts = list({bytes(rng.integers(97, 97 + (2 if seed % 2 else 4), rng.integers(6, 40), dtype=np.uint8)) for _ in range(60)})
    holders = rng.integers(0, 50, len(contexts))
    found = suffix_dedup.smallest_holders(contexts, holders, 6)
    for context, least in zip(contexts, found):
        wanted = [min(h for other, h in zip(contexts, holders) if context[i : i + 6] in other) for i in range(len(context) - 5)]
        assert least.tolist() == wanted


def test_hot_grams_are_dealt_out_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    rng = np.random.default_rng(3)
    common = "the passage that stands in very many documents of this small table, again and again. "
    texts = [f"{rng.integers(1 << 40)} {common} {rng.integers(1 << 40)}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row for row in suffix_dedup.remove_repeats(docs).collect()}
    for id_, (removed, spans, left) in enumerate(repeats([(k, x.encode()) for k, x in enumerate(texts)])):
        assert (found[id_].n_removed, found[id_].n_spans, found[id_].text) == (removed, spans, left.decode())


def test_byte_pair_encoding(run, documents, tokenizer):
    found = run("op2_byte_pair_encoding")
    for id_, text, *_ in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(found[id_])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(decoded))


def test_words_of_odd_texts(tokenizer):
    import random

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "a", "s", "t", "ll", "re", "ve", "'", "1", "½", "é", "漢", "!", "\t", " ", "m", "d", "R", "<|endoftext|>", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "x" * 5000, " " * 500]
    from lakeledger.llm.bpe import _encoder

    _, ids_of = _encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, ids_of(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_with_one_hash_are_told_apart(monkeypatch):
    from lakeledger.llm import words

    monkeypatch.setattr(words, "_hashes", lambda points, starts, ends: (np.zeros(len(starts), np.uint64), np.arange(len(starts)).astype(np.uint64)))
    table = WordTable()
    numbers, owner = table.split(["one two one", "two"])
    known = list(table.numbers)
    assert [known[k] for k in numbers] == ["one", " two", " one", "two"] and owner.tolist() == [0, 0, 0, 1]


def test_decoding_gives_the_text_back(documents):
    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text, *_ in documents[:20]:
        assert vocabulary.decode(np.concatenate(vocabulary.encode_words(re.findall(r"\s*\S+|\s+", text)))) == text


def test_token_files(run, documents, tokenizer):
    found, start = run("op10_token_files"), 0
    for id_, text, *_ in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(found[id_]) == (id_, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 4097])
def test_packed_ids_come_back(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << (32 if n == 7 else 17), n).astype(np.uint32)
    file = pack_ids(ids, chunk=256, bits=bits)
    assert (unpack_ids(file) == ids).all()
    for start, stop in ((0, 1), (200, 300), (n // 2, n), (n - 1, n + 5)):
        assert unpack_ids(file, max(start, 0), stop).tolist() == ids[max(start, 0) : stop].tolist()
    with pytest.raises(ValueError):
        unpack_ids(b"\0" * 40)


def greedy(word, pieces, continuing=None):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = word[at:end] if not continuing or not at else continuing + word[at:end]
            if piece in pieces and (at or not continuing or not piece.startswith(continuing)):
                break
        else:
            return -1
        at, n = end, n + 1
    return n


def test_longest_match_counts(run, documents):
    pieces = set(token_counts.read_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    found = run("op9_token_counts")
    for id_, text, *_ in documents[:60]:
        words = [b" " + word.encode() for word in WORD.findall(text or "")]
        assert tuple(found[id_])[1:] == (len(words), sum(greedy(word, pieces) for word in words), 0)


@pytest.mark.parametrize("continuing", [None, b"##"])
def test_longest_match_on_random_pieces(continuing):
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 14), dtype=np.uint8)) for _ in range(400)] + [b"ab" * 400]
    pieces = {bytes(rng.integers(97, 100, rng.integers(1, 6), dtype=np.uint8)) for _ in range(25)}
    if continuing:
        pieces = {continuing + x if k % 2 else x for k, x in enumerate(sorted(pieces))}
    automaton = token_counts.MatchAutomaton(sorted(pieces), continuing)
    counts = automaton.counts(words)
    assert counts.tolist() == [greedy(word, pieces, continuing) for word in words]
    assert (counts == -1).any() and (counts > 1).any()


def test_edit_fingerprints(run, documents):
    found = run("op4_edit_fingerprints")
    order = documents[::-1]
    for k, (id_, text, *_) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (edit_fingerprints.fingerprints([x])[0] for x in (text, edited, following))
        row = found[id_]
        assert (row.n_chars, row.edited_sha256, row.fingerprint, row.edited_fingerprint) == (len(text), sha(edited), own, other)
        assert (row.near_edited, row.near_next) == (edit_fingerprints.likeness(own, other), edit_fingerprints.likeness(own, after))
    assert np.median([row.near_edited for row in found.values()]) > 0.4 > 0.1 > np.median([row.near_next for row in found.values()])


def test_few_edits_stay_near_and_group(spark, documents):
    rows = []
    for id_, text, *_ in documents[:60]:
        if len(text) > 400:
            rows += [(id_, text), (1000 + id_, text[:100] + "q" + text[101:300] + text[301:])]
    prints = edit_fingerprints.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {row.fingerprint: row.group for row in edit_fingerprints.fingerprint_groups(prints, 0.5).collect()}
    by_id = {row.doc_id: groups[row.fingerprint] for row in prints.collect()}
    together = [by_id[id_] == by_id[1000 + id_] for id_ in by_id if id_ < 1000]
    assert np.mean(together) > 0.9
    assert len(set(by_id.values())) > len(together) * 0.7


def bits_of(text, shingle=3):
    words = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    if not words:
        return 0
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    root = {id_: id_ for id_ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {id_: find(id_) for id_ in ids}


def test_simhash(run, documents):
    prints = {id_: bits_of(text) for id_, text, *_ in documents}
    wanted = components(prints)
    for id_, row in run("op6_simhash").items():
        assert (row.fingerprint, row.component_id) == (f"{prints[id_]:016x}", wanted[id_])
    assert len(set(wanted.values())) < len(wanted)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for errors in (1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in words], np.uint64)
        held = []
        for values in (words, words ^ flips):
            keys, rows = simhash.fuzzy_keys(values)
            sets = [set() for _ in words]
            for key, row in zip(keys.tolist(), rows.tolist()):
                sets[row].add(key)
            held.append(sets)
        assert all(a & b for a, b in zip(*held))


@pytest.mark.parametrize("compared", [4, 10_000])
def test_links_under_one_key_by_pairs_and_by_neighbours(monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = np.random.default_rng(5)
    prints = np.unique(np.array([sum(1 << int(b) for b in rng.choice(12, 3)) for _ in range(60)] + [(1 << 60) | (1 << 61)], np.uint64))
    wanted = components({int(x): int(x) for x in prints})
    assert prints[simhash._roots(prints, 2)].tolist() == [wanted[int(x)] for x in prints]
