"""The manifest, aligned tokens and repeated windows against brute-force versions, and on odd rows."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeledger.llm import merkle, token_alignment, window_dedup
from lakeledger.llm.bpe import byte_letters
from lakeledger.llm.queries import BYTE_BPE, QUERIES, SPACE_PIECES

DIRECTORY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------------------------


def leaf_of(row, add=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + add, row.text]
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in values])


def hash_tree(nodes, fanout=2):
    """The root and each leaf's (before, after) siblings, level by level."""
    proofs, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for k in range(len(run)):
                for leaf in owners[start + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            held.append([leaf for owner in owners[start : start + fanout] for leaf in owner])
        nodes, owners = above, held
    return nodes[0], proofs


def brute_manifest(rows, fanout=2):
    """A (doc_id, leaf, subroot, root, proof) of each row, in any order."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row.lang].append((row.doc_id is not None, row.doc_id or 0, leaf_of(row), row.doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: hash_tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])], fanout) for lang in langs}
    root, above = hash_tree([trees[lang][0] for lang in langs], fanout)
    found = []
    for lang, up in zip(langs, above):
        subroot, proofs = trees[lang]
        for (*_, leaf, id_), proof in zip(sorted(by_lang[lang], key=lambda x: x[:3]), proofs):
            found.append((id_, leaf, subroot, root, tuple(proof + up)))
    return found


def by_text(rows):
    return sorted(rows, key=str)


def test_merkle_manifest(spark, documents):
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()
    found = {row[0]: tuple(row) for row in QUERIES["op11_merkle_manifest"](spark, DIRECTORY).collect()}
    by_id = {row.doc_id: row for row in rows}
    unverified = 0
    for id_, leaf, subroot, root, proof in brute_manifest(rows):
        is_tampered = zlib.crc32(str(id_).encode()) % 7 == 0
        folded = leaf_of(by_id[id_], 1) if is_tampered else leaf
        for before, after in proof:
            folded = sha(before, folded, after)
        assert found[id_] == (id_, leaf, subroot, root, sha(*[a + b for a, b in proof]), folded, folded == root)
        unverified += folded != root
    assert len(found) == len(rows) and 0 < unverified == sum(zlib.crc32(str(x).encode()) % 7 == 0 for x in by_id)


@pytest.mark.parametrize(("fanout", "block"), [(2, 2), (2, 8), (3, 9), (3, 1000)])
def test_blocks_and_tiers_do_not_change_proofs(spark, odd, fanout, block):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.manifest(odd, fields, fanout=fanout, block=block, carry={"own": F.col("`a.b`")})
    got = [(row.doc_id, row.leaf, row.subroot, row.root, tuple(map(tuple, row.proof))) for row in found.collect()]
    assert by_text(got) == by_text(brute_manifest(odd.collect(), fanout))
    folded = found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root"))
    assert folded.count() == 0 and found.select("own").distinct().count() == odd.count()


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    assert merkle.manifest(spark.createDataFrame([], schema), fields).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "x", None, None, None)], schema), fields).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    two = merkle.manifest(spark.createDataFrame([(1, "x", "b", None, 2), (1, "x", None, "s", 2)], schema), fields).collect()
    assert {len(row.proof) for row in two} == {1} and len({row.root for row in two}) == 1
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], schema), fields, fanout=1)


# --- tokens of two vocabularies ---------------------------------------------------------------------------------


def brute_alignment(rows):
    """For (key, text) rows the contract's columns, from the libraries' whole-text encodings."""
    first = Tokenizer.from_file(BYTE_BPE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SPACE_PIECES)
    letters = byte_letters()
    found, docs = {}, Counter()
    for key, text in rows:
        found[key] = None
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a_bytes = [bytes(letters[x] for x in first.id_to_token(k)) for k in a]
        pieces = [second.id_to_piece(k) for k in b]
        b_bytes = [bytes([int(x[3:5], 16)]) if second.is_byte(k) else x.replace("▁", " ").encode() for k, x in zip(b, pieces)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            ends = [0]
            for token in tokens:
                ends.append(ends[-1] + len(token))
            spans.append(list(zip(ends, ends[1:])))
        cuts = sorted({end for _, end in spans[0]} & {end for _, end in spans[1]})
        links, groups, low = [], [], 0
        for cut in cuts:
            in_a = [k for k, (start, end) in enumerate(spans[0]) if low <= start and end <= cut]
            in_b = [k for k, (start, end) in enumerate(spans[1]) if low <= start and end <= cut]
            groups.append(",".join(str(a[k]) for k in in_a) + "|" + ",".join(str(b[k]) for k in in_b))
            links += [
                (a[x], b[y]) for x in in_a for y in in_b
                if max(spans[0][x][0], spans[1][y][0]) < min(spans[0][x][1], spans[1][y][1])
            ]
            low = cut
        found[key] = (len(a), len(b), len(groups), links, ";".join(groups))
        docs.update(set(links))
    best = defaultdict(int)
    for (a, _), count in docs.items():
        best[a] = max(best[a], count)
    return {
        key: (0, 0, 0, 0, 0, 0, "") if x is None else
        (*x[:3], len(x[3]), sum(docs[k] == best[k[0]] for k in x[3]), sum(docs[k] for k in x[3]), sha(x[4]))
        for key, x in found.items()
    }


ODD_TEXTS = [
    None, "", " ", "  ", "a  b   c ", "▁x", "ﬁ Å é <|endoftext|> <s> x y　z\x00 \n\n  tab\t 漢字 😀  ", "  lead", "x" * 3000, "é ½ ① ​ ﻿ \r\n",
    "\n \n", "don't 'tis  I'll", "a  b   c ",
]


@pytest.mark.parametrize("small", [False, True])
def test_aligned_tokens(spark, documents, small, monkeypatch):
    if small:  # chunks and remembered segments that end after a few texts
        for name in ("TOGETHER", "CHUNK", "WINDOWS", "MOST"):
            monkeypatch.setattr(token_alignment, name, 500)
    rows = [(k, text) for k, (_, text, *_) in enumerate(documents[:: 1 if not small else 4])]
    rows = [(id_, text) for id_, text in rows if len(text or "") < 6_000] + [(-1 - k, text) for k, text in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {row[0]: tuple(row)[1:] for row in token_alignment.align_tokens(docs, BYTE_BPE, SPACE_PIECES).collect()}
    assert found == brute_alignment(rows)


def test_segments_are_encoded_as_in_whole_texts(documents):
    segments = token_alignment.SegmentIds(SPACE_PIECES)
    texts = [text for _, text, *_ in documents if text] + [x for x in ODD_TEXTS if x]
    ids, counts = segments([" " + x for x in texts])
    whole = segments.model.encode(texts)
    assert ids.tolist() == [k for x in whole for k in x] and counts.tolist() == list(map(len, whole))


def test_alignment_of_odd_rows(spark, odd):
    found = token_alignment.align_tokens(odd, BYTE_BPE, SPACE_PIECES)
    assert found.count() == odd.count() and found.where("n_a = 0 and groups_sha256 = ''").count() == 3
    assert token_alignment.align_tokens(odd.limit(0), BYTE_BPE, SPACE_PIECES).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.align_tokens(odd, public_tokenizers.path("word_bpe_49k.json"), SPACE_PIECES)


def test_keys_are_numbered_as_they_come():
    numbered, known, rng = token_alignment.Numbered(np.uint64), {}, np.random.default_rng(5)
    for _ in range(20):
        keys = rng.permutation(np.unique(rng.integers(0, 400, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        assert numbered(keys).tolist() == [known.setdefault(x, len(known)) for x in keys.tolist()]
    assert numbered.in_order().tolist() == list(known) and numbered.size == len(known)


def test_a_worker_aligns_much_text_in_little_memory(monkeypatch):
    """Workers share an executor's 3000 MB with its heap: 2 MB of rare words, which hardly share a window."""
    context = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(token_alignment, "TaskContext", context)
    rng = np.random.default_rng(11)
    letters = rng.integers(97, 123, 2_000_000, dtype=np.uint8)
    letters[rng.random(len(letters)) < 0.16] = 32
    texts = [letters[k : k + 3_000].tobytes().decode() for k in range(0, len(letters), 3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    aligned = token_alignment._aligner(pa.int64(), BYTE_BPE, SPACE_PIECES)
    assert sum(x.num_rows for x in aligned(iter([batch.slice(0, 1)]))) == 2  # vocabularies are loaded
    tracemalloc.start()
    try:
        found = sum(pc.sum(rows.column("n_links")).as_py() or 0 for rows in aligned(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 1_000_000 and most < 200e6, (found, most)


# --- windows of words -------------------------------------------------------------------------------------------


def brute_windows(texts, length):
    """For each text (words, words removed, what is left)."""
    split = [WORD.findall(text or "") for text in texts]
    seen = Counter(tuple(words[k : k + length]) for words in split for k in range(len(words) - length + 1))
    found = []
    for words in split:
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if seen[tuple(words[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        found.append((len(words), sum(gone), " ".join(word for word, out in zip(words, gone) if not out)))
    return found


def test_window_dedup(spark, documents):
    found = {row[0]: tuple(row)[1:] for row in QUERIES["op13_window_dedup"](spark, DIRECTORY).collect()}
    expected = brute_windows([text for _, text, *_ in documents], 35)
    assert found == {row[0]: (n, gone, sha(left)) for row, (n, gone, left) in zip(documents, expected)}
    assert sum(gone for _, gone, _ in found.values()) > 1000


@pytest.mark.parametrize("period", [1, 2, 5, 7])
def test_every_match_is_found_at_any_shift(spark, period, monkeypatch):
    for name in ("CHUNK", "BUCKET", "PIECE", "RUN"):
        monkeypatch.setattr(window_dedup, name, 64)
    passage = " ".join(f"p{k}" for k in range(9))
    texts = [" ".join(f"w{row}_{k}" for k in range(row)) + f"  {passage}\t" + f"tail{row}" for row in range(12)]
    texts += [passage, " ".join(passage.split()[:6]), "a b " * 20, "long" * 5000 + " " + passage, None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {row.doc_id: row for row in window_dedup.remove_repeated_windows(docs, words=7, period=period).collect()}
    for k, (n, gone, left) in enumerate(brute_windows(texts, 7)):
        row = found[k]
        assert (row.n_words, row.n_removed, row.kept_sha256) == (n, gone, sha(left))
        assert row.text == (None if texts[k] is None else left)


def test_windows_of_odd_rows(spark, odd):
    found = window_dedup.remove_repeated_windows(odd)
    assert found.columns == [*odd.columns, *window_dedup.ADDED] and found.count() == odd.count()
    same = brute_windows([row.text for row in odd.collect()], 35)
    assert Counter((row.n_words, row.n_removed, row.kept_sha256) for row in found.collect()) == Counter((n, m, sha(x)) for n, m, x in same)
    assert window_dedup.remove_repeated_windows(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        window_dedup.remove_repeated_windows(odd, words=5, period=6)


@pytest.mark.parametrize("period", range(1, 32))
def test_difference_covers(period):
    cover = window_dedup.difference_cover(period)
    assert {(x - y) % period for x in cover for y in cover} == set(range(period))
    assert len(cover) * (len(cover) - 1) + 1 >= period and len(cover) <= 1.5 * period**0.5 + 2
