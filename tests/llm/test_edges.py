"""Every document operator on nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeledger.llm import bpe, edit_fingerprints, mixing, quality, simhash, suffix_dedup, token_counts, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def mixed(docs):
    weights = docs.sparkSession.createDataFrame([("lang", "en", 2.0)], "level string, key string, weight double")
    return mixing.mix(docs, weights, ["lang", "source"], share=0.6, max_epochs=2)


OPERATORS = {
    "repeats": (suffix_dedup.remove_repeats, suffix_dedup.ADDED),
    "bpe": (lambda docs: bpe.encode_documents(docs, BPE), bpe.ADDED),
    "fingerprints": (edit_fingerprints.edit_fingerprints, ("fingerprint",)),
    "simhash": (simhash.near_duplicates, simhash.ADDED),
    "one_of_each": (simhash.one_of_each, ()),
    "mixing": (mixed, mixing.ADDED),
    "quality": (quality.quality_rules, quality.ADDED),
    "counts": (lambda docs: token_counts.token_counts(docs, PIECES), token_counts.ADDED),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(odd, name):
    operator, added = OPERATORS[name]
    found = operator(odd)
    kept = [x for x in odd.columns if x not in added]
    assert found.columns == kept + list(added)
    rows = found.collect()
    if name not in ("mixing", "one_of_each"):
        assert len(rows) == odd.count()
    others = [x for x in kept if x not in ("text", "n_chars")]
    wanted = {tuple(row) for row in odd.select(*[F.col(f"`{x}`") for x in others]).collect()}
    assert {tuple(row[x] for x in others) for row in rows} <= wanted


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(odd, name):
    operator, _ = OPERATORS[name]
    assert operator(odd.where("doc_id = -7")).count() == 0


def test_no_documents_for_files_and_circles(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write_token_files(nothing, BPE, end=2)
    assert files.count() == 0 and token_files.read_token_files(files).count() == 0
    assert edit_fingerprints.edited_likeness(nothing).count() == 0
    assert edit_fingerprints.fingerprint_groups(edit_fingerprints.edit_fingerprints(nothing)).count() == 0


def test_null_and_repeated_rows_of_each(odd):
    left = suffix_dedup.remove_repeats(odd).collect()
    by = {(row.doc_id, row["a.b"]): row for row in left}
    # a null id is the smallest: what it has goes from all others; equal ids leave each other alone
    assert by[None, "dot 2"].n_removed == 0
    assert by[1, "dot 0"].text == by[1, "dot 1"].text == ""
    assert by[5, "dot 7"].n_removed == 0 and by[6, "dot 8"].n_removed == by[6, "dot 8"].n_bytes > 100_000
    assert by[None, "dot 3"].text is None and by[None, "dot 3"].n_bytes == 0
    near = {(row.doc_id, row["a.b"]): row for row in simhash.near_duplicates(odd).collect()}
    assert near[None, "dot 2"].component_id == near[1, "dot 0"].component_id == 1
    assert near[None, "dot 3"].component_id == 2 and near[3, "dot 5"].fingerprint == "0" * 16
    assert near[6, "dot 8"].component_id == 5
    one = simhash.one_of_each(odd)
    assert sorted(row.doc_id for row in one.collect()) == [1, 1, 2, 5, 7, 8]
    judged = {row["a.b"]: row for row in quality.quality_rules(odd).collect()}
    assert judged["dot 3"].n_words == 0 and judged["dot 3"].base_failed and not judged["dot 3"].kept


def test_odd_documents_in_files_and_circles(odd):
    rows = token_files.read_token_files(token_files.write_token_files(odd, BPE, end=2)).collect()
    assert len(rows) == odd.count()
    rows.sort(key=lambda row: row.start)
    assert [row.start for row in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert rows[0].doc_id is None and rows[-1].doc_id == 8
    near = edit_fingerprints.edited_likeness(odd).collect()
    assert len(near) == odd.count()
    assert all(0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1 for row in near)
