"""Vocabulary files that differ from the built rule are refused; added tokens match longest first."""

import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeledger.llm.bpe import _encoder, encode_documents
from lakeledger.llm.token_files import _library_ids, encoded

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def variant(folder, name, change):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    change(content)
    path = folder / f"{name}.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    return str(path)


def token(id_, content, **flags):
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    return {"id": id_, "content": content} | plain | flags


SPLITTING = {
    "space": lambda c: c["pre_tokenizer"].update(add_prefix_space=True),
    "pattern": lambda c: c["pre_tokenizer"].update(use_regex=False),
    "other": lambda c: c.update(pre_tokenizer={"type": "Whitespace"}),
    "none": lambda c: c.update(pre_tokenizer=None),
    "normal": lambda c: c.update(normalizer={"type": "NFC"}),
    "strip": lambda c: c["added_tokens"].append(token(50257, "<a>", lstrip=True)),
}
MERGING = {
    "ignore": lambda c: c["model"].update(ignore_merges=True),
    "ending": lambda c: c["model"].update(end_of_word_suffix="</w>"),
    "bytes": lambda c: c["model"]["vocab"].pop("Ā"),
}


@pytest.mark.parametrize("name", sorted(SPLITTING))
def test_another_splitting_rule_is_refused(spark, tmp_path, name):
    path = variant(tmp_path, name, SPLITTING[name])
    docs = spark.createDataFrame([(1, "x")], SCHEMA)
    with pytest.raises(ValueError):
        encode_documents(docs, path)
    with pytest.raises(ValueError):
        encoded(docs, path, 2)


@pytest.mark.parametrize("name", sorted(MERGING))
def test_another_merging_rule_is_refused(spark, tmp_path, name):
    with pytest.raises(ValueError):
        encode_documents(spark.createDataFrame([(1, "x")], SCHEMA), variant(tmp_path, name, MERGING[name]))


def test_added_tokens_match_longest_first(tmp_path):
    more = [token(50257, "<a>"), token(50258, "<a><b>"), token(50259, "<a><b>c d", special=False), token(50260, "b><")]
    path = variant(tmp_path, "added", lambda c: c["added_tokens"].extend(more))
    library = Tokenizer.from_file(path)
    texts = ["<a><b>c d", "<a><b>c  d", " <a> <a><a><b> x", "<b><a>", "<|endoftext|><a>y<a><b>", "b><a><b>c d<a", ""]
    for ids_of in (_encoder(path)[1], _library_ids(path)):
        found = [ids.tolist() for ids in ids_of(texts)]
        assert found == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_a_shorter_list_of_merges_gives_the_ids_of_the_library(tmp_path, documents):
    def shorten(content):
        content["model"]["merges"] = content["model"]["merges"][:3000]

    path = variant(tmp_path, "short", shorten)
    library = Tokenizer.from_file(path)
    texts = [text or "" for _, text, *_ in documents]
    for ids_of in (_encoder(path)[1], _library_ids(path)):
        for text, ids in zip(texts, ids_of(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
