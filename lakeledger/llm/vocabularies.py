"""What the operators expect of a byte-level BPE file in the JSON form of the tokenizers library."""

from __future__ import annotations

import json


def check_splitting(path: str) -> dict:
    """The file's content; an error unless it cuts texts into words by the rule that ``words`` is built for.

    That is the byte-level rule with its own pattern and no added space, no normalizer, and added tokens that match as
    they stand, without taking blanks around them or asking for word borders.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    rule = content.get("pre_tokenizer") or {}
    if rule.get("type") != "ByteLevel" or not rule.get("use_regex", True) or rule.get("add_prefix_space", True):
        raise ValueError(f"{path}: texts are not split by the byte-level rule without an added space")
    if content.get("normalizer"):
        raise ValueError(f"{path}: texts are normalized before they are split")
    for token in content.get("added_tokens", []):
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
            raise ValueError(f"{path}: added token {token['content']!r} does not match as it stands")
    return content


def check_merging(path: str) -> None:
    """As ``check_splitting``; an error too unless words become ids by merges alone, from an entry for every byte."""
    model = check_splitting(path)["model"]
    if model.get("type", "BPE") != "BPE":
        raise ValueError(f"{path}: the model is {model['type']}, not BPE")
    for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"):
        if model.get(name):
            raise ValueError(f"{path}: {name} is not part of the merging rule that is built")
    if sum(len(word) == 1 for word in model["vocab"]) < 256:
        raise ValueError(f"{path}: some bytes have no entry of their own")
