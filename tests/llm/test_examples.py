"""Chat examples with their contexts written out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakeledger.llm import chat
from lakeledger.llm.queries import INJECTION, QUERIES

DIRECTORY = "/root/testdata/sf0.001"


def segment(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_query_counts_every_example_with_its_context(spark):
    rows = spark.read.parquet(f"{DIRECTORY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    by = {-1: [("user", INJECTION), ("assistant", INJECTION)]}
    for conv, _, role, text in sorted(tuple(x) for x in rows):
        by.setdefault(conv, []).append((role, text or ""))
    found = {row.conv_id: row for row in QUERIES["op5_chat_formatting"](spark, DIRECTORY).collect()}
    assert sorted(found) == sorted(by)
    for conv, turns in by.items():
        if conv == -1:
            turns = [(role, text.replace("<|", "<|\\")) for role, text in turns]
        segments = [segment(*turn) for turn in turns]
        wanted = sum(len("".join(segments[: k + 1])) for k, (role, _) in enumerate(turns) if role == "assistant")
        assert found[conv].formatted_chars == found[conv].expanded_chars == wanted


@pytest.mark.parametrize("name", [7, None])
def test_examples_are_written_with_whole_contexts(spark, name):
    turns = [("system", "be brief")]
    for k in range(chat.BLOCK + 9):
        turns += [("user", f"question {k} <|im_end|>"), ("assistant", "" if k == 3 else f"ä reply {k} <|im_start|>")]
    turns.append(("user", "no answer"))
    df = spark.createDataFrame([(name, k, *turn) for k, turn in enumerate(turns)] + [(8, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(df)
    examples = chat.expand_examples(formatted)
    texts = {}
    for row in sorted(examples.collect(), key=lambda x: (x.example, x.position)):
        assert row.conv == name and row.position <= row.last
        text, _ = texts.get(row.example, ("", None))
        assert len(text) == row.start
        texts[row.example] = text + row.segment, (row.loss_start, row.loss_end)
    escaped = [(role, text.replace("<|im", "<|\\im")) for role, text in turns]
    replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
    assert len(texts) == len(replies) == chat.BLOCK + 9
    for example, last in enumerate(replies):
        text, (begin, stop) = texts[example]
        assert text == "".join(segment(*turn) for turn in escaped[: last + 1])
        assert text[begin:stop] == escaped[last][1]
    read = {row.conv: row for row in chat.read_examples(formatted, examples).collect()}
    loss = "".join(turns[k][1] for k in replies)
    assert (read[name].n_turns, read[name].n_examples) == (len(turns), len(replies))
    assert (read[name].loss_chars, read[name].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read[name].formatted_chars == sum(len(text) for text, _ in texts.values())
    assert (read[8].n_turns, read[8].n_examples, read[8].formatted_chars) == (1, 0, 0)
    # an example that lacks a segment of its context is seen
    short = examples.where(~((F.col("example") == 2) & (F.col("position") == 1)))
    cut = {row.conv: row for row in chat.read_examples(formatted, short).collect()}[name]
    assert cut.formatted_chars < cut.expanded_chars
