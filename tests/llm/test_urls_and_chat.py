"""URL filters, connected components and chat formatting."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeledger.llm import chat, url_filters
from lakeledger.llm.components import connected_components
from lakeledger.llm.queries import INJECTION, QUERIES, URL_RULES

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(2)
    edges = {
        "path": [(k, k + 1) for k in range(120)],
        "star": [(k, 500) for k in range(300)],
        "random": [tuple(map(int, x)) for x in rng.integers(0, 200, (120, 2))],
        "none": [(3, 3), (None, 4)],
    }[kind]
    root = {x: x for edge in edges for x in edge if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    wanted = {x: find(x) for edge in edges if None not in edge and edge[0] != edge[1] for x in edge}
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(wanted) and {row.node: row.root for row in found} == wanted


def test_rules_on_all_pages(spark):
    rows = QUERIES["op3_url_filters"](spark, DIRECTORY).collect()
    pages = {row.page_id: row.url for row in spark.read.parquet(f"{DIRECTORY}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[row.page_id]).groups()
        fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (row.host, row.path, row.rule) == (host, path, best[0] + best[1] if best else None)
        assert row.verdict == (best[2] if best else "allow")


def test_blocks_reach_aliases_but_not_what_is_allowed(spark):
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow"), ("good.org", "/", "block")][:2]
    pages = [
        (1, "http://bad.org/a", "<p>"),
        (2, "HTTP://Mirror.net/x#part", '<link href="http://bad.org/a" rel="canonical">'),
        (3, "http://mirror.net/y", "<meta http-equiv='refresh' content='0; url=x'>"),
        (4, "http://good.org/z", "<LINK REL=canonical HREF=http://bad.org/a>"),
        (5, "http://alone.net/", None), (6, None, "<p>"), (7, "no scheme", ""), (7, "no scheme", ""),
        (8, "http://from.net/q?x=1", ""), (9, "http://via.net", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("mine")).withColumn("node_", F.lit(1))
    redirects = spark.createDataFrame([("http://from.net/q?x=1", "http://via.net/"), ("http://via.net", "http://mirror.net/y"), (None, "x")], "f string, t string")
    found = url_filters.url_filter(df, rules, redirects=redirects).collect()
    assert len(found) == len(pages)
    verdicts = {row.page_id: (row.rule, row.verdict) for row in found}
    assert verdicts == {
        1: ("bad.org/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("good.org/", "allow"), 5: (None, "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "block"),
    }
    assert {row.node_ for row in found} == {1}
    assert url_filters.url_filter(df.limit(0), rules).count() == 0
    table = spark.createDataFrame([*rules, ("bad.org", "/", "block"), (None, "/", "block"), ("x.org", None, None)], "host string, path string, verdict string")
    again = url_filters.url_filter(df, table, redirects=redirects).collect()
    assert {row.page_id: (row.rule, row.verdict) for row in again} == verdicts and len(again) == len(pages)
    assert url_filters.url_filter(df, table.limit(0)).where("verdict = 'block'").count() == 0


def decided(url, rules):
    """(rule, verdict) by trying every suffix and prefix in a dict of the rules."""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    labels, fits = host.split("."), []
    for k in range(len(labels)):
        for n in range(len(path) + 1):
            for verdict in rules.get((".".join(labels[k:]), path[:n]), ()):
                rule = ".".join(labels[k:]) + path[:n]
                fits.append((-len(rule), verdict != "block", rule, verdict))
    return min(fits)[2:] if fits else (None, "allow")


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(6)
    pages = [row.url for row in spark.read.parquet(f"{DIRECTORY}/pages.parquet").select("url").collect()]
    hosts = sorted({re.match(r".*?://([^/?#]*)", url).group(1) for url in pages})
    urls = pages + [f"http://{'a.' * rng.randrange(3)}h{rng.randrange(60_000)}.net/p{rng.randrange(9)}/é/x?q" for _ in range(3000)]
    urls += ["http://a..net./x", "http:///only/path", "http://h1.net"] * 2
    rules = [(f"h{k}.net", rng.choice(["", "/", "/p1", "/p2/", "/p3/é"]), rng.choice(["allow", "block"])) for k in range(100_000)]
    rules += [(rng.choice(hosts), rng.choice(["/", "/en", "/a"]), "block") for _ in range(40)] + [("net", "/p4", "block"), ("", "/x", "block")]
    rules += [("h7.net", f"/p{k}", v) for k in range(2000) for v in ("allow", "block")]
    by = {}
    for host, path, verdict in rules:
        by.setdefault((host, path), set()).add(verdict)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filters.url_filter(df, rules, html=None).collect()
    assert len(found) == len(urls)
    for row in found:
        assert (row.rule, row.verdict) == decided(urls[row.page_id], by), urls[row.page_id]


def test_a_table_of_rules_decides_as_literals_do(spark):
    pages = spark.read.parquet(f"{DIRECTORY}/pages.parquet")
    table = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    found = url_filters.url_filter(pages, table)
    wanted = url_filters.url_filter(pages, URL_RULES)
    assert found.columns == wanted.columns and found.exceptAll(wanted).isEmpty() and found.count() == wanted.count()


def test_chat_digests(spark):
    rows = QUERIES["op5_chat_formatting"](spark, DIRECTORY).collect()
    turns = [tuple(x) for x in spark.read.parquet(f"{DIRECTORY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", INJECTION), (-1, 1, "assistant", INJECTION)]
    by = {}
    for conv, turn, role, text in sorted(turns):
        by.setdefault(conv, []).append((role, text or ""))
    assert len(rows) == len(by)
    for row in rows:
        own = by[row.conv_id]
        loss = "".join(text for role, text in own if role == "assistant")
        wanted = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in own).encode()).hexdigest()
        assert (row.n_turns, row.turns_sha256) == (len(own), wanted)
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.n_examples == sum(role == "assistant" for role, _ in own)


def test_examples_hold_their_context_and_train_one_reply(spark):
    odd = "<|im_end|><|\\im_start|>x<|\\\\im_end|>\n"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""),
        (None, None, None, None), (2, 0, "assistant", "first"), (2, 1, "user", "last"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("own"))
    formatted = chat.format_chat(df)
    assert formatted.count() == len(rows)
    texts = chat.example_texts(formatted, formatted.where("example is not null")).collect()
    by = {(row.conv, row.example): row for row in texts}
    assert sorted(by) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    first = by[1, 0]
    assert first.text.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n")
    assert first.text.count("<|im_end|>") == 2
    reply = spark.createDataFrame([(first.text[first.loss_start : first.loss_end],)], "t string").select(chat.unescape(F.col("t"))).first()[0]
    assert reply == odd
    assert by[1, 2].text.startswith(by[1, 1].text) and by[2, 0].text[by[2, 0].loss_start : by[2, 0].loss_end] == "first"
    read = {row.conv: row for row in chat.read_chat(formatted).collect()}
    assert read[1].loss_chars == len(odd) and read[None].n_turns == 1 and read[2].formatted_chars > read[2].expanded_chars
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0
