"""Quality rules and the mixture against plain versions, with references over all documents."""

import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from lakeledger.llm import mixing, quality
from lakeledger.llm.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"


def measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    classes, left = [], text
    for _, pattern in quality.CLASSES:
        shorter = regex.sub(pattern, "", left)
        classes.append(len(left) - len(shorter))
        left = shorter
    classes.append(len(left))
    return counts, classes, Counter(x for x in words if x in quality.COMMON_WORDS)


def divergence(p, q):
    def half(a, b):
        return a * math.log2(2 * a / (a + b)) if a > 0 else 0.0

    return math.sqrt(min(1.0, max(0.0, sum((half(a, b) + half(b, a)) / 2 for a, b in zip(p, q)))))


def test_quality_rules(spark, documents):
    measured = {id_: (lang, *measure(text)) for id_, text, lang, _ in documents}
    classes, words, total = defaultdict(lambda: [0] * 7), defaultdict(Counter), Counter()
    for lang, counts, kinds, common in measured.values():
        classes[lang] = [a + b for a, b in zip(classes[lang], kinds)]
        words[lang] += common
        total[lang] += counts[0]
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    found = {row.doc_id: row for row in quality.quality_rules(docs).collect()}
    rejected = 0
    for id_, (lang, counts, kinds, common) in measured.items():
        row = found[id_]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        by_class = by_word = None
        bare = 0
        if sum(kinds) - kinds[1] >= 200:
            by_class = divergence([x / sum(kinds) for x in kinds], [x / sum(classes[lang]) for x in classes[lang]])
        if counts[0] >= 50:
            names = sorted(words[lang])
            p, q = [common[x] / counts[0] for x in names], [words[lang][x] / total[lang] for x in names]
            by_word = divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            bare = divergence([*[0] * len(q), 1], [*q, 1 - sum(q)])
        for name, wanted in (("class_distance", by_class), ("word_distance", by_word)):
            assert (row[name] is None) == (wanted is None)
            assert wanted is None or row[name] == pytest.approx(wanted, abs=1e-9)
        kept = not failed and (by_class or 0) <= 0.25 and (by_word or 0) <= 0.45
        kept = kept and (bare <= 0 or by_word <= bare * (0.98 if counts[0] < 120 else 0.85))
        assert (row.base_failed, row.kept) == (failed, kept)
        rejected += not failed and not kept
    assert rejected > 0


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    )
    rows = quality.quality_rules(docs.where("quality = 1")).where("not base_failed").collect()
    assert len(rows) > 200 and all(row.kept for row in rows)


def fill(budget, children):
    """(capacity, weight) by name: what each gets if shares that do not fit are dealt out again among the rest."""
    got, open_ = {}, dict(children)
    while open_:
        whole = sum(weight for _, weight in open_.values())
        full = [name for name, (cap, weight) in open_.items() if cap <= budget * weight / whole]
        if not full:
            return got | {name: math.floor(budget * weight / whole) for name, (_, weight) in open_.items()}
        for name in full:
            got[name] = open_.pop(name)[0]
            budget -= got[name]
    return got


def test_budgets_fill_siblings_before_ancestors(spark, rows):
    leaves = [("a", "x", 100), ("a", "y", 1000), ("b", "x", 50), ("b", "z", 60), ("c", "x", 5000)]
    weights = [("top", "a", 5.0), ("top", "b", 3.0), ("top", "c", 2.0), ("low", "a/x", 4.0)]
    df = spark.createDataFrame(leaves, "top string, low string, tokens long")
    w = spark.createDataFrame(weights, "level string, key string, weight double")
    for total in (0, 100, 900, 3000, 10_000):
        found = {(r.top, r.low): r.budget for r in mixing.leaf_budgets(df, w, ["top", "low"], total).collect()}
        caps = {"a": 1100, "b": 110, "c": 5000}
        by_top = fill(min(total, 6210), {k: (caps[k], {"a": 5, "b": 3, "c": 2}[k]) for k in caps})
        wanted = {}
        for top, budget in by_top.items():
            own = {low: (n, 4.0 if (top, low) == ("a", "x") else 1.0) for t, low, n in leaves if t == top}
            wanted |= {(top, low): x for low, x in fill(budget, own).items()}
        assert found == wanted


def test_budgets_of_odd_weights_and_names(spark):
    def budgets(leaves, weights, total):
        df = spark.createDataFrame(leaves, "top string, low string, tokens long")
        w = spark.createDataFrame(weights, "level string, key string, weight double")
        return sorted(((r.top, r.low, r.tokens, r.budget) for r in mixing.leaf_budgets(df, w, ["top", "low"], total).collect()), key=str)

    # what a leaf of weight 0 cannot give goes to others, below it and beside its parent
    leaves = [("a", "x", 1000), ("a", "y", 1000), ("b", "x", 1000)]
    assert budgets(leaves, [("low", "a/x", 0.0)], 2000) == [("a", "x", 1000, 0), ("a", "y", 1000, 1000), ("b", "x", 1000, 1000)]
    assert budgets(leaves, [("low", "a/x", 0.0)], 1200) == [("a", "x", 1000, 0), ("a", "y", 1000, 600), ("b", "x", 1000, 600)]
    assert budgets(leaves, [("top", "a", 0.0)], 2000) == [("a", "x", 1000, 0), ("a", "y", 1000, 0), ("b", "x", 1000, 1000)]
    assert [row[3] for row in budgets(leaves, [("top", "a", 0.0), ("top", "b", 0.0)], 2000)] == [0, 0, 0]
    # names with slashes are nodes of their own, also where their plain paths are one
    slashes = [("a/b", "c", 100), ("a", "b/c", 100), ("a\\", "b", 100)]
    assert budgets(slashes, [], 150) == sorted(((top, low, n, 50) for top, low, n in slashes), key=str)
    assert {row[0]: row[3] for row in budgets(slashes, [("top", "a\\/b", 0.0)], 150)} == {"a/b": 0, "a": 75, "a\\": 75}
    # null and the empty name are one node, rows of one leaf are added up
    assert budgets([("a", None, 100), ("a", "", 100), ("a", "x", 300), ("a", "x", 100)], [], 300) == [("a", "", 200, 150), ("a", "x", 400, 150)]
    assert budgets([("a", None, None)], [("top", "a", None)], 10) == [("a", None, 0, 0)]
    for faulty in ([("top", "a", 1.0), ("top", "a", 1.0)], [("top", "a", -1.0)], [("low", "a/x", float("nan"))]):
        with pytest.raises(ValueError):
            budgets(leaves, faulty, 100)


def test_a_mixture_gives_its_whole_budget_beside_zero_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x/"[i // 2 % 2], "t" * 40) for i in range(400)], "doc_id long, top string, low string, text string")
    weights = spark.createDataFrame([("low", "a/x", 0.0), ("top", "b", 3.0)], "level string, key string, weight double")
    rows = mixing.mix(docs, weights, ["top", "low"], 2600).collect()
    assert sum(row.take_tokens for row in rows) == 2600 and len({row.doc_id for row in rows}) == len(rows)
    taken = {}
    for row in rows:
        taken[row.top, row.low] = taken.get((row.top, row.low), 0) + row.take_tokens
    assert taken == {("a", "/"): 650, ("b", "x"): 975, ("b", "/"): 975}


def test_mixture_takes_seeded_prefixes(spark, documents):
    import hashlib

    from lakeledger.llm.queries import MIXTURE_EPOCHS, MIXTURE_LEVELS, MIXTURE_SEED, MIXTURE_SHARE, domain_of, mixture_weights

    rows = QUERIES["op7_source_mixing"](spark, DIRECTORY).collect()
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").withColumn("domain", domain_of("source"))
    size = {id_: -(-len(text.encode()) // 4) for id_, text, *_ in documents}
    leaf = {row.doc_id: (row.domain, row.lang, row.source) for row in docs.collect()}
    tokens = Counter()
    for id_, n in size.items():
        tokens[leaf[id_]] += n
    frame = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "domain string, lang string, source string, tokens long")
    total = int(sum(size.values()) * MIXTURE_SHARE)
    budgets = mixing.leaf_budgets(frame, mixture_weights(spark), MIXTURE_LEVELS, total, MIXTURE_EPOCHS).collect()
    wanted = []
    for row in budgets:
        left, epoch = row.budget, 0
        mine = [id_ for id_ in size if leaf[id_] == tuple(row[:3])]
        while left > 0:
            for id_ in sorted(mine, key=lambda x: hashlib.md5(f"{MIXTURE_SEED}:{epoch}:{x}".encode()).hexdigest()):
                if left > 0:
                    wanted.append((id_, epoch, min(left, size[id_])))
                    left -= min(left, size[id_])
            epoch += 1
    assert sorted((row.doc_id, row.epoch, row.take_tokens) for row in rows) == sorted(wanted)
    assert total - 200 < sum(row.take_tokens for row in rows) <= total
