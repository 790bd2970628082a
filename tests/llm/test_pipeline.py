"""The pipeline against brute-force versions of its stages, each on what the one before kept."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from test_documents import bits_of, components, repeats, sha
from test_quality_rules import divergence, fill, measure
from tokenizers import Tokenizer

import corpus_pipeline
from lakeledger.llm.queries import MIXTURE_SEED, MIXTURE_SHARE, MIXTURE_WEIGHTS

DIRECTORY = "/root/testdata/sf0.001"


def passes(docs):
    measured = {id_: (lang, *measure(text)) for id_, (text, lang, _) in docs.items()}
    classes, words, total = defaultdict(lambda: [0] * 7), defaultdict(Counter), Counter()
    for lang, counts, kinds, common in measured.values():
        classes[lang] = [a + b for a, b in zip(classes[lang], kinds)]
        words[lang] += common
        total[lang] += counts[0]
    for id_, (lang, counts, kinds, common) in measured.items():
        if counts[0] < 10 or 100 * counts[4] > 20 * counts[0]:
            continue
        if sum(kinds) - kinds[1] >= 200:
            if divergence([x / sum(kinds) for x in kinds], [x / sum(classes[lang]) for x in classes[lang]]) > 0.25:
                continue
        if counts[0] >= 50:
            names = sorted(words[lang])
            p, q = [common[x] / counts[0] for x in names], [words[lang][x] / total[lang] for x in names]
            by_word, bare = divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)]), divergence([*[0] * len(q), 1], [*q, 1 - sum(q)])
            if by_word > 0.45 or bare > 0 and by_word > bare * (0.98 if counts[0] < 120 else 0.85):
                continue
        yield id_


def domain(source):
    number = int(source.removeprefix("src"))
    return "crawl" if number == 0 else "web" if number % 2 else "reference"


def taken(docs):
    """Ids that fill the leaves' budgets in seeded order, one epoch."""
    size = {id_: -(-len(text.encode()) // 4) for id_, (text, *_) in docs.items()}
    path = {id_: (domain(source), f"{domain(source)}/{lang}", f"{domain(source)}/{lang}/{source}") for id_, (_, lang, source) in docs.items()}
    weight = {(level, key): w for level, key, w in MIXTURE_WEIGHTS}
    budgets = {"": min(sum(size.values()), int(sum(size.values()) * MIXTURE_SHARE))}
    for k, level in enumerate(("domain", "lang", "source")):
        caps = defaultdict(Counter)
        for id_, n in size.items():
            caps[path[id_][k - 1] if k else ""][path[id_][k]] += n
        budgets = {
            node: share
            for parent, own in caps.items()
            for node, share in fill(budgets[parent], {x: (cap, weight.get((level, x), 1.0)) for x, cap in own.items()}).items()
        }
    for leaf, left in budgets.items():
        mine = [id_ for id_ in size if path[id_][2] == leaf]
        for id_ in sorted(mine, key=lambda x: hashlib.md5(f"{MIXTURE_SEED}:0:{x}".encode()).hexdigest()):
            if left > 0:
                left -= size[id_]
                yield id_


def test_pipeline(spark):
    docs = {
        row.doc_id: (row.text, row.lang, row.source)
        for row in spark.read.parquet(f"{DIRECTORY}/documents.parquet").orderBy("doc_id").collect()
    }
    kept = sorted(passes(docs))
    docs = {id_: docs[id_] for id_ in kept}
    groups = components({id_: bits_of(text) for id_, (text, *_) in docs.items()})
    docs = {id_: doc for id_, doc in docs.items() if groups[id_] == id_}
    left = repeats([(id_, text.encode()) for id_, (text, *_) in docs.items()])
    docs = {id_: (text.decode("utf-8", "ignore"), *doc[1:]) for (id_, doc), (*_, text) in zip(docs.items(), left)}
    chosen = sorted(taken(docs))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for id_ in chosen:
        text, lang, source = docs[id_]
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        wanted.append((id_, lang, source, len(ids), ids, sha(",".join(map(str, ids))), sha(text)))
    assert 20 < len(wanted) < len(groups)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIRECTORY).collect())) == wanted


def test_stages_return_documents_and_take_none(spark, odd):
    nothing = spark.read.parquet(f"{DIRECTORY}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (nothing, odd.select(*nothing.columns)):
            found = stage(spark, docs, DIRECTORY)
            rows = found.collect()
            assert docs is odd or name == corpus_pipeline.STAGES[-1][0] or found.columns == nothing.columns
            assert len(rows) <= docs.count()
