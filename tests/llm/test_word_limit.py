"""The limit of the quality rules that a text without common words does not pass."""

from lakeledger.llm import quality

#: The shares that the README gives figures for.
SHARES = {"bare_share": 0.85, "bare_share_short": 0.98, "short_words": 120}


def test_texts_without_common_words_are_rejected(spark):
    prose = [(k, " ".join(f"the word{j} has thing{j * 7 % 61} beside{k}" for j in range(50)), "en") for k in range(60)]
    salad = [(100, " ".join(f"word{j} thing{j * 7 % 61}" for j in range(100)), "en"), (101, " ".join(f"word{j}" for j in range(60)), "en")]
    bare = [(200, " ".join(f"word{j}" for j in range(150)), "xx"), (300, None, None)]
    df = spark.createDataFrame([*prose, *salad, *bare], "doc_id long, text string, lang string")
    loose = {row.doc_id: row for row in quality.quality_rules(df, max_class_distance=1.0, bare_share=None).collect()}
    strict = {row.doc_id: row for row in quality.quality_rules(df, max_class_distance=1.0, **SHARES).collect()}
    assert all(loose[k].kept and not strict[k].kept for k in (100, 101))
    assert all(strict[k].kept for k in range(60))
    # a reference without common words says nothing, and texts that are not judged by words pass as before
    assert strict[200].kept and strict[300].kept == loose[300].kept


def test_labels_in_both_directions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = quality.quality_rules(docs.join(labels, "doc_id", "left"), **SHARES).where("not base_failed and quality is not null")
    rows = [tuple(row) for row in judged.select("quality", "kept").collect()]
    good, bad = ([kept for label, kept in rows if label == wanted] for wanted in (1, 0))
    assert len(good) > 200 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 20 and sum(bad) <= 0.2 * len(bad)
