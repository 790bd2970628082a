import pytest

DIRECTORY = "/root/testdata/sf0.001"
LONG = "word0 " + " ".join(f"alpha{k % 997} beta{k % 89}, gamma." for k in range(12_000))


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table as a list of (doc_id, text, lang, source)."""
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return sorted(tuple(row) for row in rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that clash with those operators add."""
    clashing = "body_ body chunk bucket id print_ root_ least_ node_ kept host rule ids n_tokens epoch fingerprint key_ c0 value_".split()
    texts = [
        (1, "A plain text with some words in it, and no more of them than that."), (1, "A plain text with some words in it, and no more of them than that."),
        (None, "A plain text with some words in it, and no more of them than that."), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG),
        (7, "ä" * 60 + " <|endoftext|> 'tis don't   x 漢字"), (1, "Another text under an id that is there already."), (8, "x"),
    ]
    rows = [
        (id_, text, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src1", None, f"dot {k}", *[f"own {k}"] * len(clashing))
        for k, (id_, text) in enumerate(texts)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, " + ", ".join(f"`{x}` string" for x in clashing)
    return spark.createDataFrame(rows, schema)
