"""A corpus pipeline: quality rules, near-duplicates, repeated passages, a mixture by weights, token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.bpe import encode_documents
from lakeledger.llm.mixing import mix
from lakeledger.llm.quality import quality_rules
from lakeledger.llm.queries import BYTE_BPE, MIXTURE_LEVELS, MIXTURE_SEED, MIXTURE_SHARE, domain_of, mixture_weights
from lakeledger.llm.simhash import one_of_each
from lakeledger.llm.suffix_dedup import remove_repeats
from lakeledger.llm.support import stored

#: Suffix sorting, fingerprints and token ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id."""
    return one_of_each(docs, shingle=3, distance=2).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier one has; n_chars is that of the new text."""
    left = remove_repeats(docs, length=50)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the budgets of the mixture's tree, each at most once."""
    named = docs.withColumn("domain", domain_of("source"))
    mixed = mix(named, mixture_weights(spark), MIXTURE_LEVELS, share=MIXTURE_SHARE, seed=MIXTURE_SEED)
    return mixed.select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests."""
    encoded = encode_documents(docs, BYTE_BPE)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
