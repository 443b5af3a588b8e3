"""From raw documents to tokens: a pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written to the shared folder and read
again as the documents of the next stage. All stages but the last return the columns of `documents`.
A stage handles NULL texts, empty texts, repeated rows and empty tables as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash, pii, quality
from tidemark.llm.common import quoted, remainder
from tidemark.session import stage

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least even odds. Learned without the held-out labels."""
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than 5 % of the words lie in passages of the benchmark, each judged by itself."""
    return decontaminate.drop_contaminated_rows(docs, _table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; `n_chars` is that of the new text."""
    return pii.mask(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the decoded ids are the text again."""
    held = bpe.load(spark, RANKS)
    encoded = bpe.encode(docs, held, decoded=True)
    ids, decoded = encoded.columns[-2:]
    back = F.col(quoted(decoded)) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size(quoted(ids)).cast("long").alias("n_tokens"),
        F.col(quoted(ids)).alias("ids"),
        back.alias("round_trip"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", mask_private),
    ("tokens", tokenize),
]

# The quality network, the signatures and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table `documents` in `sf_dir`."""
    docs = _table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
