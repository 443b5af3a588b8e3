"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, collocations, decontaminate, fingerprints, langid, lm, minhash, packing, pii, quality, sharding, toxicity
from tidemark.llm.common import remainder
from tidemark.session import shared_path, stage

RANKS = corpus_pipeline.RANKS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int, rest: int) -> Column:
    return (remainder("doc_id", n) == rest).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.where(remainder("doc_id", 3) != 1))
    return quality.score(docs, net).select("doc_id", _held_out(3, 1), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = lm.score(docs, remainder("doc_id", 7) != 2, RANKS)
    return scored.select(
        "doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(4, 2), "score", "predicted", F.to_json("passages").alias("passages")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.load(spark, RANKS))


def op8_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 1 MiB of text, so that the smallest tables have several, too."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, limit=1 << 20).select(
        "doc_id", "n_bytes", "depth", "shard", "page"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1), "text", "lang")
    return langid.predict(docs, model).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path
    held = alignment.load(spark, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    encoded = stage(alignment.encode(docs, held), "alignments")
    return alignment.digests(encoded, alignment.count_pairs(encoded, held))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again; the rows come from the files."""
    path = shared_path(spark, "packed")
    packing.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.read(spark, path, digests=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_pii,
        op3_minhash,
        op4_attention,
        op5_order_minhash,
        op6_toxicity,
        op7_bpe,
        op8_extendible,
        op9_language,
        op10_winnowing,
        op11_alignment,
        op12_collocations,
        op13_packing,
        pipeline,
    )
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def plain(query):
        return lambda spark, sf_dir: query(spark, sf_dir.rstrip("/"))

    return {name: plain(query) for name, query in QUERIES.items()}
