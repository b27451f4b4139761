"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Stages handle what their operators handle: null and empty
texts, null ids, repeated rows, empty tables and further columns; see there for what comes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatrix.llm import jaccard_join, kit, mixing, packing, quality_crf, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_crf.accepted(docs, quality_crf.learn(docs, kit.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs, kit.Durable(spark, "pipeline-near-duplicates", docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier already; n_chars follows."""
    return substring_dedup.without_repeats(docs, kit.Durable(spark, "pipeline-passages", docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times or not at all."""
    return mixing.mixed(docs, kit.Durable(spark, "pipeline-mix", docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences."""
    return packing.pack(docs.select("doc_id", "text"), kit.Durable(spark, "pipeline-pack", docs), packing.tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("pack", pack)]

#: A trained classifier, hashes and a tokenizer decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, held = kit.table(spark, sf_dir, "documents"), kit.Durable(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = held.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
