"""Reports over chunks and tables, as totals by group and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, kind, chunks and chars; null keys are totals."""
    return chunks.rollup("doc_id", "kind").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def composition(chunks: DataFrame) -> DataFrame:
    """doc_id, table_records, narrative and the share of the former; doc_id null for the total."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return chunks.rollup("doc_id").agg(of("table_records").alias("table_records"), of("narrative").alias("narrative"), (of("table_records") / F.count("*")).alias("table_share"))


def growth(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old, new, delta and ratio of two chunkings' counts."""
    count = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    both = count(old, "old").join(count(new, "new"), "doc_id", "full").fillna(0, ["old", "new"])
    return both.select("doc_id", "old", "new", (F.col("new") - F.col("old")).alias("delta"), F.when(F.col("old") > 0, F.col("new") / F.col("old")).alias("ratio"))


def records_per_table(converted: DataFrame) -> DataFrame:
    """doc_id, table_id and how many records a converted table has."""
    return converted.filter("status like 'converted%'").select("doc_id", "table_id", F.size("records").alias("records"))


def section_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """section, old and new: chunks by section in two chunkings."""
    count = lambda df, n: df.groupBy("section").agg(F.count("*").alias(n))
    return count(old, "old").join(count(new, "new"), "section", "full").fillna(0, ["old", "new"])


def spanning_table(chunks: DataFrame) -> DataFrame:
    """The chunks of the shortest table that takes exactly two, as an example."""
    per = chunks.filter("kind = 'table_records'").groupBy("doc_id", "block_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    one = per.filter("n = 2").orderBy("chars", "doc_id", "block_id").limit(1)
    return chunks.join(one.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi").orderBy("chunk_ord")
