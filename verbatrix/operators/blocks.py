"""Blocks of a document: identity, serialisation and offsets.

A block is a row (doc_id, block_type, source_order, section_id, text, raw_html, flat_text, records, speaker, ...). Columns that
a kind does not have are null. Documents are groups of rows, so nothing here collects one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TABLE, TURN = "table", "speaker_turn"


def serialized() -> Column:
    """A block's text: a table's records by line, or its flattened text; a turn with its speaker."""
    table = F.when(F.size(F.coalesce("records", F.array().cast("array<string>"))) > 0, F.array_join("records", "\n")).otherwise(F.coalesce("flat_text", F.lit("")))
    turn = F.concat(F.coalesce("speaker", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return F.when(F.col("block_type") == TABLE, table).when(F.col("block_type") == TURN, turn).otherwise(F.coalesce("text", F.lit("")))


def identity() -> Column:
    """What a block's id is made of: its content, with white space collapsed."""
    turn = F.concat(F.coalesce("speaker", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    own = F.when(F.col("block_type") == TABLE, F.coalesce("raw_html", F.lit(""))).when(F.col("block_type") == TURN, turn).otherwise(F.coalesce("text", F.lit("")))
    return T.collapse(own)


def assign_ids(blocks: DataFrame) -> DataFrame:
    """Sets block_id from content. The n-th block of a document with the same type and content gets "#n", n > 1.

    The window is keyed by the content's hash, so its rows stay small.
    """
    hashed = blocks.withColumn("__hash", F.sha2(identity(), 256))
    nth = F.row_number().over(Window.partitionBy("doc_id", "block_type", "__hash").orderBy("source_order"))
    suffix = F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise(F.lit(""))
    own = F.concat("doc_id", F.lit("/"), "block_type", F.lit("/"), F.substring("__hash", 1, T.HASH_LENGTH), suffix)
    return hashed.withColumn("block_id", own).drop("__hash")


def serialize_documents(blocks: DataFrame) -> DataFrame:
    """doc_id and the concatenation of its blocks in order, without separators."""
    pieces = blocks.select("doc_id", F.struct("source_order", serialized().alias("t")).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "")
    return pieces.groupBy("doc_id").agg(joined.alias("text"))


def block_offsets(blocks: DataFrame, chars: Column | None = None) -> DataFrame:
    """Adds start and end: where each block lies in its document's serialisation, in code points. chars: a block's length, where it is known."""
    w = Window.partitionBy("doc_id").orderBy("source_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length(serialized()).cast("long") if chars is None else chars
    return blocks.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - length)


def speaker_turns(conversations: DataFrame) -> DataFrame:
    """Blocks of (conv_id, turn, role, text): one speaker turn each."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.lit(TURN).alias("block_type"), F.col("turn").cast("int").alias("source_order"),
        F.lit(None).cast("string").alias("section_id"), "text", F.col("role").alias("speaker"), F.col("turn").cast("int").alias("turn_index"),
        F.lit(None).cast("string").alias("raw_html"), F.lit(None).cast("string").alias("flat_text"), F.lit(None).cast("array<string>").alias("records"),
    )


def text_blocks(documents: DataFrame) -> DataFrame:
    """One text block per document row (doc_id, text)."""
    null = lambda kind: F.lit(None).cast(kind)
    return documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("block_type"), F.lit(0).alias("source_order"), null("string").alias("section_id"), "text",
        null("string").alias("speaker"), null("int").alias("turn_index"), null("string").alias("raw_html"), null("string").alias("flat_text"), null("array<string>").alias("records"),
    )
