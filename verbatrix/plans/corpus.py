"""From documents to chunks with ids and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import chunking, sections
from ..sources.documents import document_blocks

STRATEGY = "structure_aware"


def doc_id(company, form, period):
    return F.concat_ws("_", company, form, period)


def chunk_ids(chunks: DataFrame, documents: DataFrame, strategy: str = STRATEGY) -> DataFrame:
    """Adds id, company, form, period and strategy; ord orders chunks over all documents, and is a number, not text."""
    about = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "company", "form", "period")
    joined = chunks.join(about, "doc_id")
    return joined.select(
        F.concat("doc_id", F.lit("_"), F.col("chunk_ord").cast("string")).alias("id"), F.struct("doc_id", "chunk_ord").alias("ord"), "doc_id", "chunk_ord", "text",
        "company", "form", "period", "section", F.lit(strategy).alias("strategy"), "kind", "block_id",
    )


def build(documents: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks and diagnostics of documents (doc_id, doc_type, html, company, form, period)."""
    # Detection and attribution read the blocks several times; parsing them is the costly part.
    blocks = written(document_blocks(documents), "blocks")
    made, notes = sections.detect(blocks, strict)
    attributed, more = sections.attribute(blocks, made)
    return chunk_ids(chunking.section_chunks(attributed, size, overlap), documents), notes.unionByName(more)


def plain(documents: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of (doc_id, text, company, form, period) by size alone."""
    cut = chunking.fixed_chunks(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), size, overlap)
    rows = cut.select("doc_id", "chunk_ord", "text", F.lit(None).cast("string").alias("section"), F.lit("narrative").alias("kind"), F.lit("").alias("block_id"))
    return chunk_ids(rows, documents, "fixed_size")
