"""Chunking: fixed-size windows of prose, whole records of tables, by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import TABLE, serialized

SIZE, OVERLAP = 500, 50
#: Pieces that are cut out of one block of a text.
BLOCK = 16
#: A table of up to so many chunk sizes stays whole.
WHOLE_TABLE = 3


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"the overlap must be at least 0 and less than the size: {overlap}, {size}")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of ``size`` characters, each ``overlap`` before the last one's end; empty for an empty text.

    The text is cut into blocks of ``BLOCK`` pieces first: a substring by position is found by scanning from the start.
    """
    _check(size, overlap)
    step = size - overlap
    # A block's end stays an int.
    wide = max(1, min(BLOCK, (2**31 - 1 - overlap) // step)) * step
    of_block = lambda b: F.transform(F.sequence(F.lit(0), F.least(F.lit(wide), F.length(b)) - 1, F.lit(step)), lambda i: F.substring(b, i + 1, F.lit(size)))
    blocks = lambda t: F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(wide)), lambda i: F.substring(t, i + 1, F.lit(wide + overlap)))
    cut = lambda t: F.when(F.length(t) > 0, F.flatten(F.transform(blocks(t), of_block)))
    return F.coalesce(T.let(text, cut), F.array().cast("array<string>"))


def fixed_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_ord and text of each piece of (doc_id, text)."""
    return documents.select("doc_id", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_ord", "text"))


def range_chunks(documents: DataFrame, ranges: list[tuple[str, int, int | None]], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks within given character ranges (name, start, end); an end of None is the text's. What lies outside is left out."""
    last = lambda e: F.length("text") if e is None else F.least(F.lit(e), F.length("text"))
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("section"), F.lit(s).alias("start"), last(e).alias("end")) for i, (n, s, e) in enumerate(ranges)])
    cut = documents.select("doc_id", "text", F.inline(named)).filter("end > start")
    part = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return cut.select("doc_id", "i", "section", F.posexplode(windows(part, size, overlap)).alias("chunk_index_in_section", "text"))


def continuation_header() -> Column:
    """What the second and later chunks of a table start with."""
    title, unit = F.coalesce("table_title", F.lit("")), F.coalesce("unit", F.lit(""))
    named = F.when(title != "", F.concat(title, F.lit(" (continued)"))).otherwise(F.lit("(continued from the preceding table)"))
    return F.concat(named, F.when(unit != "", F.concat(F.lit(" | values in "), unit, F.lit(" unless the record states otherwise"))).otherwise(F.lit("")))


def pack_records(records: Column, header: Column, size: int = SIZE, whole: int = WHOLE_TABLE) -> Column:
    """Records as array<struct<text, oversize>>: as many per chunk as fit, none cut, all but the first under the header."""
    kind = "struct<done:array<struct<text:string,oversize:int>>,lines:array<string>,chars:int,oversize:int>"
    none = F.array().cast("array<struct<text:string,oversize:int>>")

    def greedy(h: Column) -> Column:
        start = F.struct(none.alias("done"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("chars"), F.lit(0).alias("oversize")).cast(kind)
        closed = lambda a: F.concat(a["done"], F.array(F.struct(F.array_join(a["lines"], "\n").alias("text"), a["oversize"].alias("oversize"))))

        def step(a, r):
            n = F.length(r)
            fits = (F.size(a["lines"]) == 0) | (a["chars"] + n + 1 <= size)
            first = (F.size(a["lines"]) == 0) & (n > size)
            same = F.struct(a["done"].alias("done"), F.concat(a["lines"], F.array(r)).alias("lines"), (a["chars"] + n + F.when(F.size(a["lines"]) > 0, 1).otherwise(0)).alias("chars"), (a["oversize"] + first.cast("int")).alias("oversize"))
            # A record that does not fit below the header either is there all the same, as it is never cut.
            over = F.length(h) + n + 1 > size
            new = F.struct(closed(a).alias("done"), F.array(h, r).alias("lines"), (F.length(h) + 1 + n).alias("chars"), over.cast("int").alias("oversize"))
            return F.when(fits, same).otherwise(new).cast(kind)

        return F.aggregate(records, start, step, lambda a: F.when(F.size(a["lines"]) > 0, closed(a)).otherwise(a["done"]))

    joined = F.array_join(records, "\n")
    return F.when(F.length(joined) <= whole * size, F.array(F.struct(joined.alias("text"), F.lit(0).alias("oversize")))).otherwise(T.let(header, greedy))


def section_chunks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of attributed blocks: doc_id, section, run, chunk_index_in_section, kind, block_id, text, oversize, chunk_ord.

    Consecutive blocks of one section are a run. Within it consecutive prose is cut as one text, and each table with
    records is packed by itself. The index counts through a run, chunk_ord through a document.
    """
    _check(size, overlap)
    by_doc = Window.partitionBy("doc_id").orderBy("source_order")
    is_table = (F.col("block_type") == TABLE) & (F.size(F.coalesce("records", F.array().cast("array<string>"))) > 0)
    upto = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(by_doc) == 1
    marked = blocks.withColumn("is_table", is_table).withColumn("changed", first | ~F.col("section_id").eqNullSafe(F.lag("section_id").over(by_doc)))
    runs = marked.withColumn("run", F.sum(F.col("changed").cast("int")).over(upto))
    piece = F.col("changed") | F.col("is_table") | F.coalesce(F.lag("is_table").over(by_doc), F.lit(True))
    pieces = runs.withColumn("piece", F.sum(piece.cast("int")).over(upto)).withColumn("body", serialized())
    grouped = pieces.groupBy("doc_id", "section_id", "run", "piece", "is_table").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_order", "body"))), lambda p: p["body"]), "").alias("prose"),
        F.first("records").alias("records"), F.first("table_title").alias("table_title"), F.first("unit").alias("unit"), F.first("block_id").alias("block_id"),
    )
    cut = F.transform(windows(F.col("prose"), size, overlap), lambda t: F.struct(t.alias("text"), F.lit(0).alias("oversize")))
    made = F.when(F.col("is_table"), pack_records(F.col("records"), continuation_header(), size)).otherwise(cut)
    kind = F.when(F.col("is_table"), F.lit("table_records")).otherwise(F.lit("narrative"))
    chunks = grouped.select("doc_id", F.col("section_id").alias("section"), "run", "piece", kind.alias("kind"), F.when(F.col("is_table"), F.col("block_id")).otherwise(F.lit("")).alias("block_id"), F.posexplode(made).alias("i", "c"))
    in_run, in_doc = Window.partitionBy("doc_id", "run").orderBy("piece", "i"), Window.partitionBy("doc_id").orderBy("run", "piece", "i")
    return chunks.select(
        "doc_id", "section", "run", (F.row_number().over(in_run) - 1).alias("chunk_index_in_section"), "kind", "block_id", "c.text", "c.oversize",
        (F.row_number().over(in_doc) - 1).alias("chunk_ord"),
    )


def table_chunk_stats(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of counts over the table chunks of ``section_chunks``."""
    tables = chunks.filter("kind = 'table_records'").groupBy("doc_id", "run", "block_id").agg(F.count("*").alias("n"), F.sum("oversize").alias("oversize"), F.max(F.length("text")).alias("longest"))
    one = F.col("n") == 1
    return tables.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("table_chunks"), F.count_if(one).alias("tables_kept_whole"), F.count_if(~one).alias("tables_spanning_chunks"),
        F.coalesce(F.sum("oversize"), F.lit(0)).alias("oversize_records"), F.coalesce(F.max(F.when(one, F.col("longest"))), F.lit(0)).alias("largest_whole_table_chars"),
    )
