"""Sparse retrieval: an inverted index and BM25 scores.

The index is three tables: postings (term, chunk, frequency), lengths, and term statistics. A query joins only the postings
of its terms; statistics always cover the whole collection, so filters come after scoring and before ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of queries that are broadcast.
FEW_TERMS = 100_000
#: Scores are rounded, so that the order of addition does not decide ranks.
DIGITS = 6


@dataclass
class SparseIndex:
    postings: DataFrame
    """term, id, tf, dl"""
    terms: DataFrame
    """term, df, idf"""
    totals: DataFrame
    """One row: n (chunks) and avgdl."""
    chunks: DataFrame


def token_counts(chunks: DataFrame) -> DataFrame:
    """id, term, tf and dl of (id, text).

    Texts are dealt by id, so that a text's terms are counted where it is: the terms of all texts, many times as large, are not
    shuffled. The number of partitions is explicit, as texts are small in bytes but not in work, and would be merged into few tasks.
    """
    dealt = chunks.select("id", "text").repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    exploded = dealt.select("id", T.tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return exploded.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def build(chunks: DataFrame) -> SparseIndex:
    """chunks: id, ord and text, and whatever columns filters use. Texts are tokenized once: the postings are written."""
    postings = written(token_counts(chunks), "postings")
    size = chunks.agg(F.count("*").alias("n"), F.count("text").alias("texts"))
    totals = size.join(F.broadcast(postings.agg(F.sum("tf").alias("tokens")))).select("n", F.try_divide(F.coalesce("tokens", F.lit(0)), "texts").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(totals.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    terms = written(raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf")), "terms")
    return SparseIndex(postings, terms, totals, chunks)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query has it."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def few_terms(queries: DataFrame) -> bool:
    """Whether the terms of queries are few enough to be broadcast."""
    return query_terms(queries).limit(FEW_TERMS + 1).count() <= FEW_TERMS


def scores(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """query_id, id and score of every chunk that shares a term with the query."""
    asked = query_terms(queries).join(index.terms, "term")
    # Few terms go to all postings, so that those of a frequent one stay where they are; many are met term by term.
    if few_terms(queries):
        asked = F.broadcast(asked)
    hits = index.postings.join(asked, "term").join(F.broadcast(index.totals))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * weight), DIGITS).alias("score"))


def matching(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that equal every given value; no filters keep all."""
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == value)
    return df


def search(index: SparseIndex, queries: DataFrame, n: int = 20, filters: dict | None = None, positive: bool = True) -> DataFrame:
    """query_id, id, rank and score of each query's best n chunks. Ties go to the earlier chunk."""
    found = scores(index, queries)
    if positive:
        found = found.filter("score > 0")
    if not filters:
        # What ties with the n-th stays, as ord decides between them; so only short lists meet the chunks.
        found = found.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= n).drop("place")
    kept = found.join(matching(index.chunks, filters).select("id", "ord"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "id", "rank", "score")


def explain(index: SparseIndex, queries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """query_id, id, term, tf and idf: why a chunk matches."""
    hits = query_terms(queries).join(index.postings, "term").join(index.terms, "term")
    if ids is not None:
        hits = hits.join(ids.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hits.select("query_id", "id", "term", "tf", "df", F.round("idf", DIGITS).alias("idf"))


def prefix_dedup(chunks: DataFrame, window: int = 200) -> DataFrame:
    """The first chunk (by ord) of those whose first ``window`` characters agree up to white space and case."""
    key = F.sha2(F.lower(T.collapse(F.substring("text", 1, window))), 256)
    first = F.row_number().over(Window.partitionBy("__key").orderBy("ord"))
    return chunks.withColumn("__key", key).withColumn("__n", first).filter("__n = 1").drop("__key", "__n")
