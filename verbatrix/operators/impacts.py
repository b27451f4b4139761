"""Top lists of sparse search without scoring every chunk that shares a word: postings in blocks of like impact.

A posting's impact is its weight in BM25 without the term's idf. Postings are kept by term and level of impact, and each such block
by its greatest impact and its size: a table of at most ``LEVELS`` rows a term. A search works on that table first.

1. The blocks that promise most are read until they hold ``FIRST`` times n postings. The ``TRIED`` times n chunks that score most
   there are scored whole: their n-th best score is a threshold that the final list reaches.
2. Terms are put in order of the most that they can give. A block is essential if it and the most of all lesser terms reach the
   threshold. A chunk with postings in other blocks only cannot: its foremost term's block and all lesser terms fall short.
3. Chunks of essential blocks, and of these only those that reach the threshold with the most that other blocks can add, are
   scored whole.

Lists equal those of ``sparse.search``. Terms with a negative idf (in collections where most terms are in most chunks) give 0 at
most. Filters apply to the threshold's chunks too. Without n chunks in the
first pass there is no threshold, and every block is essential.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import sparse
from .sparse import K1, B, SparseIndex

#: Levels of impact; impacts lie between 0 and K1 + 1.
LEVELS = 64
#: Postings that the first pass reads, and chunks that it scores whole, in lists' lengths.
FIRST, TRIED = 200, 10
#: Blocks that queries ask for that are broadcast, so that postings stay where they are.
FEW_BLOCKS = 500_000
#: Scores are rounded before they are ranked; what may be rounded up to the threshold counts as reaching it.
MARGIN = 2 * 10.0**-sparse.DIGITS


@dataclass
class ImpactIndex:
    postings: DataFrame
    """term, level, id, impact"""
    blocks: DataFrame
    """term, level, top (the greatest impact), postings"""
    index: SparseIndex


def build(index: SparseIndex) -> ImpactIndex:
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    level = F.floor(F.col("impact") / (K1 + 1) * LEVELS).cast("int")
    graded = index.postings.join(F.broadcast(index.totals.select("avgdl"))).select("term", "id", impact.alias("impact")).withColumn("level", level)
    postings = written(graded.select("term", "level", "id", "impact").sortWithinPartitions("term", "level"), "impacts")
    blocks = postings.groupBy("term", "level").agg(F.max("impact").alias("top"), F.count("*").alias("postings"))
    return ImpactIndex(postings, written(blocks, "blocks"), index)


def asked_blocks(impacts: ImpactIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, level, gain (what an impact of 1 is worth), bound (the most that a posting gives) and postings."""
    met = gains(impacts, queries).join(impacts.blocks, "term")
    return met.select("query_id", "term", "level", "gain", F.greatest(F.col("gain") * F.col("top"), F.lit(0.0)).alias("bound"), "postings")


def gains(impacts: ImpactIndex, queries: DataFrame) -> DataFrame:
    """query_id, term and gain: what an impact of 1 is worth."""
    return sparse.query_terms(queries).join(impacts.index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("gain"))


def scores(impacts: ImpactIndex, queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, id and score of given pairs.

    Few gains go to all postings, whose sums by pair are made where a chunk's postings lie together, and these meet the pairs: pairs
    that each ask for all terms of their query are many times as many. Of many gains each pair asks for its own.
    """
    total = F.round(F.sum(F.col("gain") * F.col("impact")), sparse.DIGITS).alias("score")
    worth = gains(impacts, queries)
    if sparse.few_terms(queries):
        return impacts.postings.join(F.broadcast(worth), "term").groupBy("query_id", "id").agg(total).join(found, ["query_id", "id"])
    return impacts.postings.join(found.join(worth, "query_id"), ["term", "id"]).groupBy("query_id", "id").agg(total)


def _best(of: DataFrame, score: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))
    return of.withColumn("rank", rank).filter(F.col("rank") <= n)


def thresholds(impacts: ImpactIndex, queries: DataFrame, asked: DataFrame, n: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id and a score that the n-th of its list reaches; no row where the first pass finds fewer than n."""
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level")
    read = F.coalesce(F.sum("postings").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = asked.withColumn("read", read).filter(F.col("read") < FIRST * n).select("query_id", "term", "level", "gain")
    first = F.broadcast(first) if asked.count() <= FEW_BLOCKS else first
    sums = impacts.postings.join(first, ["term", "level"]).groupBy("query_id", "id").agg(F.sum(F.col("gain") * F.col("impact")).alias("part"))
    if allowed is not None:
        sums = sums.join(allowed, "id", "left_semi")
    whole = scores(impacts, queries, written(_best(sums, "part", TRIED * n).select("query_id", "id"), "tried"))
    return _best(whole, "score", n).filter(F.col("rank") == n).select("query_id", (F.col("score") - MARGIN).alias("threshold"))


def essential_blocks(asked: DataFrame, limits: DataFrame) -> DataFrame:
    """query_id, term, level, gain of essential blocks, with spare (what the term's other blocks give at most), rest (the sum of all terms' spare) and threshold."""
    peaks = asked.groupBy("query_id", "term").agg(F.max("bound").alias("peak"))
    lesser = Window.partitionBy("query_id").orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, -1)
    below = peaks.withColumn("below", F.coalesce(F.sum("peak").over(lesser), F.lit(0.0))).select("query_id", "term", "below")
    judged = asked.join(below, ["query_id", "term"]).join(limits, "query_id", "left")
    marked = judged.withColumn("essential", F.col("threshold").isNull() | (F.col("below") + F.col("bound") >= F.col("threshold")))
    spare = marked.groupBy("query_id", "term").agg(F.coalesce(F.max(F.when(~F.col("essential"), F.col("bound"))), F.lit(0.0)).alias("spare"))
    rest = spare.groupBy("query_id").agg(F.sum("spare").alias("rest"))
    return marked.filter("essential").join(spare, ["query_id", "term"]).join(rest, "query_id").select("query_id", "term", "level", "gain", "spare", "rest", "threshold")


def candidates(impacts: ImpactIndex, queries: DataFrame, n: int = 20, filters: dict | None = None) -> DataFrame:
    """query_id and id of the chunks that may be among the first n."""
    allowed = sparse.matching(impacts.index.chunks, filters).select("id") if filters else None
    asked = written(asked_blocks(impacts, queries), "asked")
    chosen = essential_blocks(asked, written(thresholds(impacts, queries, asked, n, allowed), "thresholds"))
    chosen = F.broadcast(chosen) if asked.count() <= FEW_BLOCKS else chosen
    reach = F.first("rest") + F.sum(F.greatest(F.col("gain") * F.col("impact"), F.lit(0.0)) - F.col("spare"))
    sums = impacts.postings.join(chosen, ["term", "level"]).groupBy("query_id", "id").agg(reach.alias("reach"), F.first("threshold").alias("threshold"))
    found = sums.filter(F.col("threshold").isNull() | (F.col("reach") >= F.col("threshold"))).select("query_id", "id")
    return found if allowed is None else found.join(allowed, "id", "left_semi")


def search(impacts: ImpactIndex, queries: DataFrame, n: int = 20, filters: dict | None = None, found: DataFrame | None = None) -> DataFrame:
    """query_id, id, rank and score of each query's best n chunks with a positive score, as ``sparse.search`` ranks them.

    ``found`` are its candidates, where they are known already.
    """
    few = written(candidates(impacts, queries, n, filters), "candidates") if found is None else found
    placed = scores(impacts, queries, few).filter("score > 0").join(impacts.index.chunks.select("id", "ord"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return placed.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "id", "rank", "score")


def saved(impacts: ImpactIndex, queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, pairs (chunks that share a term with the query, which plain search scores) and scored (the candidates)."""
    pairs = sparse.query_terms(queries).join(impacts.postings, "term").select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("pairs"))
    scored = found.groupBy("query_id").agg(F.count("*").alias("scored"))
    return pairs.join(scored, "query_id", "left").select("query_id", "pairs", F.coalesce("scored", F.lit(0)).alias("scored"))
