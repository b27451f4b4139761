"""Hybrid search over a batch of queries: dense and sparse lists, near-duplicates removed, fused, reranked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, fusion, rerank, sparse
from ..operators.sparse import SparseIndex
from ..providers import Embedder, Scorer
from ..functions.tables import written

N, TOP = 20, 5
#: Hits whose ids are broadcast, so that texts stay where they are.
FEW_HITS = 1_000_000
META = ("company", "form", "period", "section", "kind")


@dataclass
class SearchResult:
    """Every list of a search, each a DataFrame with query_id, id and rank; and (query_id, id, kept_id, list) of what was dropped."""

    dense: DataFrame
    sparse: DataFrame
    fused: DataFrame
    reranked: DataFrame
    dropped: DataFrame


def search(queries: DataFrame, chunks: DataFrame, index: SparseIndex, embedder: Embedder, scorer: Scorer, n: int = N, top: int = TOP, filters: dict | None = None) -> SearchResult:
    """queries: query_id, query. chunks: id, ord, text, embedding and metadata columns."""
    about = chunks.select("id", "text", *[c for c in META if c in chunks.columns])
    asked = dense.embed(queries, embedder, "query") if "embedding" not in queries.columns else queries
    # Lists hold n rows a query; each is read several times below, so it is written. One pass over all texts finds theirs.
    near, said = written(dense.search(asked, chunks, n, filters), "near"), written(sparse.search(index, queries, n, filters), "said")
    ids = written(near.select("id").unionByName(said.select("id")).distinct(), "ids")
    about = written(about.join(F.broadcast(ids) if ids.count() <= FEW_HITS else ids, "id", "left_semi"), "texts")
    near, said = near.join(about, "id"), said.join(about, "id")
    sets = written(fusion.shingle_sets(near.select("id", "text").unionByName(said.select("id", "text"))), "sets")
    (near, less), (said, fewer) = fusion.greedy_dedup(near, sets=sets), fusion.greedy_dedup(said, sets=sets)
    near, said = written(near, "near"), written(said, "said")
    fused = written(fusion.reciprocal_rank_fusion([near, said]).join(about, "id"), "fused")
    kept, more = fusion.greedy_dedup(fused, sets=sets)
    kept = written(kept if "kind" in kept.columns else kept.withColumn("kind", F.lit("narrative")), "kept")
    dropped = [d.withColumn("list", F.lit(name)) for name, d in (("dense", less), ("sparse", fewer), ("fused", more))]
    return SearchResult(near, said, kept, written(rerank.rerank(kept, queries, scorer, top), "reranked"), written(reduce(DataFrame.unionByName, dropped), "dropped"))
