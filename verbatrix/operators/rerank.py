"""Reranking by a scorer of query and passage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..providers import Scorer
from .render import scoring_text

DIGITS = 6


def rerank(hits: DataFrame, queries: DataFrame, scorer: Scorer, top: int = 5) -> DataFrame:
    """Adds rerank_score and rerank_rank to fused hits (query_id, id, rank, text, kind), and keeps the best ``top``.

    Ties keep the fused order.
    """

    @F.pandas_udf("double")
    def score(query: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(list(zip(query, passage))), dtype="float64")

    # The passage is made below the join: a Python function is not planned over an argument with lambdas in it.
    shown = hits.withColumn("__passage", scoring_text(F.col("text"), F.col("kind")))
    joined = shown.join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
    scored = joined.withColumn("rerank_score", F.round(score("__query", "__passage"), DIGITS)).drop("__query", "__passage")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return scored.withColumn("rerank_rank", place).filter(F.col("rerank_rank") <= top)
