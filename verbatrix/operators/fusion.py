"""Near-duplicate removal in ranked lists, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
DIGITS = 12


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id and s, the shingles of (id, text); rows that share an id have one text."""
    one = texts.groupBy("id").agg(F.first("text").alias("text"))
    # An explicit number of partitions, as texts are small in bytes but not in work, and would be merged into one task.
    spread = one.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return spread.select("id", T.char_shingles(F.col("text")).alias("s"))


def greedy_dedup(hits: DataFrame, threshold: float = T.DUPLICATE, keys: tuple[str, ...] = ("query_id",), sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From ranked hits (keys, id, rank, text, ...): the kept ones, ranked anew, and (keys, id, kept_id) of the dropped.

    In rank order a hit is dropped if it overlaps one that was kept before. ``sets`` (id, s) are the shingles of all ids, where
    they are known already. A list is a query's top n: its sets meet in one row, where each pair is compared once, and the
    choice runs over ranks only.
    """
    known = shingle_sets(hits.select("id", "text")) if sets is None else sets
    entry = F.struct("rank", "id", "s")
    spread = hits.select(*keys, "id", "rank").join(known, "id").repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    lists = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("l"))
    like = lambda l, e, k: F.filter(F.transform(F.slice(l, F.lit(1), k), lambda x, j: F.when(T.overlap_of(e["s"], x["s"]) >= threshold, j)), lambda j: j.isNotNull())
    marked = T.let(F.col("l"), lambda l: F.transform(l, lambda e, k: F.struct(k.alias("i"), e["id"].alias("id"), like(l, e, k).alias("like"))))
    judged = lists.select(*keys, marked.alias("m"))

    kind = "struct<kept:array<int>,dropped:array<struct<i:int,by:int>>>"
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<struct<i:int,by:int>>").alias("dropped")).cast(kind)

    def step(acc, e):
        by = F.array_min(F.array_intersect(e["like"], acc["kept"]))
        keep = F.struct(F.concat(acc["kept"], F.array(e["i"])).alias("kept"), acc["dropped"].alias("dropped")).cast(kind)
        drop = F.struct(acc["kept"].alias("kept"), F.concat(acc["dropped"], F.array(F.struct(e["i"].alias("i"), by.alias("by")))).alias("dropped")).cast(kind)
        return F.when(by.isNull(), keep).otherwise(drop)

    chosen = judged.select(*keys, "m", F.aggregate("m", start, step).alias("a"))
    id_at = lambda i: F.get("m", i)["id"]
    kept = chosen.select(*keys, F.posexplode(F.transform("a.kept", id_at)).alias("i", "id")).select(*keys, "id", (F.col("i") + 1).alias("new_rank"))
    ranked = hits.join(kept, [*keys, "id"]).withColumn("rank", F.col("new_rank")).drop("new_rank")
    dropped = chosen.select(*keys, F.inline(F.transform("a.dropped", lambda d: F.struct(id_at(d["i"]).alias("id"), id_at(d["by"]).alias("kept_id")))))
    return ranked, dropped


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, id, rank, rrf_score, found_in (list -> rank), list_idx of lists of (query_id, id, rank).

    list_idx is the last list that has the hit, whose text and metadata stand for it. Ties keep the order in which hits are
    first seen: by list, then by rank.
    """
    both = None
    for i, hits in enumerate(lists):
        own = hits.select("query_id", "id", "rank", F.lit(i).alias("list_idx"))
        both = own if both is None else both.unionByName(own)
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), DIGITS).alias("rrf_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("list_idx", "rank")))).alias("found_in"),
        F.max("list_idx").alias("list_idx"), F.min(F.struct("list_idx", "rank")).alias("seen"),
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen"))
    return fused.select("query_id", "id", rank.alias("rank"), "rrf_score", "found_in", "list_idx")
