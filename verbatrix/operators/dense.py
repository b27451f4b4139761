"""Dense retrieval: exact nearest neighbours by squared Euclidean distance, and cosine similarity.

Queries and vectors are packed into tiles, which meet in the cells of a grid: a tile of queries goes to each cell of its grid
row, a tile of vectors to each cell of its grid column, so that neither side is ever sent whole to one task. A pair of tiles
is one matrix product, of which each query keeps its best n; these short lists are ranked per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..providers import Embedder
from .sparse import matching

DIGITS = 6
QUERY_TILE, VECTOR_TILE = 256, 2048
#: Pairs of a query and a vector that one cell of the grid works on, about.
CELL_PAIRS = 1 << 30


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot / scale)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column, batch by batch."""

    @pandas_udf("array<float>")
    def run(texts):
        return texts.__class__(list(embedder.embed(texts.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))


def _tiles(df: DataFrame, rows: int, name: str, *columns: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Vectors of one length (and of equal keys), about ``rows`` of them or less in a row: an array of (columns, embedding) in the order of the columns.

    A column ``tile`` of df, where there is one, says which vectors share a row.
    """
    usable = df.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    entry = F.struct(*columns, F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    placed = usable.select(*keys, F.size("embedding").alias("dim"), (F.col("tile") if "tile" in df.columns else F.floor(F.monotonically_increasing_id() / rows)).alias("tile"), entry.alias("x"))
    return placed.groupBy(*keys, "dim", "tile").agg(F.array_sort(F.collect_list("x")).alias(name))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """NaN where a vector has no length."""
    scale = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))
    return (a @ b.T) / np.where(scale > 0, scale, np.nan)


def _best(values: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, largest: bool):
    """query_id, id, ord and score of each query's best n in a pair of tiles; of equal scores the first in the tile."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, v, dim = batch.column("q")[i].values, batch.column("v")[i].values, batch.column("dim")[i].as_py()
                matrix = lambda x: np.asarray(x.field("e").flatten()).reshape(len(x), dim)
                score = np.floor(values(matrix(q), matrix(v)) * 10**DIGITS + 0.5) / 10**DIGITS
                key = np.where(np.isnan(score), np.inf, -score if largest else score)
                # Whatever reaches the n-th best value, then those in order of value and place.
                bar = np.partition(key, n - 1, axis=1)[:, n - 1 : n] if key.shape[1] > n else np.inf
                rows, cols = np.nonzero((key <= bar) & np.isfinite(key))
                order = np.lexsort((cols, key[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
                rows, cols = rows[place < n], cols[place < n]
                taken = [q.field("query_id").take(pa.array(rows)), v.field("id").take(pa.array(cols)), v.field("ord").take(pa.array(cols)), pa.array(score[rows, cols] + 0.0)]
                yield pa.RecordBatch.from_arrays(taken, ["query_id", "id", "ord", "score"])

    return run


def meet(queries: DataFrame, vectors: DataFrame, keys: list[str], spread: int, n: int, values: Callable[[np.ndarray, np.ndarray], np.ndarray], largest: bool) -> DataFrame:
    """query_id, id, ord and score: short lists of queries over vectors of equal keys, tile by tile.

    The tiles of a key's vectors are dealt into ``spread`` parts, and its queries are sent to each.
    """
    left = _tiles(queries, QUERY_TILE, "q", "query_id", keys=tuple(keys)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = _tiles(vectors, VECTOR_TILE, "v", "ord", "id", keys=tuple(keys)).withColumn("c", F.pmod(F.xxhash64("tile"), F.lit(spread)).cast("int"))
    return _scored(left.join(right.drop("tile"), [*keys, "dim", "c"]), queries, vectors, values, n, largest)


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, values, n: int, largest: bool) -> DataFrame:
    kinds = {**dict(queries.dtypes), **dict(vectors.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "id", "ord")) + ", score double"
    return pairs.select("dim", "q", "v").mapInArrow(_best(values, n, largest), schema)


def ranked(scored: DataFrame, n: int, largest: bool) -> DataFrame:
    """query_id, id, rank and score: the best n of each query's short lists."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "id", "rank", "score")


def _top(queries: DataFrame, vectors: DataFrame, n: int, values: Callable[[np.ndarray, np.ndarray], np.ndarray], largest: bool) -> DataFrame:
    spark = queries.sparkSession
    n_queries, n_vectors = max(1, queries.count()), max(1, vectors.count())
    cells = max(spark.sparkContext.defaultParallelism, math.ceil(n_queries * n_vectors / CELL_PAIRS))
    down = max(1, min(math.ceil(n_queries / QUERY_TILE), round(math.sqrt(cells * n_queries / n_vectors))))
    across = max(1, math.ceil(cells / down))
    of = lambda parts: F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = _tiles(queries, QUERY_TILE, "q", "query_id").select("dim", "q", of(down).alias("r"), every(across).alias("c"))
    right = _tiles(vectors, VECTOR_TILE, "v", "ord", "id").select("dim", "v", every(down).alias("r"), of(across).alias("c"))
    return ranked(_scored(left.hint("shuffle_hash").join(right, ["r", "c", "dim"]), queries, vectors, values, n, largest), n, largest)


def search(queries: DataFrame, vectors: DataFrame, n: int = 20, filters: dict | None = None) -> DataFrame:
    """query_id, id, rank and score (squared distance) of each query's n nearest. Ties go to the smaller ord.

    queries: query_id, embedding. vectors: id, ord, embedding and the columns of the filters, which reach the scan.
    """
    return _top(queries, matching(vectors, filters), n, squared_distances, largest=False)


def most_similar(queries: DataFrame, vectors: DataFrame, n: int = 20, filters: dict | None = None) -> DataFrame:
    """As ``search``, by cosine similarity; vectors without length are similar to nothing."""
    return _top(queries, matching(vectors, filters), n, cosines, largest=True)
