"""Exact top-k inner products (operator 8): tiles of queries times tiles of shards, merged as a tree.

Vectors are packed into tiles: a matrix of up to ``QUERY_TILE`` or ``SHARD_TILE`` vectors in one row. Query tiles and
shard tiles meet in the cells of a grid: a query tile goes to each cell of its grid row, a shard tile to each cell of
its grid column, so that neither side is ever sent whole to one task. Each pair of tiles is one matrix product, from which
every query keeps its best k. These short lists are merged per cell, then per query.

Scores are integers. A product runs in single precision only where every partial sum is below 2**24, in double where it
is below 2**53, and in Python integers beyond that, so it is exact always. One that does not fit into 64 bits is an error.

Defined cases: a vector that is null, or holds a null, NaN or infinite component, takes no part, nor does a null id.
Vectors of different lengths are not compared; empty ones score 0 with each other. A query is never its own candidate:
rows that bear its id are left out. Repeated ids are candidates once per row. A query without candidates returns nothing.
Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

QUERY_TILE = 512
SHARD_TILE = 4096
K = 5
EVERY = 50
SCALE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * component) of every vector that takes part."""
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _tiles(rows: int):
    """Pack a partition's vectors into tiles of up to ``rows`` vectors of one length, ids ascending in each."""

    def pack(dim: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([matrix[order].tobytes()], pa.binary())], ["dim", "ids", "matrix"])

    def run(batches):
        open_tiles: dict[int, list] = {}
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("v"))).astype(np.int64)
            all_ids = np.asarray(batch.column("vec_id")).astype(np.int64)
            for dim in np.unique(lengths):
                mine = np.flatnonzero(lengths == dim)
                ids, matrix = all_ids[mine], np.asarray(batch.column("v").take(pa.array(mine)).flatten()).reshape(len(mine), dim)
                if dim in open_tiles:
                    ids, matrix = np.concatenate([open_tiles[dim][0], ids]), np.concatenate([open_tiles[dim][1], matrix])
                while len(ids) >= rows:
                    yield pack(int(dim), ids[:rows], matrix[:rows])
                    ids, matrix = ids[rows:], matrix[rows:]
                open_tiles[dim] = [ids, matrix]
        for dim, (ids, matrix) in open_tiles.items():
            if len(ids):
                yield pack(int(dim), ids, matrix)

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly, for matrices of whole numbers held as doubles."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    exact = whole(a).dot(whole(b).T)
    if exact.size and max(exact.max(), -exact.min()) >= 2**63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


def _multiply(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_ids, q, c_ids, c = (batch.column(n)[i].as_py() for n in ("dim", "q_ids", "q_matrix", "ids", "matrix"))
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                scores = product(np.frombuffer(q).reshape(len(q_ids), dim), np.frombuffer(c).reshape(len(c_ids), dim))
                allowed = np.ones(scores.shape, bool)
                low, high = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
                for row in np.flatnonzero(high > low):
                    allowed[row, low[row] : high[row]] = False
                floor = np.iinfo(np.int64).min
                scores[~allowed] = floor
                if len(c_ids) > k:
                    allowed &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]
                rows, cols = np.nonzero(allowed)
                order = np.lexsort((c_ids[cols], -scores[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
                rows, cols = rows[place < k], cols[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[rows]), pa.array(c_ids[cols]), pa.array(scores[rows, cols]), pa.array(np.full(len(rows), batch.column("cell")[i].as_py(), np.int32))],
                    ["query_id", "vec_id", "score", "cell"],
                )

    return run


def top_k(queries: DataFrame, shards: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all shard rows but its own. Both inputs are ``quantised``."""
    spark = queries.sparkSession
    n_queries, n_rows = max(1, queries.count()), max(1, shards.count())
    # Enough cells to keep every core busy and to hold a cell's share of the work at about 2**36 multiplications of pairs.
    cells = max(spark.sparkContext.defaultParallelism, math.ceil(n_queries * n_rows / 2**32))
    down = max(1, min(math.ceil(n_queries / QUERY_TILE), round(math.sqrt(cells * n_queries / n_rows))))
    across = max(1, math.ceil(cells / down))
    tile = "dim int, ids binary, matrix binary"
    dealt = lambda df, parts: df.repartition(parts, F.xxhash64("vec_id"))
    left = dealt(queries, down).mapInArrow(kit.lean(_tiles(QUERY_TILE)), tile).select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.pmod(F.xxhash64("ids"), F.lit(down)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    right = dealt(shards, across).mapInArrow(kit.lean(_tiles(SHARD_TILE)), tile).select("dim", "ids", "matrix", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), F.pmod(F.xxhash64("ids"), F.lit(across)).alias("c"))
    cell = (F.col("r") * across + F.col("c")).cast("int").alias("cell")
    pairs = left.select("dim", "q_ids", "q_matrix", cell).hint("shuffle_merge").join(right.select("dim", "ids", "matrix", cell), ["cell", "dim"])
    lists = pairs.mapInArrow(kit.lean(_multiply(k)), "query_id long, vec_id long, score long, cell int")
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    per_cell = best(lists, "query_id", "cell").drop("rank")
    return best(per_cell, "query_id").select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(kit.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.filter(F.col("vec_id") % EVERY == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
