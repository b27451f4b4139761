"""Approximate dense retrieval by an inverted file: vectors are filed under the nearest of some centroids, queries probe a few lists.

Centroids are fitted by k-means on a bounded sample of vectors; every vector is filed. The file is Parquet, one partition a list,
so that a batch of queries opens the lists that it probes and no others, and filters reach the scan. Within a list, tiles of
queries meet tiles of vectors as in exact search; a frequent list has many tiles, dealt over tasks. Scores are exact: what is
approximate is only which vectors are looked at. Probing all lists is exact search.

The number of lists follows the number of vectors, and ``probes`` is a number of lists, or a share of them below 1. How many are
needed depends on the vectors: few where they cluster, half of them and more where they are spread evenly over a sphere.
``probes_for`` finds the number from exact answers to a bounded sample of queries; ``recall`` measures a choice.

Vectors that are null or hold a null or NaN are in no list. New vectors are filed under the old centroids; fit anew when their
distances grow (``spread``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dense

#: Vectors that k-means sees, for each centroid, and its rounds.
SAMPLE_EACH, ROUNDS, SEED = 256, 12, 17
#: Most lists, so that centroids stay a few megabytes.
MOST_LISTS = 16384
PROBES = 0.25
#: Queries that are answered exactly to find the number of probes, and the recall that is asked of them.
CALIBRATION, TARGET = 200, 0.93
#: Rows of one file of a list.
FILE_ROWS = 200_000
#: Vectors that one task of k-means sees, about, and the digits of centroids.
FIT_ROWS, DIGITS = 8192, 9
#: Pairs of a vector and a centroid that are measured at a time.
PAIRS = 1 << 20
#: Vectors of a list that one task compares, about.
LIST_PART = 32768


@dataclass
class VectorIndex:
    centroids: np.ndarray
    """One row a list."""
    lists: DataFrame
    """What was filed, with the columns it came with, list and distance (squared, to the centroid)."""
    largest: int
    """Vectors in the longest list."""

    def probed(self, probes: float) -> int:
        return min(len(self.centroids), max(1, math.ceil(probes * len(self.centroids)) if probes < 1 else int(probes)))


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def lists_for(n: int) -> int:
    """About the square root of the number of vectors: then centroids and a list's vectors cost a query alike."""
    return max(1, min(MOST_LISTS, math.isqrt(n)))


def fit(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids of about ``SAMPLE_EACH`` vectors each, those of the least hash; the same vectors give the same centroids.

    The sample is a share of the hashes' range, so nothing is sorted or limited as a whole.
    """
    hashed = usable(vectors).withColumn("__hash", F.xxhash64(*vectors.columns)).select("embedding", "__hash")
    count = hashed.count()
    lists = lists or lists_for(count)
    most = lists * SAMPLE_EACH
    if count > most:
        hashed = hashed.filter(F.col("__hash") < int(most / count * 2.0**64) - 2**63)
    # Dealt by hash and in its order, so that sums and starting points do not depend on how rows were dealt; digits drop the order of addition.
    dealt = hashed.repartition(max(1, math.ceil(min(count, most) / FIT_ROWS)), "__hash").sortWithinPartitions("__hash", "embedding")
    sample = dealt.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = KMeans(k=lists, maxIter=ROUNDS, seed=SEED, featuresCol="v").fit(sample)
    return np.round(np.array(model.clusterCenters()), DIGITS)


def _distances(embeddings: pd.Series, centroids: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances of vectors to all centroids, for a bounded number of pairs at a time."""
    rows = max(1, PAIRS // max(1, len(centroids)))
    for start in range(0, len(embeddings), rows):
        yield dense.squared_distances(np.stack(embeddings.iloc[start : start + rows].to_numpy()).astype(float), centroids)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """usable vectors with list and distance. Centroids travel with the function: at most ``MOST_LISTS`` of them."""

    @F.pandas_udf("list int, distance double")
    def nearest(embeddings: pd.Series) -> pd.DataFrame:
        if not len(embeddings):
            return pd.DataFrame({"list": [], "distance": []})
        told = [(d.argmin(axis=1), d.min(axis=1)) for d in _distances(embeddings, centroids)]
        at, distance = (np.concatenate(c) for c in zip(*told))
        return pd.DataFrame({"list": at.astype("int32"), "distance": distance})

    return usable(vectors).withColumn("__at", nearest("embedding")).select(*vectors.columns, "__at.list", "__at.distance")


def write(vectors: DataFrame, centroids: np.ndarray, path: str, mode: str = "errorifexists") -> None:
    """File vectors under ``path``; a list with many vectors gets several files, dealt by a hash of the vector."""
    filed = assigned(vectors, centroids)
    parts = F.pmod(F.xxhash64("embedding"), F.lit(max(1, math.ceil(vectors.count() / FILE_ROWS))))
    filed.repartition("list", parts).write.mode(mode).partitionBy("list").parquet(f"{path}/lists")
    if mode != "append":
        spark = vectors.sparkSession
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    lists = spark.read.parquet(f"{path}/lists")
    largest = lists.groupBy("list").count().agg(F.max("count")).head()[0] or 0
    return VectorIndex(np.array([r.centroid for r in rows]), lists, largest)


def build(vectors: DataFrame, path: str, lists: int | None = None, mode: str = "errorifexists") -> VectorIndex:
    """Fit, file and open."""
    write(vectors, fit(vectors, lists), path, mode)
    return read(vectors.sparkSession, path)


def probes_of(index: VectorIndex, queries: DataFrame, probes: float = PROBES) -> DataFrame:
    """The columns of queries with place and list: a row for each list that a query probes, the nearest at place 0."""
    count, centroids = index.probed(probes), index.centroids

    @F.pandas_udf("array<int>")
    def nearest(embeddings: pd.Series) -> pd.Series:
        if not len(embeddings):
            return pd.Series([], dtype=object)
        return pd.Series([row for d in _distances(embeddings, centroids) for row in np.argsort(d, axis=1, kind="stable")[:, :count].astype("int32")])

    return usable(queries).select(*queries.columns, F.posexplode(nearest("embedding")).alias("place", "list"))


def search(index: VectorIndex, queries: DataFrame, n: int = 20, probes: float = PROBES, filters: dict | None = None) -> DataFrame:
    """query_id, id, rank and score (squared distance) of each query's n nearest among the lists it probes; ties go to the smaller ord.

    queries: query_id, embedding. The index holds id, ord, embedding and the columns of the filters.
    """
    # Queries share a tile in whatever lists they meet: numbered after they are sent to lists, hardly two would.
    tiles = max(1, math.ceil(queries.count() / dense.QUERY_TILE))
    asked = probes_of(index, queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).alias("tile")), probes)
    everywhere = index.probed(probes) == len(index.centroids)
    wanted = range(len(index.centroids)) if everywhere else [r.list for r in asked.select("list").distinct().collect()]  # at most one a list
    opened = dense.matching(index.lists.filter(F.col("list").isin(*wanted)), filters)
    spread = max(1, math.ceil(index.largest / LIST_PART))
    return dense.ranked(dense.meet(asked, opened, ["list"], spread, n, dense.squared_distances, largest=False), n, largest=False)


def probes_for(index: VectorIndex, queries: DataFrame, n: int = 20, target: float = TARGET) -> int:
    """The least number of probes that finds the share ``target`` of the exact n nearest, over a sample of ``CALIBRATION`` queries.

    A neighbour is found from the place on that its list has in the query's order, so one exact search tells all numbers at once.
    """
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION)
    everywhere = len(index.centroids)
    hits = search(index, sample, n, everywhere).join(index.lists.select("id", "list"), "id")
    places = hits.join(probes_of(index, sample, everywhere).select("query_id", "list", "place"), ["query_id", "list"]).groupBy("place").count().collect()
    found, total = 0, sum(r["count"] for r in places)
    for r in sorted(places, key=lambda r: r.place):
        found += r["count"]
        if found >= target * total:
            return r.place + 1
    return everywhere


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found and recall: how many of the exact list's rows the approximate list has."""
    hit = approximate.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    per = exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return per.withColumn("recall", F.col("found") / F.col("wanted"))


def spread(index: VectorIndex) -> DataFrame:
    """list, vectors and their mean squared distance to the centroid."""
    return index.lists.groupBy("list").agg(F.count("*").alias("vectors"), F.avg("distance").alias("distance"))
