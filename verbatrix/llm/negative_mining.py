"""Hard negatives by a Voronoi-partitioned join (operator 13).

Every vector gets one more component, ``sqrt(M^2 - |x|^2)`` with M the greatest norm, anchors a zero. Then the squared distance
of an anchor a and a row x is ``|a|^2 + M^2 - 2 a.x``: high scores are short distances. Rows are filed in the cell of the
nearest of at most ``PIVOTS`` pivots, together with their distance to it. For anchors of a cell, with the range of distances
that can matter to them, the triangle inequality gives for each other cell a range of distances to its pivot; only rows within
are copied to the anchors' group. There, tiles of anchors meet tiles of rows in exact matrix products, and short lists are merged.

Positives: the range ends where the summary of cells (the ``POSITIVES + 1`` nearest ids a label and cell) proves enough rows of
the label. Negatives: from the cells of the anchors' group comes a first list for each positive; where it is full, its last score bounds
the range from below, elsewhere the lowest admissible score does. The highest admissible score bounds it from above.

Cells that lie close together share a group, so that a group has about a tile of anchors: bounds are those of each cell, but a
row is copied once for a group. Anchors of a group are dealt into tiles and copied rows into tiles, which meet on a grid, so that no
group goes whole to one task. Bounds are kept by (cell, cell), ``PIVOTS`` squared at most; those of positives by label too, as a table. Pivots are rows of a
bounded sample (``PIVOTS`` rows of least hash), all rows are filed. Scores are integers and exact (``vector_search.product``);
ranges are widened by more than rounding can shift them, so no row is lost. Where bounds leave out little, as in many dimensions, few groups keep copies few.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different
lengths are not compared. Rows that bear the anchor's id are neither its positives nor its negatives. Repeated rows count once
each as candidates; equal anchor rows are one anchor; an id with several vectors or labels is an anchor for each. Anchors without
positives or negatives return nothing. Extra columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit, vector_search

PIVOTS = 128
POSITIVES, NEGATIVES = 5, 10
EVERY, MISLABELLED, LABELS = 100, 7, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHOR_TILE, ROW_TILE = 512, 4096
#: Ranges of distances are widened by this share of M, far more than doubles lose.
SLACK = 1e-6
#: Anchors and rows of one grid cell, and the size up to which a checked table of ranges is broadcast.
ANCHOR_PART, ROW_PART, BROADCAST_BYTES = 8192, 16384, 32 << 20


def labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: usable rows, some with the next label, components as whole numbers."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % MISLABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * vector_search.SCALE).cast("double")).alias("v"))


def _pivots(rows: DataFrame, n: int, dims: list[int], most: float) -> dict[int, np.ndarray]:
    """Pivots by vector length, each with its last component: at most PIVOTS rows of least hash, and one for any length that these lack."""
    wanted = min(PIVOTS, max(4, math.isqrt(n) // 4))
    by_dim: dict[int, list] = {}
    for (v,) in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect():
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim in dims:
        vectors = by_dim.get(dim, [[0.0] * dim])
        matrix = np.array(vectors, float).reshape(len(vectors), dim)
        out[dim] = np.concatenate([matrix, np.sqrt(np.maximum(most**2 - (matrix**2).sum(1), 0))[:, None]], axis=1)
    return out


def _grouped(p: np.ndarray, groups: int) -> np.ndarray:
    """The group of each pivot: seeds are chosen one by one, each farthest from those before, and gather what is nearest."""
    seeds, far = [0], np.sqrt(((p - p[0]) ** 2).sum(1))
    while len(seeds) < min(groups, len(p)):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((p - p[seeds[-1]]) ** 2).sum(1)))
    return np.stack([((p - p[i]) ** 2).sum(1) for i in seeds]).argmin(0).astype(np.int32)


def _file(pivots: dict[int, np.ndarray], groups: dict[int, np.ndarray], most: float, dtype):
    """The cell of every row, its group and its distance to the pivot; also those of the row as an anchor, whose last component is 0."""

    def nearest(matrix: np.ndarray, last: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = ((matrix**2).sum(1) + last**2)[:, None] + (p**2).sum(1) - 2 * (matrix @ p[:, :-1].T + last[:, None] * p[:, -1])
        cell = square.argmin(1)
        # Once more by differences, as the sum above cancels where distances are short.
        return cell, np.sqrt(((matrix - p[cell, :-1]) ** 2).sum(1) + (last - p[cell, -1]) ** 2)

    def run(batches):
        for batch in batches:
            n, offsets, flat = batch.num_rows, np.asarray(batch.column("v").offsets), np.asarray(batch.column("v").values)
            lengths = np.diff(offsets)
            out = {"dim": lengths.astype(np.int32), **{c: np.zeros(n, np.int32) for c in ("cell", "home", "a_cell", "grp")}, **{c: np.zeros(n) for c in ("r", "a_r", "norm")}}
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                matrix = flat[offsets[mine][:, None] + np.arange(dim)]
                norm = (matrix**2).sum(1)
                out["norm"][mine] = norm
                out["cell"][mine], out["r"][mine] = nearest(matrix, np.sqrt(np.maximum(most**2 - norm, 0)), pivots[dim])
                out["a_cell"][mine], out["a_r"][mine] = nearest(matrix, np.zeros(len(mine)), pivots[dim])
                out["home"][mine], out["grp"][mine] = groups[dim][out["cell"][mine]], groups[dim][out["a_cell"][mine]]
            packed = kit.packed((flat[offsets[0] : offsets[-1]] + 0.0).astype(dtype), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed, *map(pa.array, out.values())], ["vec_id", "label", "v", *out])

    return run


FILED = "vec_id long, label long, v binary, dim int, cell int, home int, a_cell int, grp int, r double, a_r double, norm double"


def _apart(spark: SparkSession, pivots: dict[int, np.ndarray], groups: dict[int, np.ndarray]) -> DataFrame:
    """dim, a_cell, cell, apart, and the groups of both cells; at most PIVOTS squared rows and one a length."""
    rows = [(dim, i, j, float(d), int(groups[dim][i]), int(groups[dim][j])) for dim, p in pivots.items() for i, row in enumerate(p) for j, d in enumerate(np.sqrt(((p - row) ** 2).sum(1)))]
    return spark.createDataFrame(rows, "dim int, a_cell int, cell int, apart double, grp int, home int")


def _copies(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """rows, copied to each group for which ``ranges`` (keys, grp, low, high) holds their distance to their own pivot."""
    lists = ranges.groupBy(*keys).agg(F.collect_list(F.struct("grp", "low", "high")).alias("ranges"))
    lists = lists.select(F.concat_ws(":", *keys).alias("key"), "ranges")
    rows = rows.drop("grp").withColumn("key", F.concat_ws(":", *keys))
    joined = rows.join(F.broadcast(lists), "key") if ranges.count() * 24 <= BROADCAST_BYTES else kit.spread_join(rows, lists, "key", ["vec_id"])
    within = F.filter("ranges", lambda t: (F.col("r") >= t.low) & (F.col("r") <= t.high))
    return joined.select("dim", "vec_id", "label", "v", F.explode(F.array_distinct(F.transform(within, lambda t: t.grp))).alias("grp"))


def _tiles(names: list[str], rows: int):
    """Pack rows that come sorted by dim, grp and part: up to ``rows`` of one group, 64-bit columns and the vectors as bytes."""

    def run(batches):
        group, held, n = None, [], 0

        def emit(upto):
            nonlocal held, n
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            vectors = [v for h in held for v in h[-1]]
            held, n = ([[*(c[upto:] for c in columns), vectors[upto:]]], n - upto) if upto < n else ([], 0)
            packed = [*(c[:upto].tobytes() for c in columns), b"".join(vectors[:upto])]
            return pa.RecordBatch.from_arrays([*(pa.array([g], pa.int32()) for g in group), *(pa.array([x], pa.binary()) for x in packed)], ["dim", "grp", "part", *names, "matrix"])

        for batch in batches:
            keys = [np.asarray(batch.column(k)) for k in ("dim", "grp", "part")]
            edges = np.flatnonzero(kit.run_starts(*keys))
            for a, b in zip(edges, np.append(edges[1:], batch.num_rows)):
                here = tuple(int(k[a]) for k in keys)
                if here != group and n:
                    yield emit(n)
                group, part = here, batch.slice(a, b - a)
                wide = [np.asarray(part.column(c).flatten() if pa.types.is_list(part.column(c).type) else part.column(c)).astype(np.int64).reshape(b - a, -1) for c in names]
                held.append([*wide, part.column("v").to_pylist()])
                n += b - a
                while n >= rows:
                    yield emit(rows)
        if n:
            yield emit(n)

    return run


def _first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best allowed scores, ties to the smaller id."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    rows, cols = np.nonzero(allowed)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], cols[place < k]


def _meet(wanted: int, dtype):
    """Short lists of each anchor of a tile over a tile of rows: of its label, or for each of its bounds of other labels."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ints = {n: np.frombuffer(row[n], np.int64) for n in ("key", "anchor_id", "a_label", "bounds", "vec_id", "label")}
                bounds = ints["bounds"].reshape(len(ints["key"]), -1, 2)
                a, b = (np.frombuffer(row[m], dtype).astype(np.float64).reshape(len(ints[ids]), dim) for m, ids in (("a_matrix", "key"), ("matrix", "vec_id")))
                scores = vector_search.product(a, b)
                other, same = ints["anchor_id"][:, None] != ints["vec_id"], ints["a_label"][:, None] == ints["label"]
                for p in range(max(1, bounds.shape[1])):
                    allowed = other & ~same & (scores >= bounds[:, p, :1]) & (scores <= bounds[:, p, 1:]) if bounds.shape[1] else other & same
                    at, cols = _first(scores, allowed, ints["vec_id"], wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(ints["key"][at]), pa.array(np.full(len(at), p + 1, np.int32)), pa.array(ints["vec_id"][cols]), pa.array(scores[at, cols])], ["key", "positive", "vec_id", "score"])

    return run


def _join(anchors: DataFrame, copies: DataFrame, wanted: int, n_anchors: int, n_rows: int, dtype) -> DataFrame:
    """key, positive, vec_id, score: short lists of all tiles of anchors over all tiles of rows that were copied to their group.

    Each group's anchors are dealt into ``down`` parts and its rows into ``across``; a tile goes to all cells of its grid row or column.
    """
    down, across = math.ceil(n_anchors / ANCHOR_PART) or 1, math.ceil(n_rows / ROW_PART) or 1
    spark = anchors.sparkSession
    parts = kit.buckets_for(anchors, "anchor_id")

    def tiles(df, deal, n, names, rows):
        dealt = df.withColumn("part", F.pmod(F.xxhash64(deal), F.lit(n)).cast("int")).repartition(parts, "dim", "grp", "part").sortWithinPartitions("dim", "grp", "part")
        return dealt.select("dim", "grp", "part", *names, "v").mapInArrow(kit.lean(_tiles(names, rows)), "dim int, grp int, part int, " + "".join(f"{c} binary, " for c in names) + "matrix binary")

    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    with kit.small_batches(spark):
        left = tiles(anchors, "key", down, ["key", "anchor_id", "a_label", "bounds"], ANCHOR_TILE).withColumnRenamed("matrix", "a_matrix").withColumnRenamed("part", "y").withColumn("x", all_of(across))
        right = tiles(copies, "vec_id", across, ["vec_id", "label"], ROW_TILE).withColumnRenamed("part", "x").withColumn("y", all_of(down))
        return left.hint("shuffle_merge").join(right, ["dim", "grp", "x", "y"]).mapInArrow(kit.lean(_meet(wanted, dtype)), "key long, positive int, vec_id long, score long")


def _ranked(lists: DataFrame, most: int, *keys: str) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= most)


def mine(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``labelled`` vectors."""
    spark = vectors.sparkSession
    held = kit.Durable(spark, "negatives", vectors)
    total = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.collect_set(F.size("v")).alias("dims"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).head()
    most = math.sqrt(total.norm or 0.0)
    if not math.isfinite(most):
        raise OverflowError("a vector's norm is not finite")
    pivots = _pivots(vectors, total.n, total.dims, most)
    groups = {dim: _grouped(p, math.ceil(total.anchors / ANCHOR_TILE)) for dim, p in pivots.items()}
    apart = _apart(spark, pivots, groups)
    dtype = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    rows = held.write(vectors.mapInArrow(kit.lean(_file(pivots, groups, most, dtype)), FILED), "filed")
    slack = F.lit(SLACK * most)

    anchors = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
    anchors = held.write(anchors.select(F.xxhash64("vec_id", "label", "v").alias("key"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), "dim", "a_cell", "grp", "a_r", "norm", "v", F.array().cast("array<long>").alias("bounds")), "anchors")
    n_anchors = anchors.count()

    # Positives: enough rows of the label are proven to lie within `far` of every anchor of the group.
    nearest = rows.groupBy("dim", "label", "cell", "vec_id").agg(F.min("r").alias("r"))
    nearest = nearest.withColumn("__vx_r", F.row_number().over(Window.partitionBy("dim", "label", "cell").orderBy("r", "vec_id"))).filter(F.col("__vx_r") <= POSITIVES + 1)
    near = anchors.groupBy("dim", "a_cell", F.col("a_label").alias("label")).agg(F.max("a_r").alias("reach"))
    proven = near.join(nearest, ["dim", "label"]).join(F.broadcast(apart.drop("grp", "home")), ["dim", "a_cell", "cell"]).withColumn("far", F.col("reach") + F.col("apart") + F.col("r"))
    proven = proven.withColumn("__vx_r", F.row_number().over(Window.partitionBy("dim", "a_cell", "label").orderBy("far"))).filter(F.col("__vx_r") == POSITIVES + 1).select("dim", "a_cell", "label", "far")
    near = near.join(proven, ["dim", "a_cell", "label"], "left").withColumn("wide", F.col("reach") + F.coalesce("far", F.lit(float("inf"))) + slack)
    near = held.write(near.join(F.broadcast(apart), ["dim", "a_cell"]).select("dim", "label", "cell", "grp", (F.col("apart") - F.col("wide")).alias("low"), (F.col("apart") + F.col("wide")).alias("high")), "near")
    copies = _copies(rows, near, ["dim", "label", "cell"])
    positives = held.write(_ranked(_join(anchors, copies, POSITIVES, n_anchors, total.n, dtype).drop("positive"), POSITIVES, "key").select("key", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: from the own group first, then from all cells that the bounds leave.
    hundredth = lambda times, round_: round_(F.col("positive_score").cast("decimal(20,0)") * times / 100).cast("long")
    windows = positives.select("key", "positive", hundredth(LOW, F.ceil).alias("low"), hundredth(HIGH, F.floor).alias("high")).filter("low <= high")
    bounds = windows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("positive", F.array("low", "high")))).alias("w"))
    none = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    bounded = held.write(anchors.drop("bounds").join(bounds, "key").withColumn("bounds", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda i: F.coalesce(F.try_element_at("w", i), none)))).drop("w"), "bounded")
    own = _join(bounded, rows.drop("grp").withColumnRenamed("home", "grp"), NEGATIVES, n_anchors, total.n, dtype)
    first = held.write(_ranked(own, NEGATIVES, "key", "positive"), "first")
    full = first.filter(F.col("rank") == NEGATIVES).select("key", "positive", F.col("score").alias("tenth"))
    distance = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + most**2 - 2 * score))
    needs = windows.join(full, ["key", "positive"], "left").groupBy("key").agg(F.min(F.coalesce("tenth", "low")).alias("least"), F.max("high").alias("most"))
    needs = bounded.join(needs, "key").groupBy("dim", "a_cell").agg(F.max("a_r").alias("reach"), F.max(distance(F.col("least"))).alias("far"), F.min(distance(F.col("most"))).alias("near"))
    ring = needs.join(F.broadcast(apart), ["dim", "a_cell"]).filter("home <> grp").select(
        "dim", "cell", "grp",
        F.greatest(F.col("apart") - F.col("reach") - F.col("far"), F.col("near") - F.col("apart") - F.col("reach")) - slack, F.col("apart") + F.col("reach") + F.col("far") + slack,
    )
    ring = held.write(ring.toDF("dim", "cell", "grp", "low", "high"), "ring")
    rest = _join(bounded, _copies(rows, ring, ["dim", "cell"]), NEGATIVES, n_anchors, total.n, dtype)
    negatives = _ranked(first.drop("rank").unionByName(rest), NEGATIVES, "key", "positive")
    named = anchors.select("key", "anchor_id").join(positives, "key").join(negatives, ["key", "positive"])
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(labelled(kit.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
) WHERE rank <= 10
"""
