"""Inverted file: recall against exact search, pruned partitions, filters, and odd input."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

from verbatrix.operators import ann, dense

FIELDS = "id int, ord int, embedding array<float>, label int"


def clustered(spark, n=1200, dim=16, centres=12, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 4
    own = np.where(rng.random(n) < 0.35, 0, rng.integers(0, centres, n))
    points = middle[own] + rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, i, [float(x) for x in v], int(own[i])) for i, v in enumerate(points)], FIELDS)


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    vectors = clustered(spark)
    return vectors, ann.build(vectors, str(tmp_path_factory.mktemp("ann")) + "/index", lists=16)


def asked(vectors):
    return vectors.filter("id % 40 = 0").selectExpr("id as query_id", "embedding")


def test_few_probes_find_most_and_all_probes_are_exact(filed):
    vectors, index = filed
    queries = asked(vectors)
    exact = dense.search(queries, vectors, 10)
    probes = ann.probes_for(index, queries, 10, 0.95)
    assert probes <= 6
    few = ann.recall(ann.search(index, queries, 10, probes), exact).collect()
    assert len(few) == 30 and sum(r.found for r in few) >= 0.9 * sum(r.wanted for r in few)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(ann.search(index, queries, 10, 16)) == order(exact)
    assert order(ann.search(index, queries, 5, 16, {"label": 3})) == order(dense.search(queries, vectors, 5, {"label": 3}))


def test_every_vector_is_filed_under_its_nearest_centroid(filed):
    vectors, index = filed
    rows = index.lists.collect()
    assert sorted(r.id for r in rows) == list(range(1200)) and index.largest == max(np.bincount([r.list for r in rows]))
    for r in rows:
        d = ((np.array(r.embedding, float) - index.centroids) ** 2).sum(axis=1)
        assert d[r.list] == pytest.approx(d.min()) and r.distance == pytest.approx(d.min(), abs=1e-6)
    assert sum(r.vectors for r in ann.spread(index).collect()) == 1200


def test_unprobed_lists_and_other_labels_are_not_read(filed):
    vectors, index = filed
    out = io.StringIO()
    with redirect_stdout(out):
        ann.search(index, asked(vectors).filter("query_id = 0"), 5, 2, {"label": 3}).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [list#" in plan.replace("isnotnull(list", "list") or "PartitionFilters: [list" in plan
    assert "EqualTo(label,3)" in plan


def test_centroids_do_not_depend_on_partitions(spark):
    vectors = clustered(spark, 300)
    assert np.array_equal(ann.fit(vectors.repartition(7), 6), ann.fit(vectors.coalesce(1), 6))


def test_new_odd_and_no_vectors(spark, tmp_path):
    path = str(tmp_path / "x")
    vectors = clustered(spark, 200)
    first = ann.build(vectors, path, lists=5)
    odd = spark.createDataFrame([(900, 900, None, 1), (901, 901, [1.0, None] * 8, 1), (902, 902, [float("nan")] * 16, 1), (903, 903, [0.0] * 16, 1)], FIELDS)
    ann.write(odd, first.centroids, path, "append")
    index = ann.read(spark, path)
    assert index.lists.count() == 201 and np.array_equal(index.centroids, first.centroids)
    query = spark.createDataFrame([(1, [0.0] * 16), (2, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.id, r.score) for r in ann.search(index, query, 1, 5).collect()] == [(1, 903, 0.0)]
    assert ann.search(index, query.limit(0), 1, 5).collect() == []
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        ann.write(vectors, first.centroids, path)


def test_queries_share_tiles_within_lists(spark, filed):
    vectors, index = filed
    met = []

    def counted(queries, opened, keys, *rest, **named):
        met.append(dense._tiles(queries, dense.QUERY_TILE, "q", "query_id", keys=tuple(keys)).count())
        return plain(queries, opened, keys, *rest, **named)

    plain = dense.meet
    try:
        dense.meet = counted
        ann.search(index, vectors.selectExpr("id as query_id", "embedding"), 5, 16)
    finally:
        dense.meet = plain
    assert met[0] <= 16 * 5


def test_fit_deals_its_sample(spark, monkeypatch):
    vectors = clustered(spark, 900)
    whole = ann.fit(vectors, 6)
    monkeypatch.setattr(ann, "FIT_ROWS", 100)
    assert np.array_equal(ann.fit(vectors, 6), ann.fit(vectors.repartition(7), 6))
    monkeypatch.setattr(ann, "SAMPLE_EACH", 50)
    few = ann.fit(vectors, 6)
    assert few.shape == whole.shape and np.isfinite(few).all()
