"""Versioned collections: what readers see while and after they change, and when an index is stale."""

import pytest
from pyspark.sql import functions as F

from verbatrix.operators import sparse
from verbatrix.providers import HashedEmbedder
from verbatrix.sources import store

TEXTS = ["the cat sat on the mat", "dogs chase cats", "plums and pears", "rivers run to the sea"]


def frame(spark, texts):
    rows = [(i, i, t, "acme", "10-K", "FY2025", None, "s", None, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, ord int, text string, company string, form string, period string, section string, strategy string, kind string, block_id string")


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "collection")
    store.write_collection(frame(spark, TEXTS), HashedEmbedder(), where)
    return where


def test_a_replaced_chunk_of_equal_count_is_stale(spark, path):
    store.write_sparse(spark, path)
    store.write_vectors(spark, path, lists=2)
    assert store.read_sparse(spark, path).postings.count() > 0 and store.read_vectors(spark, path).lists.count() == 4
    store.write_collection(frame(spark, [*TEXTS[:3], "rivers run to the lake"]), HashedEmbedder(), path, replace=True)
    assert store.manifest(spark, path).chunks == 4
    for read in (store.read_sparse, store.read_vectors):
        with pytest.raises(store.StaleIndex):
            read(spark, path)
    assert store.read_sparse(spark, path, rebuild=True).postings.filter("term = 'lake'").count() == 1
    store.write_collection(frame(spark, TEXTS), HashedEmbedder(), path, replace=True)
    assert store.manifest(spark, path).fingerprint == store.manifest(spark, path, 1).fingerprint


def test_readers_see_the_old_version_during_a_rebuild(spark, path, monkeypatch):
    store.write_sparse(spark, path)
    before = store.read_collection(spark, path)
    seen = []

    def late(*args):
        seen.append((store.manifest(spark, path).version, sorted(r.text for r in store.read_collection(spark, path).collect()), store.read_sparse(spark, path).terms.count()))
        return commit(*args)

    commit = store.commit
    monkeypatch.setattr(store, "commit", late)
    store.write_collection(frame(spark, ["all new"]), HashedEmbedder(), path, replace=True)
    assert seen == [(2, sorted(TEXTS), seen[0][2])] and seen[0][2] > 5
    assert [r.text for r in store.read_collection(spark, path).collect()] == ["all new"]
    # A frame that was opened before still reads its own version, as does a reader who names it.
    assert before.count() == 4 and store.read_collection(spark, path, 1).count() == 4


def test_a_crash_leaves_the_old_version(spark, path, monkeypatch):
    class Breaks(HashedEmbedder):
        def embed(self, texts):
            raise RuntimeError("out of memory")

    with pytest.raises(Exception, match="out of memory"):
        store.write_collection(frame(spark, ["x"]), Breaks(), path, append=True)
    monkeypatch.setattr(sparse, "build", lambda chunks: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        store.write_sparse(spark, path)
    assert store.versions(spark, path) == [1] and store.read_collection(spark, path).count() == 4
    assert store.vacuum(spark, path) != [] and store.read_collection(spark, path).count() == 4


def test_append_versions_and_vacuum(spark, path):
    store.write_collection(frame(spark, ["one more"]).withColumn("id", F.lit(9)), HashedEmbedder(), path, append=True)
    assert store.read_collection(spark, path).count() == 5 and store.read_collection(spark, path, 1).count() == 4
    store.write_collection(frame(spark, ["new"]), HashedEmbedder(), path, replace=True)
    assert store.vacuum(spark, path, keep=2) == [] and store.versions(spark, path) == [2, 3]
    assert len(store.vacuum(spark, path, keep=1)) == 2 and store.read_collection(spark, path).count() == 1
    with pytest.raises(FileExistsError):
        store.write_collection(frame(spark, ["new"]), HashedEmbedder(), path)
    with pytest.raises(ValueError):
        store.write_collection(frame(spark, []), HashedEmbedder(), path, replace=True)


def test_two_writers_of_one_version(spark, path):
    now = store.manifest(spark, path)
    store.write_sparse(spark, path)
    with pytest.raises(store.ConcurrentChange):
        store.commit(spark, path, store.Manifest(now.version + 1))


def test_cost_without_work(spark):
    row = store.build_cost(frame(spark, ["a" * 4000, "b" * 4000])).head()
    assert (row.chunks, row.chars, row.tokens) == (2, 8000, 2000.0) and row.dollars == pytest.approx(2000 / 1e6 * 0.02)
