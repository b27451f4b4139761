"""Hard negatives: against brute force on clustered, tied and odd vectors."""

import math

import numpy as np
import pytest

from verbatrix.llm import negative_mining, vector_search

FIELDS = "vec_id long, embedding array<double>, label int, extra string, score double"


def expected(rows, every):
    usable = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = sorted({(i, label, tuple(v)) for i, label, v in usable if i % every == 0})
    out = []
    for i, label, v in anchors:
        others = [(-dot(v, w), j, other) for j, other, w in usable if j != i and len(w) == len(v)]
        for score, pos, _ in sorted(x for x in others if x[2] == label)[:5]:
            fit = sorted(x for x in others if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score)[:10]
            out += [(i, pos, rank, neg, -score, -s) for rank, (s, neg, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], FIELDS).repartition(3)
    return sorted(tuple(r) for r in negative_mining.mine(negative_mining.labelled(frame), every).collect())


def clusters(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    own = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 6, n))
    v = centres[own] + spread * rng.normal(size=(n, dim))
    v *= np.where(rng.random(n) < 0.2, 3, 1)[:, None]
    labels = np.where(rng.random(n) < 0.8, own, rng.integers(0, 10, n))
    return [(i, [float(x) for x in v[i]], int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("seed, n, dim, spread", [(0, 900, 8, 0.1), (1, 700, 3, 0.5), (2, 400, 2, 0.0)])
def test_as_brute_force(spark, monkeypatch, seed, n, dim, spread):
    """Many small tiles and grid cells; with no spread, most scores are tied."""
    for name, value in (("ANCHOR_TILE", 4), ("ROW_TILE", 32), ("ANCHOR_PART", 20), ("ROW_PART", 200)):
        monkeypatch.setattr(negative_mining, name, value)
    rows = clusters(seed, n, dim, spread)
    assert mined(spark, rows, 10) == expected(rows, 10)


def test_bounds_leave_cells_out(spark):
    """On vectors in tight clusters most rows are copied to few cells."""
    copied = []
    keep = negative_mining._copies

    def counted(rows, ranges, keys):
        copies = keep(rows, ranges, keys)
        copied.append((copies.count(), rows.count() * ranges.select("grp").distinct().count()))
        return copies

    rows = clusters(3, 2000, 4, 0.01)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(negative_mining, "_copies", counted)
        patch.setattr(negative_mining, "ANCHOR_TILE", 4)
        assert mined(spark, rows, 50) == expected(rows, 50)
    (near, all_near), (ring, all_ring) = copied
    assert near < 0.5 * all_near and ring < all_ring


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(negative_mining, "BROADCAST_BYTES", 0)
    rows = clusters(4, 200, 4, 0.2)
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (510, [1.0, None, 0.0, 0.0], 2), (520, [float("nan")] * 4, 2), (530, [float("inf")] * 4, 2), (540, [0.5] * 4, None)]
    rows += [(600, [0.1, 0.2], 3), (601, [0.1, 0.2], 3), (602, [0.1, 0.1], 4), (610, [], 5), (611, [], 5), (612, [], 6), (620, [0.0] * 4, 7)]
    rows += [rows[10], rows[10], rows[11], rows[11], (20, [0.3] * 4, 1), (630, [9.0, 1.0, 0.0, 0.0], 8), (-30, [9.0, 1.0, 0.0, 0.0], -3)]
    assert mined(spark, rows, 10) == expected(rows, 10)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], 100) == []
    empty = spark.createDataFrame([], FIELDS)
    assert negative_mining.mine(negative_mining.labelled(empty)).collect() == []


def test_scores_that_do_not_fit(spark):
    big = np.full((1, 4), 2.0**40)
    with pytest.raises(OverflowError):
        vector_search.product(big, big)
