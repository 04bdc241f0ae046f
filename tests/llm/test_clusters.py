import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold.llm import clusters


def plain(ids, x, k=16, rounds=3):
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), tuple(v)) for i, v in zip(ids, x.tolist()) if i is not None)[:k]
    c = np.array([v for _, v in start])
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        which = d.argmin(axis=1)
        if r < rounds:
            c = np.array([x[which == j].sum(axis=0) // max(1, (which == j).sum()) if (which == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(x)), which]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((i, int(w), int(b), int(best[which == w].sum()), int(best.sum()), sha[w]) for i, w, b in zip(ids, which, best)), key=repr)


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_walk_finds_the_nearest_with_ties(d):
    rng = np.random.default_rng(d)
    for k in (1, 2, 7, 40):
        c, x = rng.integers(-6, 7, (k, d)), rng.integers(-9, 10, (200, d))
        c = np.concatenate([c, c[:1]])                       # an equal centroid of larger number
        which, best = clusters.Walk(c).nearest(x)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (which == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_walk_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    c = np.arange(0, 64000, 1000)[:, None] + rng.integers(0, 9, (64, 4))
    walk = clusters.Walk(c)
    walk.nearest(c + 3)
    assert walk.depth < 5


def test_clusters_against_brute_force_with_awkward_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[100:180] = x[100]                                      # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[9].tolist()), (None, x[4].tolist())]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] + [1.0] * 63), (905, [None] + [1.0] * 63), (906, [1.0] * 65)]
    df = (spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
          .withColumn("cluster", F.lit("clash")).withColumn("inertia", F.lit(0)).withColumn("v", F.lit(0)))
    got = sorted((tuple(r) for r in clusters.clusters(clusters.integer_vectors(df)).collect()), key=repr)
    v = np.floor(64 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    assert got == plain([r[0] for r in rows], v)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(i, [0.5 * i] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert [r["distance"] for r in clusters.clusters(clusters.integer_vectors(df)).collect()] == [0, 0, 0]
    out = clusters.clusters(clusters.integer_vectors(df.limit(0)))
    assert out.collect() == [] and out.columns[0] == "vec_id"


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component beyond"):
        clusters.integer_vectors(df).collect()
