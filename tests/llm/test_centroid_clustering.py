import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsight.llm import centroid_clustering as cc


def brute(rows, dims, k, rounds):
    """(vec_id, cluster, distance) in Python integers; rows of (vec_id, components)."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in first[:k]]
    if not c:
        return [], c

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, row)), n) for n, row in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for o, (_, v) in zip(own, kept) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cc, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0] * 5), (103, [1.0] * 7), (104, [None] + [1.0] * 5),
             (105, [float("nan")] + [0.0] * 5), (106, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (None, [0.5] * 6),
             (5, rows[5][1]), (5, rows[5][1]), (107, rows[5][1]), (7, [9.0] * 6), (108, [1e6] + [0.0] * 5)]
    got, centroids = cc.cluster_vectors(frame(spark, rows), dimensions=6, clusters=4, rounds=5, block_columns=4)
    want, c = brute([(i, v) for i, v in rows], 6, 4, 5)
    assert centroids.tolist() == c
    same(got, want)


def test_too_few_vectors(spark):
    rows = [(1, [0.25, 0.5]), (2, [0.25, 0.5])]
    got, centroids = cc.cluster_vectors(frame(spark, rows), dimensions=2, clusters=5, rounds=3)
    assert len(centroids) == 2
    same(got, [(1, 0, 0), (2, 0, 0)])           # a tie goes to the smaller number; the other cluster stays empty
    for none in ([], [(None, [0.25, 0.5])], [(1, None)]):
        assert cc.cluster_report(frame(spark, none), dimensions=2).count() == 0


def test_numbers_beyond_64_bits_are_an_error(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.0])]
    with pytest.raises(Exception, match="64 bits|too large|OverflowError"):
        cc.cluster_vectors(frame(spark, rows), dimensions=2, clusters=1, rounds=1)


def test_blocks_do_not_change_the_result(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a = cc.cluster_report(vectors, rounds=3).orderBy("vec_id").collect()
    b = cc.cluster_report(vectors.repartition(5), rounds=3, block_columns=9).orderBy("vec_id").collect()
    assert a == b and len(a) == vectors.where(F.size("embedding") == 64).count()
