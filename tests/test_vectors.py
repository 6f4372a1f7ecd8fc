"""Nearest vectors by pairs of blocks, against all pairs."""

from __future__ import annotations

import numpy as np

from loregrain.operators import keywords

SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def brute(rows, k):
    out = []
    for i, label, e, _ in rows:
        near = []
        for j, other, f, _ in rows:
            if i != j and label == other:
                a, b = np.array(e, dtype="float32").astype(float), np.array(f, dtype="float32").astype(float)
                near.append((-round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 6), j))
        out += [(i, j, place + 1) for place, (_, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_blocks_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(5)
    # half of the vectors are of few values, so that copies and ties cross blocks; label 2 has one vector only
    rows = [(i, 0 if i % 3 else 1, [float(x) for x in (rng.integers(-1, 2, 4) if i % 2 else rng.normal(size=4))], "x") for i in range(90)]
    rows = [r for r in rows if any(r[2])] + [(1000, 2, [1.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (7, 1000):
        found = sorted((r["vec_id"], r["other_id"], r["rank"]) for r in keywords.similar_vectors(df, 5, block).collect())
        assert found == brute(rows, 5)


def test_vectors_without_a_length(spark):
    rows = [(1, 0, [1.0, 0.0], "x"), (2, 0, [2.0], "x"), (3, 0, None, "x"), (4, 0, [], "x"), (5, 0, [0.0, 0.0], "x"), (6, 0, [None, 1.0], "x"), (7, 0, [float("nan"), 1.0], "x"), (8, 0, [float("inf"), 1.0], "x"), (9, None, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in keywords.similar_vectors(df).select("vec_id", "other_id", "score", "rank").collect()) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert keywords.similar_vectors(df.limit(0)).collect() == []


def test_large_groups_cluster_as_small_ones_do_and_shuffle_no_vectors(spark):
    from pyspark.sql import functions as F

    from loregrain.operators import clusters

    told = [(i, f"w{(5 * i + j * j) % 23}", float(1 + (i * j) % 7)) for i in range(90) for j in range(6) if i % 10]
    docs = spark.createDataFrame([(g, i) for g in "ab" for i in range(90)] + [("bare", 0), ("bare", 10)], "grp string, doc_id long")
    weights = spark.createDataFrame(told, "doc_id long, term string, w double")
    long = weights.join(docs, "doc_id")
    for by_group in (False, True):
        rows = clusters.vectors(weights.repartition(3), docs)
        large = clusters.large_clusters(rows, 4, 5, by_group)
        small = clusters.clustered(long, docs, 4, 5, by_group)
        told_of = lambda df: sorted(map(tuple, df.select("grp", "doc_id", "cluster").collect()))
        assert told_of(large) == told_of(small) and len(told_of(large)) == 182
        assert large.where("grp = 'bare'").agg(F.max("cluster")).first()[0] == 0
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
