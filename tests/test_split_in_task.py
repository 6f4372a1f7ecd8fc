"""Groups that one task can hold are split there, as rounds over all tasks split them."""

from __future__ import annotations

import os

import numpy as np

from loregrain.operators import clusters


def test_small_groups_are_split_without_rounds_and_alike(spark):
    rng = np.random.default_rng(3)
    docs = [(g, i) for g in ("a", "b") for i in range(150)] + [("c", i) for i in range(60)]
    # copies, vectors without weights, and one of another length
    weights = [(i, f"t{int(t)}", float(rng.integers(1, 9))) for i in range(140) for t in {*rng.integers(0, 12, 4), i % 3}] + [(i, "same", 2.0) for i in range(1000, 1100)]
    docs += [("d", i) for i in range(1000, 1100)]
    weights, docs = spark.createDataFrame(weights, "doc_id long, term string, w double"), spark.createDataFrame(docs, "grp string, doc_id long")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    rounds = lambda: sum(name.startswith("centres-") for name in os.listdir(folder))
    split = lambda **more: sorted(map(tuple, clusters.split_groups(weights, docs, most=20, fan=3, depth=2, rounds=4, **more).collect()))
    before = rounds()
    got = split()
    assert rounds() == before
    for bound in (0, 500):
        assert got == split(in_task=bound)
    assert rounds() > before
    assert len(got) == 460
