"""Neighbours in splits that come one after the other, from vectors of numbered terms, against splits made all at once from rows of documents and terms."""

from __future__ import annotations

import functools
import os
import random

import pytest
from pyspark.sql import functions as F

from loregrain.operators import clusters, keywords


@pytest.mark.parametrize(("common", "at_once", "in_task"), [(200_000, 10**9, 10**9), (40, 1, 0), (40, 1, 300)])
def test_splits_in_turn_find_the_same_and_leave_little(spark, monkeypatch, common, at_once, in_task):
    rnd = random.Random(5)
    texts = [" ".join(f"w{chr(97 + int(rnd.paretovariate(0.7)) % 26)}{chr(97 + rnd.randrange(4))}" for _ in range(rnd.randrange(1, 30))) for _ in range(140)]
    # copies, one of them twice as long, texts without terms, none at all, and a document without an id
    texts += ["alpha beta beta"] * 30 + ["alpha beta beta alpha beta beta", "", None, "7 8"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "alpha")], "doc_id long, body string")
    split = {"most": 20, "fan": 3, "depth": 2, "rounds": 4}
    weights = keywords.tfidf(docs)
    groups = clusters.split_groups(clusters.unit_weights(weights), docs.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("grp"), "doc_id"), **split)
    want = sorted(map(tuple, keywords.similar_in_any(weights, groups, 4).collect()))
    monkeypatch.setattr(keywords, "Numbered", functools.partial(keywords.Numbered, common=common))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: {d: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(os.path.join(folder, d)) for f in names) for d in os.listdir(folder)}
    before = size()
    got = sorted(map(tuple, keywords.similar_in_splits(docs, 2, 4, at_once, **split, in_task=in_task).collect()))
    assert len(want) > 500 and got == want
    left = {d.rsplit("-", 5)[0] for d in size().keys() - before.keys()}
    assert not left & {"vectors", "numbered", "terms", "common-terms", "split-groups", "weights"} and not any(d.startswith("centres") for d in left)


def test_numbers_of_ids_that_come_twice_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "b a a"), (1, "a c"), (2, "c"), (3, None)], "doc_id long, body string")
    rows = {r["doc_id"]: (r["terms"], r["tf"]) for r in keywords.Numbered(docs).rows.collect()}
    assert rows[1] == ([0, 1], [1, 1]) and rows[2] == ([0], [1])  # c, b; a is a stop word
    assert keywords.similar_in_splits(docs.where("false"), 2).collect() == []


def test_a_finished_write_leaves_no_shuffle_files(spark):
    from loregrain.sources import tables

    seen = []
    with tables.shuffles_removed(spark):
        seen.append(spark.conf.get(tables.CLEANUP))
    assert seen == ["true"] and spark.conf.get(tables.CLEANUP) == "false"
