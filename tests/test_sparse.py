"""Nearest sparse vectors by pairs of blocks, against all pairs."""

from __future__ import annotations

import random

import pytest

from loregrain.operators import keywords, knowledge, sparse


@pytest.mark.parametrize(("block", "tile", "dense"), [(16_384, 1024, 0.05), (9, 4, 0.2), (15, 64, 1.0), (20, 7, 0.0)])
def test_blocks_find_what_all_pairs_give(spark, monkeypatch, block, tile, dense):
    monkeypatch.setattr(sparse, "TILE", tile)
    monkeypatch.setattr(sparse, "DENSE", dense)
    monkeypatch.setattr(keywords, "_near", lambda p, g, k, near=keywords._near: near(p, g, k, block))
    rnd = random.Random(3)
    docs = {i: {f"t{rnd.randrange(12)}": round(rnd.random() * 9 + 0.1, 6) for _ in range(rnd.randrange(6))} for i in range(90)}
    docs |= {i: {"t1": 2.0, "t2": 3.0} for i in range(90, 120)}  # copies, whose ties go by id
    group = {i: None if i == 7 else "large" if i % 4 else "small" for i in docs}
    weights = spark.createDataFrame([(i, t, w) for i, v in docs.items() for t, w in v.items()], "doc_id long, term string, weight double")
    groups = spark.createDataFrame([*group.items()], "doc_id long, grp string")

    def cosine(a, b):
        long = [sum(w * w for w in docs[i].values()) ** 0.5 for i in (a, b)]
        return round(sum(w * docs[b].get(t, 0.0) for t, w in docs[a].items()) / (long[0] * long[1]), 6) if all(long) else 0.0

    want = set()
    for a in docs:
        near = sorted((-s, b) for b in docs if b != a and group[a] and group[a] == group[b] and (s := cosine(a, b)) > 0)
        want |= {(a, b, round(-s, 5), rank) for rank, (s, b) in enumerate(near[:5], 1)}
    pairs = keywords._near(weights, groups, 5)
    assert pairs.count() <= 5 * len(docs) * -(-90 // block)
    got = {(r["doc_id"], r["other_id"], round(r["score"], 5), r["rank"]) for r in keywords.similar(weights, groups).collect()}
    assert got == want


def test_nothing_is_near_in_empty_tables(spark):
    weights = spark.createDataFrame([], "doc_id long, term string, weight double")
    assert keywords.similar(weights, spark.createDataFrame([], "doc_id long, grp string")).collect() == []


def test_terms_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(1, "B the b a1b"), (2, None), (3, "ÄBc Éa"), (None, "x")], "doc_id long, body string")
    counts = keywords.term_counts(docs)
    assert sorted((r["doc_id"] or 0, r["term"], r["tf"]) for r in counts.collect()) == [(0, "x", 1), (1, "b", 3), (3, "bc", 1)]
    assert "Aggregate" not in counts._sc._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "formatted")
    twice = keywords.term_counts(docs.unionByName(docs.where("doc_id = 1")))
    assert sorted((r["doc_id"] or 0, r["term"], r["tf"]) for r in twice.collect()) == [(0, "x", 1), (1, "b", 6), (3, "bc", 1)]


def test_rows_of_users_and_units_are_not_shuffled(spark):
    users = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    units = spark.createDataFrame([("topic:1", 1, 10, "a"), ("topic:1", 1, 10, "b"), ("kw:a", 1, 10, "a"), ("kw:c", 2, 20, "c")], "knowledge_id string, topic_id long, doc_id long, term string")
    known = spark.createDataFrame([(1, "a"), (1, "z")], "user_id long, term string")
    topics = spark.createDataFrame([(1, 1), (2, 2), (2, 9)], "user_id long, topic_id long")
    reads = spark.createDataFrame([(1, 20), (2, 30)], "user_id long, doc_id long")
    got = knowledge.classified(users, units, known, topics, reads)
    told = {(r["user_id"], r["knowledge_id"]): (r["n_terms"], r["n_matched"], r["in_topic"], r["seen"], r["status"]) for r in got.collect()}
    assert len(told) == 9 and told[1, "topic:1"] == (2, 1, True, False, "known") and told[1, "kw:c"] == (1, 0, False, True, "new")
    assert told[2, "kw:c"] == (1, 0, True, False, "refine") and told[None, "kw:a"] == (1, 0, False, False, "new")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = knowledge.scored(got, spark.createDataFrame([(10, True), (20, False)], "doc_id long, reliable boolean"))
        plan = scores._sc._jvm.PythonSQLUtils.explainString(scores._jdf.queryExecution(), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan[: plan.index("BroadcastNestedLoopJoin")]


def test_counting_holds_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from loregrain.operators.keywords import _counted

    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(4000)], "text": pa.array(["word " * 2000] * 4000)})
    tracemalloc.start()
    rows = sum(len(b) for b in _counted([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 15_000_000
