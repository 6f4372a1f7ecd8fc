"""Cuckoo filters, and indexes of lines through insertions, deletions and clashing columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from loregrain.llm import line_dedup


def test_filter_knows_its_keys():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, 20_000, dtype=np.int64).astype(np.uint64))
    cuckoo = line_dedup.CuckooFilter.for_keys(len(keys))
    assert cuckoo.add(keys[:15_000]) and cuckoo.has(keys[:15_000]).all()
    assert cuckoo.has(keys[15_000:]).mean() < 0.01
    assert cuckoo.add(keys[15_000:]) and cuckoo.has(keys).all()
    cuckoo.discard(keys[:10_000])
    assert cuckoo.has(keys[10_000:]).all() and cuckoo.has(keys[:10_000]).mean() < 0.01
    assert (line_dedup.CuckooFilter.of_bytes(cuckoo.to_bytes()).buckets == cuckoo.buckets).all()


def counted(index) -> Counter:
    return Counter({(r["hi"], r["lo"]): r["n_docs"] for r in index.refs.collect()})


def holds(index) -> None:
    """Every key of refs is in its shard's filter."""
    filters = {r["shard"]: line_dedup.CuckooFilter.of_bytes(bytes(r["cuckoo"])) for r in index.filters.collect()}
    for r in index.refs.collect():
        assert filters[r["shard"]].has(np.array([r["lo"]], np.int64).astype(np.uint64)).all()


@pytest.mark.parametrize("per_shard", [10, 500_000])
def test_insert_and_delete(spark, monkeypatch, per_shard):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", per_shard)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old = frame([(i, f"a\nline {i % 7}\nonly {i}") for i in range(20)])
    new = frame([(100 + i, f"A \nline {i}\nmore {i}") for i in range(25)] + [(None, None)])
    index = line_dedup.build_index(old)
    both = line_dedup.add_documents(index, new)
    assert counted(both) == counted(line_dedup.build_index(old.unionByName(new)))
    holds(both)
    back = line_dedup.delete_documents(both, new)
    assert counted(back) == counted(index)
    holds(back)
    gone = line_dedup.delete_documents(back, old)
    assert gone.refs.count() == 0
    for r in gone.filters.collect():
        assert not line_dedup.CuckooFilter.of_bytes(bytes(r["cuckoo"])).buckets.any()


def test_lines_of_a_larger_index_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x\ny", "d", 1, None), (None, "x\nz", "d", 1, "t"), (None, "x\nz", "d", 1, "t")], "doc_id long, text string, `drop` string, gone int, row string")
    others = spark.createDataFrame([(i, "x") for i in range(10, 20)], "doc_id long, text string")
    index = line_dedup.build_index(docs.select("doc_id", "text").unionByName(others))
    got = line_dedup.dedup_lines(docs, index, min_docs=10)
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == ["y", "z", "z"]
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs, min_docs=10).collect()) == ["x\ny", "x\nz", "x\nz"]


def test_false_positives_own_their_marks(spark, monkeypatch):
    """Filters that take every key for known: what comes in and goes out again must leave them as they were."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.build_index(frame([(i, f"line {i}") for i in range(60)]))
    added = frame([(1000 + i, f"other {i}") for i in range(400)])
    monkeypatch.setattr(line_dedup, "maybe_known", lambda k, f: k.withColumn("maybe", line_dedup.F.lit(True)))
    both = line_dedup.add_documents(index, added)
    monkeypatch.undo()
    holds(both)
    back = line_dedup.delete_documents(both, added)
    holds(back)
    assert counted(back) == counted(index)
    more = frame([(2000 + i, "\n".join(f"line {j}" for j in range(60))) for i in range(9)])
    full = line_dedup.add_documents(back, more)
    assert set(counted(full).values()) == {10} and len(counted(full)) == 60
    docs = frame([(1, "line 1\nown"), (2, "line 59")])
    texts = lambda i: sorted(r["text"] for r in line_dedup.dedup_lines(docs, i, min_docs=10).collect())
    assert texts(full) == ["", "own"]
