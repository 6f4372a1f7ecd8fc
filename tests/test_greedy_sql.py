"""Greedy deduplication: its SQL on chains longer than a few rounds, null keys and empty tables."""

from __future__ import annotations

import duckdb

from loregrain.operators import ingest
from loregrain.plans.oracle import GREEDY, HASHED


def test_sql_follows_a_long_chain(spark):
    # rows share a key with the one before by turns: 0, 2, 4, .. stay
    rows = [(i, f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(25)]
    con = duckdb.connect()
    con.execute("CREATE TABLE chain (doc_id BIGINT, source_url VARCHAR, hash VARCHAR)")
    con.executemany("INSERT INTO chain VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    sql = GREEDY.replace(HASHED, "h AS (SELECT * FROM chain)")
    want = list(range(0, 25, 2))
    assert sorted(r[0] for r in con.execute(sql).fetchall()) == want
    df = spark.createDataFrame(rows, "doc_id long, source_url string, hash string")
    assert sorted(r["doc_id"] for r in ingest.greedy(df, ("source_url", "hash")).collect()) == want


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "h"), (2, "u", "h"), (3, "v", None), (4, "u", "i")], "doc_id long, k string, h string")
    assert [r["doc_id"] for r in ingest.greedy(df, ("k", "h")).collect()] == [2]
    assert ingest.greedy(df.limit(0), ("k", "h")).collect() == []
