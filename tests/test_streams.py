"""Streams that go on from their checkpoints: polls of feeds, and upserts."""

from __future__ import annotations

from loregrain.operators import records
from loregrain.streaming import events

ITEM = "feed_id string, guid string, published_at long, has_transcript boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_polls_go_on(spark, tmp_path):
    landed, path, checkpoint = (str(tmp_path / x) for x in ("landed", "known", "checkpoint"))
    for i, batch in enumerate(([("f", f"d{k:02}", k, k == 15) for k in range(1, 17)], [("f", f"d{k:02}", k, k == 14) for k in range(1, 18)], [("f", "d03", 3, True), ("g", "x", None, False)])):
        spark.createDataFrame(batch, ITEM).coalesce(1).write.mode("append").parquet(landed)
        query = events.poll_sink(spark.readStream.schema(ITEM).parquet(landed), path, checkpoint)
        query.awaitTermination()
        got = rows(spark.read.parquet(path), "feed_id", "guid", "status")
        if i == 0:
            assert got == [("f", "d14", "awaiting_transcript"), ("f", "d15", "queued"), ("f", "d16", "awaiting_transcript")]
        else:
            later = [("f", "d14", "queued"), ("f", "d15", "queued"), ("f", "d16", "awaiting_transcript"), ("f", "d17", "awaiting_transcript")]
            assert got == later + ([("g", "x", "awaiting_transcript")] if i == 2 else [])


def test_upserts_keep_the_latest(spark, tmp_path):
    landed, path, checkpoint = (str(tmp_path / x) for x in ("landed", "rows", "checkpoint"))
    for i, batch in enumerate(([("a", 1), ("b", 1), ("a", 2)], [("a", 1), ("c", 5)])):
        spark.createDataFrame(batch, "k string, v int").coalesce(1).write.mode("append").parquet(landed)
        events.upsert_sink(spark.readStream.schema("k string, v int").parquet(landed), path, ["k"], "v", checkpoint).awaitTermination()
        assert rows(spark.read.parquet(path), "k", "v") == ([("a", 2), ("b", 1)] if i == 0 else [("a", 2), ("b", 1), ("c", 5)])


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    def files():
        return {f for f in (tmp_path / "rows").rglob("*.parquet")}

    put = lambda rows: records.upsert_buckets(spark.createDataFrame(rows, "k long, v int"), str(tmp_path / "rows"), ["k"], "v", 8)
    put([(i, 0) for i in range(100)] + [(5, 1), (5, 0)])
    before = files()
    assert len(put([(7, 3)])) == 1 and len(put([(7, 3)])) == 1 and put([]) == []
    assert len(before - files()) == 1
    assert rows(spark.read.parquet(str(tmp_path / "rows")), "k", "v") == [(i, {5: 1, 7: 3}.get(i, 0)) for i in range(100)]
