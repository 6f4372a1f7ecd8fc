"""Streams with state by key: polls, retries and rate limits across restarts, with a clock that the test sets."""

from __future__ import annotations

from datetime import UTC, datetime

from loregrain.streaming import state

OUTCOME = "item string, event_id long, kind string, ts timestamp"


def poll(spark, folder, rows):
    """The changes that one poll brings, by a query that is started anew."""
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], state.ITEM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    changes = state.polled_changes(spark.readStream.schema(state.ITEM).parquet(f"{folder}/in"))
    done = state.to_folder(changes, f"{folder}/out", f"{folder}/checkpoint").lastProgress
    rows = spark.read.schema(state.CHANGE).parquet(f"{folder}/out/v={done['batchId']}").collect()
    return sorted((r["feed_id"], r["guid"], r["status"], r["change"], r["poll"]) for r in rows)


def test_polls_by_feed(spark, tmp_path):
    folder = str(tmp_path)
    first = [("f", f"d{k:02}", k, k == 15) for k in range(1, 17)] + [("f", "d16", 16, True), ("g", None, 1, False)]
    assert poll(spark, folder, first) == [("f", "d14", "awaiting_transcript", "new", 0), ("f", "d15", "queued", "new", 0), ("f", "d16", "awaiting_transcript", "new", 0)]
    # d13 is late and unseen, d16 as new as the newest, d17 comes twice, d00 has no date
    second = [("f", f"d{k:02}", k, k == 14) for k in range(1, 18)] + [("f", "d17", 17, True), ("f", "e16", 16, False), ("f", "d00", None, False)]
    assert poll(spark, folder, second) == [("f", "d00", "awaiting_transcript", "new", 1), ("f", "d14", "queued", "queued", 1), ("f", "d17", "awaiting_transcript", "new", 1), ("f", "e16", "awaiting_transcript", "new", 1)]
    assert poll(spark, folder, [("f", "d03", 3, True), ("f", "d17", 17, True), ("f", "d17", 17, True), ("g", "x", None, False)]) == [("f", "d17", "queued", "queued", 2), ("g", "x", "awaiting_transcript", "new", 1)]
    assert poll(spark, folder, [("f", "d17", 17, False)]) == []


def test_retries_by_timer(spark, tmp_path):
    folder = str(tmp_path)

    def at(minute: float) -> datetime:
        return datetime.fromtimestamp(1_800_000_000 + 60 * minute, UTC)

    n = 0

    def run(*rows):
        nonlocal n
        spark.createDataFrame([(item, n + i, kind, at(m)) for i, (item, kind, m) in enumerate(rows)], OUTCOME).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        n += len(rows)
        course = state.retried(spark.readStream.schema(OUTCOME).parquet(f"{folder}/in"))
        state.to_folder(course, f"{folder}/out", f"{folder}/checkpoint")
        rows = spark.read.schema(state.ATTEMPT).option("recursiveFileLookup", "true").parquet(f"{folder}/out").collect()
        latest = {r["item"]: r for r in sorted(rows, key=lambda r: r["seq"])}
        return {i: (r["status"], r["attempts"], r["cause"]) for i, r in latest.items()}

    assert run(("a", "failed", 0), ("b", "failed", 3), ("c", "ready", 4)) == {"a": ("failed", 1, "failed"), "b": ("failed", 1, "failed"), "c": ("ready", 0, "ready")}
    # five minutes later the timer of a is due, b's isn't; the clock moves by a row of no kind
    assert run(("z", "clock", 5)) == {"a": ("queued", 1, "timer"), "b": ("failed", 1, "failed"), "c": ("ready", 0, "ready")}
    # a fails twice more: the third time is the last; b is done before its timer
    assert run(("b", "ready", 7), ("a", "failed", 6), ("a", "failed", 12)) == {"a": ("failed", 3, "failed"), "b": ("ready", 1, "ready"), "c": ("ready", 0, "ready")}
    assert run(("z", "clock", 60))["a"] == ("failed", 3, "failed")
    assert run(("a", "manual", 61), ("a", "failed", 62))["a"] == ("failed", 1, "failed")
    assert run(("z", "clock", 67))["a"] == ("queued", 1, "timer")


def test_rate_limits_forget(spark, tmp_path):
    folder, rows_held = str(tmp_path), []

    def run(*rows):
        made = [(who, datetime.fromtimestamp(1_800_000_000 + s, UTC)) for who, s in rows]
        spark.createDataFrame(made, "who string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        over = state.rate_limited(spark.readStream.schema("who string, ts timestamp").parquet(f"{folder}/in"), "who", "ts", 2)
        done = state.to_folder(over, f"{folder}/out", f"{folder}/checkpoint").lastProgress
        rows_held.append(done["stateOperators"][0]["numRowsTotal"])
        rows = spark.read.schema(over.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out").collect()
        return sorted((r["who"], r["start"].timestamp() - 1_800_000_000, r["n"]) for r in rows)

    assert run(("a", 0), ("a", 10), ("b", 20)) == []
    assert run(("a", 59), ("b", 61)) == [("a", 0, 3)]  # the third within the minute
    assert run(("b", 62), ("b", 63), ("a", 300)) == [("a", 0, 3), ("b", 60, 3)]
    assert rows_held[-1] == 1  # two windows later all that is over has been forgotten


def test_rows_that_only_move_the_clock_reach_no_state(spark):
    from pyspark.sql import functions as F

    told = spark.readStream.format("rate").load().select(F.lit("a").alias("item"), F.col("value").alias("event_id"), F.lit("clock").alias("kind"), F.col("timestamp").alias("ts"))
    plan = state.retried(told)._jdf.queryExecution().analyzed().toString()
    kept, clock = plan.index("Filter"), plan.index("EventTimeWatermark")
    assert plan.index("TransformWithState") < kept < clock
