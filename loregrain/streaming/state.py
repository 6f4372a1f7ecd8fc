"""Streams with state by key: polls of feeds, retries with timers and rate limits, each as Spark keeps it between micro-batches.

State lives in RocksDB beside the checkpoint, so a restarted query goes on where it was, on whatever machines. ``keyed_state`` sets the
provider, which has to be done before a query starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ITEM = "feed_id string, guid string, published_at long, has_transcript boolean, at long"
CHANGE = "feed_id string, guid string, published_at long, status string, change string, poll long"
ATTEMPT = "item string, seq long, status string, attempts int, at long, cause string"


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class FeedPolls(StatefulProcessor):
    """Of each feed the number of polls and the newest date; of each known item its date and status."""

    def __init__(self, first: int, later: int):
        self.first, self.later = first, later

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.feed = handle.getValueState("feed", "polls long, newest long")
        self.known = handle.getMapState("known", "guid string", "published_at long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        polls, cutoff = self.feed.get() if self.feed.exists() else (0, None)
        seen: dict[str, Row] = {}
        for row in rows:
            # an item that comes twice in a poll counts once, as the feed has it first
            if row["guid"] is not None and (row["guid"] not in seen or _place(row) < _place(seen[row["guid"]])):
                seen[row["guid"]] = row
        newest = cutoff
        for row in heapq.nsmallest(self.later if polls else self.first, seen.values(), key=_newest_first):
            guid, published = row["guid"], row["published_at"]
            old = self.known.getValue((guid,)) if self.known.containsKey((guid,)) else None
            if old is None:
                if cutoff is not None and published is not None and published < cutoff:
                    continue
                if published is not None and (newest is None or published > newest):
                    newest = published
                status, change = "queued" if row["has_transcript"] else "awaiting_transcript", "new"
            elif old[1] == "awaiting_transcript" and row["has_transcript"]:
                published, status, change = old[0], "queued", "queued"
            else:
                continue
            self.known.updateValue((guid,), (published, status))
            yield Row(feed_id=key[0], guid=guid, published_at=published, status=status, change=change, poll=polls)
        self.feed.update((polls + 1, newest))

    def close(self) -> None:
        pass


def _place(row: Row) -> tuple:
    return row["at"] is None, row["at"] or 0


def _newest_first(row: Row) -> tuple:
    return row["published_at"] is None, -(row["published_at"] or 0), *_place(row), row["guid"]


def polled_changes(items: DataFrame, first: int = 3, later: int = 100) -> DataFrame:
    """What each micro-batch of feed items (ITEM) changes, as rows of CHANGE; a micro-batch is a poll.

    A feed's first poll takes its ``first`` newest items, later ones up to ``later``. Items that are not known and older than the newest known
    one of their feed are left out, by the state before the poll; those without a date, or as new, come in. Known items that wait for a
    transcript and have one now are queued. A poll's items of one feed are held in memory together, known ones are not. Items without a guid are left out.
    """
    keyed_state(items.sparkSession)
    return items.groupBy("feed_id").transformWithState(FeedPolls(first, later), outputStructType=CHANGE, outputMode="Update", timeMode="None")


class Retries(StatefulProcessor):
    """Of each item its status, its attempts and when the next one is due, with a timer for that."""

    def __init__(self, wait_ms: int, attempts: int):
        self.wait_ms, self.attempts = wait_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "seq long, status string, attempts int, retry_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.item.get() if self.item.exists() else None
        for _, _, kind, at in sorted((r["at"], r["event_id"], r["kind"], r["at"]) for r in rows if r["kind"] in ("failed", "ready", "manual")):
            seq, status, attempts, retry_at = held or (0, "queued", 0, None)
            if retry_at is not None:
                self.handle.deleteTimer(retry_at)
                if retry_at <= at:  # the timer was due before this row, in the same micro-batch
                    seq += 1
                    yield self._row(key, seq, "queued", attempts, retry_at, "timer")
            retry_at = None
            if kind == "failed":
                attempts += 1
                status = "failed"
                if attempts < self.attempts:
                    retry_at = at + self.wait_ms
                    self.handle.registerTimer(retry_at)
            elif kind == "manual":
                status, attempts = "queued", 0
            else:
                status = "ready"
            held = seq + 1, status, attempts, retry_at
            yield self._row(key, seq + 1, status, attempts, at, kind)
        if held:
            self.item.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, _, attempts, retry_at = self.item.get()
        if retry_at == expiredTimerInfo.getExpiryTimeInMs():
            self.item.update((seq + 1, "queued", attempts, None))
            yield self._row(key, seq + 1, "queued", attempts, retry_at, "timer")

    @staticmethod
    def _row(key, seq, status, attempts, at, cause) -> Row:
        return Row(item=key[0], seq=seq, status=status, attempts=attempts, at=at, cause=cause)

    def close(self) -> None:
        pass


def retried(outcomes: DataFrame, wait_ms: int = 300_000, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """The course of items as rows of ATTEMPT: outcomes are (item, event_id, kind, ts), kind being failed, ready or manual; rows of other kinds only move the clock.

    A failed item is queued again ``wait_ms`` after its failure, by a timer on the stream's own time, at most ``attempts`` - 1 times; a transcript that a user gives
    (manual) queues it and starts its attempts anew. Rows of one item in a micro-batch take effect in the order of ts, event_id.
    """
    keyed_state(outcomes.sparkSession)
    timed = outcomes.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    # rows that only move the clock have done so here; a condition on ts stays above the watermark
    timed = timed.where(F.when(F.col("kind").isin("failed", "ready", "manual"), F.col("ts")).isNotNull())
    return timed.groupBy("item").transformWithState(Retries(wait_ms, attempts), outputStructType=ATTEMPT, outputMode="Update", timeMode="EventTime")


def rate_limited(requests: DataFrame, key: str, time: str, limit: int = 20, width: str = "1 minute") -> DataFrame:
    """(key, start, n) of windows in which a key has asked more often than limit so far, in update mode.

    A window's state goes when a second one of the same width is over: rows as late as ``width`` still count.
    """
    counts = requests.withWatermark(time, width).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Runs a stream over what is there now; each micro-batch's rows go to their own folder, which one that comes again overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def landed_in_turn(batches: list[DataFrame], flow: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Lands batches one after the other and runs flow on each from the checkpoint before it, as a scheduled job does; all rows that came out.

    Batches are read by their schema, so it has to be the same for all of them.
    """
    spark, schema = batches[0].sparkSession, batches[0].schema
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        out = flow(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        to_folder(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
