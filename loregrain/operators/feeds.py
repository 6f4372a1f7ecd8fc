"""Transcripts, upserts, subscriptions, late data and quotas, each as the batch form of the incremental rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(texts: DataFrame, key: str, size: int = 800) -> DataFrame:
    """(key, segment_id, text): slices of size characters of the stripped text."""
    plain = texts.select(key, F.trim("text").alias("text")).where("text <> ''")
    starts = F.sequence(F.lit(0), ((F.length("text") - 1) / size).cast("int"))
    return plain.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))).alias("segment_id", "text"))


def in_order(segments: DataFrame, key: str, place: str = "segment_id") -> DataFrame:
    """(key, segments): each transcript's segments as structs in their order. Transcripts are bounded (``contract.TRANSCRIPT``), so lists are too."""
    rest = [c for c in segments.columns if c not in (key, place)]
    return segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place, *rest))).alias("segments"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def notified(episodes: DataFrame, subscriptions: DataFrame, sent: DataFrame, parts: int = 16, tile: int = 128) -> DataFrame:
    """(user_id, episode_id): ready episodes for those who subscribed before, less what was sent.

    The result has a row for each subscriber and episode of a feed, so all else is settled before the join that makes these, and they are not shuffled after
    it: an episode takes along whom it was sent to, and a feed's episodes are dealt into parts. Only where an episode is in several feeds, rows are compared once more.

    A part's episodes come in tiles of ``tile``, by readiness, and a tile goes to one subscriber after the other: columns of long runs and of short sequences
    that come again and again, which Parquet's encodings make small. Tasks are so many that a file's dictionary holds its users.
    """
    told = sent.groupBy("episode_id").agg(F.collect_set("user_id").alias("told"))
    ready = episodes.groupBy("feed_id", "episode_id").agg(F.max("ready_at").alias("ready_at"))
    several = not ready.groupBy("episode_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    since = subscriptions.groupBy("user_id", "feed_id").agg(F.min("created_at").alias("created_at"))
    n = max(2 * since.sparkSession.sparkContext.defaultParallelism, since.count() * parts // 30_000)
    ready = ready.join(told, "episode_id", "left").withColumn("part", F.pmod(F.xxhash64("episode_id"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("feed_id", "part").orderBy("ready_at", "episode_id"))
    one = F.struct("ready_at", "episode_id", "told").alias("e")
    tiles = ready.where("ready_at is not null").repartition(n, "feed_id", "part").select("feed_id", "part", F.floor((place - 1) / tile).alias("tile"), one)
    tiles = tiles.groupBy("feed_id", "part", "tile").agg(F.array_sort(F.collect_list("e")).alias("es"), F.max("e.ready_at").alias("last"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    follower = since.select("user_id", "feed_id", "created_at", each).repartition(n, "feed_id", "part")
    pairs = tiles.hint("merge").join(follower, ["feed_id", "part"]).where("created_at <= last").select("user_id", "created_at", F.explode("es").alias("e"))
    due = pairs.where("created_at <= e.ready_at and not coalesce(array_contains(e.told, user_id), false)").select("user_id", "e.episode_id")
    return due.distinct() if several else due


def on_time(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items that are not older than the newest known one of their feed, or are known themselves; without a date they pass."""
    newest = known.groupBy("feed_id").agg(F.max("published_at").alias("cutoff"))
    own = known.select("feed_id", "guid", F.lit(True).alias("old")).distinct()
    joined = items.join(newest, "feed_id", "left").join(own, ["feed_id", "guid"], "left")
    return joined.where("cutoff is null or published_at is null or published_at >= cutoff or old").drop("cutoff", "old")


def retry_due(items: DataFrame, now: int, attempts: int = 3) -> DataFrame:
    return items.where((F.col("status") == "queued") | ((F.col("status") == "failed") & (F.col("attempts") < attempts) & (F.col("retry_at") <= now)))


def within_quota(rows: DataFrame, user: str, item: str, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` different items of each user; repeats take no place."""
    first = rows.groupBy(user, item).agg(F.min(order).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy("at", item))).where(F.col("place") <= most)


def tail(rows: DataFrame, cursor: int, limit: int = 50, key: str = "event_id") -> DataFrame:
    return rows.where(F.col(key) > cursor).orderBy(key).limit(limit)


def over_limit(requests: DataFrame, key: str, time: str, limit: int = 20, width: str = "1 minute") -> DataFrame:
    """(key, start, n): the windows in which a key asks more often than limit. On a stream with a watermark, windows are forgotten when they are over."""
    return requests.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")
