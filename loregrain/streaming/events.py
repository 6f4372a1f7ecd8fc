"""Structured Streaming forms: windowed counts, keyed deduplication with late data, and idempotent upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: list[str], late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """What is there now, through the stream, as Parquet in the shared folder. A batch that comes again writes the same files again."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # complete batches hold all results, appended ones what is new
        batch.write.mode("overwrite").parquet(f"{path}/all" if mode == "complete" else f"{path}/all/v={epoch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/all")


def upsert_sink(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, mode: str = "append"):
    """Keeps the latest row of each key under path, in buckets by key; a micro-batch rewrites the buckets that it touches, and one that comes again changes nothing."""
    from ..operators.records import upsert_buckets

    def write(batch: DataFrame, epoch: int) -> None:
        upsert_buckets(batch, path, key, order, int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key of what is there now, through the sink."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    query = upsert_sink(stream, f"{path}/rows", key, order, f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns) if query.lastProgress else spark.createDataFrame([], stream.schema)


def poll_sink(stream: DataFrame, path: str, checkpoint: str):
    """Feed items (feed_id, guid, published_at, has_transcript) into what is known under path, by the rules of ``state.polled_changes``: its state decides, so that
    a micro-batch that comes again after a crash decides the same."""
    from .state import polled_changes

    items = stream if "at" in stream.columns else stream.withColumn("at", F.lit(None).cast("long"))
    return upsert_sink(polled_changes(items), path, ["feed_id", "guid"], "poll", checkpoint, "update")
