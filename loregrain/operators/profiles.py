"""Updates of stored rows: arrays, deletions, back-references, poll batches and score runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def pushed(column: Column, value: Column) -> Column:
    """value at the end; null counts as no entries."""
    return F.array_append(F.coalesce(column, F.array().cast("array<string>")), value)


def added(column: Column, values: Column) -> Column:
    """The different entries of both, in order."""
    return F.array_union(F.coalesce(column, F.array().cast("array<string>")), values)


def pulled(column: Column, value: Column) -> Column:
    return F.array_remove(F.coalesce(column, F.array().cast("array<string>")), value)


def subscribed(rows: DataFrame, item: Column, most: int = 20) -> DataFrame:
    """rows (.., items) with item added if there is room; ``accepted`` is true where it is in afterwards."""
    has = F.array_contains("items", item)
    room = F.size("items") < most
    return rows.withColumn("accepted", has | room).withColumn("items", F.when(~has & room, F.array_append("items", item)).otherwise(F.col("items")))


def deleted(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def with_result(documents: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """documents with ``mining``: batch, topic and number of keywords of their newest result; a document without a new one keeps what it has."""
    newest = results.groupBy(*key).agg(F.max_by(F.struct("batch_id", "topic_cluster_id", F.size("keywords").alias("keyword_count")), "batch_id").alias("__new"))
    old = F.col("mining") if "mining" in documents.columns else F.lit(None)
    return documents.join(newest, key, "left").withColumn("mining", F.coalesce("__new", old)).drop("__new")


def polled(items: DataFrame, known: DataFrame, first: int = 3, later: int = 100) -> DataFrame:
    """What a poll of feeds brings in: items (feed_id, guid, published_at, has_transcript) against known (.., status), as rows with status and ``change``.

    A feed's first poll takes its ``first`` newest items, later polls up to ``later``. Unknown items older than the newest known one of their feed are
    left out; those without a date, or as new, come in. A known item that waits for its transcript and has one now is queued; others stay as they are.
    """
    # a guid that comes twice counts once: as the feed has it first, by ``at`` where items have that column
    again = Window.partitionBy("feed_id", "guid").orderBy(*(F.col(c) for c in ("at",) if c in items.columns), F.desc_nulls_last("published_at"), F.desc("has_transcript"))
    once = items.where("guid is not null").withColumn("place", F.row_number().over(again)).where("place = 1")
    newest = known.groupBy("feed_id").agg(F.max("published_at").alias("cutoff"), F.lit(True).alias("polled"))
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc_nulls_last("published_at"), "guid"))
    # the limit for all comes first, as a literal: each task keeps no more rows of a feed than that
    bounded = once.withColumn("place", place).where(F.col("place") <= max(first, later))
    seen = bounded.join(newest, "feed_id", "left").where(F.col("place") <= F.when(F.col("polled"), later).otherwise(first))
    both = seen.join(known.select("feed_id", "guid", "status"), ["feed_id", "guid"], "left")
    late = F.col("status").isNull() & (F.col("published_at") < F.col("cutoff"))
    fresh = F.when(F.col("has_transcript"), "queued").otherwise("awaiting_transcript")
    enriched = (F.col("status") == "awaiting_transcript") & F.col("has_transcript")
    change = F.when(F.col("status").isNull(), "new").when(enriched, "queued").otherwise("none")
    status = F.when(F.col("status").isNull() | enriched, fresh).otherwise(F.col("status"))
    return both.where(~F.coalesce(late, F.lit(False))).select("feed_id", "guid", "published_at", status.alias("status"), change.alias("change"))


BATCH = "batch_id string, source string, input_count long, valid_count long, failed_count long, status string, error_message string"


def batch_row(spark: SparkSession, folder: str, *values) -> DataFrame:
    """Writes a row of BATCH under folder; one of the same batch_id takes its place."""
    row = spark.createDataFrame([values], BATCH)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/batches")
    return row


def score_batch(scores: DataFrame, batch_id: str, folder: str, inputs: DataFrame | None = None) -> DataFrame:
    """Writes scores (user_id, knowledge_id, score) of a batch and its batch row under folder; returns the batch row, in which failed are rows without a score.

    The write counts its own rows. A batch that runs again replaces its scores and its row, whatever came of it before; one that fails leaves a row
    with the number of its inputs (those given, else its keys) and the error, and raises.
    """
    spark, counts = scores.sparkSession, Observation()
    seen = scores.observe(counts, F.count("*").alias("n"), F.count("score").alias("valid"))
    try:
        seen.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/scores")
    except Exception as error:
        n = (inputs if inputs is not None else scores.select("user_id", "knowledge_id")).count()
        batch_row(spark, folder, batch_id, "scores", n, 0, n, "failed", str(error).split("\n")[0][:300])
        raise
    n, valid = counts.get["n"], counts.get["valid"]
    return batch_row(spark, folder, batch_id, "scores", n, valid, n - valid, "success", None)


def shown(df: DataFrame, hidden: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rows as an API shows them: ``_id`` as id, no hidden columns, times as ISO text in UTC."""
    cols = []
    for name, kind in df.dtypes:
        if name not in hidden:
            value = F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind.startswith("timestamp") else F.col(name)
            cols.append(value.alias("id" if name == "_id" else name))
    return df.select(*cols)
