"""Results by batch, partial updates and bounded groups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def batch_id(at: Column, seed: Column) -> Column:
    """``YYYYMMDD-`` and eight hexadecimal digits that follow from seed."""
    return F.concat(F.date_format(at, "yyyyMMdd"), F.lit("-"), F.substring(F.md5(seed.cast("string")), 1, 8))


def append_results(results: DataFrame, path: str) -> None:
    """Adds batches to the history under path; a batch that comes again replaces itself, so a retried job changes nothing."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def current_results(history: DataFrame, key: list[str], batch: str = "batch_id") -> DataFrame:
    """The history's rows of the newest batch of each key."""
    newest = history.groupBy(*key).agg(F.max(batch).alias(batch))
    return history.join(newest, [*key, batch], "left_semi")


def upsert_buckets(new: DataFrame, path: str, key: list[str], order: str, buckets: int = 64) -> list[int]:
    """Keeps the row of each key that is last by order, in Parquet under path, in folders by a hash of the key; returns the buckets it has written anew.

    Only buckets that new has keys of are read and written; the merged rows are complete in the shared folder before the first file goes. The same
    rows again change nothing. A bucket is one task's work: take so many that each fits one. path is always used with the same number.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    own = new.withColumn("bucket", bucket)
    touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())
    if not touched:
        return []
    try:
        old = spark.read.schema(own.schema).parquet(path).where(F.col("bucket").isin(touched))
        own = old.unionByName(own)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    whole = F.struct(*new.columns)
    merged = own.repartition("bucket").groupBy("bucket", *key).agg(F.max_by(whole, order).alias("row")).select("row.*", "bucket")
    ready = staged(merged, "upsert")
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def pointed_at(documents: DataFrame, results: DataFrame, key: tuple[str, str] = ("source", "doc_id")) -> DataFrame:
    """documents with the result that their pointer names: the one of the same key and of batch ``mining.batch_id``; documents without one are left out."""
    named = documents.withColumn("batch_id", F.col("mining.batch_id"))
    return named.join(results, [*key, "batch_id"])


def recovered(items: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: items (.., status, batch_id) in work are queued again, and the batches (batch_id, status, failed_count, error_message) that had them have failed."""
    lost = items.where("status = 'processing'").select("batch_id").distinct().withColumn("__lost", F.lit(True))
    after = batches.join(lost, "batch_id", "left")
    hit = F.col("__lost").isNotNull()
    for name, value in (("status", F.lit("failed")), ("failed_count", F.lit(1)), ("error_message", F.lit("worker_interrupted"))):
        after = after.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return items.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status"))), after.drop("__lost")


def latest_batches(batches: DataFrame, shown: list[str], k: int = 5) -> DataFrame:
    """The shown columns of the k batches that started last."""
    return batches.orderBy(F.desc("started_at"), "batch_id").limit(k).select(*shown)


def updated_columns(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Partial upsert: new's columns replace those of rows for the keys of new, nulls too; all others stay. Keys are unique in both."""
    own = new.withColumn("__new", F.lit(True))
    joined = rows.alias("r").join(own.alias("n"), key, "full_outer")
    changed = set(new.columns) - set(key)
    cols = [F.when(F.col("__new"), F.col(f"n.`{c}`")).otherwise(F.col(f"r.`{c}`")).alias(c) if c in changed else F.col(f"r.`{c}`") for c in rows.columns if c not in key]
    return joined.select(*key, *cols)


def update_where(rows: DataFrame, column: str, allowed: list[str], value: str) -> DataFrame:
    """Compare and set: value where the column holds one of allowed; ``matched`` tells where."""
    matched = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return rows.withColumn("matched", matched).withColumn(column, F.when(F.col("matched"), F.lit(value)).otherwise(F.col(column)))


def bounded_groups(rows: DataFrame, group: str, key: str, most: int = 300) -> DataFrame:
    """rows with ``part`` and ``slice``: (group, part, slice) holds at most ``most`` rows.

    A group is dealt by hash into as many parts as it needs on average, and a part that gets too many is sliced in the order of key, so
    that no task sorts a whole large group: rows are dealt by both, as a join by group alone would leave its groups whole.
    """
    parts = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("parts"))
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    dealt = rows.join(parts, group).withColumn("part", F.pmod(hashed, F.col("parts"))).drop("parts").repartition(group, "part")
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(key))
    return dealt.withColumn("slice", F.floor((place - 1) / F.lit(most)).cast("long"))


def at_keys(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows of some keys: one join for any number of look-ups. Spark broadcasts keys below its threshold."""
    return rows.join(keys.select(*key).distinct(), key, "left_semi")
