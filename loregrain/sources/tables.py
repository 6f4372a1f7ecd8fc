"""The input tables as the engine's views. Reads are lazy; filters and columns reach the Parquet scan."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """doc_id, source, lang, title (the first line), body, source_url, topic_id and reliable (50 words or more). of: a few documents (doc_id), for which only these columns are made."""
    docs = table(spark, sf_dir, "documents")
    if of is not None:
        # an inner join with few different ids: Spark makes the columns of a semi-join's left side before it
        docs = docs.join(F.broadcast(of.select("doc_id").distinct()), "doc_id")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select(
        "doc_id",
        "source",
        "lang",
        title.alias("title"),
        F.col("text").alias("body"),
        F.concat_ws("/", "source", title).alias("source_url"),
        F.substring("source", 4, 10).cast("long").alias("topic_id"),
        (word_count(F.col("text")) >= 50).alias("reliable"),
        "n_chars",
    )


def word_count(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def known_topics(events: DataFrame) -> DataFrame:
    """(user_id, topic_id, derives): topics that a user set, which make their keywords known too, or confirmed, which don't."""
    topic = (F.col("event_id") % 20).alias("topic_id")
    chosen = events.where(F.col("event_type").isin("signup", "purchase") & (F.col("event_id") % 3 == 0))
    return chosen.groupBy("user_id", topic).agg(F.max(F.col("event_type") == "signup").alias("derives"))


def reads(events: DataFrame, docs: DataFrame) -> DataFrame:
    """(user_id, doc_id, read_at): what each user has viewed, and the first event of it."""
    n = docs.agg(F.count("*").alias("n"))  # one row
    return events.where("event_type = 'view'").join(F.broadcast(n)).groupBy("user_id", (F.col("event_id") % F.col("n")).alias("doc_id")).agg(F.min("event_id").alias("read_at"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loregrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Spark removes the shuffle files of an execution at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written within leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again, so that several later branches don't compute it anew."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that was written to the shared one, and its path there, for tasks that read it themselves."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def unstaged(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes staged tables (or folders) that nothing reads any more."""
    paths = {p for t in tables for p in ([t] if isinstance(t, str) else [f.rpartition("/")[0] for f in t.inputFiles()])}
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
