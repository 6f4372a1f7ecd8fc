"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns A-Z into a-z and leaves every other byte, those of UTF-8 sequences too.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of an Arrow batch that become Python objects at once.
ROWS_AT_ONCE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loregrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: later steps start from the files, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read; one of fewer files than the cluster has cores is dealt anew, so that small tables use all cores too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def rows_of(batches, *names: str) -> Iterator[list[tuple]]:
    """Slices of Arrow batches as lists of tuples of the named columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield list(zip(*(part.column(n).to_pylist() for n in names), strict=True))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a fixed number of words."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none make an empty set."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = mix(h + words[i : n - width + 1 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(h)


def groups_of(batches, key: str, at_once: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal key, from batches sorted by it; small groups come together, up to at_once rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != keys[0] and size >= at_once:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        start = 0
        for cut in np.flatnonzero(keys[1:] != keys[:-1]) + 1:
            if size + cut - start >= at_once:
                held.append(batch.slice(start, cut - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, int(cut)
        held.append(batch.slice(start))
        size += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def ddl(schema, *names: str) -> str:
    """The named columns of a schema, or all of them, as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if not names or f.name in names)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches. Nodes without an edge have no row.

    Alternates large-star and small-star steps on distinct edges until only stars are left; each round is written to the
    shared folder, so a lost executor costs one round at most, and no node's neighbours are ever gathered in one task.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def all_stars() -> bool:
        """Whether every node has one smaller neighbour at most, which has none itself."""
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    while not all_stars():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = staged(small.where("a <> b").distinct(), "edges")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
