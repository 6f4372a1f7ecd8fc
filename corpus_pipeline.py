"""A training corpus from raw documents: five stages, each of them one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and reads it
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loregrain.llm.bpe import encode
from loregrain.llm.common import staged
from loregrain.llm.decontaminate import drop_contaminated
from loregrain.llm.jaccard_join import Likeness, one_of_each
from loregrain.llm.line_dedup import dedup_lines
from loregrain.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them or more have."""
    return dedup_lines(docs, min_docs=10)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return one_of_each(docs, Likeness(words=5, percent=80))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmarks), ("BPE encoding", tokens)]

#: Suffix intervals, exact Jaccard components and BPE are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
