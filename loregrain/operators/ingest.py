"""Validation, quality flags and deduplication of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged, word_count


def validated(docs: DataFrame, required: tuple[str, ...] = ("source", "title", "body", "source_url")) -> DataFrame:
    """docs with reject_reason: missing_field, no_usable_text or null, and short_body. Only null and '' are missing."""
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull() | (F.col(name) == "")
    usable = F.coalesce(F.col("body").rlike("[a-zA-Z]{2,}"), F.lit(False))
    reason = F.when(missing, "missing_field").when(~usable, "no_usable_text")
    return docs.withColumn("reject_reason", reason).withColumn("short_body", word_count(F.col("body")) < 50)


def reject_counts(docs: DataFrame) -> DataFrame:
    return validated(docs).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def quality_by_source(docs: DataFrame) -> DataFrame:
    return validated(docs).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("short_body").cast("long")).alias("n_short"))


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(normalized(title), F.lit("\n"), normalized(body)), 256)


def first_of(docs: DataFrame, key: str, order: str = "doc_id") -> DataFrame:
    """The first row of each key: a partial aggregate, so hot keys are reduced before the shuffle."""
    whole = F.struct(*docs.columns)
    return docs.groupBy(key).agg(F.min_by(whole, order).alias("row")).select("row.*")


def greedy(docs: DataFrame, keys: tuple[str, str], order: str = "doc_id") -> DataFrame:
    """Rows kept by taking rows in order, unless an earlier kept row has the same value of either key.

    Rounds: a row that is first by both keys among the open ones is kept, rows that share a key with it go; repeat. A key's minimum
    carries the row's other key, so that the rows to keep are the minima of both keys that meet, and each key has one of them at most.
    The keys are computed once; each round is one table in the shared folder, which cuts the lineage; rounds number as the longest
    chain of alternating keys. Rows with a null key are not kept.
    """
    a, b = keys
    open_ = staged(docs.select(order, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), "greedy")
    kept = open_.select(order).limit(0)
    while not open_.isEmpty():
        # partial minima come first, so that a hot key is never sorted in one task
        first_a = open_.groupBy(a).agg(F.min(F.struct(order, b)).alias("m")).select(a, f"m.{order}", f"m.{b}")
        first_b = open_.groupBy(b).agg(F.min(F.struct(order, a)).alias("m")).select(b, f"m.{order}", f"m.{a}")
        taken = first_a.join(first_b, [order, a, b])
        by_a, by_b = taken.select(a, F.col(order).alias("__a")), taken.select(b, F.lit(True).alias("__b"))
        marked = open_.join(by_a, a, "left").join(by_b, b, "left")
        is_taken = F.coalesce(F.col(order) == F.col("__a"), F.lit(False))
        round_ = staged(marked.where(is_taken | (F.col("__a").isNull() & F.col("__b").isNull())).select(order, a, b, is_taken.alias("__taken")), "greedy")
        kept = kept.unionByName(round_.where("__taken").select(order))
        open_ = round_.where("not __taken").drop("__taken")
    return docs.join(kept, order, "left_semi")
