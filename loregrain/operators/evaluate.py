"""Precision@K and NDCG@K of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_ndcg(rankings: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, mode, precision, ndcg); rankings: query_id, mode, rank (from 1), grade (0..3) of all judged items.

    The denominator of precision stays k for short lists; the ideal order is that of the query's own pool; ndcg is 0 if its gain is 0.
    """
    ideal = F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("grade"), "rank"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    placed = rankings.withColumn("ideal", ideal)
    sums = placed.groupBy("query_id", "mode").agg(
        F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("best"),
    )
    return sums.select("query_id", "mode", F.round(F.col("good") / k, 6).alias("precision"), F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"))


def macro_difference(metrics: DataFrame) -> DataFrame:
    """Means over queries of personalized minus baseline."""
    sign = F.when(F.col("mode") == "personalized", 1.0).otherwise(-1.0)
    n = F.countDistinct("query_id")
    return metrics.agg(F.round(F.sum(sign * F.col("precision")) / n, 4).alias("precision_diff"), F.round(F.sum(sign * F.col("ndcg")) / n, 4).alias("ndcg_diff"))
