"""Topics, knowledge units, classification against what a user knows, scores and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("topic_id").agg(F.count("*").alias("document_count"))


def topic_terms(keywords: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(topic_id, term, weight, doc_id, rank): each topic's k best terms with their best document. Keywords that come with their topic_id are not joined with docs."""
    rows = keywords.where("doc_id is not null") if "topic_id" in keywords.columns else keywords.join(docs.select("doc_id", "topic_id"), "doc_id")
    best = rows.groupBy("topic_id", "term").agg(F.max("weight").alias("weight"), F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    return best.withColumn("rank", place).where(F.col("rank") <= k)


def knowledge_units(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(knowledge_id, topic_id, doc_id, term): the terms of each unit. A term of several topics belongs to the one with the fewest documents."""
    heads = terms.where("rank = 1").select("topic_id", F.col("doc_id").alias("head"))
    whole = terms.join(heads, "topic_id").select(F.concat(F.lit("topic:"), "topic_id").alias("knowledge_id"), "topic_id", F.col("head").alias("doc_id"), "term")
    place = F.row_number().over(Window.partitionBy("term").orderBy("document_count", F.desc("topic_id")))
    single = terms.join(counts, "topic_id").withColumn("p", place).where("p = 1")
    return whole.unionByName(single.select(F.concat(F.lit("kw:"), "term").alias("knowledge_id"), "topic_id", "doc_id", "term"))


def known_keywords(topics: DataFrame, terms: DataFrame, reads: DataFrame, keywords: DataFrame) -> DataFrame:
    """(user_id, term): terms of topics that the user set and of documents that the user read."""
    of_topics = topics.where("derives").join(terms.select("topic_id", "term"), "topic_id").select("user_id", "term")
    of_reads = reads.join(keywords.select("doc_id", "term"), "doc_id").select("user_id", "term")
    return of_topics.unionByName(of_reads).distinct()


def status(matched: Column, in_topic: Column) -> Column:
    return F.when((matched > 0), "known").when(in_topic, "refine").otherwise("new")


def matched_terms(units: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, knowledge_id, matched): the unit's terms that the user knows, sorted. A unit has a few terms, so the arrays are short."""
    return units.join(known, "term").groupBy("user_id", "knowledge_id").agg(F.array_sort(F.collect_set("term")).alias("matched"))


def classified(users: DataFrame, units: DataFrame, known: DataFrame, topics: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """(user_id, knowledge_id, topic_id, doc_id, n_terms, n_matched, in_topic, status) for every user and unit; with reads, whether the user has seen the unit's document too.

    Units are a few per topic, so every user gets all of them. What is known of a user about them is one short row, made by joins on terms and documents,
    so that the many rows of the result are never shuffled.
    """
    unit = F.broadcast(units.groupBy("knowledge_id", "topic_id", "doc_id").agg(F.count("*").alias("n_terms")))
    hits = units.join(known, "term").groupBy("user_id", "knowledge_id").agg(F.count("*").alias("n"))
    own = [
        hits.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("knowledge_id", "n"))).alias("hits")),
        topics.join(F.broadcast(units.select("topic_id").distinct()), "topic_id", "left_semi").groupBy("user_id").agg(F.collect_set("topic_id").alias("topics")),
    ]
    if reads is not None:
        own.append(reads.join(F.broadcast(units.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("user_id").agg(F.collect_set("doc_id").alias("docs")))
    for facts in own:
        users = users.join(facts, "user_id", "left")
    has = lambda which, c: F.coalesce(F.array_contains(which, F.col(c)), F.lit(False))
    n_matched, in_topic = F.coalesce(F.try_element_at("hits", F.col("knowledge_id")), F.lit(0)), has("topics", "topic_id")
    seen = [has("docs", "doc_id").alias("seen")] if reads is not None else []
    rows = users.crossJoin(unit).select("user_id", "knowledge_id", "topic_id", "doc_id", "n_terms", n_matched.alias("n_matched"), in_topic.alias("in_topic"), *seen)
    return rows.withColumn("status", status(F.col("n_matched"), F.col("in_topic")))


def with_conflicts(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """Units whose evidence has a snippet get it; those with reviewed evidence become possible_conflict, others wait for review. Evidence is a row for each unit, and units are few."""
    joined = units.join(F.broadcast(evidence.where("snippet <> ''")), "knowledge_id", "left")
    found = F.col("snippet").isNotNull()
    return joined.withColumn("pending_review", found & ~F.col("reviewed")).withColumn("status", F.when(found & F.col("reviewed"), "possible_conflict").otherwise(F.col("status"))).fillna(False, ["pending_review"])


def scored(classes: DataFrame, docs: DataFrame, weights=(0.4, 0.4, 0.2, 0.5)) -> DataFrame:
    """classes, which tell what was seen, with a score: topic relevance, new keywords and quality for it, having read the document against it. docs: those of the units."""
    topic, new, quality, read = weights
    facts = classes.join(F.broadcast(docs.select("doc_id", "reliable")), "doc_id", "left")
    ratio = (F.col("n_terms") - F.col("n_matched")) / F.col("n_terms")
    good = F.when(F.coalesce("reliable", F.lit(True)), 1.0).otherwise(0.3)
    score = topic * F.col("in_topic").cast("double") + new * ratio + quality * good - read * F.col("seen").cast("double")
    return facts.withColumn("score", F.round(score, 6))


def recommended(scores: DataFrame, k: int = 20) -> DataFrame:
    if not 1 <= k <= 100:
        raise ValueError("k must be 1..100")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "knowledge_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def baseline_similar(reads: DataFrame, neighbours: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """Per user, unread neighbours of read documents in the order of reading, then of similarity; same source only."""
    source = docs.select("doc_id", "source")
    near = neighbours.join(source, "doc_id").join(source.select(F.col("doc_id").alias("other_id"), F.col("source").alias("other_source")), "other_id").where("source = other_source")
    found = reads.join(near.select("doc_id", "other_id", F.col("rank").alias("near")), "doc_id")
    first = found.groupBy("user_id", "other_id").agg(F.min(F.struct("read_at", "near")).alias("at"))
    unread = first.join(reads.select("user_id", F.col("doc_id").alias("other_id")), ["user_id", "other_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at.read_at", "at.near", "other_id"))
    return unread.select("user_id", F.col("other_id").alias("doc_id"), place.alias("rank")).where(F.col("rank") <= k)
