"""Every query of the library outside the training-data operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, feeds, ingest, keywords, knowledge, records
from ..sources import markup, tables, transcripts
from ..streaming import events as streams
from .oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark, sf):
    return tables.documents(spark, sf)


@query
def doc_validate(spark, sf):
    return ingest.validated(_docs(spark, sf)).select("doc_id", "source", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "short_body")


@query
def doc_reject_counts(spark, sf):
    return ingest.reject_counts(_docs(spark, sf))


@query
def doc_quality(spark, sf):
    return ingest.quality_by_source(_docs(spark, sf))


@query
def dedup_exact(spark, sf):
    return ingest.first_of(_docs(spark, sf).select("doc_id", "source", "source_url"), "source_url").select("doc_id", "source")


def _hashed(spark, sf):
    return _docs(spark, sf).select("doc_id", "source_url", ingest.content_hash(F.col("title"), F.col("body")).alias("hash"))


@query
def dedup_content(spark, sf):
    return ingest.first_of(_hashed(spark, sf), "hash").select("doc_id", "hash")


@query
def dedup_greedy(spark, sf):
    return ingest.greedy(_hashed(spark, sf), ("source_url", "hash")).select("doc_id")


@query
def html_to_text(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query
def url_normalize(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", markup.normalized_url(F.col("url")).alias("url"))


@query
def stable_ids(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", F.sha2(F.concat(F.sha2("url", 256), F.lit(":"), F.col("page_id").cast("string")), 256).alias("stable_id"))


@query
def token_counts(spark, sf):
    return keywords.term_counts(_docs(spark, sf))


@query
def doc_freq(spark, sf):
    return keywords.document_frequency(keywords.term_counts(_docs(spark, sf)))


@query
def tfidf_topk(spark, sf):
    return keywords.top_keywords(_docs(spark, sf))


@query
def vocab_top(spark, sf):
    counts = keywords.term_counts(_docs(spark, sf)).groupBy("term").agg(F.sum("tf").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(100)


@query
def similar_docs_topk(spark, sf):
    docs = _docs(spark, sf)
    return keywords.similar_docs(docs, docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("grp")))


@query
def embedding_similar_topk(spark, sf):
    return keywords.similar_vectors(tables.table(spark, sf, "embeddings"))


@query
def kmeans_topics(spark, sf):
    return keywords.kmeans_topics(_docs(spark, sf))


def _topics(spark, sf):
    docs = _docs(spark, sf)
    top = tables.staged(keywords.top_keywords(docs, keep=("topic_id",)), "top-keywords")
    return docs, top, tables.staged(knowledge.topic_terms(top, docs), "topic-terms"), knowledge.topic_counts(docs)


@query
def topic_aggregation(spark, sf):
    return knowledge.topic_counts(_docs(spark, sf))


@query
def topic_top_terms(spark, sf):
    return _topics(spark, sf)[2]


@query
def knowledge_units(spark, sf):
    _, _, terms, counts = _topics(spark, sf)
    return knowledge.knowledge_units(terms, counts)


def _profile(spark, sf, of_units=False):
    """of_units: only keywords that are terms of units, the only ones that these are matched with."""
    docs, top, terms, counts = _topics(spark, sf)
    events = tables.table(spark, sf, "events")
    topics, reads = tables.known_topics(events), tables.reads(events, docs)
    if of_units:
        top = top.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return docs, terms, counts, events, topics, reads, knowledge.known_keywords(topics, terms, reads, top)


@query
def profile_known_keywords(spark, sf):
    return _profile(spark, sf)[-1]


def _classes(spark, sf):
    """Documents of units, units, and users with all of these."""
    _, terms, counts, events, topics, reads, known = _profile(spark, sf, of_units=True)
    users = events.select("user_id").distinct()
    units = tables.staged(knowledge.knowledge_units(terms, counts), "units")
    return tables.documents(spark, sf, units), knowledge.classified(users, units, known, topics, reads)


@query
def classify_units(spark, sf):
    return _classes(spark, sf)[1].select("user_id", "knowledge_id", "n_matched", "status")


@query
def classify_counts(spark, sf):
    return _classes(spark, sf)[1].groupBy("status").agg(F.count("*").alias("n"))


@query
def conflict_override(spark, sf):
    units = _classes(spark, sf)[1].select("user_id", "knowledge_id", "status")
    events = tables.table(spark, sf, "events").where("event_type = 'error'")
    evidence = events.groupBy(F.concat(F.lit("topic:"), (F.col("event_id") % 20).cast("string")).alias("knowledge_id")).agg(F.max(F.col("event_id") % 7 == 0).alias("reviewed"), F.lit("evidence").alias("snippet"))
    return knowledge.with_conflicts(units, evidence).select("user_id", "knowledge_id", "status", "pending_review")


def _scores(spark, sf):
    docs, classes = _classes(spark, sf)
    return docs, knowledge.scored(classes, docs)


@query
def score_units(spark, sf):
    return _scores(spark, sf)[1].select("user_id", "knowledge_id", "score")


@query
def recommendations_topk(spark, sf):
    return knowledge.recommended(_scores(spark, sf)[1]).select("user_id", "knowledge_id", "status", "score", "rank")


@query
def recommendations_by_source(spark, sf):
    docs, scores = _scores(spark, sf)
    named = scores.join(F.broadcast(docs.where("source = 'src7'").select("doc_id", "title")), "doc_id")
    return knowledge.recommended(named, 5).select("user_id", "knowledge_id", "title", "rank")


@query
def baseline_newest(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", "title").orderBy(F.desc("doc_id")).limit(20)


@query
def baseline_similar(spark, sf):
    docs = _docs(spark, sf)
    reads = tables.reads(tables.table(spark, sf, "events"), docs)
    return knowledge.baseline_similar(reads, similar_docs_topk(spark, sf), docs)


@query
def feedback_latest(spark, sf):
    events = tables.table(spark, sf, "events").where("event_type in ('click', 'error', 'purchase')")
    return feeds.latest(events.select("user_id", (F.col("event_id") % 20).alias("topic_id"), "event_type", "event_id"), ["user_id", "topic_id"], "event_id")


@query
def confirm_known_update(spark, sf):
    return tables.known_topics(tables.table(spark, sf, "events"))


def _rankings(spark, sf):
    docs = _docs(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(3)
    by = {"personalized": [F.desc("n_chars"), F.asc("doc_id")], "baseline": [F.asc("doc_id")]}
    from pyspark.sql import Window

    parts = [docs.select(F.col("source").alias("query_id"), F.lit(mode).alias("mode"), F.row_number().over(Window.partitionBy("source").orderBy(*order)).alias("rank"), grade.alias("grade")) for mode, order in by.items()]
    return parts[0].unionByName(parts[1])


@query
def eval_precision_ndcg(spark, sf):
    return evaluate.precision_ndcg(_rankings(spark, sf))


@query
def eval_macro_difference(spark, sf):
    return evaluate.macro_difference(evaluate.precision_ndcg(_rankings(spark, sf)))


def _transcripts(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))


@query
def transcript_segments(spark, sf):
    return feeds.segments(_transcripts(spark, sf), "conv_id").select("conv_id", F.col("segment_id").cast("long").alias("segment_id"), F.sha2("text", 256).alias("digest"))


def _segment_docs(spark, sf):
    cut = feeds.segments(_transcripts(spark, sf), "conv_id")
    return cut.select((F.col("conv_id") * 1000 + F.col("segment_id")).alias("doc_id"), "conv_id", F.col("text").alias("body"))


@query
def transcript_keywords(spark, sf):
    return keywords.top_keywords(_segment_docs(spark, sf), 8).where("weight > 0")


@query
def segment_similarity(spark, sf):
    docs = _segment_docs(spark, sf)
    return keywords.similar(keywords.tfidf(docs), docs.select("doc_id", F.col("conv_id").alias("grp")), 3)


@query
def upsert_latest(spark, sf):
    rows = tables.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return feeds.latest(rows, ["user_id", "event_type"], "event_id")


@query
def insert_if_absent(spark, sf):
    rows = tables.table(spark, sf, "events").select("user_id", "event_type").distinct()
    return feeds.insert_if_absent(rows.where("event_type = 'view'"), rows, ["user_id", "event_type"])


@query
def stats_by_source(spark, sf):
    return _docs(spark, sf).where("source <> ''").rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")


@query
def notification_fanout(spark, sf):
    events = tables.table(spark, sf, "events")
    feed = (F.col("event_id") % 50).alias("feed_id")
    episodes = events.where("event_type = 'view'").select(feed, F.col("event_id").alias("episode_id"), F.col("event_id").alias("ready_at"))
    subscriptions = events.where("event_type = 'signup'").groupBy("user_id", feed).agg(F.min("event_id").alias("created_at"))
    sent = events.where("event_type = 'view' and event_id % 5 = 0").select("user_id", F.col("event_id").alias("episode_id")).distinct()
    return feeds.notified(episodes, subscriptions, sent)


@query
def subscription_episodes_semi(spark, sf):
    events = tables.table(spark, sf, "events")
    active = events.where("event_type = 'signup'").select((F.col("event_id") % 50).alias("feed_id")).distinct()
    return events.where("event_type = 'view'").select((F.col("event_id") % 50).alias("feed_id"), "event_id").join(active, "feed_id", "left_semi")


@query
def late_data_cutoff(spark, sf):
    rows = tables.table(spark, sf, "events").select(F.col("user_id").alias("feed_id"), F.col("event_type").alias("guid"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("published_at"), "event_id")
    return feeds.on_time(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0")).select("feed_id", "guid", "published_at", "event_id")


@query
def retry_queue(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").otherwise("ready")
    rows = tables.table(spark, sf, "events").select("event_id", status.alias("status"), (F.col("event_id") % 5).alias("attempts"), F.col("event_id").alias("retry_at"))
    return feeds.retry_due(rows, 500)


@query
def quota_cap(spark, sf):
    rows = tables.table(spark, sf, "events").select("user_id", (F.col("event_id") % 50).alias("feed_id"), "event_id")
    return feeds.within_quota(rows, "user_id", "feed_id", "event_id").select("user_id", "feed_id", "place")


@query
def rate_limit_tumbling(spark, sf):
    rows = tables.table(spark, sf, "events").select(F.date_trunc("minute", "ts").cast("timestamp").alias("m"), "user_id")
    return rows.groupBy(F.unix_seconds("m").alias("minute"), "user_id").agg(F.count("*").alias("n"))


@query
def stream_tumbling_counts(spark, sf):
    done = streams.run_once(streams.tumbling(streams.event_stream(spark, sf)), "complete")
    return done.select(F.unix_seconds("w.start").alias("day_start"), "event_type", "n")


@query
def stream_dedup(spark, sf):
    rows = streams.event_stream(spark, sf).select("ts", "user_id", "event_type")
    return streams.run_once(streams.deduplicated(rows, ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query
def tail_cursor(spark, sf):
    return feeds.tail(tables.table(spark, sf, "events").select("event_id", "user_id", "event_type"), 100)


@query
def current_results(spark, sf):
    history = tables.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("batch_id"), "event_id")
    return records.current_results(history, ["user_id"])


@query
def latest_batches(spark, sf):
    events = tables.table(spark, sf, "events")
    batches = events.groupBy(F.date_format("ts", "yyyyMMdd").alias("batch_id")).agg(F.min("event_id").alias("started_at"), F.count("*").alias("input_count"))
    return records.latest_batches(batches, ["batch_id", "input_count"])


@query
def column_update(spark, sf):
    events = tables.table(spark, sf, "events")
    rows = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("status"), F.max("event_id").alias("score"))
    scores = events.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("score"))
    return records.updated_columns(rows, scores, ["user_id"])


@query
def compare_and_set(spark, sf):
    return records.update_where(tables.table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["error", "click"], "queued")


@query
def bounded_groups(spark, sf):
    return records.bounded_groups(_docs(spark, sf).select("doc_id", "topic_id"), "topic_id", "doc_id", 20)


@query
def transcript_json(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    entry = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("body"), "text")
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("segments"))
    body = F.when(F.col("conv_id") % 2 == 0, F.to_json("segments")).otherwise(F.to_json(F.struct("segments")))
    return lists.select("conv_id", transcripts.transcript_text(body, F.lit("application/json; charset=utf-8")).alias("text"))


@query
def feed_dates(spark, sf):
    told = F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, " GMT").otherwise(" +0100"))
    return tables.table(spark, sf, "events").select("event_id", F.unix_seconds(transcripts.feed_date(told)).alias("published_at"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
