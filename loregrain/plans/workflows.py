"""Queries of sources, contracts, stored rows, polls and transcripts, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import contract, feeds, keywords, knowledge, profiles, records
from ..sources import landed, tables, transcripts
from ..operators.clusters import UNIT_SQL, clusters_sql, split_sql
from ..streaming import events as streams
from . import catalogue
from .oracle import DOCS, PROFILE, STOP, TF, cosine

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark, sf):
    return tables.table(spark, sf, "events")


def _epoch():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query("""SELECT 'site' || (event_id % 4) || '-' || event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_tags,
strftime(make_timestamp(CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) * 1000000 END), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'CC' END AS license FROM events""")
def qa_records(spark, sf):
    kind = F.col("event_type")
    item = F.struct(
        F.col("event_id").alias("question_id"),
        kind.alias("title"),
        F.lit("<p>b</p>").alias("body"),
        F.when(F.col("event_id") % 3 != 0, F.array(kind)).alias("tags"),
        F.when(F.col("event_id") % 10 != 0, _epoch()).alias("creation_date"),
        F.lit("http://s/").alias("link"),
        F.when(F.col("event_id") % 4 != 0, "CC").alias("content_license"),
    )
    site = F.concat(F.lit("site"), (F.col("event_id") % 4).cast("string"))
    r = _events(spark, sf).select(landed.question_record(site, item).alias("r"))
    return r.select("r.doc_id", F.size("r.tags").alias("n_tags"), "r.created_at", "r.license")


@query("""SELECT source, page, place, item FROM (SELECT event_id % 4 AS source, (event_id // 4) % 30 + 1 AS page, event_id AS item,
row_number() OVER (ORDER BY event_id % 4, (event_id // 4) % 30, event_id) - 1 AS place FROM events
WHERE (event_id // 4) % 30 + 1 <= 25 AND NOT (event_id % 4 = 2 AND (event_id // 4) % 30 + 1 > 7) AND NOT (event_id % 4 = 3 AND (event_id // 4) % 30 + 1 >= 5)) WHERE place < 500""")
def qa_collected(spark, sf):
    page = F.floor(F.col("event_id") / 4) % 30 + 1
    pages = _events(spark, sf).groupBy((F.col("event_id") % 4).alias("source"), page.alias("page")).agg(F.array_sort(F.collect_list("event_id")).alias("items"))
    empty = (F.col("source") == 3) & (F.col("page") == 5)
    pages = pages.withColumn("items", F.when(empty, F.array().cast("array<bigint>")).otherwise(F.col("items"))).withColumn("has_more", ~((F.col("source") == 2) & (F.col("page") == 7)))
    return landed.collected(pages, 500)


@query("""SELECT CAST(event_id AS VARCHAR) AS doc_id, 'A ' || event_type AS title, 'some text' AS body_text, 'cs.DC,' || event_type AS tags, 'http://p.example/abs/' || event_id AS source_url FROM events""")
def paper_records(spark, sf):
    xml = F.concat(
        F.lit("<entry><id>http://p.example/abs/"), F.col("event_id").cast("string"), F.lit("</id><title> A\n  "), F.col("event_type"),
        F.lit("</title><summary>some\n text </summary><updated>2026-01-01T00:00:00Z</updated><category term='cs.DC'/><category term='"), F.col("event_type"), F.lit("'/></entry>"),
    )
    r = _events(spark, sf).select(landed.paper_record(xml).alias("r"))
    return r.select("r.doc_id", "r.title", "r.body_text", F.array_join("r.tags", ",").alias("tags"), "r.source_url")


@query("""WITH e AS (SELECT user_id % 40 AS f, event_id, CASE WHEN event_id % 2 = 0 THEN '/a/' || event_id || '.mp3' END AS audio, 'ep/' || event_id AS link,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE 'T' || event_id END AS title, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS published_at,
  CASE WHEN event_id % 3 = 0 THEN 'http://feed.example/t' || event_id END AS transcript_url, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type || (event_id % 7) END AS own FROM events),
g AS (SELECT *, coalesce(own, audio, link) AS guid FROM e),
one AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY f, guid ORDER BY event_id) = 1)
SELECT sha256('http://feed.example/' || f || '/rss.xml') AS feed_id, guid, CASE WHEN title = '' THEN guid ELSE title END AS title, 'http://feed.example/' || f || '/' || link AS source_url,
'http://feed.example' || audio AS audio_url, transcript_url, published_at, place FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY published_at DESC NULLS LAST, event_id) AS place FROM one) WHERE place <= 3""")
def feed_items(spark, sf):
    i = F.col("event_id")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    told = F.when(i % 11 == 0, "soon").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    item = F.concat(
        tag("guid", F.when(i % 5 == 0, "").otherwise(F.concat("event_type", (i % 7).cast("string")))),
        tag("title", F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("T"), i.cast("string")))),
        tag("link", F.concat(F.lit("ep/"), i.cast("string"))),
        tag("pubDate", told),
        F.when(i % 2 == 0, F.concat(F.lit('<enclosure url="/a/'), i.cast("string"), F.lit('.mp3"/>'))).otherwise(""),
        F.lit('<podcast:transcript url="http://x" type="audio/x"/>'),
        F.when(i % 3 == 0, F.concat(F.lit('<podcast:transcript url="//feed.example/t'), i.cast("string"), F.lit('" type="Text/VTT; a=b"/>'))).otherwise(""),
    )
    url = F.concat(F.lit("http://feed.example/"), (F.col("user_id") % 40).cast("string"), F.lit("/rss.xml"))
    lists = _events(spark, sf).select(url.alias("url"), F.struct(i.alias("at"), tag("item", item).alias("x")).alias("s")).groupBy("url").agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.concat(F.lit('<rss xmlns:podcast="http://podcast.example/ns"><channel><title>F</title>'), F.array_join(F.transform("s", lambda s: s["x"]), ""), F.lit("</channel></rss>"))
    return landed.feed_items(lists.select("url", body.alias("body"))).select("feed_id", "guid", "title", "source_url", "audio_url", "transcript_url", F.unix_seconds("published_at").alias("published_at"), "place")


@query("SELECT 'events' AS origin, event_id AS id, event_type AS kind FROM events UNION ALL SELECT 'documents', doc_id, NULL FROM documents")
def source_union(spark, sf):
    sources = {
        "events": lambda: _events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")),
        "papers": lambda: tables.table(spark, sf, "no_such_table"),
        "documents": lambda: tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id")),
    }
    return landed.union_available(sources)[0].select("origin", "id", "kind")


def _judged(spark, sf):
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(3)
    return tables.table(spark, sf, "labels").join(tables.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), grade.alias("grade"))


JUDGED = "j AS (SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 3 END AS grade FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {JUDGED} SELECT * FROM j")
def judgments_report(spark, sf):
    """A JSON report, written and read again; an object holds at most a thousand judgments of a query."""
    dealt = records.bounded_groups(_judged(spark, sf), "query_id", "doc_id", 1000)
    lists = dealt.groupBy("query_id", "part", "slice").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "grade"))).alias("judgments")).drop("part", "slice")
    path = f"{tables.shared_folder(spark)}/judgments-{uuid.uuid4().hex}"
    lists.write.json(path)
    return landed.judgments(spark, path, one_list=False)


@query(f"WITH {JUDGED}, r AS (SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) SELECT query_id, 'all' AS mode, doc_id, rank FROM r ANTI JOIN j USING (query_id, doc_id) WHERE rank <= 5")
def unjudged_topk(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rankings = tables.table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.lit("all").alias("mode"), F.col("doc_id").cast("string").alias("doc_id"), place.alias("rank"))
    return contract.unjudged(rankings, _judged(spark, sf), 5)


@query("""WITH u AS (SELECT user_id, list_sort(list_distinct(list(CAST(event_id % 10 AS VARCHAR)))) AS items FROM events GROUP BY user_id)
SELECT user_id, len(items) + 1 AS n_pushed, array_to_string(list_sort(list_distinct(list_concat(items, ['3', 'zz']))), ',') AS added, array_to_string(list_filter(items, lambda x: x <> '3'), ',') AS pulled,
list_contains(items, '7') OR len(items) < 6 AS accepted, CASE WHEN list_contains(items, '7') OR len(items) >= 6 THEN len(items) ELSE len(items) + 1 END AS n_items FROM u""")
def profile_arrays(spark, sf):
    users = _events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("event_id") % 10).cast("string"))).alias("items"))
    items = F.col("items")
    rows = users.select(
        "user_id", F.size(profiles.pushed(items, F.lit("x"))).alias("n_pushed"), F.array_join(F.array_sort(profiles.added(items, F.array(F.lit("3"), F.lit("zz")))), ",").alias("added"),
        F.array_join(profiles.pulled(items, F.lit("3")), ",").alias("pulled"), "items",
    )
    return profiles.subscribed(rows, F.lit("7"), 6).withColumn("n_items", F.size("items")).drop("items")


@query("SELECT DISTINCT user_id, event_id % 50 AS feed_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id, event_id % 50 FROM events WHERE event_type = 'error'")
def unsubscribed(spark, sf):
    rows = _events(spark, sf).select("user_id", (F.col("event_id") % 50).alias("feed_id"), "event_type")
    return profiles.deleted(rows.where("event_type = 'signup'").select("user_id", "feed_id").distinct(), rows.where("event_type = 'error'"), ["user_id", "feed_id"])


@query("SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, sf):
    return contract.key_violations(_events(spark, sf), ["user_id", "event_type"])


@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing:title' WHEN coalesce(text, '') = '' THEN 'missing:body_text' WHEN doc_id % 11 = 0 THEN 'missing:language' WHEN doc_id % 3 = 2 THEN 'source' ELSE 'valid' END AS reason,
count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_unknown FROM documents GROUP BY 1""")
def contract_counts(spark, sf):
    i = F.col("doc_id")
    raw = tables.table(spark, sf, "documents").select(
        i.cast("string").alias("doc_id"), F.when(i % 3 == 0, "arxiv").when(i % 3 == 1, "stackexchange").otherwise("reddit").alias("source"), F.lit(" ").alias("source_site"), F.when(i % 7 != 0, "t").otherwise("").alias("title"),
        F.col("text").alias("body_text"), F.when(i % 11 != 0, F.col("lang")).alias("language"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.lit("u").alias("source_url"), F.when(i % 2 != 0, "CC").alias("license"),
    )
    return contract.checked(raw).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("license") == "unknown").alias("n_unknown"))


@query("""SELECT event_id, event_id % 50 AS feed_id FROM events WHERE event_type = 'view' AND event_id % 50 IN (SELECT event_id % 50 FROM events WHERE event_type = 'signup' AND user_id % 3 = 0)
ORDER BY event_id % 1000 DESC, event_id LIMIT 50""")
def episodes_newest(spark, sf):
    rows = _events(spark, sf).select("event_id", (F.col("event_id") % 50).alias("feed_id"), "event_type", "user_id", "props", (F.col("event_id") % 1000).alias("published_at"))
    own = rows.where("event_type = 'signup' and user_id % 3 = 0").select("feed_id")
    episodes = rows.where("event_type = 'view'").drop("props").join(own, "feed_id", "left_semi")
    return contract.first_rows(episodes, [F.desc("published_at"), "event_id"], 50).select("event_id", "feed_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'click') WHERE place <= 50")
def notifications_newest(spark, sf):
    return contract.ranked_within(_events(spark, sf).where("event_type = 'click'"), "user_id", [F.desc("event_id")], 50).select("user_id", "event_id")


@query("""SELECT event_id FROM events WHERE (event_type = 'view' OR (event_type = 'error' AND event_id % 5 < 3 AND event_id <= 500)) AND event_id % 50 IN (SELECT event_id % 50 FROM events WHERE event_type = 'signup') ORDER BY event_id LIMIT 10""")
def work_queue(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").otherwise("ready")
    rows = _events(spark, sf).select("event_id", status.alias("status"), (F.col("event_id") % 5).alias("attempts"), F.col("event_id").alias("retry_at"), (F.col("event_id") % 50).alias("feed_id"))
    active = _events(spark, sf).where("event_type = 'signup'").select((F.col("event_id") % 50).alias("feed_id"))
    return contract.first_rows(feeds.retry_due(rows, 500).join(active, "feed_id", "left_semi"), ["event_id"], 10).select("event_id")


CONV = "conv AS (SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn, text), ' ') AS text FROM conversations GROUP BY conv_id)"
SEGS = f"{CONV}, sd AS (SELECT conv_id AS grp, conv_id * 1000 + i AS doc_id, substr(text, i * 800 + 1, 800) AS body FROM (SELECT conv_id, text, unnest(range((length(text) + 799) // 800)) AS i FROM conv))"
GROUPED = f"""{SEGS}, tok AS (SELECT grp, doc_id, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS term FROM sd),
tf AS (SELECT grp, doc_id, term, count(*) AS tf FROM tok WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY ALL),
w0 AS (SELECT *, round(tf * ln((n + 1.0) / (df + 1.0)), 6) AS w FROM tf JOIN (SELECT grp, term, count(*) AS df FROM tf GROUP BY ALL) USING (grp, term) JOIN (SELECT grp, count(DISTINCT doc_id) AS n FROM tf GROUP BY grp) USING (grp)),
w AS (SELECT grp, doc_id, term, CASE WHEN flat THEN tf::DOUBLE ELSE w END AS weight, CASE WHEN flat THEN 'term_frequency' ELSE 'tfidf' END AS weighting FROM w0 JOIN (SELECT grp, max(w) <= 0 AS flat FROM w0 GROUP BY grp) USING (grp))"""


@query(f"WITH {CONV} SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(trim(text)) < 20 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long' ELSE 'taken' END AS reason, count(*) AS n FROM conv GROUP BY 1")
def transcript_bounds(spark, sf):
    texts = catalogue._transcripts(spark, sf).select(F.trim("text").alias("text"))
    return texts.groupBy(F.coalesce(contract.bounded_transcript(F.col("text"), 20, 2000), F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


def _segments(spark, sf):
    return catalogue._segment_docs(spark, sf).withColumnRenamed("conv_id", "grp")


@query(rf"WITH {SEGS} SELECT grp AS conv_id, count(*) FILTER (WHERE NOT regexp_matches(lower(body), '[a-z]')) AS skipped_segments, count(*) AS n_segments FROM sd GROUP BY grp")
def segment_skips(spark, sf):
    letters = F.filter(F.split(F.lower("body"), "[^a-z]+"), lambda t: t != "")
    return contract.kept_segments(_segments(spark, sf), letters, "grp")[1].withColumnRenamed("grp", "conv_id")


@query(f"WITH {GROUPED} SELECT doc_id, term, weight, weighting, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 8 AND weight > 0")
def transcript_weights(spark, sf):
    return keywords.ranked(keywords.grouped_weights(_segments(spark, sf)), "doc_id", "weight", "term", 8).where("weight > 0").select("doc_id", "term", "weight", "weighting", "rank")


@query(f"WITH {GROUPED}, v AS (SELECT grp, doc_id, string_agg(term || '=' || weight, ',' ORDER BY term) AS v FROM w GROUP BY ALL) SELECT grp AS conv_id, least(count(DISTINCT v), 4) AS k, CASE WHEN count(DISTINCT v) > 1 THEN 'kmeans' ELSE 'single_group' END AS mode FROM v GROUP BY grp")
def segment_groups(spark, sf):
    return keywords.cluster_modes(keywords.grouped_weights(_segments(spark, sf))).withColumnRenamed("grp", "conv_id")


@query(f"WITH {GROUPED}, sw AS MATERIALIZED (SELECT grp, doc_id, term, round(weight * 1000) AS w FROM w), {clusters_sql('sw', '(SELECT DISTINCT grp, doc_id FROM sw)', 4, 20)} SELECT grp AS conv_id, doc_id AS segment, cluster FROM member")
def segment_clusters(spark, sf):
    return keywords.segment_clusters(_segments(spark, sf)).select(F.col("grp").alias("conv_id"), F.col("doc_id").alias("segment"), "cluster")


@query(f"WITH {GROUPED}, sw AS MATERIALIZED (SELECT grp, doc_id, term, round(weight * 1000) AS w FROM w), {clusters_sql('sw', '(SELECT DISTINCT grp, doc_id FROM sw)', 4, 20)} SELECT grp AS conv_id, cluster, count(*) AS n_segments, min(doc_id) AS first_segment FROM member GROUP BY grp, cluster")
def cluster_groups(spark, sf):
    """The clusters of each transcript: sizes and first segments, by a partial aggregate and no list of members."""
    return keywords.segment_clusters(_segments(spark, sf)).groupBy(F.col("grp").alias("conv_id"), "cluster").agg(F.count("*").alias("n_segments"), F.min("doc_id").alias("first_segment"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>|<aside\b[^>]*>.*?</aside\s*>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g') AS page FROM pages),
p AS (SELECT page_id, array_to_string(list_transform(string_split_regex(page, '(?i)<(?:p|cite)\b[^>]*>')[2:], lambda x: regexp_replace(x, '(?is)</(?:p|cite)\s*>.*', '')), chr(10)) AS told FROM b),
t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(told, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS told FROM p)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(told, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM t""")
def transcript_pages(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", transcripts.paragraph_lines(F.col("html")).alias("text"))


@query("""WITH h AS (SELECT user_id, arg_max(event_id, event_id) AS e FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT u.user_id, e AS batch_id, e % 20 AS topic, CASE WHEN e IS NOT NULL THEN 1 END AS keyword_count FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN h USING (user_id)""")
def result_pointers(spark, sf):
    results = _events(spark, sf).where("event_type = 'view'").select("user_id", F.col("event_id").alias("batch_id"), (F.col("event_id") % 20).alias("topic_cluster_id"), F.array("event_type").alias("keywords"))
    rows = profiles.with_result(_events(spark, sf).select("user_id").distinct(), results, ["user_id"])
    return rows.select("user_id", "mining.batch_id", F.col("mining.topic_cluster_id").alias("topic"), "mining.keyword_count")


@query("""WITH p AS (SELECT 'src' || (user_id % 3) AS source, user_id AS doc_id, max(event_id % 7) AS batch_id FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT p.source, p.doc_id, p.batch_id, count(*) AS n_results FROM p JOIN events e ON e.user_id = p.doc_id AND e.event_id % 7 = p.batch_id GROUP BY ALL""")
def pointed_results(spark, sf):
    rows = _events(spark, sf).select(F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("batch_id"), "event_type")
    documents = rows.where("event_type = 'view'").groupBy("source", "doc_id").agg(F.struct(F.max("batch_id").alias("batch_id")).alias("mining"))
    return records.pointed_at(documents, rows.drop("event_type")).groupBy("source", "doc_id", "batch_id").agg(F.count("*").alias("n_results"))


@query("""WITH lost AS (SELECT DISTINCT event_id % 40 AS batch_id FROM events WHERE event_type = 'purchase')
SELECT event_id % 40 AS batch_id, CASE WHEN event_id % 40 IN (FROM lost) THEN 'failed' ELSE 'success' END AS batch_status, CASE WHEN event_id % 40 IN (FROM lost) THEN 1 ELSE 0 END AS failed_count,
CASE WHEN event_type IN ('purchase', 'view') THEN 'queued' ELSE 'ready' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def recovered_items(spark, sf):
    """Items and batches after a crash, counted."""
    status = F.when(F.col("event_type") == "purchase", "processing").when(F.col("event_type") == "view", "queued").otherwise("ready")
    items = _events(spark, sf).select("event_id", status.alias("status"), (F.col("event_id") % 40).alias("batch_id"))
    batches = items.select("batch_id").distinct().select("batch_id", F.lit("success").alias("status"), F.lit(0).alias("failed_count"), F.lit(None).cast("string").alias("error_message"))
    now, after = records.recovered(items, batches)
    return now.join(after.withColumnRenamed("status", "batch_status"), "batch_id").groupBy("batch_id", "batch_status", "failed_count", "status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id % 25 AS topic_id FROM events WHERE event_type = 'signup' AND event_id % 25 NOT IN (SELECT CAST(substr(source, 4) AS BIGINT) FROM documents)")
def topics_unknown(spark, sf):
    return contract.unknown(_events(spark, sf).where("event_type = 'signup'").select((F.col("event_id") % 25).alias("topic_id")), tables.documents(spark, sf), "topic_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) > 0 AS found FROM events GROUP BY event_type")
def existence_counts(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("value") > 50) > 0).alias("found"))


@query("""WITH r AS (SELECT user_id AS feed_id, event_type || (event_id % 9) AS guid, CAST(floor(epoch(ts)) AS BIGINT) AS p, event_id FROM events),
k AS (SELECT feed_id, guid, max(p) AS published_at, CASE WHEN max(event_id) % 3 = 0 THEN 'awaiting_transcript' ELSE 'ready' END AS status FROM r WHERE event_id % 2 = 0 AND feed_id % 4 > 0 GROUP BY feed_id, guid),
i AS (SELECT feed_id, guid, CASE WHEN max(event_id) % 13 = 0 THEN NULL ELSE max(p) END AS published_at, max(event_id) % 5 < 3 AS has_transcript FROM r WHERE event_id % 2 = 1 GROUP BY feed_id, guid),
c AS (SELECT feed_id, max(published_at) AS cutoff FROM k GROUP BY feed_id),
b AS (SELECT i.*, k.status AS s, cutoff, c.feed_id IS NOT NULL AS polled, row_number() OVER (PARTITION BY i.feed_id ORDER BY i.published_at DESC NULLS LAST, i.guid) AS place FROM i LEFT JOIN k USING (feed_id, guid) LEFT JOIN c ON c.feed_id = i.feed_id)
SELECT feed_id, guid, published_at, CASE WHEN s IS NULL OR (s = 'awaiting_transcript' AND has_transcript) THEN CASE WHEN has_transcript THEN 'queued' ELSE 'awaiting_transcript' END ELSE s END AS status,
CASE WHEN s IS NULL THEN 'new' WHEN s = 'awaiting_transcript' AND has_transcript THEN 'queued' ELSE 'none' END AS change FROM b
WHERE place <= CASE WHEN polled THEN 100 ELSE 3 END AND NOT coalesce(s IS NULL AND published_at < cutoff, false)""")
def poll_changes(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("feed_id"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("guid"), _epoch().alias("p"), "event_id")
    last = F.max("event_id")
    known = rows.where("event_id % 2 = 0 and feed_id % 4 > 0").groupBy("feed_id", "guid").agg(F.max("p").alias("published_at"), F.when(last % 3 == 0, "awaiting_transcript").otherwise("ready").alias("status"))
    items = rows.where("event_id % 2 = 1").groupBy("feed_id", "guid").agg(F.when(last % 13 != 0, F.max("p")).alias("published_at"), (last % 5 < 3).alias("has_transcript"))
    return profiles.polled(items, known)


@query(f"{PROFILE} SELECT user_id, knowledge_id, string_agg(DISTINCT term, ',' ORDER BY term) AS matched FROM units JOIN known USING (term) GROUP BY ALL")
def matched_keywords(spark, sf):
    _, terms, counts, _, _, _, known = catalogue._profile(spark, sf, of_units=True)
    return knowledge.matched_terms(knowledge.knowledge_units(terms, counts), known).select("user_id", "knowledge_id", F.array_join("matched", ",").alias("matched"))


@query("SELECT 'b1' AS batch_id, 'scores' AS source, count(*) AS input_count, count(value) AS valid_count, count(*) - count(value) AS failed_count, 'success' AS status FROM events")
def score_batch(spark, sf):
    scores = _events(spark, sf).select("user_id", F.col("event_id").cast("string").alias("knowledge_id"), F.col("value").alias("score"))
    return profiles.score_batch(scores, "b1", f"{tables.shared_folder(spark)}/scores-{uuid.uuid4().hex}").drop("error_message")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def api_values(spark, sf):
    return profiles.shown(_events(spark, sf).select(F.col("event_id").alias("_id"), "user_id", "ts"))


@query("SELECT event_id, strftime(ts, '%Y%m%d') || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS batch_id FROM events")
def batch_ids(spark, sf):
    return _events(spark, sf).select("event_id", records.batch_id(F.col("ts"), F.col("event_id")).alias("batch_id"))


@query("SELECT event_id, event_type FROM events WHERE event_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def point_lookups(spark, sf):
    keys = tables.table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("event_id"))
    return records.at_keys(_events(spark, sf), keys, ["event_id"]).select("event_id", "event_type")


@query("SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limit_exceeded(spark, sf):
    asked = _events(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return feeds.over_limit(asked, "user_id", "ts", 2, "1 day").withColumn("start", F.unix_seconds("start"))


@query(f"WITH {DOCS} SELECT topic_id, count(*) AS document_count, row_number() OVER (ORDER BY count(*) DESC, topic_id) AS place FROM d GROUP BY topic_id")
def topics_listed(spark, sf):
    """Topics by size; a few rows, which one window puts in order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("document_count"), "topic_id"))
    return knowledge.topic_counts(tables.documents(spark, sf)).withColumn("place", place)


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_upsert(spark, sf):
    return streams.upserted(streams.event_stream(spark, sf).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, lang, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % ((count(*) OVER (PARTITION BY source, lang) + 299) // 300) AS part FROM d),
s AS (SELECT *, source || '/' || lang || '/' || part || '/' || ((row_number() OVER (PARTITION BY source, lang, part ORDER BY doc_id) - 1) // 300) AS grp FROM p) SELECT grp, count(*) AS n FROM s GROUP BY grp""")
def similarity_groups(spark, sf):
    return _bounded(spark, sf).groupBy("grp").agg(F.count("*").alias("n"))


def _bounded(spark, sf):
    rows = tables.documents(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang").alias("g"))
    return records.bounded_groups(rows, "g", "doc_id", 300).select("doc_id", F.concat_ws("/", "g", F.col("part").cast("string"), F.col("slice").cast("string")).alias("grp"))


@query(f"""{TF}, p AS (SELECT doc_id, lang, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % ((count(*) OVER (PARTITION BY source, lang) + 299) // 300) AS part FROM d),
{cosine("SELECT doc_id, source || '/' || lang || '/' || part || '/' || ((row_number() OVER (PARTITION BY source, lang, part ORDER BY doc_id) - 1) // 300) AS grp FROM p", 5)} SELECT doc_id, other_id, score, rank FROM near""")
def similar_docs_bounded(spark, sf):
    """Neighbours within groups of at most 300 documents: work grows with the table, not with the square of a group."""
    return keywords.similar(keywords.tfidf(tables.documents(spark, sf)), tables.staged(_bounded(spark, sf), "bounded-groups"))


def _split_sql(times: int) -> str:
    """Each document in ``times`` groups of all documents, which are split."""
    return f"""{TF}, kw AS MATERIALIZED ({UNIT_SQL}), kd AS (SELECT CAST(t AS VARCHAR) AS grp, doc_id FROM d, range({times}) r(t)), {split_sql("kw", "kd", 300, 4, 3, 4)}"""


@query(f"{_split_sql(1)} SELECT doc_id, grp FROM split")
def kmeans_bounded_groups(spark, sf):
    """All documents, clustered again and again until no group has more than 300."""
    return keywords.split_documents(keywords.Numbered(tables.documents(spark, sf)), ["0"])


@query(f"""{_split_sql(6)}, u AS (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS v FROM w WHERE weight > 0),
pairs AS (SELECT DISTINCT a.doc_id, b.doc_id AS other_id FROM split a JOIN split b ON a.grp = b.grp AND a.doc_id <> b.doc_id),
s AS (SELECT a.doc_id, b.doc_id AS other_id, round(sum(a.v * b.v), 6) AS score FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id) AS rank FROM s SEMI JOIN pairs USING (doc_id, other_id) WHERE score > 0) SELECT doc_id, other_id, score, rank FROM near WHERE rank <= 5""")
def similar_docs_split(spark, sf):
    """Neighbours among documents that any of six splits puts together, in groups of at most 300, whatever their source and language."""
    return keywords.similar_in_splits(tables.documents(spark, sf), 6)


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CASE event_id % 11 WHEN 0 THEN 'many' WHEN 1 THEN ' 7 ' ELSE CAST(event_id % 130 AS VARCHAR) END END AS lim,
CASE event_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'stackexchange' WHEN 2 THEN 'reddit' END AS source, CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'best' END AS mode FROM events)
SELECT event_id, CASE WHEN lim IS NOT NULL AND NOT coalesce(TRY_CAST(trim(lim) AS INT), -1) BETWEEN 1 AND 100 THEN 'invalid_limit' WHEN source = 'reddit' THEN 'invalid_source' WHEN mode = 'best' THEN 'invalid_mode' END AS error FROM r""")
def request_errors(spark, sf):
    i = F.col("event_id")
    limit = F.when(i % 5 > 0, F.when(i % 11 == 0, "many").when(i % 11 == 1, " 7 ").otherwise((i % 130).cast("string")))
    source = F.when(i % 4 == 0, "arxiv").when(i % 4 == 1, "stackexchange").when(i % 4 == 2, "reddit")
    mode = F.when(i % 3 == 0, "baseline").when(i % 3 == 1, "best")
    return _events(spark, sf).select(i, contract.request_error(limit, source, mode).alias("error"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'topic:' || (event_id % 20) WHEN 1 THEN 'kw:' || event_type WHEN 2 THEN repeat('x', (event_id % 300)::BIGINT) END AS k,
CASE event_id % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'confirmed_known' ELSE event_type END AS action FROM events)
SELECT event_id, CASE WHEN k LIKE 'topic:%' THEN 'topic' WHEN k LIKE 'kw:%' THEN 'keyword' END AS kind, CASE WHEN k LIKE 'topic:%' THEN substr(k, 7) WHEN k LIKE 'kw:%' THEN substr(k, 4) END AS value,
CASE WHEN NOT coalesce(length(k) BETWEEN 1 AND 256 AND action IN ('useful', 'irrelevant', 'confirmed_known'), false) THEN 'invalid_action' END AS error FROM r""")
def feedback_ids(spark, sf):
    i = F.col("event_id")
    k = F.when(i % 4 == 0, F.concat(F.lit("topic:"), (i % 20).cast("string"))).when(i % 4 == 1, F.concat(F.lit("kw:"), "event_type")).when(i % 4 == 2, F.repeat(F.lit("x"), (i % 300).cast("int")))
    action = F.when(i % 3 == 0, "useful").when(i % 3 == 1, "confirmed_known").otherwise(F.col("event_type"))
    return _events(spark, sf).select(i, contract.knowledge_parts(k).alias("p"), contract.feedback_error(k, action).alias("error")).select("event_id", "p.*", "error")


@query(f"WITH {SEGS} SELECT grp AS conv_id, count(*) AS n_segments, sha256(string_agg(body, '|' ORDER BY doc_id)) AS digest FROM sd GROUP BY grp")
def segments_in_order(spark, sf):
    rows = feeds.in_order(_segments(spark, sf).withColumnRenamed("grp", "conv_id"), "conv_id", "doc_id")
    return rows.select("conv_id", F.size("segments").cast("long").alias("n_segments"), F.sha2(F.array_join(F.transform("segments", lambda s: s["body"]), "|"), 256).alias("digest"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
