"""SQL twins of the catalogue's queries, for an independent engine over the same Parquet tables."""

from __future__ import annotations

from ..functions.stopwords import ENGLISH
from ..operators.clusters import clusters_sql

STOP = ", ".join(f"'{w}'" for w in ENGLISH if w.isalpha())
DOCS = r"""d AS (SELECT doc_id, source, lang, n_chars, text AS body, split_part(text, chr(10), 1) AS title, source || '/' || split_part(text, chr(10), 1) AS source_url,
  CAST(substr(source, 4) AS BIGINT) AS topic_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents)"""
NORM = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
HASHED = f"h AS (SELECT doc_id, source_url, sha256({NORM.format('title')} || chr(10) || {NORM.format('body')}) AS hash FROM d)"


def tf(rows: str, prefix: str = "") -> str:
    """CTEs tf, df and w over rows (doc_id, body)."""
    p = prefix
    return f"""{p}tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS term FROM {rows}),
{p}tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}w AS (SELECT doc_id, term, round(tf * ln((n + 1.0) / (df + 1.0)), 6) AS weight FROM {p}tf JOIN {p}df USING (term), (SELECT count(*) AS n FROM {rows}))"""


def top(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM {rows}) WHERE rank <= {k}"


def cosine(groups: str, k: int) -> str:
    return f"""g AS (SELECT w.*, grp FROM w JOIN ({groups}) USING (doc_id) WHERE weight > 0),
u AS (SELECT doc_id, grp, term, weight / nrm AS v FROM g JOIN (SELECT doc_id, sqrt(sum(weight * weight)) AS nrm FROM g GROUP BY doc_id) USING (doc_id)),
s AS (SELECT a.doc_id, b.doc_id AS other_id, round(sum(a.v * b.v), 6) AS score FROM u a JOIN u b ON a.grp = b.grp AND a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


TF = f"WITH {DOCS}, {tf('d')}"
TOP = f"{TF}, t10 AS ({top('w', 10)})"
TERMS = f"""{TOP}, best AS (SELECT topic_id, term, max(weight) AS weight, arg_max(doc_id, struct_pack(a := weight, b := -doc_id)) AS doc_id FROM t10 JOIN d USING (doc_id) GROUP BY ALL),
tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM best) WHERE rank <= 5),
tc AS (SELECT topic_id, count(*) AS document_count FROM d GROUP BY topic_id)"""
UNITS = f"""{TERMS}, units AS (
SELECT 'topic:' || tt.topic_id AS knowledge_id, tt.topic_id, h.doc_id, tt.term FROM tt JOIN tt h ON h.topic_id = tt.topic_id AND h.rank = 1
UNION ALL SELECT 'kw:' || term, topic_id, doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY document_count, topic_id DESC) AS p FROM tt JOIN tc USING (topic_id)) WHERE p = 1)"""
KNOWN_TOPICS = "SELECT user_id, event_id % 20 AS topic_id, bool_or(event_type = 'signup') AS derives FROM events WHERE event_type IN ('signup', 'purchase') AND event_id % 3 = 0 GROUP BY ALL"
READS = "SELECT user_id, event_id % (SELECT count(*) FROM documents) AS doc_id, min(event_id) AS read_at FROM events WHERE event_type = 'view' GROUP BY ALL"
PROFILE = f"""{UNITS}, kt AS ({KNOWN_TOPICS}), rd AS ({READS}),
known AS (SELECT user_id, term FROM kt JOIN tt USING (topic_id) WHERE derives UNION SELECT user_id, term FROM rd JOIN t10 USING (doc_id))"""
CLASSES = f"""{PROFILE}, un AS (SELECT knowledge_id, topic_id, doc_id, count(*) AS n_terms FROM units GROUP BY ALL),
hits AS (SELECT user_id, knowledge_id, count(*) AS n FROM units JOIN known USING (term) GROUP BY ALL),
classes AS (SELECT u.user_id, un.*, coalesce(n, 0) AS n_matched, kt.topic_id IS NOT NULL AS in_topic,
  CASE WHEN coalesce(n, 0) > 0 THEN 'known' WHEN kt.topic_id IS NOT NULL THEN 'refine' ELSE 'new' END AS status
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN un LEFT JOIN hits ON hits.user_id = u.user_id AND hits.knowledge_id = un.knowledge_id
  LEFT JOIN kt ON kt.user_id = u.user_id AND kt.topic_id = un.topic_id)"""
SCORES = f"""{CLASSES}, scores AS (SELECT c.*, d.source, d.title, round(0.4::DOUBLE * c.in_topic::INT + 0.4::DOUBLE * ((n_terms - n_matched) / n_terms) + 0.2::DOUBLE * CASE WHEN d.words IS NULL OR d.words >= 50 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END
  - 0.5::DOUBLE * (rd.doc_id IS NOT NULL)::INT, 6) AS score FROM classes c LEFT JOIN d USING (doc_id) LEFT JOIN rd ON rd.user_id = c.user_id AND rd.doc_id = c.doc_id)"""
RANKED = "SELECT {} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, knowledge_id) AS rank FROM scores {}) WHERE rank <= {}"
RANKINGS = f"""WITH {DOCS}, j AS (SELECT source AS query_id, doc_id, n_chars, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 3 END AS grade FROM d JOIN labels USING (doc_id)),
r AS (SELECT query_id, 'personalized' AS mode, grade, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM j
  UNION ALL SELECT query_id, 'baseline', grade, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM j),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY grade DESC, rank) AS ideal FROM r),
s AS (SELECT query_id, mode, sum(CASE WHEN rank <= 5 AND grade > 0 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= 5 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY ALL),
m AS (SELECT query_id, mode, round(good / 5, 6) AS precision, round(CASE WHEN best > 0 THEN dcg / best ELSE 0.0 END, 6) AS ndcg FROM s)"""
SEG = """conv AS (SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn, text), ' ') AS text FROM conversations GROUP BY conv_id),
seg AS (SELECT conv_id, i AS segment_id, substr(text, i * 800 + 1, 800) AS body FROM (SELECT conv_id, text, unnest(range((length(text) + 799) // 800)) AS i FROM conv)),
sd AS (SELECT conv_id * 1000 + segment_id AS doc_id, conv_id, body FROM seg)"""


#: As many rounds as the rows ask for: those kept are out of the next round, and so are those that share a key with one of them.
GREEDY = f"""WITH RECURSIVE {DOCS}, {HASHED},
g AS (SELECT doc_id, source_url, hash, doc_id = min(doc_id) OVER (PARTITION BY source_url) AND doc_id = min(doc_id) OVER (PARTITION BY hash) AS taken FROM h
  UNION ALL SELECT doc_id, source_url, hash, doc_id = min(doc_id) OVER (PARTITION BY source_url) AND doc_id = min(doc_id) OVER (PARTITION BY hash) FROM
  (SELECT * FROM (SELECT *, bool_or(taken) OVER (PARTITION BY source_url) OR bool_or(taken) OVER (PARTITION BY hash) AS settled FROM g) WHERE NOT settled))
SELECT doc_id FROM g WHERE taken"""


KMEANS = f"""{TF}, often AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20000),
kw AS MATERIALIZED (SELECT 0 AS grp, doc_id, term, round(weight * 1000) AS w FROM w SEMI JOIN often USING (term) WHERE weight > 0),
kd AS (SELECT 0 AS grp, doc_id FROM d), {clusters_sql("kw", "kd", 8, 10)} SELECT doc_id, cluster AS topic_id FROM member"""

REASON = "CASE WHEN source IS NULL OR source = '' OR title = '' OR body IS NULL OR body = '' OR source_url = '' THEN 'missing_field' WHEN NOT regexp_matches(body, '[a-zA-Z]{2,}') THEN 'no_usable_text' ELSE '' END"

SQL: dict[str, str] = {
    "doc_validate": f"WITH {DOCS} SELECT doc_id, source, {REASON} AS reject_reason, words < 50 AS short_body FROM d",
    "doc_reject_counts": f"WITH {DOCS} SELECT CASE WHEN r = '' THEN 'valid' ELSE r END AS reason, count(*) AS n FROM (SELECT {REASON} AS r FROM d) GROUP BY r",
    "doc_quality": f"WITH {DOCS} SELECT source, count(*) AS n_docs, CAST(sum(CASE WHEN words < 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM d GROUP BY source",
    "dedup_exact": f"WITH {DOCS} SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM d GROUP BY source_url",
    "dedup_content": f"WITH {DOCS}, {HASHED} SELECT min(doc_id) AS doc_id, hash FROM h GROUP BY hash",
    "dedup_greedy": GREEDY,
    "html_to_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "url_normalize": """SELECT page_id, lower(regexp_extract(url, '^[^:]+://[^/?#]*')) || CASE WHEN r = '' THEN '/' WHEN starts_with(r, '?') THEN '/' || r ELSE r END AS url
FROM (SELECT *, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS r FROM pages)""",
    "stable_ids": "SELECT page_id, sha256(sha256(url) || ':' || page_id) AS stable_id FROM pages",
    "token_counts": f"{TF} SELECT doc_id, term, tf FROM tf",
    "doc_freq": f"{TF} SELECT term, df FROM df",
    "tfidf_topk": f"{TOP} SELECT * FROM t10",
    "vocab_top": f"{TF} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "similar_docs_topk": f"{TF}, {cosine('SELECT doc_id, source || chr(47) || lang AS grp FROM d', 5)} SELECT doc_id, other_id, score, rank FROM near",
    "embedding_similar_topk": """WITH s AS (SELECT a.vec_id, b.vec_id AS other_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other_id) AS rank FROM s) WHERE rank <= 5""",
    "kmeans_topics": KMEANS,
    "topic_aggregation": f"WITH {DOCS} SELECT topic_id, count(*) AS document_count FROM d GROUP BY topic_id",
    "topic_top_terms": f"{TERMS} SELECT topic_id, term, weight, doc_id, rank FROM tt",
    "knowledge_units": f"{UNITS} SELECT * FROM units",
    "profile_known_keywords": f"{PROFILE} SELECT user_id, term FROM known",
    "classify_units": f"{CLASSES} SELECT user_id, knowledge_id, n_matched, status FROM classes",
    "classify_counts": f"{CLASSES} SELECT status, count(*) AS n FROM classes GROUP BY status",
    "conflict_override": f"""{CLASSES}, ev AS (SELECT 'topic:' || (event_id % 20) AS knowledge_id, bool_or(event_id % 7 = 0) AS reviewed FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, knowledge_id, CASE WHEN reviewed THEN 'possible_conflict' ELSE status END AS status, coalesce(NOT reviewed, false) AS pending_review FROM classes LEFT JOIN ev USING (knowledge_id)""",
    "score_units": f"{SCORES} SELECT user_id, knowledge_id, score FROM scores",
    "recommendations_topk": f"{SCORES} {RANKED.format('user_id, knowledge_id, status, score, rank', '', 20)}",
    "recommendations_by_source": f"""{SCORES} {RANKED.format('user_id, knowledge_id, title, rank', "WHERE source = 'src7'", 5)}""",
    "baseline_newest": f"WITH {DOCS} SELECT doc_id, source, title FROM d ORDER BY doc_id DESC LIMIT 20",
    "baseline_similar": f"""{TF}, {cosine('SELECT doc_id, source || chr(47) || lang AS grp FROM d', 5)}, rd AS ({READS}),
f AS (SELECT rd.user_id, near.other_id AS doc_id, min(struct_pack(a := read_at, b := rank)) AS seen_at FROM rd JOIN near USING (doc_id) GROUP BY ALL),
n AS (SELECT * FROM f ANTI JOIN rd USING (user_id, doc_id))
SELECT * FROM (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY seen_at, doc_id) AS rank FROM n) WHERE rank <= 20""",
    "feedback_latest": "SELECT user_id, event_id % 20 AS topic_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY user_id, event_id % 20",
    "confirm_known_update": KNOWN_TOPICS,
    "eval_precision_ndcg": f"{RANKINGS} SELECT * FROM m",
    "eval_macro_difference": f"""{RANKINGS} SELECT round(sum(CASE WHEN mode = 'personalized' THEN precision ELSE -precision END) / count(DISTINCT query_id), 4) AS precision_diff,
round(sum(CASE WHEN mode = 'personalized' THEN ndcg ELSE -ndcg END) / count(DISTINCT query_id), 4) AS ndcg_diff FROM m""",
    "transcript_segments": f"WITH {SEG} SELECT conv_id, segment_id, sha256(body) AS digest FROM seg",
    "transcript_keywords": f"WITH {SEG}, {tf('sd')} SELECT * FROM ({top('w', 8)}) WHERE weight > 0",
    "segment_similarity": f"WITH {SEG}, {tf('sd')}, {cosine('SELECT doc_id, conv_id AS grp FROM sd', 3)} SELECT doc_id, other_id, score, rank FROM near",
    "upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "insert_if_absent": "SELECT DISTINCT user_id, event_type FROM events",
    "stats_by_source": "SELECT coalesce(source, 'all') AS source, count(*) AS n FROM documents WHERE source <> '' GROUP BY ROLLUP (source)",
    "notification_fanout": """WITH e AS (SELECT event_id % 50 AS feed_id, event_id FROM events WHERE event_type = 'view'), s AS (SELECT user_id, event_id % 50 AS feed_id, min(event_id) AS created_at FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT DISTINCT s.user_id, e.event_id AS episode_id FROM e JOIN s USING (feed_id) WHERE created_at <= e.event_id AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'view' AND x.event_id % 5 = 0 AND x.user_id = s.user_id AND x.event_id = e.event_id)""",
    "subscription_episodes_semi": "SELECT event_id % 50 AS feed_id, event_id FROM events WHERE event_type = 'view' AND event_id % 50 IN (SELECT event_id % 50 FROM events WHERE event_type = 'signup')",
    "late_data_cutoff": """WITH r AS (SELECT user_id AS feed_id, event_type AS guid, CAST(floor(epoch(ts)) AS BIGINT) AS published_at, event_id FROM events), k AS (SELECT * FROM r WHERE event_id % 2 = 0)
SELECT r.* FROM r LEFT JOIN (SELECT feed_id, max(published_at) AS cutoff FROM k GROUP BY feed_id) USING (feed_id)
WHERE event_id % 2 = 1 AND (cutoff IS NULL OR published_at IS NULL OR published_at >= cutoff OR EXISTS (SELECT 1 FROM k WHERE k.feed_id = r.feed_id AND k.guid = r.guid))""",
    "retry_queue": """SELECT * FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'ready' END AS status, event_id % 5 AS attempts, event_id AS retry_at FROM events)
WHERE status = 'queued' OR (status = 'failed' AND attempts < 3 AND retry_at <= 500)""",
    "quota_cap": "SELECT user_id, feed_id, place FROM (SELECT user_id, feed_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), feed_id) AS place FROM (SELECT user_id, event_id % 50 AS feed_id, event_id FROM events) GROUP BY user_id, feed_id) WHERE place <= 20",
    "rate_limit_tumbling": "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, user_id, count(*) AS n FROM events GROUP BY ALL",
    "stream_tumbling_counts": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "tail_cursor": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "current_results": "SELECT user_id, batch_id, event_id FROM (SELECT user_id, strftime(ts, '%Y%m%d') AS batch_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y%m%d') DESC) AS r FROM events) WHERE r = 1",
    "latest_batches": "SELECT batch_id, n AS input_count FROM (SELECT strftime(ts, '%Y%m%d') AS batch_id, count(*) AS n, min(event_id) AS s FROM events GROUP BY 1) ORDER BY s DESC, batch_id LIMIT 5",
    "column_update": """WITH r AS (SELECT user_id, min(event_id) AS status, max(event_id) AS score FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT user_id, max(event_id) AS score FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, r.status, coalesce(c.score, r.score) AS score FROM r FULL JOIN c USING (user_id)""",
    "compare_and_set": "SELECT event_id, event_type IN ('error', 'click') AS matched, CASE WHEN event_type IN ('error', 'click') THEN 'queued' ELSE event_type END AS event_type FROM events",
    "bounded_groups": f"""WITH {DOCS}, p AS (SELECT doc_id, topic_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % ((count(*) OVER (PARTITION BY topic_id) + 19) // 20) AS part FROM d)
SELECT doc_id, topic_id, part, (row_number() OVER (PARTITION BY topic_id, part ORDER BY doc_id) - 1) // 20 AS slice FROM p""",
    "transcript_json": r"SELECT conv_id, nullif(regexp_replace(string_agg(text, chr(10) ORDER BY turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END, text), '^\s+|\s+$', '', 'g'), '') AS text FROM conversations GROUP BY conv_id",
    "feed_dates": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3600 END AS published_at FROM events",
}
