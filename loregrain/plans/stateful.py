"""Queries of data sources and of streams that keep state by key, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import scan, tables
from ..streaming import events as streams
from ..streaming import state

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _polls_sql(n: int = 3) -> str:
    """Known items after each poll, from those after the one before."""
    parts = ["k0 AS (SELECT NULL::VARCHAR AS feed_id, NULL::VARCHAR AS guid, NULL::BIGINT AS published_at, NULL::VARCHAR AS status WHERE false)"]
    for p in range(n):
        parts += [
            f"i{p} AS (SELECT * FROM items WHERE poll = {p} QUALIFY row_number() OVER (PARTITION BY feed_id, guid ORDER BY event_id) = 1)",
            f"r{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC NULLS LAST, event_id) AS place FROM i{p}) WHERE place <= CASE WHEN feed_id IN (SELECT feed_id FROM items WHERE poll < {p}) THEN 100 ELSE 3 END)",
            f"c{p} AS (SELECT feed_id, max(published_at) AS cutoff FROM k{p} GROUP BY feed_id)",
            f"""k{p + 1} AS (SELECT k.feed_id, k.guid, k.published_at, CASE WHEN k.status = 'awaiting_transcript' AND r.has_transcript THEN 'queued' ELSE k.status END AS status FROM k{p} k LEFT JOIN r{p} r USING (feed_id, guid)
UNION ALL SELECT feed_id, guid, published_at, CASE WHEN has_transcript THEN 'queued' ELSE 'awaiting_transcript' END FROM r{p} ANTI JOIN k{p} USING (feed_id, guid) LEFT JOIN c{p} USING (feed_id) WHERE NOT coalesce(published_at < cutoff, false))""",
        ]
    return f"""WITH items AS (SELECT CAST(user_id AS VARCHAR) AS feed_id, event_type || (event_id % 9) AS guid, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS published_at,
event_id % 5 < 3 AS has_transcript, event_id, event_id % {n} AS poll FROM events), {", ".join(parts)} SELECT * FROM k{n}"""


@query(_polls_sql())
def stream_polls(spark, sf):
    """Three polls of the same feeds, each a run of its own that goes on from the state of the one before."""
    i = F.col("event_id")
    items = tables.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("feed_id"), F.concat("event_type", (i % 9).cast("string")).alias("guid"), F.when(i % 13 != 0, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("published_at"),
        (i % 5 < 3).alias("has_transcript"), i.alias("at"), (i % 3).alias("poll"),
    )
    batches = [items.where(F.col("poll") == p).drop("poll") for p in range(3)]
    changes = state.landed_in_turn(batches, state.polled_changes, _folder(spark, "polls"))
    return changes.groupBy("feed_id", "guid").agg(F.max_by(F.struct("published_at", "status"), "poll").alias("r")).select("feed_id", "guid", "r.*")


@query("""WITH o AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'manual' END AS kind FROM events),
r AS (SELECT *, max(CASE WHEN kind = 'manual' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS anew FROM o WHERE kind IS NOT NULL),
l AS (SELECT user_id, count(*) FILTER (WHERE kind = 'failed' AND (anew IS NULL OR (ts, event_id) > anew)) AS attempts, arg_max(kind, (ts, event_id)) AS kind, arg_max(ts, (ts, event_id)) AS ts FROM r GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS item, CAST(attempts AS INT) AS attempts, CASE kind WHEN 'ready' THEN 'ready' WHEN 'manual' THEN 'queued' ELSE CASE WHEN attempts < 3 AND ts + INTERVAL 2 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) THEN 'queued' ELSE 'failed' END END AS status FROM l""")
def stream_retries(spark, sf):
    """Where items stand after their failures and the timers that are due by the newest event, with two hours between attempts."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "signup", "manual").otherwise("clock")
    outcomes = streams.event_stream(spark, sf).select(F.col("user_id").cast("string").alias("item"), "event_id", kind.alias("kind"), "ts")
    folder = _folder(spark, "retries")
    state.to_folder(state.retried(outcomes, wait_ms=7_200_000), f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.schema(state.ATTEMPT).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("item").agg(F.max_by(F.struct("attempts", "status"), "seq").alias("r")).select("item", "r.*")


@query("SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def stream_rate_limit(spark, sf):
    requests = streams.event_stream(spark, sf).select("user_id", "ts")
    folder = _folder(spark, "limits")
    over = state.rate_limited(requests, "user_id", "ts", 2, "1 day")
    state.to_folder(over, f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.schema(over.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("user_id", F.unix_seconds("start").alias("start")).agg(F.max("n").alias("n"))


@query("""SELECT 'site' || site AS site, page, place, item FROM (SELECT *, row_number() OVER (ORDER BY site, page, item) - 1 AS place
FROM (SELECT event_id % 4 AS site, event_id // 400 + 1 AS page, event_id AS item FROM events) WHERE page <= 25 AND NOT (site = 2 AND page > 7) AND NOT (site = 3 AND page >= 5)) WHERE place < 8000""")
def qa_scan(spark, sf):
    """Pages of a hundred items, landed and scanned: site 2 says at page 7 that it has no more, site 3 can't be read from page 5 on and keeps what came before."""
    i = F.col("event_id")
    rows = tables.table(spark, sf, "events").select(F.concat(F.lit("site"), (i % 4).cast("string")).alias("site"), (F.floor(i / 400) + 1).alias("page"), i)
    pages = rows.groupBy("site", "page").agg(F.array_sort(F.collect_list("event_id")).alias("items"))
    broken = (F.col("site") == "site3") & (F.col("page") == 5)
    folder = _folder(spark, "pages")
    told = pages.withColumn("has_more", ~((F.col("site") == "site2") & (F.col("page") == 7))).withColumn("items", F.when(~broken, F.col("items")))
    told.write.partitionBy("site", "page").json(folder)
    scan.register(spark)
    items, _ = scan.collected_items(spark.read.format("landed_pages").options(path=folder, sites="site0,site1,site2,site3").load(), 8000)
    return items.select("site", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"), F.col("item").cast("long").alias("item"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def stream_tail(spark, sf):
    """The first poll of a tail that starts after a cursor."""
    scan.register(spark)
    rows = spark.readStream.format("id_tail").options(path=f"{sf}/events.parquet", key="event_id", limit=50, start=100).load().select("event_id", "user_id", "event_type")
    folder = _folder(spark, "tail")
    state.to_folder(rows, f"{folder}/out", f"{folder}/checkpoint", "append")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
