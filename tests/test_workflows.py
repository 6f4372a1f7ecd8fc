"""Fixtures that the tables can't expose: greedy chains, falsy fields, ties, polls, quotas, feeds, pages and judgments."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loregrain.operators import clusters, contract, evaluate, feeds, ingest, keywords, profiles, records
from loregrain.sources import landed, transcripts


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_greedy_is_sequential(spark):
    df = spark.createDataFrame([(0, "k1", "h1"), (1, "k2", "h1"), (2, "k2", "h3")], "doc_id long, k string, h string")
    assert rows(ingest.greedy(df, ("k", "h")), "doc_id") == [(0,), (2,)]


def test_greedy_follows_long_chains(spark):
    chain = [(i, f"k{(i + 1) // 2}", f"h{i // 2}") for i in range(40)]  # each row shares a key with the one before
    df = spark.createDataFrame(chain, "doc_id long, k string, h string")
    seen_k, seen_h, want = set(), set(), []
    for i, k, h in chain:
        if k not in seen_k and h not in seen_h:
            seen_k.add(k)
            seen_h.add(h)
            want.append((i,))
    assert rows(ingest.greedy(df, ("k", "h")), "doc_id") == want


def test_falsy_fields(spark):
    full = {name: "x" for name in contract.REQUIRED} | {"source": "arxiv"}
    raws = [full, full | {"title": ""}, full | {"title": None}, full | {"title": " "}, full | {"source": "reddit"}, full | {"language": ""}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(raws)], "i int, " + ", ".join(f"{n} string" for n in full)).withColumn("tags", F.lit(None).cast("array<string>"))
    got = {r["i"]: r for r in contract.checked(df).collect()}
    assert [got[i]["reject_reason"] for i in range(6)] == [None, "missing:title", "missing:title", None, "source", "missing:language"]
    assert got[0]["tags"] == [] and got[0]["license"] == "unknown" and got[0]["body_raw"] == ""
    assert contract.checked(df.limit(0)).count() == 0


def test_text_edges(spark):
    docs = spark.createDataFrame([(1, "the and of"), (2, "123 456"), (3, "C x y"), (4, "same words here"), (5, "same words here")], "doc_id long, body string")
    assert rows(keywords.term_counts(docs), "doc_id", "term") == [(3, "c"), (3, "x"), (3, "y"), (4, "words"), (5, "words")]
    twins = docs.where("doc_id > 3").withColumn("grp", F.lit(1))
    weights = keywords.grouped_weights(twins)
    assert {r["weighting"] for r in weights.collect()} == {"term_frequency"}
    assert rows(keywords.cluster_modes(weights), "k", "mode") == [(1, "single_group")]
    mixed = spark.createDataFrame([(i, ("spark cluster data " if i % 2 else "cooking soup onion ") * 3 + f"w{i}", i // 100) for i in [*range(8), 100]], "doc_id long, body string, grp int")
    both = mixed.unionByName(twins.withColumn("grp", F.lit(2)))
    for df in (both, both.repartition(7)):
        got = {r["doc_id"]: r["cluster"] for r in keywords.segment_clusters(df, most=2).collect()}
        assert len({got[i] for i in range(0, 8, 2)}) == len({got[i] for i in range(1, 8, 2)}) == 1 and got[0] != got[1]
        assert got[100] == got[4] == 0 or got[4] != got[5]
    assert {r["topic_id"] for r in keywords.kmeans_topics(mixed.limit(1)).collect()} == {0}
    assert rows(keywords.kmeans_topics(mixed)) == rows(keywords.kmeans_topics(mixed.repartition(5)))
    assert rows(keywords.kmeans_topics(docs.where("doc_id < 3")), "topic_id") == [(0,), (0,)]
    assert keywords.kmeans_topics(docs.limit(0)).count() == 0


def test_bounded_groups_hold_at_most(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("t").alias("topic"))
    got = records.bounded_groups(df, "topic", "doc_id", 300)
    assert got.count() == 700 and got.groupBy("topic", "part", "slice").count().agg(F.max("count")).first()[0] <= 300


def test_late_items_and_first_poll(spark):
    item = "feed_id string, guid string, published_at long, has_transcript boolean"
    known = "feed_id string, guid string, published_at long, status string"
    first = spark.createDataFrame([("f", f"d{i:02}", i, i == 15) for i in range(1, 17)], item)
    got = profiles.polled(first, spark.createDataFrame([], known))
    assert rows(got, "guid", "status") == [("d14", "awaiting_transcript"), ("d15", "queued"), ("d16", "awaiting_transcript")]
    later = spark.createDataFrame([("f", f"d{i:02}", i, i == 14) for i in range(1, 18)] + [("f", "none", None, False), ("f", "equal", 16, False)], item)
    second = profiles.polled(later, got.select("feed_id", "guid", "published_at", "status"))
    assert rows(second.where("change <> 'none'"), "guid", "change") == [("d14", "queued"), ("d17", "new"), ("equal", "new"), ("none", "new")]
    # a guid that comes twice stays one row, poll after poll
    twice = spark.createDataFrame([("g", "a", 1, False, 1), ("g", "a", 1, True, 2), ("g", None, 2, True, 3)], item + ", at long")
    now = spark.createDataFrame([], known)
    for _ in range(3):
        now = profiles.polled(twice, now).select("feed_id", "guid", "published_at", "status")
        assert rows(now) == [("g", "a", 1, "awaiting_transcript")]


def test_quota(spark):
    twenty = [f"f{i}" for i in range(20)]
    df = spark.createDataFrame([(1, twenty, "f3"), (2, twenty, "new"), (3, [], "new")], "user_id int, items array<string>, item string")
    assert rows(profiles.subscribed(df, F.col("item")), "user_id", "accepted") == [(1, True), (2, False), (3, True)]
    assert feeds.within_quota(spark.createDataFrame([(1, f"f{i % 25}", i) for i in range(60)], "u int, f string, at int"), "u", "f", "at").count() == 20


def test_feed_fixture(spark):
    feed = """<rss xmlns:podcast="p"><channel><title>T</title>
<item><guid>a</guid><title> One </title><description>no transcript</description><pubDate>Fri, 02 Jan 2026 03:04:05 +0000</pubDate><link>/e/1</link><enclosure url="https://cdn.x/1.mp3"/></item>
<item><guid>a</guid><title>again</title><pubDate>Sat, 03 Jan 2026 03:04:05 GMT</pubDate></item>
<item><title>no id</title></item>
<item><enclosure url="b.mp3"/><podcast:transcript url="t.srt" type="application/x-subrip"/></item></channel></rss>"""
    df = spark.createDataFrame([("https://h.org/f/feed.xml", feed), ("https://empty.org/", "<rss><channel><title>E</title></channel></rss>"), ("https://bad.org/", None)], "url string, body string")
    got = landed.feed_items(df).orderBy("place").collect()
    assert [(r["guid"], r["title"], r["source_url"], r["audio_url"], r["transcript_url"]) for r in got] == [
        ("a", "One", "https://h.org/e/1", "https://cdn.x/1.mp3", None),
        ("b.mp3", "b.mp3", "https://h.org/f/feed.xml", "https://h.org/f/b.mp3", "https://h.org/f/t.srt"),
    ]


def test_transcript_page(spark):
    page = "<html><nav><p>menu</p></nav><header><p>x</p></header><cite>Ann:</cite><p class='a'>Hello &amp;<br>Spark<script>var p='</p>';</script></p><div>chrome</div><p>open <b>end</b><footer><p>f</p></footer></html>"
    df = spark.createDataFrame([(page, "Ann:\nHello &\nSpark\nopen end"), ("", ""), (None, None)], "body string, want string")
    for r in df.withColumn("got", transcripts.paragraph_lines(df["body"])).collect():
        assert r["got"] == r["want"]


def test_pages_end_where_they_should(spark):
    pages = [("a", p, p < 3, [f"a{p}{i}" for i in range(3)]) for p in range(1, 6)] + [("b", p, True, [] if p == 2 else [f"b{p}"]) for p in range(1, 30)] + [("c", p, True, [f"c{p}"]) for p in range(1, 40)]
    df = spark.createDataFrame(pages, "source string, page int, has_more boolean, items array<string>")
    assert Counter(r["source"] for r in landed.collected(df, 1000).collect()) == {"a": 9, "b": 1, "c": 25}
    assert rows(landed.collected(df, 10), "item")[-1] == ("b1",) and landed.collected(df, 10).count() == 10


def test_judged_rankings(spark, tmp_path):
    path = str(tmp_path / "j.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([{"query_id": "q1", "judgments": {"a": 3, "b": 0}}, {"query_id": "q2", "judgments": {"a": 1}}], f)
    judged = landed.judgments(spark, path)
    assert rows(judged) == [("q1", "a", 3), ("q1", "b", 0), ("q2", "a", 1)]
    ranking = spark.createDataFrame([("q1", "m", "a", 1), ("q1", "m", "b", 2), ("q2", "m", "a", 1)], "query_id string, mode string, doc_id string, rank int")
    contract.require_judged(ranking, judged, 2)
    scores = evaluate.precision_ndcg(ranking.join(judged, ["query_id", "doc_id"]), 2)
    assert rows(scores, "query_id", "precision", "ndcg") == [("q1", 0.5, 1.0), ("q2", 0.5, 1.0)]
    for bad in (ranking.where("query_id = 'q1'"), ranking.unionByName(ranking), ranking.unionByName(spark.createDataFrame([("q2", "m", "z", 2)], ranking.schema))):
        with pytest.raises(ValueError):
            contract.require_judged(bad, judged, 2)
    with pytest.raises(ValueError):
        contract.require_judged(ranking, judged, 101)


def test_sources_that_fail_are_left_out(spark):
    out, failed = landed.union_available({"a": lambda: spark.range(2), "b": lambda: spark.read.parquet("/no/such/place"), "c": lambda: spark.range(3).withColumn("x", F.lit(1))}, {"c": 1})
    assert rows(out.groupBy("origin").count(), "origin", "count") == [("a", 2), ("c", 1)] and list(failed) == ["b"]
    assert landed.union_available({})[0] is None


def test_score_batch_replaces_itself_and_records_failures(spark, tmp_path):
    scores = spark.createDataFrame([(1, "k", 0.5), (2, "k", None)], "user_id int, knowledge_id string, score double")
    for _ in range(2):
        assert rows(profiles.score_batch(scores, "b1", str(tmp_path)), "input_count", "failed_count") == [(2, 1)]
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    with pytest.raises(Exception, match="(?i)divi"):
        profiles.score_batch(scores.withColumn("score", F.expr("user_id / (user_id - user_id)")), "b2", str(tmp_path))
    assert rows(spark.read.parquet(str(tmp_path / "batches")), "batch_id", "status", "input_count", "valid_count", "failed_count") == [("b1", "success", 2, 1, 1), ("b2", "failed", 2, 0, 2)]
    profiles.score_batch(scores.limit(1), "b2", str(tmp_path))
    assert ("b2", "success", 1) in rows(spark.read.parquet(str(tmp_path / "batches")), "batch_id", "status", "input_count")


def test_split_groups_are_bounded_and_alike(spark):
    # three subjects in one group, a group of copies only, one without terms, one that fits
    told = [("big", i, f"s{i % 3}w{j}", float(1 + (i // 3 + j) % 5)) for i in range(60) for j in range(4)]
    copies = [("copies", 100 + i, "same", 7.0) for i in range(25)]
    docs = [("big", i) for i in range(60)] + [("copies", 100 + i) for i in range(25)] + [("bare", 200 + i) for i in range(12)] + [("small", 300 + i) for i in range(5)]
    weights = spark.createDataFrame(told + copies, "grp string, doc_id long, term string, w double")
    frame = spark.createDataFrame(docs, "grp string, doc_id long")
    got = {r["doc_id"]: r["grp"] for r in clusters.split_groups(weights, frame, most=20, fan=4, depth=2, rounds=4).collect()}
    assert len(got) == len(docs) and max(Counter(got.values()).values()) <= 20
    assert all(got[d].split("/")[0] == g for g, d in docs) and {got[d] for g, d in docs if g == "small"} == {"small"}
    assert all(len({d % 3 for d in range(60) if got[d] == g}) == 1 for g in {got[d] for d in range(60)})
    again = clusters.split_groups(weights.repartition(7, "term"), frame.repartition(5), most=20, fan=4, depth=2, rounds=4)
    assert {r["doc_id"]: r["grp"] for r in again.collect()} == got
    none = clusters.split_groups(weights.where("false"), frame.where("false"), most=20)
    assert none.count() == 0 and none.columns == ["doc_id", "grp"]


def test_similar_in_any_group_counts_a_pair_once(spark):
    vectors = {1: {"a": 1.0, "b": 2.0}, 2: {"a": 2.0, "b": 4.0}, 3: {"a": 1.0}, 4: {"b": 1.0}, 5: {"c": 1.0}}
    weights = spark.createDataFrame([(d, t, w) for d, v in vectors.items() for t, w in v.items()], "doc_id long, term string, weight double")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "y"), (5, "y"), (4, "z")], "doc_id long, grp string")
    got = rows(keywords.similar_in_any(weights, groups, 2), "doc_id", "other_id", "score", "rank")
    third = 0.447214
    assert got == [(1, 2, 1.0, 1), (1, 3, third, 2), (2, 1, 1.0, 1), (2, 3, third, 2), (3, 1, third, 1), (3, 2, third, 2)]


def test_splits_of_one_group_differ(spark):
    told = [(i, f"w{(7 * i + j * j) % 31}", float(1 + j)) for i in range(120) for j in range(5)]
    weights = clusters.unit_weights(spark.createDataFrame(told, "doc_id long, term string, weight double"))
    docs = spark.createDataFrame([(g, i) for g in ("0", "1") for i in range(120)], "grp string, doc_id long")
    got = rows(clusters.split_groups(weights, docs, most=40, fan=4, depth=2, rounds=3), "doc_id", "grp")
    assert len(got) == 240 and max(Counter(g for _, g in got).values()) <= 40
    parts = [{frozenset(d for d, h in got if h == g) for g in {h for _, h in got if h[0] == t}} for t in "01"]
    assert parts[0] != parts[1]
