"""Transcript formats, feed dates and batch history on small fixtures."""

from __future__ import annotations

import html
from html.entities import html5
from urllib.parse import urljoin

from pyspark.sql import functions as F

from loregrain.operators import records
from loregrain.sources import landed, transcripts
from loregrain.sources.entities import unescaped


def test_formats(spark):
    vtt = "WEBVTT\n\nNOTE a remark\nmore of it\n\n1\n00:01 --> 00:02\n<v Ann>Hello &amp;\nSpark"
    rows = [(vtt, "Text/VTT; x=1", "Hello &\nSpark"), ('[{"body": "Hello"}, {"text": "Spark"}]', "application/json", "Hello\nSpark"), ('{"segments": [{"body": "", "text": "Hi"}]}', "application/json", "Hi")]
    rows += [("<p>Hello <b>Spark</b></p>", "text/html", "Hello Spark"), (" plain ", "text/plain", "plain"), ("<html>", "text/plain", None), ("x", "audio/mpeg", None), ("", "text/plain", None), (None, "text/vtt", None)]
    df = spark.createDataFrame(rows, "body string, mime string, want string")
    for r in df.withColumn("got", transcripts.transcript_text(df["body"], df["mime"])).collect():
        assert r["got"] == r["want"], r


def test_every_entity(spark):
    told = [f"&{name}" for name in html5] + [f"&{name}x" for name in list(html5)[::9]] + [f"&#{i};" for i in (*range(300), 55296, 64976, 65535, 1114111, 1114112, 99999999999, 128512)]
    told += ["&#x1F600;", "&#X41", "&#0000065;", "&#x;", "&#;", "&", "&&amp;", "&notit;", "&ampamp;", "&#8217;s &eacute;t&eacute", "plain", "", "&" + "x" * 50 + ";", "x &lt y&gt z"]
    df = spark.createDataFrame([(t,) for t in told], "told string")
    for r in df.withColumn("got", unescaped(df["told"])).collect():
        assert r["got"] == html.unescape(r["told"]), r
    assert spark.createDataFrame([(None,)], "t string").select(unescaped(F.col("t")).alias("t")).first()["t"] is None


def test_links_of_pages(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/b", "https://h.x:80/p/q/?z#f", "http://a/b/../c/./d?x=1#y"]
    links = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g?y/./x g#s/../x c/../d //h/a/../b http:g mailto:x@y".split() + [""]
    df = spark.createDataFrame([(b, u) for b in bases for u in links], "base string, url string")
    for r in df.withColumn("got", landed.resolved(df["url"], df["base"])).collect():
        assert r["got"] == urljoin(r["base"], r["url"]), r


def test_dates(spark):
    rows = [("Fri, 02 Jan 2026 03:04:05 +0100", 1767319445), ("2 Jan 2026 03:04:05", 1767323045), ("Fri, 02 Jan 2026 03:04:05 GMT", 1767323045), ("soon", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "value string, want long")
    for r in df.withColumn("got", transcripts.feed_date(df["value"]).cast("long")).collect():
        assert r["got"] == r["want"], r


def test_history_is_idempotent(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "b1"), ("c", 2, "b1")], "k string, v int, batch_id string")
    second = spark.createDataFrame([("a", 3, "b2")], first.schema)
    for batch in (first, second, second):
        records.append_results(batch, str(tmp_path / "h"))
    now = records.current_results(spark.read.parquet(str(tmp_path / "h")), ["k"])
    assert sorted((r["k"], r["v"]) for r in now.collect()) == [("a", 3), ("c", 2)]
