"""Landed pages and the tail of ids as data sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loregrain.sources import scan


def land(folder, site, page, items, more=True, text=None):
    at = folder / f"site={site}" / f"page={page}"
    at.mkdir(parents=True)
    (at / "part-0.json").write_text(text if text is not None else json.dumps({"items": items, "has_more": more}))


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    scan.register(spark)
    folder = tmp_path_factory.mktemp("pages")
    for page in range(1, 8):
        land(folder, "a", page, [f"a{page}-{i}" for i in range(3)], page < 6)  # page 7 lies beyond the end
    for page in range(1, 5):
        land(folder, "b", page, [{"id": page}], text="{broken" if page == 3 else None)
    land(folder, "c", 1, [])
    return str(folder)


def test_pages_and_their_ends(spark, pages):
    df = spark.read.format("landed_pages").option("path", pages).option("range", 2).load()
    rows = {(r["site"], r["page"]): r for r in df.collect()}
    assert df.rdd.getNumPartitions() == 4 + 2 + 1 and df.count() == len(rows) == 7 + 3 + 1  # each page once; of b, the range ends at page 3
    assert rows["b", 3]["error"].startswith("JSONDecodeError") and rows["b", 2]["items"] == ['{"id": 2}']
    items, report = scan.collected_items(df, 100)
    got = [(r["place"], r["item"]) for r in items.orderBy("place").collect()]
    assert got == list(enumerate([f"a{p}-{i}" for p in range(1, 7) for i in range(3)] + ['{"id": 1}', '{"id": 2}']))
    told = {r["site"]: (r["n_pages"], r["n_items"], (r["error"] or "")[:4]) for r in report.collect()}
    assert told == {"a": (6, 18, ""), "b": (2, 2, "JSON"), "c": (1, 0, "")}
    first, _ = scan.collected_items(df, 3, ["b", "a"])
    assert [r["item"] for r in first.orderBy("place").collect()] == ['{"id": 1}', '{"id": 2}', "a1-0"]


@pytest.mark.parametrize("options", [{}, {"pages": "0"}, {"pages": "many"}, {"range": "-1"}, {"pause": "61"}])
def test_options_are_checked(spark, pages, options):
    read = spark.read.format("landed_pages").options(**({"path": pages} | options if options else {}))
    with pytest.raises(Exception, match="option"):
        read.load().collect()


def test_sites_and_page_limit(spark, pages):
    read = spark.read.format("landed_pages").options(path=pages, sites="c, a, none", pages=4, range=3)
    assert sorted((r["site"], r["page"]) for r in read.load().collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 1)]


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    scan.register(spark)
    rows, seen = str(tmp_path / "rows"), []
    spark.range(100, 220).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("k")).write.parquet(rows)

    def run():
        stream = spark.readStream.format("id_tail").options(path=rows, key="event_id", limit=50, start=120).load()
        query = stream.writeStream.foreachBatch(lambda batch, epoch: seen.append([r["event_id"] for r in batch.orderBy("event_id").collect()])).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert seen[0] == list(range(121, 171)) and [i for batch in seen for i in batch] == list(range(121, 220)) and max(map(len, seen)) == 50
    before = len(seen)
    spark.range(220, 225).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("k")).write.mode("append").parquet(rows)
    run()
    assert [i for batch in seen[before:] for i in batch if i >= 220] == list(range(220, 225)) and len({i for batch in seen[before:] for i in batch}) <= 55


def test_feed_links_are_resolved_for_the_items_that_stay(spark):
    from loregrain.sources import landed

    df = spark.createDataFrame([("https://h.org/f/feed.xml", "<rss/>")], "url string, body string")
    plan = landed.feed_items(df)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window [", 1)
    assert "regexp_extract" in above and "^(?:([^:/?#]+):)?" not in below
