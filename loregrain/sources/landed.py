"""Records of question sites, paper lists and feeds, from pages that were landed as files, and sources that may fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transcripts import feed_date

ATOM = "id string, title string, summary string, updated string, category array<struct<_term: string>>"
ITEM = "struct<guid: string, title: string, pubDate: string, link: string, enclosure: struct<_url: string>, transcript: array<struct<_url: string, _type: string>>>"
RSS = f"channel struct<title: string, item: array<{ITEM}>>"
TRANSCRIPTS = ("application/json", "text/vtt", "application/x-subrip", "application/srt", "text/srt", "text/html", "text/plain")


def collected(pages: DataFrame, target: int, most_pages: int = 25) -> DataFrame:
    """Items of paged sources: (source, page, has_more, items) in the order of source, then page, up to target items.

    A source ends at its first empty page or the first without more, and after ``most_pages``. Each item comes with its place.
    """
    last = pages.where((F.size("items") == 0) | ~F.col("has_more")).groupBy("source").agg(F.min("page").alias("last"))
    open_ = pages.where(F.col("page") <= most_pages).join(last, "source", "left").where("last is null or page <= last")
    # places follow from the sizes of the pages before: one row a page, at most most_pages a source, is put in order and no item
    before = F.sum("n").over(Window.orderBy("source", "page").rowsBetween(Window.unboundedPreceding, -1))
    sizes = open_.groupBy("source", "page").agg(F.max(F.size("items")).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = sizes.where(F.col("before") < target).select("source", "page", "before")
    placed = open_.dropDuplicates(["source", "page"]).join(wanted, ["source", "page"]).select("source", "page", "before", F.posexplode("items").alias("i", "item"))
    return placed.withColumn("place", F.col("before") + F.col("i")).where(F.col("place") < target).select("source", "page", "place", "item")


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC; null counts as 0."""
    return F.date_format(F.timestamp_seconds(F.coalesce(epoch, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def question_record(site: Column, item: Column) -> Column:
    """A document of a question site's item; ids of different sites don't meet."""
    return F.struct(
        F.concat_ws("-", site, item["question_id"].cast("string")).alias("doc_id"),
        site.alias("source_site"),
        item["title"].alias("title"),
        item["body"].alias("body_raw"),
        F.coalesce(item["tags"], F.array().cast("array<string>")).alias("tags"),
        iso_time(item["creation_date"]).alias("created_at"),
        item["link"].alias("source_url"),
        F.coalesce(item["content_license"], F.lit("unknown")).alias("license"),
    )


def paper_record(entry: Column) -> Column:
    """A document of an Atom entry, given as its XML: the id after the last slash, white space collapsed, terms of all categories."""
    e = F.from_xml(entry, F.lit(ATOM))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.struct(
        F.substring_index(e["id"], "/", -1).alias("doc_id"),
        squeezed(e["title"]).alias("title"),
        squeezed(e["summary"]).alias("body_text"),
        F.coalesce(F.transform(e["category"], lambda c: c["_term"]), F.array().cast("array<string>")).alias("tags"),
        e["updated"].alias("created_at"),
        e["id"].alias("source_url"),
    )


def without_dots(path: Column) -> Column:
    """A path whose . and .. segments have taken effect: one pass over its segments, in which .. takes back the one before."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        # the first, empty segment of an absolute path stays
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1))))).when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolved(url: Column, base: Column) -> Column:
    """A link of a page at base, by the rules of RFC 3986, as most readers apply them: links of another scheme stay, one of the base's own scheme without
    a host counts as relative, and the path of a link that has a host is left as it is."""
    part = lambda c, i: F.regexp_extract(c, r"^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    scheme, host, path, asked = (part(base, i) for i in range(1, 5))
    own_scheme, own_host, own_path, own_asked, mark = (part(url, i) for i in range(1, 6))
    folder = F.when((path == "") & (host != ""), "/").otherwise(F.regexp_extract(path, "^(.*/)?", 0))
    joined = F.when(own_path == "", path).when(own_path.startswith("/"), without_dots(own_path)).otherwise(without_dots(F.concat(folder, own_path)))
    whole = F.concat(
        scheme,
        F.lit(":"),
        F.when(own_host != "", F.concat(own_host, own_path)).otherwise(F.concat(host, joined)),
        F.when((own_host == "") & (own_path == "") & (own_asked == ""), asked).otherwise(own_asked),
        mark,
    )
    return F.when(url == "", base).when((own_scheme != "") & (F.lower(own_scheme) != F.lower(scheme)), url).otherwise(whole)


def short_title(title: Column, instead: Column) -> Column:
    """Stripped, of at most 300 characters; instead where there is none."""
    return F.substring(F.trim(F.coalesce(F.nullif(title, F.lit("")), instead)), 1, 300)


def feed_items(feeds: DataFrame, most: int = 3) -> DataFrame:
    """Of each feed (url, body: its XML) the ``most`` newest items: feed_id, item_id, guid, title, source_url, audio_url, transcript_url, transcript_type, published_at.

    An item's guid is its own, or its audio's address, or its link; items without one are left out, and of equal ones the first is taken. The first
    transcript of a known type is taken. Items without a date come last; of equal dates, the first in the feed.
    """
    parsed = feeds.select("url", F.from_xml("body", F.lit(RSS), {"ignoreNamespace": "true"})["channel"].alias("c"))
    items = parsed.select("url", F.posexplode("c.item").alias("at", "i"))
    full = lambda c: F.nullif(c, F.lit(""))
    guid = F.coalesce(full(F.trim("i.guid")), full(F.col("i.enclosure._url")), full(F.col("i.link")))
    kind = lambda t: F.split_part(F.lower(t["_type"]), F.lit(";"), F.lit(1))
    told = F.get(F.filter("i.transcript", lambda t: kind(t).isin(*TRANSCRIPTS) & (t["_url"] != "")), F.lit(0))
    # links are resolved and titles made for the few items that stay
    told_by = F.struct("at", F.col("i.title").alias("title"), F.col("i.link").alias("link"), F.col("i.enclosure._url").alias("audio"), F.struct(told["_url"].alias("url"), kind(told).alias("type")).alias("transcript"), F.col("i.pubDate").alias("date"))
    first = items.select("url", guid.alias("guid"), told_by.alias("r")).where("guid is not null").groupBy("url", "guid").agg(F.min_by("r", F.col("r.at")).alias("r"))
    dated = first.select("url", "guid", "r.*").withColumn("published_at", feed_date(F.col("date")))
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("published_at"), "at"))
    newest = dated.withColumn("place", place).where(F.col("place") <= most)
    rows = newest.select(
        F.sha2("url", 256).alias("feed_id"),
        "guid",
        short_title(F.col("title"), F.col("guid")).alias("title"),
        resolved(F.coalesce("link", F.lit("")), F.col("url")).alias("source_url"),
        resolved(F.col("audio"), F.col("url")).alias("audio_url"),
        resolved(F.col("transcript.url"), F.col("url")).alias("transcript_url"),
        F.col("transcript.type").alias("transcript_type"),
        "published_at",
        "place",
    )
    return rows.withColumn("item_id", F.sha2(F.concat_ws(":", "feed_id", "guid"), 256))


def union_available(sources: dict[str, Callable[[], DataFrame]], limits: dict[str, int] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all sources that can be read, columns by name, missing ones null, and the errors of the others. limits: rows of a source at most.

    Readers check their paths when they are planned; a source that fails while it runs fails its job, which Spark retries by task.
    """
    out, failed = None, {}
    for name, read in sources.items():
        try:
            df = read()
        except (PySparkException, OSError) as error:
            failed[name] = str(error).split("\n")[0]
            continue
        if limits and name in limits:
            df = df.limit(limits[name])
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def judgments(spark: SparkSession, path: str, one_list: bool = True) -> DataFrame:
    """(query_id, doc_id, grade) of queries with a map of judgments: a JSON list, or a line for each query."""
    raw = spark.read.schema("query_id string, judgments map<string, int>").json(path, multiLine=one_list)
    return raw.select("query_id", F.explode("judgments").alias("doc_id", "grade"))
