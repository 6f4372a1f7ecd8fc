"""What raw documents, keys, rankings and transcripts have to hold, as flags, counts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("doc_id", "source", "source_site", "title", "body_text", "language", "created_at", "source_url")
SOURCES = ("stackexchange", "arxiv")
TRANSCRIPT = (20, 400_000)


def falsy(df: DataFrame, name: str) -> Column:
    """Null, '', 0, false or an empty array; white space is something."""
    kind = dict(df.dtypes)[name]
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(name) < 1, F.lit(True))
    empty = F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(0).cast(kind) if kind in ("int", "bigint", "double", "float", "smallint") else None
    return F.col(name).isNull() if empty is None else F.coalesce(F.col(name) == empty, F.lit(True))


def checked(raw: DataFrame, required: tuple[str, ...] = REQUIRED, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """raw with ``reject_reason``: missing:<first such field>, source, or null; and defaults where a field is null: body_raw '', tags [], license unknown."""
    reason = F.when(F.lit(False), "")
    for name in required:
        reason = reason.when(falsy(raw, name), f"missing:{name}")
    out = raw.withColumn("reject_reason", reason.when(~F.col("source").isin(*sources), "source"))
    for name, value in (("body_raw", F.lit("")), ("tags", F.array().cast("array<string>")), ("license", F.lit("unknown"))):
        out = out.withColumn(name, F.coalesce(name, value) if name in raw.columns else value)
    return out


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """The keys that more than one row has, and how many; empty if key is unique. A partial count comes before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if not key_violations(df, key).isEmpty():
        raise ValueError(f"{', '.join(key)} is not unique")
    return df


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The asked keys that known lacks."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def unjudged(rankings: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, mode, doc_id, rank) within the first k that have no judgment."""
    return rankings.where(F.col("rank") <= k).join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "mode", "doc_id", "rank")


def require_judged(rankings: DataFrame, judged: DataFrame, k: int) -> None:
    """Raises unless k is 1..100, there are two queries, no ranking repeats a document and its first k are judged with grades 0..3."""
    if not 1 <= k <= 100:
        raise ValueError("k must be 1..100")
    if rankings.select("query_id").distinct().limit(2).count() < 2:
        raise ValueError("two queries at least")
    require_unique(rankings, ["query_id", "mode", "doc_id"])
    if not judged.where("grade is null or grade not between 0 and 3").isEmpty() or not unjudged(rankings, judged, k).isEmpty():
        raise ValueError("a ranking has documents without a grade of 0..3")


def bounded_transcript(text: Column, least: int = 1, most: int = TRANSCRIPT[1]) -> Column:
    """Why a transcript is not taken: empty, too_short, too_long, or null."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when(n < least, "too_short").when(F.length(text) > most, "too_long")


def kept_segments(segments: DataFrame, tokens: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Segments with tokens, and of each key how many have none (skipped_segments)."""
    flagged = segments.withColumn("__n", F.size(tokens))
    counts = flagged.groupBy(key).agg(F.count_if(F.col("__n") < 1).alias("skipped_segments"), F.count("*").alias("n_segments"))
    return flagged.where(F.col("__n") > 0).drop("__n"), counts


def first_rows(df: DataFrame, by: list, k: int) -> DataFrame:
    """The first k rows in an order that leaves no ties open; Spark keeps k rows a task."""
    if not 1 <= k <= 100:
        raise ValueError("k must be 1..100")
    return df.orderBy(*by).limit(k)


def ranked_within(df: DataFrame, key: str, by: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("place") <= k)


# Fixed values of requests.
MODES = ("personalized", "baseline")
ACTIONS = ("confirmed_known", "useful", "irrelevant")


def request_error(limit: Column, source: Column, mode: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """Why a request for recommendations, its values as text, is not answered: invalid_limit, invalid_source, invalid_mode, or null. What isn't given is valid."""
    number = F.coalesce(F.trim(limit).try_cast("int"), F.lit(-1))
    return F.when(limit.isNotNull() & ~number.between(1, 100), "invalid_limit").when(~source.isin(*sources), "invalid_source").when(~mode.isin(*MODES), "invalid_mode")


def feedback_error(knowledge_id: Column, action: Column) -> Column:
    """invalid_action unless an id of 1 to 256 characters comes with one of ACTIONS; else null."""
    fine = F.length(knowledge_id).between(1, 256) & action.isin(*ACTIONS)
    return F.when(~F.coalesce(fine, F.lit(False)), "invalid_action")


def knowledge_parts(knowledge_id: Column) -> Column:
    """struct<kind, value> of an id: topic or keyword and what follows the prefix; nulls for any other id."""
    of = lambda prefix: F.when(knowledge_id.startswith(prefix), F.substring(knowledge_id, F.lit(len(prefix) + 1), F.length(knowledge_id)))
    return F.struct(F.when(knowledge_id.startswith("topic:"), "topic").when(knowledge_id.startswith("kw:"), "keyword").alias("kind"), F.coalesce(of("topic:"), of("kw:")).alias("value"))
