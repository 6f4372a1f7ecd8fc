"""Transcripts in their formats and dates of feeds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import unescaped
from .markup import HIDDEN, without_elements

SUBTITLES = ("text/vtt", "application/x-subrip", "application/srt", "text/srt")


def media_type(mime: Column) -> Column:
    """Without parameters, in lower case."""
    return F.split_part(F.lower(mime), F.lit(";"), F.lit(1))


def json_text(body: Column) -> Column:
    """Lines of a JSON transcript: an object with ``segments`` or a bare array; of each entry its body, or else its text. Null if it is neither."""
    entries = "array<struct<body: string, text: string>>"
    bare = F.from_json(body, entries)
    whole = F.from_json(body, f"struct<segments: {entries}>")["segments"]
    found = F.when(F.ltrim(body).startswith("["), bare).otherwise(whole)
    return F.array_join(F.transform(found, lambda e: F.coalesce(F.nullif(e["body"], F.lit("")), e["text"], F.lit(""))), "\n")


def subtitle_lines(body: Column) -> Column:
    """Spoken lines of WebVTT or SRT: no header, cue times or numbers, and no NOTE, STYLE or REGION blocks, which end at a blank line.

    Tags go, entities become characters.
    """
    unix = F.regexp_replace(body, r"\r\n?", "\n")
    plain = F.regexp_replace(unix, r"(?ms)^[ \t]*(NOTE|STYLE|REGION).*?(?=^[ \t]*$|\z)", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    spoken = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    return unescaped(F.regexp_replace(F.array_join(spoken, "\n"), "<[^>\n]*>", ""))


def paragraph_lines(html: Column) -> Column:
    """The lines of p and cite elements of a transcript's page, less scripts, styles, navigation, heads, feet and asides. br ends a line.

    An element that isn't closed ends where the next one begins. Entities become characters.
    """
    page = F.regexp_replace(without_elements(html, (*HIDDEN, "nav", "header", "footer", "aside")), r"(?i)<br\s*/?>", "\n")
    told = F.regexp_extract_all(page, F.lit(r"(?is)<(p|cite)\b[^>]*>(.*?)(?=</\1\s*>|<(?:p|cite)\b|\z)"), F.lit(2))
    plain = unescaped(F.regexp_replace(F.array_join(told, "\n"), "<[^>]*>", ""))
    return F.array_join(F.filter(F.transform(F.split(plain, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def transcript_text(body: Column, mime: Column) -> Column:
    """The text of a transcript by its media type; null for other types, for none and for markup that calls itself text."""
    kind = media_type(mime)
    text = F.when(kind == "application/json", json_text(body)).when(kind.isin(*SUBTITLES), subtitle_lines(body)).when(kind == "text/html", paragraph_lines(body)).when(kind == "text/plain", body)
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when((plain != "") & ~F.lower(plain).rlike(r"^(<html|<!doctype|<\?xml)"), plain)


def feed_date(value: Column) -> Column:
    """A timestamp from a feed's date such as ``Fri, 02 Jan 2026 03:04:05 +0100``. No zone means UTC; null if it is no such date."""
    plain = F.trim(F.regexp_replace(value, r"^\s*[A-Za-z]{3},", ""))
    zoned = F.regexp_replace(plain, r"\s+(GMT|UTC?|Z)$", " +0000")
    zoned = F.when(zoned.rlike(r"[+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))
