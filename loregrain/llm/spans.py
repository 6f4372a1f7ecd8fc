"""Spans of pattern matches as DataFrame expressions, in code points.

A text's matches are wrapped in two marks by one ``regexp_replace``, the text is split at the first mark, and the pieces' lengths
give the places. Pieces are taken in blocks, whose lengths are summed first, so that a text with very many matches takes time in
proportion to them. The marks are private-use characters; where a text has them itself, another one takes their place, which
keeps all counts and matches, as the patterns are of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, STAND_IN, FILL = "\ue000", "\ue001", "\ue002", "\ue003"
CONTEXT = 16
BLOCK = 64
SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"


def let(value: Column, f) -> Column:
    """f of value, which is evaluated once however often f has it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def without_marks(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE, FILL):
        plain = F.replace(plain, F.lit(mark), F.lit(STAND_IN))
    return plain


def _pieces(text: Column, pattern: str) -> Column:
    """The text, cut before each match; a match ends at CLOSE."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def _rest(piece: Column) -> Column:
    return F.substring(piece, F.instr(piece, CLOSE) + 1, F.length(piece))


def _size(piece: Column) -> Column:
    return F.length(piece) - F.when(F.instr(piece, CLOSE) > 0, 1).otherwise(0)


def _step(acc: Column, piece: Column) -> Column:
    close, rest = F.instr(piece, CLOSE), _rest(piece)
    match = F.substring(piece, F.lit(1), close - 1)
    span = F.struct(acc["at"].alias("start"), (acc["at"] + close - 1).cast("int").alias("end"), match.alias("text"), acc["left"].alias("left"), F.left(rest, F.lit(CONTEXT)).alias("right"))
    return F.struct(
        (acc["at"] + _size(piece)).cast("int").alias("at"),
        F.right(rest, F.lit(CONTEXT)).alias("left"),
        F.when(close > 0, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
    )


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, end, text, left, right>> of the leftmost matches, which don't overlap; text has no marks.

    needs: a shorter pattern that every match has; texts without it are passed over.
    """
    if needs:
        return F.when(text.rlike(needs), matches(text, pattern)).otherwise(F.array().cast(SPAN))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, piece: n + _size(piece)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

        def within(starts: Column) -> Column:
            def found(block: Column, i: Column) -> Column:
                before = F.coalesce(F.right(_rest(F.element_at(F.get(blocks, i - 1), -1)), F.lit(CONTEXT)), F.lit(""))
                zero = F.struct(F.get(starts, i).alias("at"), before.alias("left"), F.array().cast(SPAN).alias("found"))
                return F.aggregate(block, zero, _step, lambda acc: acc["found"])

            return F.flatten(F.transform(blocks, found))

        return let(starts, within)

    def cut(pieces: Column) -> Column:
        last = F.floor((F.size(pieces) - 1) / F.lit(BLOCK)).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK))), placed)

    return let(_pieces(text, pattern), cut)


def filled(text: Column, pattern: str, valid, needs: str | None = None) -> Column:
    """text with FILL for every character of the matches that are valid, a function of struct<text>; needs as for matches."""
    if needs:
        return let(text, lambda t: F.when(t.rlike(needs), filled(t, pattern, valid)).otherwise(t))

    def one(piece: Column) -> Column:
        match = F.substring(piece, F.lit(1), F.instr(piece, CLOSE) - 1)
        covered = F.when(valid(F.struct(match.alias("text"))), F.repeat(F.lit(FILL), F.length(match))).otherwise(match)
        return F.when(F.instr(piece, CLOSE) > 0, F.concat(covered, _rest(piece))).otherwise(piece)

    return F.array_join(F.transform(_pieces(text, pattern), one), "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def clear_of(span: Column, others: Column) -> Column:
    """Whether span overlaps none of others."""
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def keyed(spans: Column, number: int, kind: str) -> Column:
    """spans as structs that sort by start, then by the kind's number."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
