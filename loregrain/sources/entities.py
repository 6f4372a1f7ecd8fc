"""Character references of HTML as a column expression: every name that HTML has, and numbers."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a name has at most; HTML's longest has 31 and a semicolon.
LONGEST = 32


def _table() -> Column:
    """Names as they stand after &, most with their semicolon, and what they mean: the language's own table, as one literal that Spark folds."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string, string>")


def _of_code(code: Column) -> Column:
    """The character of a code point, which is none for controls and non-characters; 128 to 159 mean those of Windows-1252, as in browsers."""
    western = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    nothing = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(code.between(128, 159), F.element_at(F.array(*map(F.lit, western)), (code - 127).cast("int")))
        .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(nothing, "")
        .otherwise(text)
    )


def _one(part: Column) -> Column:
    """What follows an ampersand, with its reference replaced, or with the ampersand if it is none."""
    digits = F.regexp_extract(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    plain = F.regexp_replace(F.regexp_replace(digits, r"^#[xX]?0*(?=[0-9a-fA-F])", ""), ";$", "")
    # more than eight digits are beyond any code point
    code = F.when(F.length(plain) > 8, 0x110000).when(digits.rlike("^#[xX]"), F.conv(plain, 16, 10).cast("long")).otherwise(plain.try_cast("long"))
    word = F.regexp_extract(part, rf"^[^\t\n\f <&#;]{{1,{LONGEST}}};?", 0)
    # the longest name that the word begins with; it is looked for only where there is a word
    sizes = F.when(word != "", F.sequence(F.length(word), F.lit(1), F.lit(-1)))
    hit = F.get(F.filter(sizes, lambda n: F.map_contains_key(_table(), F.substring(word, F.lit(1), n))), F.lit(0))
    named = F.concat(F.element_at(_table(), F.substring(word, F.lit(1), hit)), F.substring(part, hit + 1, F.length(part)))
    return F.when(digits != "", F.concat(_of_code(code), F.substring(part, F.length(digits) + 1, F.length(part)))).when(hit.isNotNull(), named).otherwise(F.concat(F.lit("&"), part))


def unescaped(text: Column) -> Column:
    """text with all references replaced, in one pass from left to right; texts without an ampersand are passed on."""
    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), _one)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(text)
