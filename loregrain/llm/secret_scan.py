"""Secrets: base rules, and sliding-window entropy over candidate strings. Only DataFrame and SQL functions.

Candidates are runs of at least ``WINDOW`` characters of a class: hex digits, or the letters of base64 and its URL form. A window slides
over each candidate; its character counts, packed into a few whole numbers, change by one character that leaves and one that comes,
and so does the sum of n * log2(n), which gives the window's Shannon entropy. Candidates are sought in what base spans leave over. A candidate is a secret if its best window reaches the
class's threshold, unless the allow-list knows it, it is only a path or it overlaps a base span, which stays as it is.

Spans are those of the whole match. Defined results: null and empty texts have no spans; each row is judged by itself; a null doc_id
stays null; empty tables give empty results. Only doc_id and text are read by ``secret_report``; ``masked`` keeps all other columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import clear_of, filled, keyed, let, matches, without_marks, written

# The base patterns, with possessive quantifiers where nothing is to be given back.
BASE = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
LEAST = 12
WINDOW = 24
#: class: (its characters, bits that a window must reach)
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 3.2),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 4.0),
}
#: What looks random and isn't secret: UUIDs, plain words, digests of integrity attributes, documentation keys.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[A-Za-z_/=+-]+$",
    r"^[0-9_/=+-]+$",
    r"^sha(?:1|256|384|512)-",
    r"EXAMPLE",
)
#: A run that begins like a path is allowed, unless one of its segments is a secret by itself or several are neither words nor numbers.
PATH = r"^(?:[A-Za-z0-9_-]{0,15}/){2,}"
WORDS = r"^(?:[A-Za-z]*+[0-9]*+(?:[_=+-]++|$))*+$"
SLUG = r"^(?:[a-z]*+[0-9]*+(?:[_=+-]++|$))*+$"


#: Counts of a window, five bits each, are held in whole numbers of so many.
PACKED = 12


def best_entropy(text: Column, alphabet: str) -> Column:
    """The highest entropy, in bits, of a window of text; text has only characters of alphabet, WINDOW of them at least.

    A step takes the character that leaves out of its count and puts the one that comes into its own, and changes the sum by these two.
    """
    term = lambda n: F.get(F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2))), n)
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c % PACKED * 5)
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, F.floor(c / PACKED).cast("int")), c % PACKED * 5).bitwiseAND(F.lit(31)).cast("int")

    def slid(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // PACKED)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(math.inf).alias("least"))

        def step(acc: Column, i: Column) -> Column:
            come, gone = F.get(codes, i), F.get(codes, i - WINDOW)  # null before the window is full
            lost = count(acc["counts"], gone)
            had = count(acc["counts"], come) - F.when(come == gone, 1).otherwise(0)
            total = acc["sum"] - F.coalesce(term(lost) - term(lost - 1), F.lit(0.0)) + term(had + 1) - term(had)

            def changed(packed: Column, k: Column) -> Column:
                put = F.when(F.floor(come / PACKED) == k, unit(come)).otherwise(F.lit(0).cast("long"))
                taken = F.when(F.floor(gone / PACKED) == k, unit(gone)).otherwise(F.lit(0).cast("long"))
                return packed + put - taken

            return F.struct(F.transform(acc["counts"], changed).alias("counts"), total.alias("sum"), F.when(i >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    return let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), slid)


def _allowed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | text.rlike(pattern)
    return out


def _only_path(text: Column, alphabet: str, bits: float) -> Column:
    segments = F.split(text, "/", -1)
    odd = F.size(F.filter(segments, lambda x: ~x.rlike(WORDS)))
    long_ = F.filter(segments, lambda x: (F.length(x) >= WINDOW) & ~x.rlike(SLUG) & ~_allowed(x))
    return text.rlike(PATH) & (odd < 2) & ~F.exists(long_, lambda x: best_entropy(x, alphabet) >= bits)


def _is_secret(alphabet: str, bits: float):
    return lambda s: ~_allowed(s["text"]) & (best_entropy(s["text"], alphabet) >= bits) & ~_only_path(s["text"], alphabet, bits) & clear_of(s, F.col("__base"))


def _long_enough(s: Column) -> Column:
    return F.length(F.regexp_extract(s["text"], VALUE, 1)) >= LEAST


def with_spans(docs: DataFrame) -> DataFrame:
    """docs (with text) and, by base kind, ``__assign`` etc., then ``__base`` and ``__all``: arrays of struct<start, number, end, kind>."""
    out = docs.withColumn("__plain", without_marks(F.col("text")))
    open_ = F.col("__plain")  # what base spans leave over
    for kind, pattern in BASE.items():
        out = out.withColumn(f"__{kind}", matches(F.col("__plain"), pattern))
        open_ = filled(open_, pattern, _long_enough if kind == "assign" else lambda s: F.lit(True))
    out = out.withColumn("__assign", F.filter("__assign", _long_enough)).withColumn("__open", open_)
    out = out.withColumn("__base", F.concat(*(keyed(F.col(f"__{kind}"), i, kind) for i, kind in enumerate(BASE))))
    for name, (alphabet, _) in CLASSES.items():
        letters = "[" + alphabet.replace("-", r"\-") + "]"
        out = out.withColumn(f"__{name}_runs", matches(F.col("__open"), rf"(?<!{letters}){letters}{{{WINDOW},}}+"))
    for i, (name, (alphabet, bits)) in enumerate(CLASSES.items()):
        secret = F.filter(f"__{name}_runs", _is_secret(alphabet, bits))
        out = out.withColumn(f"__{name}_new", keyed(secret, len(BASE) + i, f"entropy_{name}"))
    first, second = (F.col(f"__{name}_new") for name in CLASSES)
    return out.withColumn("__all", F.concat("__base", first, F.filter(second, lambda s: clear_of(s, first))))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts n_assign, n_access and n_hex, base_sha256, and spans: base ones and those added."""
    found = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__all")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every secret of ``text`` replaced by its kind in brackets; overlapping spans become one. Null text stays null."""
    names = docs.columns
    row = docs.select(F.col("text"), F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.array_sort("__all"), zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    done = with_spans(row).select("row", clean.alias("__clean"))
    return done.select(*(F.col("__clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names))
