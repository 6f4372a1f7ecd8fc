"""Personal data: base rules, and a boosted-tree classifier over loosely matched candidates. Only DataFrame and SQL functions.

Base rules give e-mail, IP, card and phone spans. Generators propose more where base spans leave text over: runs of digits, groups
of digits, number-like runs with any separators, and e-mail-like strings, spelt-out ones too; their spans may overlap. Each has format features (digits, separators, groups,
checks) and context features (the characters and words around it). Gradient-boosted trees learn from base spans of a bounded
sample of documents and from copies of these as people write them too: e-mail addresses spelt out, card numbers with other separators, phone numbers without
a plus after a word such as phone. For every kind of copy there are others that look alike and are no personal data: handles and decorators, addresses whose parts
are too large, card numbers that fail their check, the same digits after a word such as order or isbn, and dates, times, amounts, versions and the like.
The threshold is calibrated on the third of these rows that the trees don't see: the lowest score from which on at least ``PRECISION`` of the rows are personal. A candidate has to
pass its kind's check besides: a card number Luhn's and its groups, an address its parts', a phone number its length's. Candidates are then taken in the order of their starts:
of two that overlap, the one with the better score stays, the longer of equal ones, and the first of equal lengths.
The trees are turned into CASE expressions, so scoring stays in the projection that reads the text; nothing is shuffled.

Defined results: null and empty texts have no spans; each row is judged by itself, so repeated rows give repeated results; a null
doc_id stays null. Empty tables, or samples with too few base spans, add nothing to the base. Only doc_id and text are read by ``pii_report``;
``redact`` keeps all other columns. Time grows with a text's candidates, not with their pairs.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import BLOCK, CONTEXT, digits, filled, keyed, let, matches, without_marks, written

# The base patterns. Possessive quantifiers and the look-behind keep matches as they are and time linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a kind has.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "groups": "[0-9][\\x20-][0-9]", "digits": "[0-9]", "mail": r"@|[\[(](?:at|AT)[\])]"}
DATE = r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.]|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])"
#: How card numbers are written: as one, or in groups with the same separator.
CARD = r"^(?:[0-9]{12,19}|[0-9]{4}([\x20./-]{1,2})[0-9]{4,6}\1[0-9]{4,6}(?:\1[0-9]{1,4}){0,2})$"
LOOSE = {
    "number": r"\+?+[0-9](?:[\x20().,:/-]{0,2}+[0-9])++",
    "groups": r"(?<![0-9])[0-9]{1,6}+(?:[\x20-][0-9]{2,6}+)++(?![0-9])",
    "digits": r"[0-9]++",
    "mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
}
#: What numbers that are no personal data look like: # stands for any digit.
OTHERS = ("20##-0#-1#", "1#:2#:3#", "#.#######", "###,###,###", "19##-20##", "978-#-###-#####-#", "#.#.##.####", "#######", "1#/0#/20##", "########################", "#: ### ###", "10.####/##### (20##)", "v#.##.###", "## x ## x ##")
#: Words before a phone number without a plus, and before other numbers of as many digits.
CALLED = ("phone", "tel", "call", "mobile", "fax")
COUNTED = ("order", "isbn", "invoice", "number", "id", "ref", "serial")
#: What stands after an @ that is no address.
HANDLES = ("setter", "property", "home", "noon", "work", "scale", "all")
WORDS = ("version", "page", "chapter", "year", "in", "of", "the", "about", "total", "ratio", "room", "and")
#: Documents that the sample may have: longer ones are left to the rest.
SAMPLE_CHARS = 20_000
SAMPLE_DOCS = 2_000
PRECISION = 0.97
TREES, DEPTH, STEP = 12, 3, 0.3


def _unary(f, first):
    """f with its first argument given, as the function of one column that higher-order functions want."""
    return lambda s: f(first, s)


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    back = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(F.try_to_number(d, F.lit("9")).cast("int") * 2))
    return F.aggregate(back, F.lit(0), lambda total, d: total + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))) % 10 == 0


def _small_part(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _valid(kind: str, s: Column) -> Column:
    n = F.length(digits(s["text"]))
    if kind == "ip":
        return F.forall(F.split(s["text"], r"\."), _small_part)
    if kind == "card":
        return n.between(12, 19) & luhn(digits(s["text"]))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _features(s: Column, kind: str) -> list[Column]:
    text, left, right = s["text"], s["left"], s["right"]
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    word = F.lower(left)
    return [
        F.length(text),
        F.length(digits(text)),
        F.length(F.regexp_extract(text, "[0-9]+", 0)),
        count(r"\."),
        count(r"[\x20]"),
        count("-"),
        count(r"[()]"),
        count("[,:/]"),
        F.when(text.startswith("+"), 1).otherwise(0),
        count("@"),
        count("[A-Za-z]"),
        F.when(luhn(digits(text)), 1).otherwise(0),
        count(r"\.[A-Za-z]|\x20?[\[(](?:dot|DOT)[\])]"),
        F.lit(1 if kind == "mail" else 0),
        F.when(left == "", 2).when(left.rlike(r"\s$"), 1).otherwise(0),
        F.when(right == "", 2).when(right.rlike(r"^[\s.,;!?]"), 1).otherwise(0),
        F.when(left.rlike(r"[A-Za-z0-9_]$"), 1).otherwise(0),
        F.when(right.rlike(r"^[A-Za-z0-9_]"), 1).otherwise(0),
        F.when(word.rlike(r"(mail|contact|write)\W*$"), 1).otherwise(0),
        F.when(word.rlike(r"(phone|tel|call|fax|mobile)\W*$"), 1).otherwise(0),
        F.when(word.rlike(r"(card|visa|account|iban)\W*$"), 1).otherwise(0),
        F.when(word.rlike(r"(version|license|page|year|chapter)\W*$"), 1).otherwise(0),
        F.when(word.rlike(r"(order|isbn|invoice|number|id|ref|serial)\W*$"), 1).otherwise(0),
    ]


def _with_base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with an array column of valid spans for each base kind, and ``__open``, the text with these filled."""
    out = docs.withColumn("__plain", without_marks(F.col("text")))
    open_ = F.col("__plain")
    for kind, pattern in BASE.items():
        out = out.withColumn(f"__{kind}", matches(F.col("__plain"), pattern, NEEDS[kind]))
        open_ = filled(open_, pattern, _unary(_valid, kind), NEEDS[kind])
    for kind in BASE:
        out = out.withColumn(f"__{kind}", F.filter(f"__{kind}", _unary(_valid, kind)))
    return out.withColumn("__base", F.concat(*(keyed(F.col(f"__{kind}"), i, kind) for i, kind in enumerate(BASE)))).withColumn("__open", open_)


def _array_of_features(s: Column, kind: str) -> Column:
    return F.array(*(x.cast("double") for x in _features(s, kind)))


def _with_candidates(based: DataFrame) -> DataFrame:
    """based with ``__loose``: candidates in what base spans leave over, with their features."""
    out = based
    for kind, pattern in LOOSE.items():
        out = out.withColumn(f"__{kind}", matches(F.col("__open"), pattern, NEEDS[kind]))
    long_enough = lambda s: F.length(s["text"]) >= 7

    def candidate(kind, s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _array_of_features(s, kind).alias("x"), F.lit(kind).alias("kind"))

    parts = [F.transform(F.filter(f"__{kind}", long_enough), _unary(candidate, kind)) for kind in LOOSE]
    return out.withColumn("__loose", F.concat(*parts))


def _copies(kind: str, text: Column, pick) -> list[tuple[Column, tuple[str, ...], float]]:
    """Of a base span: texts, words of which one stands before each, or none for the span's own context, and labels. pick draws one of some strings."""
    number = digits(text)
    if kind == "email":
        spelt = [(F.regexp_replace(F.replace(text, F.lit("@"), F.lit(at)), r"\.(?=[A-Za-z0-9-]+$)", dot), (), 1.0) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"))]
        name = F.split_part(text, F.lit("@"), F.lit(1))
        host = F.replace(F.split_part(text, F.lit("@"), F.lit(2)), F.lit("."), F.lit(""))  # as long as an address, but without a domain
        return [(text, (), 1.0), *spelt, *((F.concat(name, F.lit(at), what), (), 0.0) for i, at in enumerate(("@", " (at) ", " [at] ")) for what in (pick(HANDLES, i), host))]
    if kind == "ip":
        return [(text, (), 1.0), (F.regexp_replace(text, "[0-9]+$", "19045"), (), 0.0), (F.concat(text, F.lit(".3803")), (), 0.0)]
    if kind == "card":
        wrong = F.concat(F.left(number, F.length(number) - 1), ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        grouped = lambda x, sep: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{sep}")
        return [(text, (), 1.0), (wrong, (), 0.0), *((grouped(x, sep), (), label) for x, label in ((number, 1.0), (wrong, 0.0)) for sep in (".", "/", "  ")), *((grouped(wrong, sep), (), 0.0) for sep in (" ", "-"))]
    dashed, dotted = (F.regexp_replace(F.regexp_replace(text, "[()+]", ""), r"[\x20.-]+", sep) for sep in ("-", "."))
    return [(text, (), 1.0), *((x, words, label) for x in (number, dashed, dotted) for words, label in ((CALLED, 1.0), (COUNTED, 0.0)))]


def _labelled(docs: DataFrame) -> DataFrame:
    """x, label and held (a third of the rows, by hash): features of base spans, their copies of both labels, and as many other numbers (0)."""
    based = _with_base(docs)
    parts = []
    for kind in BASE:
        own = based.select(F.explode(f"__{kind}").alias("s")).select("s.text", "s.left", "s.right")
        pick = lambda n, seed: F.pmod(F.xxhash64("text", "left", F.lit(seed)), F.lit(n)).cast("int")
        one = lambda of, seed=0: F.get(F.array(*map(F.lit, of)), pick(len(of), 100 + seed))
        forms = [F.struct(text.alias("text"), (F.concat(one(words, i), F.lit(" ")) if words else F.lit("")).alias("word"), F.lit(label).alias("label")) for i, (text, words, label) in enumerate(_copies(kind, F.col("text"), one))]
        told = own.select("left", "right", F.explode(F.array_distinct(F.array(*forms))).alias("f")).select("f.text", F.right(F.concat("left", "f.word"), F.lit(CONTEXT)).alias("left"), "right", "f.label")
        s = F.struct("text", "left", "right")
        held = (F.pmod(F.xxhash64(F.lit(5), "text", "left"), F.lit(3)) == 0).alias("held")
        parts.append(told.select(_array_of_features(s, "mail" if kind == "email" else "number").alias("x"), "label", held))
        # in the same place something else, after a word of its own every other time
        form = F.get(F.array(*map(F.lit, OTHERS)), pick(len(OTHERS), 1))
        for i in range(10):  # each # gets a digit in turn
            form = F.regexp_replace(form, "#([^#]*)$", F.concat(pick(10, 10 + i).cast("string"), F.lit("$1")))
        form = F.translate(form, "#", "7")
        word = F.concat(F.get(F.array(*map(F.lit, WORDS)), pick(len(WORDS), 2)), F.lit(" "))
        other = own.select(form.alias("text"), F.when(pick(2, 3) == 0, F.right(F.concat("left", word), F.lit(CONTEXT))).otherwise(F.col("left")).alias("left"), "right")
        parts.append(other.select(_array_of_features(F.struct("text", "left", "right"), "number").alias("x"), F.lit(0.0).alias("label"), held))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _tree(lines: list[str]) -> Column | float:
    """A tree's printed form as an expression over x; lines are used up."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split()[1])
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)  # Else
    high = _tree(lines)
    return (int(feature), float(limit), low, high)


def _expression(node, x: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, limit, low, high = node
    return F.when(x[feature] <= limit, _expression(low, x)).otherwise(_expression(high, x))


class Scorer:
    """Boosted trees and a threshold."""

    def __init__(self, model: GBTClassificationModel):
        self.trees = [(w, _tree(t.toDebugString.strip().split("\n")[1:])) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        self.threshold = float("inf")

    def __call__(self, x: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(float(weight)) * _expression(tree, x)
        return total


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Scorer | None:
    """Trees for candidates; learnt from base spans of at most sample_docs documents, chosen by hash among documents with digits or @."""
    # by hash, a few times as many documents as needed get sorted, however many there are
    part = min(1.0, 8 * sample_docs / max(1, docs.count()))
    near = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) <= F.lit(int(part * (1 << 20)))
    chosen = docs.select("doc_id", "text").where(near & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64(F.lit(7), "text"), "doc_id").limit(sample_docs)
    sample = staged(chosen.repartition(8), "pii-sample")
    rows = staged(_labelled(sample).repartition(2), "pii-labelled").select("x", "label", array_to_vector("x").alias("features"), "held")
    known = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if min(known.get((held, label), 0) for held in (True, False) for label in (0.0, 1.0)) < 5:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=7).fit(rows.where("not held").select("features", "label"))
    scorer = Scorer(model)
    # the sample is bounded, and so are its distinct scores
    scores = rows.where("held").select(scorer(F.col("x")).alias("s"), "label").groupBy("s").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    good = n = 0
    for r in scores:
        good, n = good + r["good"], n + r["n"]
        if good >= PRECISION * n:
            scorer.threshold = r["s"]
    return scorer


def _named(c: Column) -> Column:
    """The kind of a candidate by its format, or null where it fails that kind's check."""
    text, n = c["text"], F.length(digits(c["text"]))
    parts = F.split(text, r"\.")
    return (
        F.when(c["kind"] == "mail", "email")
        .when(text.rlike(r"^[0-9]+(\.[0-9]+){3,}$") & ~text.rlike(r"^[0-9]{2,4}(\.[0-9]{2,5}){3,}$"), F.when((F.size(parts) == 4) & F.forall(parts, _small_part), "ip"))
        .when(text.rlike(CARD) & luhn(digits(text)), "card")
        .when(n.between(9, 15) & ~text.rlike(DATE), "phone")
    )


def _swept(candidates: Column) -> Column:
    """Of candidates struct<start, number, end, kind, score, ..> those that stay, by one pass in the order of their starts; results gather in blocks, so that time is in proportion to them."""
    kind = "array<struct<start:int,number:int,end:int,kind:string,score:double>>"
    none = F.array().cast(kind)

    def step(acc: Column, c: Column) -> Column:
        held = F.element_at(acc["held"], 1)
        apart = (F.size(acc["held"]) == 0) | (held["end"] <= c["start"])
        beats = F.struct(c["score"], c["end"] - c["start"]) > F.struct(held["score"], held["end"] - held["start"])
        return F.struct(F.when(apart, F.concat(acc["out"], acc["held"])).otherwise(acc["out"]).alias("out"), F.when(apart | beats, F.array(c)).otherwise(acc["held"]).alias("held"))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(none.alias("out"), acc["held"].alias("held")), step)
        return let(done, lambda d: F.struct(F.array_append(acc["out"], d["out"]).alias("out"), d["held"].alias("held")))

    def cut(order: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(order) / F.lit(BLOCK)).cast("int")), lambda i: F.slice(order, i * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.alias("held"))
        return F.aggregate(blocks, zero, block, lambda acc: F.concat(F.flatten(acc["out"]), acc["held"]))

    return let(F.array_sort(candidates), cut)


def with_spans(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """docs (with text) and ``__base`` and ``__all``: arrays of struct<start, number, end, kind>."""
    based = _with_base(docs)
    if scorer is None or scorer.threshold == float("inf"):
        return based.withColumn("__all", F.col("__base"))
    number = F.create_map(*(F.lit(v) for i, kind in enumerate(BASE) for v in (kind, i)))

    def judged(c):
        named = lambda kind: F.struct(c["start"].alias("start"), F.element_at(number, kind).alias("number"), c["end"].alias("end"), kind.alias("kind"), scorer(c["x"]).alias("score"))
        return let(_named(c), named)

    found = _with_candidates(based).withColumn("__scored", F.filter(F.transform("__loose", judged), lambda c: c["kind"].isNotNull() & (c["score"] >= scorer.threshold)))
    # candidates come from what base spans leave over, so they overlap none of these
    new = F.transform(_swept(F.col("__scored")), lambda c: F.struct(c["start"].alias("start"), c["number"].alias("number"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.withColumn("__all", F.concat("__base", new))


def pii_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, the base counts n_email, n_ip, n_card and n_phone, base_sha256, and spans: base ones and those added."""
    scorer = fit(docs, sample_docs)
    found = with_spans(docs.select("doc_id", "text"), scorer)
    counts = [F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; overlapping spans become one. Null text stays null."""
    scorer = fit(docs, sample_docs)
    names = docs.columns
    row = docs.select(F.col("text"), F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.array_sort("__all"), zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    done = with_spans(row, scorer).select("row", clean.alias("__clean"))
    return done.select(*(F.col("__clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names))
