"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models of characters, one of accepted and one of blocked URLs, give each character a probability
from the longest context that was seen, mixed with that of the next shorter one and so on (Witten-Bell weights), down to a
uniform one. A URL's score is the difference of its log-likelihoods per character. The threshold is calibrated on URLs that
the models have not seen: the score, on a grid of 1 / ``BINS``, from which on the fewer of them are judged wrongly, both classes weighing the same.

The models learn from all different URLs that the rules decide, less the fifth, chosen by hash, that the threshold is calibrated on.
They are tables: strings of up to ORDER + 1 characters, a context and the character after it, with their counts in each class, added up in
tasks first. Probabilities go from each length to the next one by a join, and the URLs to be scored are dealt into chunks, which ask for
the weights of their different strings only. Without five URLs of each class nothing is blocked by score.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
Defined results: a null URL, or one without ``://``, has an empty host and path and no score, and is allowed. Rows are judged each by
itself, whatever page_id is. Empty tables give empty results. Other columns are not read; ``keep_allowed`` keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, staged

#: (host, path, verdict), as given by the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
LETTERS = 256
#: Different strings that a task adds up before it hands them on.
HELD = 500_000
#: URLs of a chunk, which share one lookup of their strings.
CHUNK = 100
#: Steps of a score of 1 that the threshold is chosen from.
BINS = 1024
#: Weights are whole multiples of 1 / UNIT, so that their sums are the same in any order.
UNIT = 1 << 40


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def grams(url: str) -> Iterator[str]:
    """Each character of a URL after its context of up to ORDER characters."""
    text = "^" + url + "$"
    return (text[max(0, i - ORDER) : i + 1] for i in range(1, len(text)))


def _distinct_urls(pages: DataFrame, rules) -> DataFrame:
    """u, its hash h and its verdict by rule, or null, of the different URLs."""
    host, path = parts()
    urls = pages.select(F.concat(host, path).alias("u"), fitting(host, path, rules)["verdict"].alias("verdict")).where("u <> ''").distinct()
    return staged(urls.select("u", F.xxhash64("u").alias("h"), "verdict"), "url-distinct")


def _counts(learned: DataFrame) -> DataFrame:
    """s, good, bad: how often each string of up to ORDER + 1 characters is in the URLs of each class."""

    def expanded(seen: dict[str, Counter]) -> pa.RecordBatch:
        good, bad = Counter(), Counter()
        for out, own in ((good, seen["allow"]), (bad, seen["block"])):
            for gram, n in own.items():
                for k in range(len(gram)):
                    out[gram[k:]] += n
        s = list(good.keys() | bad.keys())
        return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array([good[x] for x in s], pa.int64()), pa.array([bad[x] for x in s], pa.int64())], ["s", "good", "bad"])

    def run(batches):
        seen = {"allow": Counter(), "block": Counter()}
        for rows in rows_of(batches, "u", "verdict"):
            for u, verdict in rows:
                seen[verdict].update(grams(u))
            if sum(map(len, seen.values())) > HELD:
                yield expanded(seen)
                seen = {"allow": Counter(), "block": Counter()}
        yield expanded(seen)

    return learned.select("u", "verdict").mapInArrow(run, "s string, good long, bad long").groupBy("s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _wanted(asked: DataFrame) -> DataFrame:
    """chunk, s: the different strings of the URLs of each chunk."""

    def run(batches):
        now, own = None, set()

        def batch(chunk, own):
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array(list(own), pa.string())], ["chunk", "s"])

        for rows in rows_of(batches, "chunk", "u"):
            for chunk, u in rows:
                if chunk != now and own:
                    yield batch(now, own)
                    own = set()
                now = chunk
                own.update(grams(u))
        if own:
            yield batch(now, own)

    return asked.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "u").mapInArrow(run, "chunk long, s string")


def _weights(counts: DataFrame, strings: DataFrame) -> DataFrame:
    """s, weight: by how much more likely, in units of its logarithm, the last character of each of strings is in blocked URLs than in accepted ones."""
    ends = strings.select("s").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda n: F.right(F.col("s"), n))).alias("s"))
    all_ = counts.unionByName(ends.select("s", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))).groupBy("s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_ = staged(all_.select("s", F.length("s").alias("n"), F.left(F.col("s"), F.length("s") - 1).alias("context"), "good", "bad"), "url-strings")
    contexts = all_.groupBy("context").agg(*(x for c in ("good", "bad") for x in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))))
    all_ = staged(all_.join(contexts, "context").drop("context"), "url-counts")
    out, shorter = None, None
    for n in range(1, ORDER + 2):
        level = all_.where(F.col("n") == n)
        if shorter is None:
            level = level.withColumn("good_p", F.lit(1 / LETTERS)).withColumn("bad_p", F.lit(1 / LETTERS))
        else:
            level = level.withColumn("end", F.right(F.col("s"), F.lit(n - 1))).join(shorter.withColumnRenamed("s", "end"), "end")
        mixed = [
            F.when(F.col(f"{c}_total") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")).alias(f"{c}_p")
            for c in ("good", "bad")
        ]
        shorter = staged(level.select("s", *mixed), "url-level")
        out = shorter if out is None else out.unionByName(shorter)
    return out.select("s", F.round((F.log("bad_p") - F.log("good_p")) * F.lit(float(UNIT))).cast("long").alias("weight"))


def _scored(asked: DataFrame, wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """u, verdict and score of every row of asked."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    known = wanted.join(weights, "s").select("chunk", F.lit(0).alias("kind"), "s", "weight", text.alias("verdict"))
    both = known.unionByName(asked.select("chunk", F.lit(1).alias("kind"), F.col("u").alias("s"), number.alias("weight"), "verdict"))

    def run(batches):
        now, table = None, {}
        for rows in rows_of(batches, "chunk", "kind", "s", "weight", "verdict"):
            out = []
            for chunk, kind, s, weight, verdict in rows:
                if chunk != now:
                    now, table = chunk, {}
                if kind:
                    out.append((s, verdict, sum(map(table.__getitem__, grams(s))) / UNIT / (len(s) + 1)))
                else:
                    table[s] = weight
            if out:
                kinds = [pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["u", "verdict", "score"])

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, "u string, verdict string, score double")


def calibrated(bins: list[tuple[int, int, int]]) -> float:
    """The score from which on blocking makes the fewest mistakes, both classes weighing the same; of (bin, good URLs, bad URLs)."""
    marks = sorted(bins)
    n_good, n_bad = sum(g for _, g, _ in marks), sum(b for _, _, b in marks)
    wrong = best = 1.0  # all blocked: every good one is wrong
    threshold = marks[0][0] / BINS
    for i, (at, good, bad) in enumerate(marks):
        wrong += bad / n_bad - good / n_good
        if wrong < best:
            best, threshold = wrong, (at + 1 + (marks[i + 1][0] if i + 1 < len(marks) else at + 1)) / 2 / BINS
    return threshold


def _scores(pages: DataFrame, rules) -> tuple[DataFrame, float] | None:
    """(u and score of the different URLs that no rule decides, the threshold); None if the rules decide too few URLs to learn from."""
    urls = _distinct_urls(pages, rules)
    found = {r["verdict"]: r for r in urls.groupBy("verdict").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.max("h").alias("last")).collect()}
    if any(v not in found or found[v]["n"] < 5 for v in ("allow", "block")):
        return None
    # of each class one URL at least is held, and one is learned from
    held = F.lit(False)
    for v in ("allow", "block"):
        held = held | ((F.col("verdict") == v) & ((F.pmod("h", F.lit(5)) == 0) | (F.col("h") == found[v]["first"])) & (F.col("h") != found[v]["last"]))
    open_ = F.col("verdict").isNull()
    chunks = sum(r["n"] for r in found.values()) // CHUNK + 1
    asked = urls.where(open_ | held).select(F.pmod("h", F.lit(chunks)).alias("chunk"), "u", "verdict")
    wanted = staged(_wanted(asked), "url-wanted")
    weights = _weights(_counts(urls.where(~open_ & ~held)), wanted)
    scored = staged(_scored(asked, wanted, weights), "url-scores")
    bins = scored.where(~open_).groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    return scored.where(open_).select("u", "score"), calibrated([tuple(r) for r in bins.collect()])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (null where a rule decides or there is no host and path)."""
    host, path = parts()
    rule = fitting(host, path, rules)
    base = pages.select(*(pages[f"`{c}`"] for c in pages.columns), host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))
    found = _scores(pages, rules)
    if found is None:
        return base.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("score", F.lit(None).cast("double"))
    scores, threshold = found
    open_ = F.col("verdict").isNull() & (F.concat("host", "path") != "")
    settled = base.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("score", F.lit(None).cast("double"))
    judged = base.where(open_).withColumn("__u", F.concat("host", "path")).join(scores.withColumnRenamed("u", "__u"), "__u", "left").drop("__u")
    return settled.unionByName(judged.withColumn("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    return judge(pages.select("page_id", "url"), rules).drop("url")


def keep_allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages less the rows whose URL is blocked."""
    row = F.struct(*(pages[f"`{c}`"] for c in pages.columns))
    judged = judge(pages.select("url", row.alias("row")), rules)
    return judged.where("verdict = 'allow'").select("row.*")
