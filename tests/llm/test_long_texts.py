"""Span operators on texts with very many matches and very long runs, and their entropy against brute force."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from loregrain.llm import decontaminate, pii, secret_scan, spans

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def entropy(text: str, width: int) -> float:
    best = 0.0
    for at in range(len(text) - width + 1):
        n = Counter(text[at : at + width])
        best = max(best, -sum(c / width * math.log2(c / width) for c in n.values()))
    return best


def test_entropy_of_windows(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(LETTERS[:k]) for _ in range(n)) for k in (1, 2, 5, 30, 64) for n in (24, 25, 70, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    alphabet = secret_scan.CLASSES["base64"][0]
    for r in df.select("text", secret_scan.best_entropy(F.col("text"), alphabet).alias("e")).collect():
        assert abs(r["e"] - entropy(r["text"], secret_scan.WINDOW)) < 1e-9


def test_spans_of_many_matches(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice(["ab1 ", "é", "22\n", "\ue000", "x"]) for _ in range(3000))
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    got = df.select(spans.matches(spans.without_marks(F.col("text")), "[0-9]+").alias("m")).collect()
    import re

    assert [(s["start"], s["end"], s["text"]) for s in got[0]["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
    assert got[1]["m"] == got[2]["m"] == []


def test_long_texts_end_soon(spark):
    rnd = random.Random(7)
    run = "".join(rnd.choice(LETTERS) for _ in range(1_000_000))
    mails = " ".join(f"u{i}@h{i}.org" for i in range(100_000))
    df = spark.createDataFrame([(1, "data:image/png;base64," + run), (2, mails)], "doc_id long, text string").repartition(2)
    start = time.time()
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(df).collect()}
    assert "entropy_base64" in found[1] and found[2] == ""
    counts = {r["doc_id"]: r["n_email"] for r in pii.pii_report(df).collect()}
    assert counts[2] == 100_000
    assert time.time() - start < 240


def test_a_word_repeated_a_million_times(spark):
    bench = spark.createDataFrame([(1, "the " * 40), (2, "the " * 20 + "cat " * 20), (3, "of the " * 4), (4, " ".join(map(str, range(30))))], "item_id long, text string")
    rows = [(1, "the " * 1_000_000), (2, "the " * 500_000 + "cat " * 19), (3, "of the " * 60_000), (4, "x " + "the " * 12), (5, "y " * 30), (6, "y"), (6, "the " * 2000 + " ".join(map(str, range(30))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    start = time.time()
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.contaminated(df, bench).collect()}
    assert time.time() - start < 60
    # in document 2, item 2 is found whole with one word replaced
    assert got == {(1, 1): 40, (1, 2): 20, (2, 1): 40, (2, 2): 40, (3, 3): 8, (6, 1): 40, (6, 2): 20, (6, 4): 30}


def test_offsets_of_repeated_words(spark):
    rnd = random.Random(8)
    texts = [[rnd.choice("aab") for _ in range(rnd.randint(0, 60))] for _ in range(40)]
    items = [[rnd.choice("aab") for _ in range(rnd.choice((5, 9, 14, 25)))] for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            for o in range(1 - len(item), len(t)):
                lo, hi = max(0, -o), min(len(item), len(t) - o)
                same = [item[p] == t[p + o] for p in range(lo, hi)]
                if len(item) < 13:
                    n = len(item) * (len(same) == len(item) and 10 * sum(same) >= 8 * len(item))
                else:
                    ends = [p for p, s in enumerate(same) if s]
                    n = max((b - a + 1 for a in ends for b in ends if b - a >= 12 and 10 * sum(same[a : b + 1]) >= 8 * (b - a + 1)), default=0)
                seeded = any(all(same[p + k] for k, bit in enumerate(m) if bit == "1") for m in decontaminate._masks(len(item)) for p in range(len(same) - len(m) + 1))
                if n and seeded:
                    want[i, j] = max(n, want.get((i, j), 0))
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 100
