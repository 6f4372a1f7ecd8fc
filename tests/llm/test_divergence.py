"""The source divergence audit against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from loregrain.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, whole string"


def plain(rows: list[tuple], least: int, most: int) -> Counter:
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}

        def shares(chosen, kept=kept):
            n = Counter(t for d in chosen for t in d[2] if t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // (n.total() + 5 * len(kept)) for t in kept}

        by = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        _, q = shares(own)
        for s, (n, p) in by.items():
            pairs = [(o, sum(abs(p[t] - by[o][1][t]) for t in kept)) for o in by if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if n[t] and p[t] > q[t]]
            for part, rows_ in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(rows_, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= most:
                        out[lang, s, part, item, value, rank] += 1
    return out


def some() -> list[tuple]:
    rnd = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)] + ["UP", "up", "ß", "中文"]
    rows = [
        (i, " ".join(rnd.choice(words[: 30 + 7 * (i % 9)]) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "1-2", "\x00\x7f_x@Y"]), rnd.choice(["en", "en", "en", "de", None]), rnd.choice([f"s{i % 9}", "s0", None]))
        for i in range(400)
    ]
    rows += [(1, None, "en", "silent"), (1, "", "fr", "a"), (2, "rare words", "fr", "b"), (None, "1 2 3", "only", "one"), (5, "long " * 50_000, "en", "s1")]
    return [(*r, "t", "w") for r in rows + rows[:20]]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # many blocks, chunks, slabs and partial counts
        for name, value in (("CHUNK", 7), ("SLAB", 3), ("BLOCK", 2), ("HELD", 50)):
            monkeypatch.setattr(divergence, name, value)
    rows = some()
    got = divergence.divergence(spark.createDataFrame(rows, COLUMNS).repartition(5), 30, 9)
    assert Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == plain(rows, 30, 9)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], COLUMNS)).collect() == []


def test_shares_are_exact_at_any_size(spark):
    counts = [0, 1, 7, 10**12, 3 * 10**15, 2**62]
    for whole in (5, 10**9 + 7, 2**53 - 1, 2**60 + 1, 2**63 - 10):
        want = [1 + 10**9 * (c + 5) // whole for c in counts if c + 5 <= whole]
        own = np.array([counts[: len(want)]])
        assert divergence.shares(own, np.array([whole], object))[0].tolist() == want
        rows = spark.createDataFrame([(c, whole - 5) for c in counts[: len(want)]], "c long, n long")
        assert [r["p"] for r in rows.select("c", divergence.share("c", "n", "1").alias("p")).orderBy("c").collect()] == want
