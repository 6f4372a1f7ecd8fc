"""Secret spans and benchmark overlaps against brute force, and every form of every operator on empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from loregrain.llm import bpe, decontaminate, jaccard_join, line_dedup, pii, quality_rules, secret_scan, suffix_dedup, url_filter, warc
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def entropy(text: str, width: int) -> float:
    counts = (Counter(text[at : at + width]) for at in range(len(text) - width + 1))
    return max((-sum(c / width * math.log2(c / width) for c in n.values()) for n in counts), default=0.0)


def test_secrets_against_brute_force(spark):
    rnd = random.Random(11)
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    parts = [
        lambda: f'token = "{run(LETTERS, rnd.randint(8, 30))}"',
        lambda: f"API_KEY:{run('abc.=/-', rnd.randint(8, 20))}",
        lambda: "AKIA" + run("ABCDEFGHIJ0123456789", rnd.randint(8, 20)),
        lambda: run("0123456789abcdef", rnd.randint(10, 40)),
        lambda: run(LETTERS, rnd.randint(10, 60)),
        lambda: run("ab", 40),
        lambda: "word and words",
        lambda: "passwordpassword=é" + run("xyz", 3),
    ]
    texts = [" ".join(rnd.choice(parts)() for _ in range(rnd.randint(0, 12))) for _ in range(150)] + [None, "token token=abcdefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = 0
    for r in secret_scan.secret_report(df).collect():
        t = texts[r["doc_id"]] or ""
        spans = []
        for k, (kind, p) in enumerate(BASE.items()):
            for m in re.finditer(p, t):
                if {"assign": lambda m: len(m.group(1)) >= 12, "access": lambda m: len(m.group()) >= 18, "hex": lambda m: len(m.group()) >= 16}[kind](m):
                    spans.append((m.start(), k, m.end(), kind))
        spans.sort()
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans).encode()).hexdigest(), t
        own = {f"{kind}:{s}:{e}" for s, _, e, kind in spans}
        found = set(r["spans"].split(",")) - {""}
        assert own <= found
        for kind, start, end in (x.split(":") for x in found - own):
            s, e = int(start), int(end)
            added += 1
            letters, bits = secret_scan.CLASSES[kind.removeprefix("entropy_")]
            assert set(t[s:e]) <= set(letters) and entropy(t[s:e], secret_scan.WINDOW) >= bits - 1e-9
            assert not any(a < e and s < b for a, _, b, _ in spans)
    assert added > 50


def stretch(same: list[bool], least: int, percent: int) -> int:
    n = len(same)
    return max((j - i for i in range(n) for j in range(i + least, n + 1) if same[i] and same[j - 1] and 100 * sum(same[i:j]) >= percent * (j - i)), default=0)


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(12)
    items = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (5, 6, 8, 12, 13, 20, 40)]
    texts = [[f"x{rnd.randrange(400)}" for _ in range(rnd.randint(0, 30))] for _ in range(120)]
    for t in texts:
        item = rnd.choice(items)
        low = rnd.randrange(max(1, len(item) - 12)) if len(item) > 13 else 0
        part = list(item[low : low + rnd.randint(8, 40)])
        for _ in range(rnd.randrange(5)):
            part[rnd.randrange(len(part))] = "other"
        at = rnd.randint(0, len(t))
        t[at:at] = part
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.contaminated(docs, bench).collect()}
    every, sure = {}, set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            for offset in range(-len(item) + 1, len(t)):
                places = [p for p in range(len(item)) if 0 <= p + offset < len(t)]
                same = [item[p] == t[p + offset] for p in places]
                if len(item) < 13:
                    n = len(item) * (len(same) == len(item) and 100 * sum(same) >= 80 * len(item))
                else:
                    n = stretch(same, 13, 80)
                if n:
                    every[i, j] = max(n, every.get((i, j), 0))
                    if len(item) < 13 or any(all(same[k : k + 5]) for k in range(len(same) - 4)):
                        sure.add((i, j))
    assert set(got) <= set(every) and sure <= set(got)  # all that seeds promise, and nothing else
    assert len(got) >= 0.97 * len(every) > 40
    assert all(n <= every[k] for k, n in got.items())


def test_every_form_takes_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, row string, spans string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    same = [quality_rules.keep_good(docs), suffix_dedup.drop_repeats(docs), pii.redact(docs), secret_scan.masked(docs), jaccard_join.one_of_each(docs), line_dedup.dedup_lines(docs), decontaminate.drop_contaminated(docs, bench)]
    for df in same:
        assert df.columns == docs.columns and df.count() == 0
    assert url_filter.keep_allowed(pages).count() == 0 and warc.read(warc.write(pages)).count() == 0
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    assert bpe.bpe_digest(docs, path).count() == 0 and bpe.decode(bpe.encode(docs, path), path).count() == 0
