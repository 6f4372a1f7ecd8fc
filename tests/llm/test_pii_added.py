"""What the classifier adds: nothing that fails a check, and by one sweep over candidates."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from loregrain.llm import pii

CLEAR = [
    "ISBN 9780306406157",
    "Order 1234567890123",
    "order 4930123456789",
    "10.0.19045.3803",
    "property@setter",
    "see a@b now",
    "version 4.2.1.20301",
    "card 4111/1111/1111/1112",
    "1234567890123456",
    "2024-05-01 10:20:30",
    "id 123456789012",
    "1995-2024",
    "3.1415926535",
    "look (at) this",
    "",
    None,
]


def with_check(rnd: random.Random, n: int = 16) -> str:
    """A number with a right check digit."""
    digits = [rnd.randrange(10) for _ in range(n - 1)]
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str(-total % 10)


@pytest.fixture(scope="module")
def scorer(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    made = [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"+{rnd.randrange(10**10, 10**12)}", lambda: with_check(rnd), lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))]
    rows = [(i, " ".join(f"{word()} {word()} {rnd.choice(made)()} {word()}." for _ in range(3))) for i in range(200)]
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_what_is_clear_stays_clear_and_other_forms_are_found(spark, scorer):
    rnd = random.Random(6)
    card = with_check(rnd)
    found = {".".join(card[i : i + 4] for i in range(0, 16, 4)): "card", "phone 4930123456789": "phone", "mail to jane.doe [at] example [dot] com": "email"}
    df = spark.createDataFrame(list(enumerate([*CLEAR, *found])), "doc_id long, text string")
    got = {r["text"]: [s["kind"] for s in r["__all"]] for r in pii.with_spans(df, scorer).select("text", "__all").collect()}
    assert {t: got[t] for t in CLEAR} == {t: [] for t in CLEAR}
    assert {t: got[t] for t in found} == {t: [kind] for t, kind in found.items()}


def test_overlaps_are_settled_in_order(spark, scorer):
    rnd = random.Random(9)
    number = lambda: rnd.choice(["-", " ", ".", ""]).join(str(rnd.randrange(10**k, 10 ** (k + 1))) for k in rnd.choices(range(1, 5), k=rnd.randint(2, 5)))
    rows = [(i, " ".join(rnd.choice(["phone", "tel", "and", "call"]) + " " + number() + rnd.choice(["", ",", " -"]) for _ in range(rnd.randint(0, 150)))) for i in range(60)]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string"), scorer).select("__base", "__scored", "__all").collect()
    assert sum(len(r["__scored"]) for r in got) > 200
    for r in got:
        kept = []
        for c in sorted((s["start"], s["number"], s["end"], s["kind"], s["score"]) for s in r["__scored"]):
            if kept and c[0] < kept[-1][2]:
                if (c[4], c[2] - c[0]) > (kept[-1][4], kept[-1][2] - kept[-1][0]):
                    kept[-1] = c
            else:
                kept.append(c)
        assert [tuple(s) for s in r["__all"]] == [tuple(s) for s in r["__base"]] + [c[:4] for c in kept]
        spans = sorted((s["start"], s["end"]) for s in r["__all"] if s not in r["__base"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_candidates_take_time_in_proportion(spark, scorer):
    rnd, took = random.Random(1), []
    for n in (500, 5_000, 20_000):
        df = spark.createDataFrame([(1, " ".join(f"tel {rnd.randrange(10**8, 10**9)}" for _ in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        assert pii.with_spans(df, scorer).select(F.size("__all")).first()[0] == n
        took.append(time.perf_counter() - start)
    assert took[2] < 12 * took[1]
