"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from loregrain.llm import decontaminate, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality_rules.quality_report(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    often = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    texts = {i: "\n".join(x for x in t.split("\n") if often[key(x)] < 10) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    own = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = own[i], own[j]
                own = {k: min(a, b) if v in (a, b) else v for k, v in own.items()}
    left = {i: t for i, t in texts.items() if own[i] == i}
    frame = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in left.items() if i not in bad}
    assert all(r["ids"] for r in got.values() if r["text"].strip())
