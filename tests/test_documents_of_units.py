"""Columns that take whole texts are made for documents of units only."""

from __future__ import annotations

from loregrain.plans import catalogue
from loregrain.sources import tables

SF = "/root/testdata/sf0.001"


def test_words_are_counted_after_documents_of_units_are_chosen(spark):
    own = catalogue._classes(spark, SF)[0].select("doc_id", "title", "reliable")
    plan = own._sc._jvm.PythonSQLUtils.explainString(own._jdf.queryExecution(), "simple")
    assert plan.index("split(") < plan.index("Join")
    ids = {r["doc_id"] for r in catalogue.knowledge_units(spark, SF).collect()}
    want = [r for r in tables.documents(spark, SF).select("doc_id", "title", "reliable").collect() if r["doc_id"] in ids]
    assert sorted(own.collect()) == sorted(want) and want
