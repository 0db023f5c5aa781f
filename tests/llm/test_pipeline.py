from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from siftline.llm import toxicity
from siftline.llm.common import documents
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_the_plain_way(spark) -> None:  # noqa: ANN001
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, documents(spark, SF, "labels")).collect() if r["predicted"]}
    rows = [(i, t) for i, t in rows.items() if i not in bad]
    rows = [(i, t) for (i, t), r in zip(rows, brute.exact(rows)) if r[3]]
    rows = [(i, t) for (i, t), r in zip(rows, brute.jaccard(rows, 5, 80)) if r[2] == i]
    held = {r["item_id"]: r["text"] for r in documents(spark, SF, "benchmark").collect()}
    leaky = {r[0] for r in brute.leaks(rows, list(held.items()))}
    rows = [(i, t) for i, t in rows if i not in leaky]
    sizes = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r["doc_id"]] += r["n_tokens"]
    assert dict(sizes) == {i: len(brute.words(t)) + 1 for i, t in rows}


def test_stages_keep_columns_and_take_odd_rows(spark, docs, none) -> None:  # noqa: ANN001
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, table, SF)
            if name != "packing":
                assert left.columns == table.columns
                assert left.dtypes == table.dtypes
            assert left.count() <= table.count() or name == "packing"
