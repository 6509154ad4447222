"""One document of each group of near copies, whatever its ids are."""

from __future__ import annotations

import corpus_pipeline
from morphlake.llm.simhash import simhash_components


def test_one_document_of_a_group(spark):
    base = " ".join(f"word{k}" for k in range(400))
    near = [base, base + " more", base + " other", base + " words again"]
    rows = [(1, t, "a") for t in near] + [(None, t.replace("word", "term"), "b") for t in near] + [(7, near[0].replace("word", "own"), "c"), (9, near[1].replace("word", "own"), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = simhash_components(docs, keep=("source",), root=True).collect()
    assert len({r["fingerprint"] for r in groups}) > 3 and len({r["root"] for r in groups}) == 3
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["source"], r["doc_id"]) for r in kept) == [("a", 1), ("b", None), ("c", 7)]
