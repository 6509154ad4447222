"""Stages on tables whose column names are those the stages make, or need quoting."""

from __future__ import annotations

import pytest

import corpus_pipeline
from morphlake.llm import neardup
from morphlake.sources import shared

NAMES = "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, __k1 string, __k2 long, __spans string, __shard string, __place long, __row string, __chars long, row long"


def test_clashing_names_pass(spark):
    text = [f"the quick brown fox number{k} jumps over the lazy dog and runs to the old mill by the river again " * 3 for k in range(12)]
    rows = [(k, t, "en", "s", len(t), f"x{k}", "k1", k, "spans", "shard", k, "row", k, k) for k, t in enumerate(text)]
    rows += [(100, None, None, None, None, None, None, None, None, None, None, None, None, None), (0, text[0], "en", "s", 1, "x0", "k1", 0, "spans", "shard", 0, "row", 0, 0)]
    docs = spark.createDataFrame(rows, NAMES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        for r in kept.collect():
            if r["doc_id"] != 100:
                assert (r["a.b"], r["__k1"], r["__spans"], r["__shard"], r["__row"], r["row"]) == (f"x{r['doc_id']}", "k1", "spans", "shard", "row", r["doc_id"]), name


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_lengths_that_overflow(spark):
    rows = [(0, 1, [1e200, 1e200]), (1, 1, [2e200, 2e200]), (2, 1, [1e-200, 1e-200]), (3, 1, [1.0, 1.0]), (4, 1, [1.0, -1.0]), (5, 1, [0.0, 0.0]), (6, 1, [None, 1.0]), (7, 1, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}
