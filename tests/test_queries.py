"""Every query with SQL gives the rows DuckDB gives; the others run."""

from __future__ import annotations

import pytest

import oracle
from morphlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert oracle.differences(df, con, catalog.ORACLE_SQL[name]) == []
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_partition_count_does_not_matter(spark):
    """The same rows under other shuffle partitions."""
    names = ["affix_first_success", "cosine_rank_margin", "greedy_pairs", "family_vote_conflict"]
    want = {n: oracle.rows_of((d := catalog.QUERIES[n](spark, SF)).columns, [tuple(r) for r in d.collect()]) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for n in names:
            d = catalog.QUERIES[n](spark, SF)
            assert oracle.rows_of(d.columns, [tuple(r) for r in d.collect()]) == want[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
