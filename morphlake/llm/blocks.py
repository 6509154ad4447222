"""Pairs inside groups of any size, as pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block. A task holds two blocks at most, however large the group is.
BLOCK = 4096


def block_pairs(members: DataFrame, key: list[str], spread: str, size: int = BLOCK) -> DataFrame:
    """Adds blk_i and blk_j: every pair of rows with equal key meets in at least one (key, blk_i, blk_j).

    A group of up to `size` rows is one block pair (0, 0). A larger one is dealt by the hash of
    `spread` into blocks, and each row goes to the pairs that its block is in.
    """
    sizes = members.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blk_n"))
    dealt = members.join(sizes, key).withColumn("blk", F.pmod(F.xxhash64(spread), F.col("blk_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blk_n") - 1)).alias("blk_o")
    return (
        dealt.select("*", other)
        .withColumns({"blk_i": F.least("blk", "blk_o"), "blk_j": F.greatest("blk", "blk_o")})
        .drop("blk", "blk_o", "blk_n")
    )
