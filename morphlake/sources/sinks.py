"""Writers: documents, tables, upserts emulated over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a line, in the order of line and token, over as many files as there are partitions."""
    ordered = documents.repartitionByRange("line_id", "pos").sortWithinPartitions("line_id", "pos")
    ordered.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, order: list[str], gzip: bool = False) -> None:
    """Tab-separated values with a header, the same bytes for the same rows: ordered by range, then within."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"sep": "\t", "header": True, "compression": "gzip" if gzip else "none", "emptyValue": ""}
    ordered.write.mode("overwrite").options(**options).csv(path)


def merged(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: updates, and the rows of target that they have no key of."""
    return target.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def inserted(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore: rows whose key target lacks, one a key."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti"))


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replaces what the key's values in rows have on disk; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
