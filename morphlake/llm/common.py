"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize as materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch holds: rows, and bytes where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def fold(column, modulus: int):
    """crc32 of the id's decimal text, modulo the number of folds; null ids fall in no fold."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def summed(parts: DataFrame, tasks: int) -> DataFrame:
    """(key long, vec binary of float64): the sum of the vectors of each key, added as they stream by."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        found = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), np.float64)
                if k in found:
                    found[k] += x
                else:
                    found[k] = x.copy()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["key", "vec"])

    return parts.repartition(tasks, "key").mapInArrow(run, "key long, vec binary")


def split_words(texts, lower: bool = False):
    """(words, index, sizes) of an Arrow array of UTF-8 texts: the distinct words as bytes, the place of
    each word of the texts among them, and the words of each text. Words are runs without ASCII white
    space; with `lower`, A-Z are lower-cased; a null text has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.view(pa.string()).fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes, flat = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves an empty word
        of = np.repeat(np.arange(len(sizes)), sizes)
        sizes, flat = np.bincount(of[full], minlength=len(sizes)), flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), sizes


def lean(run):
    """The function over batches, which hands memory it no longer needs back to the system when it ends:
    Python workers live on for other tasks."""
    import functools

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
