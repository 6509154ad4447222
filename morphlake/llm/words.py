"""Word counts over a corpus, for the operators that need a vocabulary."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, split_words

#: A key no word can have: it stands for the end of a text.
END = b" "
#: Distinct words a task holds before it hands on what it counted.
FLUSH = 100_000


def word_counts(docs: DataFrame, lower: bool = True, end: bool = False) -> DataFrame:
    """word (UTF-8 bytes) and n over all rows' texts; with `end`, END is counted once a row.

    Each task counts before anything is shuffled, so a frequent word is a row a task at most.
    """

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for b in batches:
            words, index, _ = split_words(b.column(0), lower)
            for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
                counts[w] += n
            if end:
                counts[END] += b.num_rows
            if len(counts) > FLUSH:
                yield out(counts)
                counts.clear()
        if counts:
            yield out(counts)

    partial = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _band():
    """Words of about equal count: bands a twentieth wide."""
    return F.floor(F.log(F.col("n")) * 20).cast("int")


def frequent(counts: DataFrame, size: int) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """The `size` most frequent words (all, if there are fewer), with their counts, by falling count; and the others.

    Whole bands of counts are taken from the top as long as they fit, and of the next one as many as there is
    room for, those of the smallest hashes: only a row a band and about the words taken come to the driver.
    """
    bands = sorted(((r["b"], r["n"]) for r in counts.groupBy(_band().alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    low, room, share = None, size, 1.0
    for band, n in bands:
        if room <= 0:
            break
        low, share = band, min(1.0, room / n)
        room -= n
    if low is None:
        return [], np.zeros(0, np.int64), counts
    unit = F.when(_band() > low, -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(1 << 30)))
    top = counts.where((_band() >= low) & (unit < int(share * (1 << 30)) + (share >= 1))).select("word", "n", unit.alias("h")).toArrow()
    words, n, h = top.column("word").to_pylist(), top.column("n").to_numpy(), top.column("h").to_numpy()
    cut = 1 << 31
    if len(words) > size:  # some more hashes fell under the share than there is room for
        cut = int(np.sort(h)[size])
    elif share < 1:
        cut = int(share * (1 << 30))
    order = sorted(np.flatnonzero(h < cut).tolist(), key=lambda k: (-n[k], words[k]))
    return [words[k] for k in order], n[order], counts.where((_band() < low) | (unit >= cut))
