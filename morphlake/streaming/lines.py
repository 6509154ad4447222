"""Lines as a stream: the same analysis as in batch, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.analyze import Options
from ..operators.lines import analyze_lines, documents, tokens
from ..operators.rulebook import RuleBook


def read_lines(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Lines of files as they appear in a folder, `files` files at most in a batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.xxhash64(F.input_file_name(), "value").alias("line_id"), F.regexp_replace("value", r"\r$", "").alias("text")).where("text <> ''")


def stream_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of streamed lines: stateless, and so never late."""
    return tokens(lines)


def stream_documents(lines: DataFrame, book: RuleBook, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:  # noqa: B008
    """Analyses each batch and appends its documents to Parquet. A batch that runs again replaces what it
    wrote: its folder is its number."""

    def one(batch: DataFrame, number: int) -> None:
        found, readings = analyze_lines(batch, book, options)
        documents(found, readings, book).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str, width: str) -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_events(events: DataFrame, late: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
