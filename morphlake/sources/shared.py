"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a folder of our own where none is set, as in tests. A cluster
    without the setting is an error: its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="morphlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and a lost executor costs nothing.

    The files go by `release`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/morphlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.shared_path = path
    return found


def release(df: DataFrame) -> None:
    """Deletes the files of a table from `materialize` that nothing reads any more; of other tables nothing."""
    if path := getattr(df, "shared_path", None):
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already; its own file system is still at hand
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
