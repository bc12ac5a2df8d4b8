"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.scratch import settle

#: A word: a run of characters other than ASCII white space. Java's and RE2's syntax agree on it.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there, and lost executors cost a
    reread only. What it is used for has to be needed more than once."""
    return settle(df, name)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the Arrow batches that Python functions get by bytes, so that ten thousand long texts never come at once.
    Spark's own bound, 64 MB for each of several buffers, is large for a small executor; a session's own choice stays."""
    if spark.conf.get(BATCH_CONF) in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(BATCH_CONF, most)


def unit(key: Column) -> Column:
    """A number in (0, 1) from a hexadecimal digest: its first 13 digits, so every engine gives the same double."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
