"""Parquet table access with explicit column projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str, *cols: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet``; with ``cols`` only those are selected so
    the scan's ReadSchema stays minimal.

    The scan's own splits are kept: how many there are is set by the files and by
    ``spark.sql.files.maxPartitionBytes``/``minPartitionNum``, not by a shuffle.
    """
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def dealt_rows(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` dealt evenly over the session's tasks, for short rows that a costly step per row follows.

    A table of short rows is few splits (one row group holds a million of them), and each split is one
    task whatever its rows cost later.  Deal such rows before they grow: the shuffle moves short rows only.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)
