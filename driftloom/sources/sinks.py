"""Writers for reports, metrics and partitioned exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON records, keeping NULL fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """CSV with a header; a file set per value of ``partition_by``.

    Rows are not gathered by partition value, so a hot value is written by
    many tasks.
    """
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append to a relational table for readers outside Spark."""
    df.write.mode("append").jdbc(url, table, properties=properties or {})


def report_name(prefix: str, run_time) -> str:
    """Timestamped report name; the run time is a parameter."""
    return f"{prefix}_{run_time:%Y%m%d_%H%M%S}"


def with_run_time(df: DataFrame, run_time, column: str = "recorded_at") -> DataFrame:
    return df.withColumn(column, F.lit(run_time).cast("timestamp"))
