"""Sinks: S20, and the table S21 works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.sources.versions import VersionedTable

WRITE_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def sink(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write parquet; mode is append, replace or fail (when the target exists)."""
    writer = df.write.mode(WRITE_MODES[mode])
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def sink_by_range(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """S20, sorted within files by range of the keys, so that filters on them skip row groups."""
    sink(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, mode)


def with_day(rows: DataFrame) -> DataFrame:
    """The partition column of a minute summary."""
    return rows.withColumn("date_day", F.to_date("date"))


def create_summary(rows: DataFrame, path: str) -> VersionedTable:
    """Create a minute summary, partitioned by garage and day, whose ranges are replaced in one step (S21: versions.replace_range).

    Rows of one partition meet in one task, but a large partition is split
    again by the adaptive rebalance.
    """
    return VersionedTable.create(with_day(rows), path, ["garage_id", "date"], ["garage_id", "date_day"])
