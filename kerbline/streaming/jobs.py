"""Structured Streaming jobs: S22 (staging files as they land) and O6 (counts from gate events).

Both write one folder per micro-batch with overwrite, so a batch that is run
again after a lost executor or driver replaces itself. The stream's own
checkpoint sits in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline.functions import timeparts as tp
from kerbline.operators.occupancy import CUSTOMER_TYPES, MINUTES_PER_DAY, fill_minutes, running_counts
from kerbline.session import cut_lineage
from kerbline.sources.files import file_dedup, file_name
from kerbline.sources.versions import VersionedTable


def stream_folder(spark: SparkSession) -> str:
    """Where streams keep their progress. It must outlive the session: a restart in a new folder would write over batch 0."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a shared folder before a stream is started")
    return f"{named}/streams"


FILES = "file_hash string, file_name string, path string, records_processed long, status string, first_name string"
STAGED, DUPLICATE = "complete", "duplicate"


def staged_files(spark: SparkSession, out: str) -> DataFrame:
    """The registry of a staging stream: one row per file it met, with its content hash, rows and outcome."""
    return spark.read.schema(f"{FILES}, batch long").parquet(f"{out}_files")


def _hashed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_name, file_hash) of the files of one micro-batch, paths as the stream shows them."""
    found = spark.read.format("binaryFile").load([unquote(p) for p in paths])
    return found.select(F.col("_metadata.file_path").alias("path"), file_name(F.col("_metadata.file_path")).alias("file_name"), F.sha2("content", 256).alias("file_hash"))


def stage_stream(
    spark: SparkSession, folder: str, columns: list[str], stage: Callable[[DataFrame], DataFrame], out: str, *, name: str,
    files_per_batch: int = 1000, encoding: str = "UTF-8",
) -> StreamingQuery:
    """Stage the CSV reports of one source that are in `folder`, each content once, then stop.

    `columns` are the report's header names; `stage` is a staging function of
    the raw rows, which also carry source_file (the file's name).

    A registry beside `out` (see staged_files) tells which contents earlier
    micro-batches have staged. A batch stages the files whose hash is not in
    it, one per hash (the first by path), and writes its own part of the
    registry: the run's log, with rows and outcome per file. Both parts are
    one folder per batch and are written over when a batch runs again, and a
    batch looks at earlier ones only, so a batch that is run twice comes out
    the same. Files without rows are not met by a batch and not in the log.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.readStream.schema(schema).option("header", True).option("encoding", encoding)
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
        .select("*", file_name(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_path").alias("_path"))
    )
    # The registry exists before the first batch, so that it can be read.
    spark.createDataFrame([], FILES).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}_files/batch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        c = F.col
        rows = batch.groupBy("_path").agg(F.count(F.lit(1)).alias("records_processed"))
        # At most files_per_batch paths.
        paths = [r["_path"] for r in rows.collect()]
        if not paths:
            return
        files = cut_lineage(_hashed(spark, paths))
        known = staged_files(spark, out).filter((c("batch") < epoch) & (c("status") == STAGED)).select("file_hash", c("file_name").alias("_known"))
        fresh = file_dedup(files, known)
        stage(batch.join(fresh.select(c("path").alias("_path")), "_path", "left_semi").drop("_path")).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(f"{out}/batch={epoch}")
        # A duplicate names the file whose content it repeats.
        first = fresh.select("file_hash", c("file_name").alias("_known"), c("path").alias("_first")).unionByName(known.withColumn("_first", F.lit(None).cast("string")))
        new = c("path") == c("_first")
        log = files.join(first, "file_hash").join(rows, c("path") == c("_path")).select(
            "file_hash", "file_name", "path", "records_processed", F.when(new, STAGED).otherwise(DUPLICATE).alias("status"), F.when(~F.coalesce(new, F.lit(False)), c("_known")).alias("first_name"))
        log.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}_files/batch={epoch}")

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{stream_folder(spark)}/{name}")
        .trigger(availableNow=True).start()
    )


def gate_minutes(events: DataFrame) -> DataFrame:
    """Net change per garage, customer type and minute of gate events (garage_id, customer_type, ts, step).

    step is +1 for an entry and -1 for an exit. An entry counts in its minute,
    an exit from the next full minute on.
    """
    at = F.when(F.col("step") > 0, tp.minute_index(F.col("ts"))).otherwise(tp.minute_index_up(F.col("ts")))
    return events.groupBy("garage_id", "customer_type", at.alias("minute")).agg(F.sum("step").alias("step"))


def occupancy_stream(events: DataFrame, out: str, *, name: str) -> StreamingQuery:
    """Net change of each micro-batch to `out`, one folder per batch.

    Changes only add up, so each batch is summed by itself and the sums are
    added when they are read: there is no state, no watermark, and an event
    that comes late or last is counted like any other.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        gate_minutes(batch).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/batch={epoch}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{stream_folder(spark)}/{name}").trigger(availableNow=True).start()
    )


def occupancy_from_stream(changes: DataFrame, start: str, end: str) -> DataFrame:
    """Minute counts over [start, end) from the net changes a stream has written."""
    wide = changes.select("garage_id", "minute", *[
        F.when(F.col("customer_type") == t, F.col("step")).otherwise(0).alias(t) for t in CUSTOMER_TYPES
    ])
    first, last = (tp.minute_index(F.lit(v).cast(tp.NTZ)) for v in (start, end))
    return fill_minutes(running_counts(wide, changes, first, last - 1))


CHANGE = ["garage_id", "customer_type", "minute"]


def _batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("garage_id int, customer_type string, minute long, step long, batch long").parquet(out)


def compact_changes(spark: SparkSession, out: str, through: int) -> VersionedTable:
    """Merge the micro-batches up to `through` into one folder per day, beside `out`.

    The table's state names the highest merged batch and turns with the rows
    in one step: a job that dies before leaves all as it was. Only days with
    new changes are rewritten. The newest batch may be written again after a
    restart, so `through` must be an earlier one, or the stream at rest.
    """
    path, day = f"{out}_compacted", F.floor(F.col("minute") / MINUTES_PER_DAY).alias("day")
    table = VersionedTable(spark, path)
    if not table.exists():
        empty = spark.createDataFrame([], "garage_id int, customer_type string, minute long, step long, day long")
        table = VersionedTable.create(empty, path, CHANGE, ["day"])
    state = table.state()
    merged = state.get("note", {}).get("through", -1)
    if through <= merged:
        return table
    fresh = _batches(spark, out).filter(F.col("batch").between(merged + 1, through)).select(*CHANGE, "step", day)
    days = fresh.select("day").distinct()
    rows = table.read(days, state).unionByName(fresh).groupBy(*CHANGE, "day").agg(F.sum("step").alias("step"))
    table.replace(rows, days, state=state, note={"through": through})
    return table


def stream_changes(spark: SparkSession, out: str) -> DataFrame:
    """All net changes of a stream: the merged ones and the micro-batches after them."""
    table, later = VersionedTable(spark, f"{out}_compacted"), _batches(spark, out)
    if not table.exists():
        return later.drop("batch")
    state = table.state()
    later = later.filter(F.col("batch") > state.get("note", {}).get("through", -1))
    return table.read(state=state).drop("day").unionByName(later.drop("batch"))
