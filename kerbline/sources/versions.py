"""Tables whose partitions are replaced in one atomic step: S21, and the stored side of L8, L9, V12, V13.

    <path>/data/_version=<v>/<partitions>/*.parquet   rows, written once, never changed
    <path>/digest/_version=<v>/*.parquet              (key_hash, partition) of those rows, in order of the hash
    <path>/manifest/<v>/*.parquet                     (partition, _version): which version of each partition counts
    <path>/CURRENT                                    one small file: the manifest that counts, the schema and the keys

A change writes the new versions of the partitions it touches, their digest and a manifest, and turns CURRENT last, by an
atomic rename. Until then readers see the old state whole; a job that dies before leaves files that nobody reads.
Partitions that are not touched keep their files. Nothing is collected: partitions are found and swapped by joins.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.session import cut_lineage

VERSION = "_version"


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in columns])


def merged(old: DataFrame, changes: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """`old` with `changes` in place of the rows of the same keys, without the rows whose keys `gone` names."""
    dropped = changes.select(*keys) if gone is None else changes.select(*keys).unionByName(gone.select(*keys))
    return old.join(dropped, _same(old, dropped, keys), "left_anti").unionByName(changes.select(*old.columns))


def replaced(old: DataFrame, new: DataFrame, starts: DataFrame) -> DataFrame:
    """For each garage in `starts` (garage_id, start), rows of `old` before its start and rows of `new` from then on.

    Other garages keep their old rows; new rows of theirs are not taken.
    """
    at = starts.select("garage_id", F.col("start").alias("_start"))
    kept = old.join(at, "garage_id", "left").filter(F.col("_start").isNull() | (F.col("date") < F.col("_start")))
    fresh = new.join(at, "garage_id").filter(F.col("date") >= F.col("_start"))
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


class VersionedTable:
    """One table. `keys` tell rows apart in upsert; `partition_by` are columns of the rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> VersionedTable:
        """A new table with these rows; refuses a path that holds one."""
        table = cls(rows.sparkSession, path)
        if table.exists():
            raise ValueError(f"{path} holds a table already")
        kinds = [f for f in rows.schema.fields if f.name not in partition_by] + [rows.schema[n] for n in partition_by]
        state = {"manifest": None, "schema": T.StructType(kinds).json(), "columns": rows.columns, "keys": keys, "partition_by": partition_by}
        table._commit(state, rows, None)
        return table

    # -- reading

    def _file(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")

    def exists(self) -> bool:
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._file())

    def state(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def manifest(self, state: dict | None = None) -> DataFrame:
        """(partition columns, _version) of every partition."""
        state = state or self.state()
        parts = [T.StructType.fromJson(json.loads(state["schema"]))[n] for n in state["partition_by"]]
        return self.spark.read.schema(T.StructType([*parts, T.StructField(VERSION, T.StringType())])).parquet(f"{self.path}/manifest/{state['manifest']}")

    def _current(self, folder: str, fields: list[T.StructField], state: dict, only: DataFrame | None) -> DataFrame:
        """Rows of a folder in the versions that count; of the partitions `only` if given."""
        schema = T.StructType([*fields, T.StructField(VERSION, T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
        live = self.manifest(state)
        if only is not None:
            live = live.join(only, _same(live, only, state["partition_by"]), "left_semi")
        # A manifest has one row per partition, fewer than the file list the driver holds anyway. The comparison tells
        # the optimizer that the manifest narrows the scan, so that partitions are pruned before they are read.
        live = F.broadcast(live.filter(F.col(VERSION) > ""))
        # Partitions are pruned through plain equality; those with a NULL are few folders, found by their name.
        columns = [*state["partition_by"], VERSION]
        whole = reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in state["partition_by"]])
        named, rest = rows.filter(whole), rows.filter(~whole)
        found = named.join(live, columns, "left_semi").unionByName(rest.join(live, _same(rest, live, columns), "left_semi"))
        return found.drop(VERSION)

    def read(self, only: DataFrame | None = None, state: dict | None = None) -> DataFrame:
        """The table's rows now; with `only`, those of the partitions whose values it lists."""
        state = state or self.state()
        fields = T.StructType.fromJson(json.loads(state["schema"])).fields
        return self._current("data", fields, state, only).select(*state["columns"])

    # -- writing

    def _commit(self, state: dict, rows: DataFrame, touched: DataFrame | None, note: dict | None = None) -> None:
        """Rows in place of all partitions they have and all in `touched`; `note` is kept in the state from then on."""
        parts, keys = state["partition_by"], state["keys"]
        before = state["manifest"]
        version = f"{int((before or '0').split('-')[0]) + 1:08d}-{uuid.uuid4().hex[:12]}"
        folder = f"{self.path}/data/{VERSION}={version}"
        rows.select(*state["columns"]).hint("rebalance", *parts).write.partitionBy(*parts).parquet(folder)
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        stored = self.spark.read.schema(schema).parquet(folder)
        stored.select(F.xxhash64(*keys).alias("key_hash"), *parts).repartitionByRange("key_hash").sortWithinPartitions("key_hash").write.parquet(f"{self.path}/digest/{VERSION}={version}")
        new = stored.select(*parts).distinct().withColumn(VERSION, F.lit(version))
        manifest = new
        if before:
            old = self.manifest(state)
            out = new.select(*parts) if touched is None else new.select(*parts).unionByName(touched.select(*parts))
            manifest = old.join(out, _same(old, out, parts), "left_anti").unionByName(new)
        manifest.write.parquet(f"{self.path}/manifest/{version}")
        if (self.state()["manifest"] if self.exists() else None) != before:
            raise RuntimeError(f"{self.path} was changed by another job")
        self._point(state | {"manifest": version} | ({"note": note} if note else {}))

    def _point(self, state: dict) -> None:
        """Turn CURRENT, the last step of every change."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = self._file()
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.CURRENT-{uuid.uuid4().hex}")
        out = fresh.getFileSystem(conf).create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, options)

    def replace(self, rows: DataFrame, touched: DataFrame | None = None, *, state: dict | None = None, note: dict | None = None) -> None:
        """Put `rows` in place of whole partitions: those they fall in, and those `touched` lists (left empty if they have none).

        With the `state` that rows were made from, a change by another job in between is refused. `note` turns with
        the rows, in the same step.
        """
        self._commit(state or self.state(), rows, touched, note)

    def upsert(self, changes: DataFrame, gone: DataFrame | None = None) -> None:
        """Put `changes` in place of the rows of the same keys, drop the rows whose keys `gone` names.

        The digest tells which partitions hold those keys; only these, and
        those the changes fall in, are read and written again.
        """
        state = self.state()
        parts, keys = state["partition_by"], state["keys"]
        changes = cut_lineage(changes.select(*state["columns"]))
        dropped = changes.select(*keys) if gone is None else changes.select(*keys).unionByName(gone.select(*keys))
        hashes = dropped.select(F.xxhash64(*keys).alias("key_hash")).distinct()
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        # The digest is sorted by hash within its files; they hold a hash and the partition's values, no other column.
        held = self.spark.read.schema(T.StructType([T.StructField("key_hash", T.LongType()), *[schema[n] for n in parts], T.StructField(VERSION, T.StringType())]))
        held = held.option("basePath", f"{self.path}/digest").parquet(f"{self.path}/digest")
        live = F.broadcast(self.manifest(state))
        held = held.join(hashes, "key_hash", "left_semi")
        held = held.join(live, _same(held, live, [*parts, VERSION]), "left_semi")
        touched = cut_lineage(held.select(*parts).unionByName(changes.select(*parts)).distinct())
        self._commit(state, merged(self.read(touched, state), changes, keys, gone), touched)


def replace_range(table: VersionedTable, rows: DataFrame, starts: DataFrame) -> None:
    """For each garage in `starts` (garage_id, start), the rows from its start on give way to `rows`, in one step.

    The table is partitioned by garage_id and date_day. The day a start falls in keeps its earlier rows; later days
    without new rows are dropped.
    """
    state = table.state()
    partitions = table.manifest(state).select("garage_id", "date_day")
    touched = partitions.join(starts, "garage_id").filter(F.col("date_day") >= F.to_date("start")).select("garage_id", "date_day")
    table.replace(replaced(table.read(touched, state), rows.withColumn("date_day", F.to_date("date")), starts), touched)
