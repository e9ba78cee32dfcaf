"""Tables with versioned partitions: atomic replacement, upserts of touched partitions, jobs that die in between."""

import pytest
from pyspark.sql import functions as F

from kerbline.sources import versions
from kerbline.sources.versions import VersionedTable, merged

SCHEMA = "id long, day string, value long"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(60).select("id", F.when(F.col("id") % 6 < 5, F.concat(F.lit("d"), (F.col("id") % 6).cast("string"))).alias("day"), (F.col("id") * 10).alias("value"))
    return VersionedTable.create(rows, str(tmp_path / "t"), ["id"], ["day"])


def content(df):
    return sorted(map(tuple, df.select("id", "day", "value").collect()), key=str)


def files(table):
    """The folder each partition is read from."""
    return {r["day"]: r[versions.VERSION] for r in table.manifest().collect()}


def test_rows_come_back_whole(spark, table):
    assert len(content(table.read())) == 60 and content(table.read())[0] == (0, "d0", 0)
    assert table.read().columns == ["id", "day", "value"]
    with pytest.raises(ValueError, match="holds a table"):
        VersionedTable.create(spark.range(1), table.path, ["id"], ["id"])


def test_upsert_equals_a_full_rewrite_and_leaves_other_partitions(spark, table):
    old, before = table.read(), files(table)
    held = content(old)
    # One row changes its value, one moves to another day, one is new, one loses its day, one goes.
    changes = spark.createDataFrame([(6, "d0", 7), (13, "d4", 1), (100, "d9", 2), (12, None, 3)], SCHEMA)
    gone = spark.createDataFrame([(18,), (999,)], "id long")
    want = content(merged(spark.createDataFrame(held, SCHEMA), changes, ["id"], gone))
    table.upsert(changes, gone)
    assert content(table.read()) == want and len(want) == 60
    after = files(table)
    assert {d for d in after if after[d] != before.get(d)} == {"d0", "d1", "d4", "d9", None}
    assert after["d2"] == before["d2"] and after["d3"] == before["d3"]


def test_a_partition_that_loses_its_last_row_is_gone(spark, table):
    table.upsert(spark.createDataFrame([], SCHEMA), spark.range(60).filter("id % 6 = 2"))
    assert "d2" not in files(table) and len(content(table.read())) == 50


@pytest.mark.parametrize("step", ["_point", "manifest"])
def test_a_job_that_dies_leaves_the_old_state(spark, table, monkeypatch, step):
    before = content(table.read())

    def dies(self, *args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "_point":
            m.setattr(VersionedTable, "_point", dies)
        else:  # rows are written, the manifest is not
            kept = VersionedTable.manifest
            calls = []
            m.setattr(VersionedTable, "manifest", lambda self, state=None: kept(self, state) if len(calls) < 2 and not calls.append(1) else dies(self))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(spark.createDataFrame([(6, "d0", 7)], SCHEMA))
    assert content(table.read()) == before
    table.upsert(spark.createDataFrame([(6, "d0", 7)], SCHEMA))
    assert (6, "d0", 7) in content(table.read()) and len(content(table.read())) == 60


def test_a_second_writer_is_refused(spark, table):
    state = table.state()
    table.upsert(spark.createDataFrame([(6, "d0", 7)], SCHEMA))
    with pytest.raises(RuntimeError, match="another job"):
        table._commit(state, spark.createDataFrame([(1, "d1", 1)], SCHEMA), None)
    assert len(content(table.read())) == 60


def test_only_listed_partitions_are_read(spark, table):
    some = table.read(spark.createDataFrame([("d1",), (None,)], "day string"))
    assert {r.day for r in some.collect()} == {"d1", None}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_replacement_drops_days_without_new_rows(spark, tmp_path):
    at = "garage_id int, date timestamp_ntz, n int"
    stamp = lambda rows: spark.createDataFrame(rows, "garage_id int, date string, n int").withColumn("date", F.col("date").cast("timestamp_ntz"))
    old = stamp([(g, f"2024-01-0{d} {h}:00:00", 1) for g in (1, 2) for d in (1, 2, 3) for h in ("05", "18")])
    assert old.schema.simpleString() == spark.createDataFrame([], at).schema.simpleString()
    table = VersionedTable.create(old.withColumn("date_day", F.to_date("date")), str(tmp_path / "s"), ["garage_id", "date"], ["garage_id", "date_day"])
    new = stamp([(1, "2024-01-02 12:00:00", 9), (1, "2024-01-01 05:00:00", 9), (2, "2024-01-03 05:00:00", 9)])
    starts = spark.createDataFrame([(1, "2024-01-02 06:00:00")], "garage_id int, start string").withColumn("start", F.col("start").cast("timestamp_ntz"))
    versions.replace_range(table, new, starts)
    got = {(r.garage_id, str(r.date)): r.n for r in table.read().collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "2024-01-01 05:00:00"): 1, (1, "2024-01-01 18:00:00"): 1, (1, "2024-01-02 05:00:00"): 1, (1, "2024-01-02 12:00:00"): 9}
    assert len(got) == 10 and set(v for k, v in got.items() if k[0] == 2) == {1}
