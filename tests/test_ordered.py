"""Chunked scans against plain windows, with one key holding a third of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import lookups, ordered


def log(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if i % 3 == 0 else rng.randint(2, 30)
        ts = dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randint(0, 9000))
        rows.append((i, key, ts, rng.choice(["a", "b", None]), rng.randint(-3, 3)))
    return spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, s string, v int")


def test_scan_equals_plain_windows(spark, rows):
    df = log(spark)
    for unit in ("day", "month"):
        got = ordered.ordered_scan(
            df, ["k"], ["ts", "id"], ordered.chunk_of("ts", unit), row_number="rn", sums={"total": F.col("v")},
            lasts={"last": F.col("s")}, nexts={"nxt": F.col("s")}, prevs={"prv": F.col("s")}, highs={"high": F.col("v")},
        )
        w = Window.partitionBy("k").orderBy("ts", "id")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumns({
            "rn": F.row_number().over(w).cast("bigint"), "total": F.sum("v").over(upto), "last": F.last("s", ignorenulls=True).over(upto),
            "nxt": F.lead("s").over(w), "prv": F.lag("s").over(w), "high": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        })
        assert rows(got.select(*want.columns), "id") == rows(want, "id")


def test_islands(spark):
    df = log(spark)
    got = {r.id: (r.k, r.island) for r in ordered.islands(df, "k", "ts", "id", "s").collect()}
    per, state, n = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.ts, r.id)):
        if r.k not in state or state[r.k] != r.s:
            n[r.k] = n.get(r.k, 0) + 1
        state[r.k] = r.s
        per[r.id] = (r.k, n[r.k])
    assert got == per


def test_overlaps_by_brute_force(spark):
    rng = random.Random(5)
    spans = []
    for i in range(300):
        a = dt.datetime(2022, 1, 1) + dt.timedelta(days=rng.randint(0, 2000))
        spans.append((i, 1 if i % 3 == 0 else rng.randint(2, 40), a, None if rng.random() < 0.05 else a + dt.timedelta(days=rng.randint(0, 60))))
    far = dt.datetime(9999, 12, 31)
    want = {
        (x[0], y[0]) for x in spans for y in spans
        if x[0] < y[0] and x[1] == y[1] and x[2] < (x[3] or far) and y[2] < (y[3] or far) and x[2] < (y[3] or far) and y[2] < (x[3] or far)
    }
    df = spark.createDataFrame(spans, "assignment_id int, device_id int, assign_date timestamp_ntz, end_date timestamp_ntz")
    got = lookups.overlap_detect(df).collect()
    assert len(got) == len(want) and {(r.first_id, r.second_id) for r in got} == want


def test_rows_with_null_keys_and_times_stay(spark, rows):
    df = log(spark, 60).unionByName(spark.createDataFrame([(900, None, None, "a", 1), (901, 1, None, "b", 2), (902, None, dt.datetime(2023, 2, 2), "a", 3), (903, 1, None, None, 4)],
                                                          "id int, k int, ts timestamp_ntz, s string, v int"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.ordered_scan(df, ["k"], ["ts", "id"], ordered.chunk_of("ts", "day"), row_number="rn", sums={"total": F.col("v")}, nexts={"nxt": F.col("s")}, prevs={"prv": F.col("s")})
    want = df.withColumns({"rn": F.row_number().over(w).cast("bigint"), "total": F.sum("v").over(upto), "nxt": F.lead("s").over(w), "prv": F.lag("s").over(w)})
    assert rows(got.select(*want.columns), "id") == rows(want, "id") and got.count() == df.count()
    for scan in (ordered.event_order(df, "k", "ts", "id"), ordered.carry_forward(df, "k", "ts", "id", {"b": F.col("s")}), ordered.period_end(df, "k", "ts", "id"), ordered.islands(df, "k", "ts", "id", "s")):
        assert scan.count() == df.count()


def test_history_keeps_rows_with_nulls(spark):
    from kerbline.operators import operations

    schema = "device int, start_date timestamp_ntz, end_date timestamp_ntz, place string"
    dim = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None, "a"), (1, None, None, "b"), (None, dt.datetime(2024, 1, 2), None, "c")], schema)
    done = operations.scd2_apply(dim, spark.createDataFrame([(1, dt.datetime(2024, 3, 1), None, "d")], schema), ["device"])
    assert sorted((r.place, r.end_date is None) for r in done.collect()) == [("a", False), ("b", False), ("c", True), ("d", True)]
    events = spark.createDataFrame([(1, None, "out", None, 1), (None, dt.datetime(2024, 1, 1), "out", None, 2), (1, dt.datetime(2024, 1, 3), "return", None, 3)],
                                   "space int, ts timestamp_ntz, kind string, date_returned timestamp_ntz, event_id int")
    assert sorted(r.event_id for r in operations.space_intervals(events).collect()) == [1, 2]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from kerbline import session

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "spark://driver:7077", "applicationId": "app"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Bare)
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_islands_over_chunk_edges_with_null_states(spark):
    import itertools

    # A run that spans months, one that ends with a month, NULL states in a row, a NULL time, a single row.
    states = ["a", "a", None, None, "b", "b", "b", "a"]
    at = [None, *(dt.datetime(2023, m, 27) for m in (1, 1, 2, 3, 3, 5, 6))]
    rows = [(i, k, t, s) for k in (1, None) for i, (t, s) in enumerate(zip(at, states))] + [(0, 2, at[1], None)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, s string").repartition(5)
    want = []
    for k, part in itertools.groupby(sorted(rows, key=lambda r: (str(r[1]), r[2] or dt.datetime.min, r[0])), key=lambda r: r[1]):
        run, last = 0, object()
        for i, _, _, s in part:
            run, last = run + (s != last), s
            want.append((str(k), i, run))
    for unit in ("day", "month"):
        assert sorted((str(r.k), r.id, r.island) for r in ordered.islands(df, "k", "ts", "id", "s", unit=unit).collect()) == sorted(want)
