"""Minute counts against brute force, and increments against rebuilds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import occupancy as oc
from kerbline.operators import visits as vs
from kerbline.sources import sinks, versions

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4)
SCHEMA = "visit_id int, garage_id int, customer_type string, entry_ts timestamp_ntz, exit_ts timestamp_ntz"
KINDS = ("transient", "permit", "employee")


def history(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = START + dt.timedelta(seconds=rng.randint(-30000, 3 * 86400))
        b = None if rng.random() < 0.1 else a + dt.timedelta(seconds=rng.choice([0, 20, 59, 60, 61, 3600, rng.randint(1, 90000)]))
        out.append((i, 1 if i % 3 == 0 else rng.randint(2, 3), rng.choice([*KINDS, None]), a, b))
    return out


def brute(rows, first, last):
    want = {}
    m = first
    while m < last:
        for g in (1, 2, 3):
            want[g, m] = {k: 0 for k in KINDS}
        m += dt.timedelta(minutes=1)
    for _, g, kind, a, b in rows:
        if kind is None or (b is not None and a >= b):
            continue
        m = max(a.replace(second=0), first)
        while m < last and (b is None or m < b):
            want[g, m][kind] += 1
            m += dt.timedelta(minutes=1)
    return want


def as_dict(df):
    got = {}
    for r in df.collect():
        key = (r.garage_id, r.date)
        assert key not in got and r.total == r.transient + r.permit + r.employee
        got[key] = {k: r[k] for k in KINDS}
    return got


@pytest.mark.parametrize("seed", [1])
def test_counts(spark, seed):
    data = history(seed)
    df = spark.createDataFrame(data, SCHEMA)
    got = as_dict(oc.count_occupancy(df, START, END))
    assert got == brute(data, START, END)
    with_end = oc.count_occupancy(df, START, END, include_end=True)
    assert with_end.filter(F.col("date") == F.lit(END).cast("timestamp_ntz")).agg(F.sum("total")).first()[0] == sum(
        1 for v in data if v[2] and v[3] < END and v[4] is None)


@pytest.mark.parametrize("seed", [3, 4])
def test_increment_equals_rebuild(spark, seed):
    """Late loads, closures of counted visits, and entries in the last minute."""
    rng = random.Random(seed)
    data = history(seed) + [(900, 1, "permit", dt.datetime(2024, 1, 2, 11, 59, 30), None), (901, 1, "permit", dt.datetime(2024, 1, 2, 11, 59, 0), dt.datetime(2024, 1, 2, 12, 0, 1))]
    cut = dt.datetime(2024, 1, 2, 11, 59)
    known = [v for v in data if v[3] <= cut and rng.random() < 0.8]
    counted = [(*v[:4], v[4] if v[4] and v[4] <= cut and rng.random() < 0.8 else None) for v in known]
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    everyone = frame(data)
    seen = oc.count_occupancy(frame(counted), START, cut + dt.timedelta(minutes=1)).drop("x")
    garages = everyone.select("garage_id").distinct().count()
    assert seen.select("garage_id").distinct().count() == garages
    ledger = oc.counted_versions(frame(counted), str(cut))
    between = dt.datetime(2024, 1, 2, 20, 30)
    middle = frame([v for v in data if v[0] % 3 or v in known])
    one = oc.occupancy_incremental(seen, middle, ledger, str(cut), str(between))
    step = oc.occupancy_incremental(oc.apply_increment(seen, one), everyone, one.ledger, str(between), "2024-01-03 23:59:00")
    got = as_dict(oc.apply_increment(oc.apply_increment(seen, one), step))
    early = [(i, g, k, max(a, START), b) for i, g, k, a, b in data if b is None or b > START]
    want = brute(early, START, END)
    assert {k: v for k, v in got.items() if k[1] >= START} == want


def test_versions_are_counted_not_matched(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    old = [(1, 1, "permit", at(1, 8), at(1, 9)), (1, 1, "permit", at(1, 8), at(1, 9)), (2, 1, "permit", at(1, 8), None), (3, 1, "permit", at(1, 7), None)]
    new = [(1, 1, "permit", at(1, 8), at(1, 9)), (2, 1, "permit", at(1, 8), at(1, 12)), (4, 2, "employee", at(2, 8), at(4, 9)), (5, 2, "other", at(2, 8), None),
           (6, 2, "permit", at(5, 8), None), (7, 2, "permit", None, at(1, 9))]
    ledger, now = (oc.counted_versions(spark.createDataFrame(r, SCHEMA), "2024-01-03 00:00:00") for r in (old, new))
    changes, months = oc.version_changes(now, ledger)
    assert sorted((r.visit_id, r.exit_ts, r.n) for r in changes.collect() if r.visit_id != 2) == [(1, at(1, 9), -1), (3, None, -1), (4, None, 1)]
    assert {(r.exit_ts, r.n) for r in changes.collect() if r.visit_id == 2} == {(None, -1), (at(1, 12), 1)}
    assert [r.month for r in months.collect()] == [dt.date(2024, 1, 1)]
    assert oc.version_changes(now, now)[0].count() == 0 and oc.version_changes(now, now)[1].count() == 0


def test_carry_from_base(spark):
    data = [v for v in history(7) if v[2]]
    mid = dt.datetime(2024, 1, 2)
    full = brute([v for v in data if v[4] is None or v[3] < v[4]], START, END)
    first = {g: full[g, mid] for g in (1, 2, 3)}
    # The base counts the cars inside just before `mid`, so entries and exits from then on are deltas.
    inside = {g: {k: sum(1 for v in data if v[1] == g and v[2] == k and v[3] < mid and (v[4] is None or (v[4] >= mid and v[3] < v[4]))) for k in KINDS} for g in first}
    base = spark.createDataFrame([(g, *[inside[g][k] for k in KINDS]) for g in inside], "garage_id int, transient long, permit long, employee long")
    usable = [v for v in data if v[4] is None or v[3] < v[4]]
    got = as_dict(oc.occupancy_delta_carry(base, spark.createDataFrame(usable, SCHEMA), str(mid), str(END)))
    assert got == {k: v for k, v in full.items() if k[1] >= mid}


def test_replace_range_keeps_other_rows(spark, tmp_path):
    df = spark.createDataFrame(history(9), SCHEMA)
    first = oc.count_occupancy(df, START, END)
    table = sinks.create_summary(first, str(tmp_path / "minute_summary"))
    cut = dt.datetime(2024, 1, 2, 6)
    fresh = oc.count_occupancy(df.filter("visit_id % 2 = 0"), START, dt.datetime(2024, 1, 3)).filter("garage_id = 1")
    versions.replace_range(table, fresh, spark.createDataFrame([(1, cut)], "garage_id int, start timestamp_ntz"))
    got = as_dict(table.read())
    want = as_dict(first)
    want = {k: v for k, v in want.items() if k[0] != 1 or k[1] < cut} | {k: v for k, v in as_dict(fresh).items() if k[1] >= cut}
    assert got == want


def test_stale_visits_add_their_minutes(spark):
    data = [("a", 1, 5, "Entry Only", dt.datetime(2024, 1, 1, 10), None, None, None, "transient", None),
            ("b", 1, 6, "Exit Only", None, dt.datetime(2024, 1, 1, 10), None, None, "transient", None),
            ("c", 1, 7, "Entry Only", dt.datetime(2024, 1, 1, 10), None, None, None, "permit", None)]
    df = spark.createDataFrame(data, "trip_id string, garage_id int, ticket int, status string, entry_ts timestamp_ntz, exit_ts timestamp_ntz,"
                                     "length_of_stay double, impute_duration double, customer_type string, update_ts timestamp_ntz")
    done = {r.ticket: r for r in vs.close_stale_visits(df, "2024-01-03 10:00:00").collect()}
    assert done[5].exit_ts == dt.datetime(2024, 1, 1, 13, 24) and done[5].trip_id == "a"
    assert done[6].entry_ts == dt.datetime(2024, 1, 1, 6, 36) and done[6].trip_id != "b"
    assert done[7].exit_ts is None and not done[7].closed_now
