"""What the jobs shuffle, read from their plans, and that the results are those of plain loops."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from kerbline.operators import features as fe
from kerbline.operators import lookups as lk
from kerbline.operators import operations as op
from kerbline.operators import permits as pm
from kerbline.plans import posting as po
from kerbline.session import SHUFFLE_CLEANUP, written

D, DAY = dt.datetime, dt.timedelta(days=1)


def plan(df):
    """The physical plan; that of a job that ran holds the first plan last."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def laid_out_last(df):
    """Days are exploded above every exchange, so that none is shuffled."""
    text = plan(df)
    return text.index("Generate explode") < text.index("Exchange")


@pytest.fixture(scope="module")
def merged_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def long_stays(spark):
    """Stays of hundreds of days that overlap, and periods that do."""
    rng = random.Random(5)
    visits = [(f"L{p}", a, a + DAY * rng.randint(0, 300)) for p in range(4) for a in (D(2022, 1, 1) + DAY * rng.randint(0, 500) for _ in range(30))]
    periods = [(f"L{p}", p, "c", D(2022, 1, 1) + DAY * 40 * k, D(2022, 1, 1) + DAY * (40 * k + 60), 1, "g", "M-F 6-18") for p in range(4) for k in range(6)]
    vf = spark.createDataFrame(visits, "permit string, entry_ts timestamp_ntz, exit_ts timestamp_ntz")
    pf = spark.createDataFrame(periods, "permit string, card_id int, customer string, period_start timestamp_ntz, period_end timestamp_ntz, has_access int, group_at_start string, access_policy string")
    return visits, periods, vf, pf


def dates(spans):
    return {(p, a.date() + DAY * k) for p, a, b in spans for k in range((b.date() - a.date()).days + 1)}


def test_visit_dates_are_laid_out_after_the_shuffle(long_stays):
    visits, _, vf, _ = long_stays
    df = pm.visit_dates(vf, "2023-12-31")
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == dates(visits) and laid_out_last(df)


def test_grid_days_are_laid_out_after_the_shuffle(long_stays, merged_joins):
    visits, periods, vf, pf = long_stays
    grid = fe.permit_day_grid(pf, vf, "2022-01-01", "2023-12-31")
    want = {k for k in dates([(r[0], r[3], r[4]) for r in periods]) if k[1].weekday() < 5}
    seen = dates(visits)
    assert {(r.permit, r.date): r.showed_up for r in grid.collect()} == {k: int(k in seen) for k in want}
    for df in (grid, grid.groupBy("permit").agg(F.sum("showed_up")), fe.permit_features(pf, vf, "2022-01-01", "2023-12-31"), fe.prediction_rows(pf, vf, "2022-08-03")):
        assert laid_out_last(df)


def test_feature_days_are_dealt_in_bounded_shares(long_stays, monkeypatch):
    _, _, vf, pf = long_stays
    monkeypatch.setattr(fe, "DAYS_PER_TASK", 50)
    assert fe.permit_features(pf, vf, "2022-01-01", "2023-12-31").rdd.getNumPartitions() > 8


def test_free_days_are_laid_out_after_the_shuffle(spark, merged_joins):
    staff = spark.createDataFrame([(1,), (2,), (None,), (2,)], "employee_id int")
    shifts = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 14),)], "week_start date")
    off = spark.createDataFrame([(1, D(2024, 1, 8, 5), False), (1, D(2024, 1, 8), False), (2, D(2024, 1, 9), True), (2, D(2030, 1, 1), False), (2, None, False)],
                                "employee_id int, request_date timestamp_ntz, is_cancelled boolean")
    days = op.staff_days(staff, shifts, off)
    assert {r.employee_id: r["count"] for r in days.groupBy("employee_id").count().collect()} == {1: 13, 2: 14, None: 14}
    assert laid_out_last(days.groupBy("employee_id").count())


@pytest.fixture(scope="module")
def one_day(spark):
    """Shifts and time off of the same few dates, with ids that repeat or are missing."""
    rng = random.Random(8)
    shifts = [(rng.choice([k, k % 7, None]), dt.date(2024, 1, 7), rng.choice(["Sun", "Mon", None])) for k in range(60)]
    off = [(rng.choice([*range(40), None]), D(2024, 1, rng.choice([7, 7, 8, 9]), k % 24), rng.choice([False, False, True, None])) for k in range(150)]
    staff = [(rng.choice([*range(30), None]),) for _ in range(60)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (shifts, "shift_id int, week_start date, day_of_week string"), (staff, "employee_id int"), (off, "employee_id int, request_date timestamp_ntz, is_cancelled boolean"))]
    away = {(e, at.date()) for e, at, gone in off if gone is False and e is not None and (e,) in staff}
    days = {"Sun": dt.date(2024, 1, 7), "Mon": dt.date(2024, 1, 8)}
    return frames, sorted(((e, s) for s, _, name in shifts for e, day in away if days.get(name) == day), key=str)


@pytest.mark.parametrize("block, gathered, per_task", [(256, 4096, 10 ** 7), (4, 9, 50), (1, 1, 1)])
def test_blocked_pairs_are_all_laid_out_last(spark, one_day, monkeypatch, block, gathered, per_task):
    for name, value in (("BLOCK", block), ("GATHERED", gathered), ("PAIRS_PER_TASK", per_task)):
        monkeypatch.setattr(op, name, value)
    frames, want = one_day
    df = op.blocked_pairs(*frames)
    assert want and sorted((tuple(r) for r in df.collect()), key=str) == want and df.columns == ["employee_id", "shift_id"]
    assert plan(df).index("Generate explode(_block#") < plan(df).index("SortMergeJoin") < plan(df).index("Exchange")


def test_blocked_pairs_are_written_in_little_space(spark, tmp_path):
    shifts = spark.sql("select id * 7919 % 1000003 shift_id, date '2024-01-07' week_start, 'Sun' day_of_week from range(1500)")
    off = spark.sql("select id * 6007 % 1000003 employee_id, timestamp_ntz '2024-01-07 08:00:00' request_date, false is_cancelled from range(1500)")
    op.blocked_pairs(shifts, off.select("employee_id"), off).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 1500 ** 2
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 1500 ** 2 / 2


def test_overlaps_meet_where_the_later_shift_starts(spark):
    rng = random.Random(6)
    day = dt.date(2024, 1, 7)
    rows = [(day, rng.choice(["Sun", "Mon"]), k, a, a + rng.choice([0.0, 0.5, 3.0, 9.0])) for k in range(60) for a in [rng.randint(8, 40) / 2]]
    want = sorted((x[1], x[2], y[2]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2] and x[3] < x[4] and y[3] < y[4] and x[3] < y[4] and y[3] < x[4])
    df = op.shift_overlap(spark.createDataFrame(rows, "week_start date, day_of_week string, shift_id int, start_hour double, end_hour double"))
    assert sorted((r.day_of_week, r.first_id, r.second_id) for r in df.collect()) == want
    assert plan(df).count("Generate explode") == 1


def test_payouts_are_shuffled_once(spark, merged_joins):
    sales = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x")], "id int, card_number string, authorization_code string")
    paid = spark.createDataFrame([("a", "x", 7), ("a", "x", 8), (None, "x", 9)], "card_number string, authorization_code string, payment_id int")
    df = lk.sales_payments_match(sales, paid)
    assert sorted((r.id, r.payment_id or 0, r.match_count) for r in df.collect()) == [(1, 7, 2), (1, 8, 2), (2, 0, 0), (3, 0, 0)]
    assert plan(df).count("Exchange hashpartitioning") == 2


def test_a_payout_date_is_shuffled_once(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), k % 12, rng.choice([None, D(2024, 1, rng.randint(1, 4))]), k) for k in range(40)]
    rows += rows[:10]
    best = {}
    for card, code, k, at, amount in rows:
        best.setdefault((card, code), []).append(((at is not None, at or D(1, 1, 1), k, amount), at, amount))
    df = lk.latest_payment(spark.createDataFrame(rows, "card_number string, authorization_code string, payment_id int, payment_date timestamp_ntz, payment_amount int"))
    assert {(r[0], r[1]): tuple(r[2:]) for r in df.collect()} == {k: (len(v), *max(v, key=lambda x: x[0])[1:]) for k, v in best.items()}
    assert df.columns == ["card_number", "authorization_code", "match_count", "payment_date", "paid_amount"]
    shuffled = next(line for line in plan(df).splitlines() if "partial_" in line)
    assert shuffled.split("output=")[0].count("payment_date, payment_date#") == 1


def test_held_assignments_equal_the_two_joins(spark):
    at = lambda d: D(2024, 1, d)
    devices = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("z", None)], "device_key string, device_id int")
    held = spark.createDataFrame([(1, 10, at(1), at(5)), (1, 11, at(5), None), (1, 12, at(6), at(9)), (2, None, at(1), None), (None, 13, at(1), None)],
                                 "device_id int, location_id int, assign_date timestamp_ntz, end_date timestamp_ntz")
    facts = spark.createDataFrame([(k, n, at(d)) for k, (n, d) in enumerate((n, d) for n in "abcz?" for d in (1, 4, 5, 7, 20))], "k int, device_key string, ts timestamp_ntz")
    columns = ["k", "device_id", "assigned_device_id", "location_id"]
    two = lk.assignment_join(facts.join(devices, "device_key", "left"), held, "ts", how="left")
    one = lk.held_at(facts.join(lk.device_assignments(devices, held), "device_key", "left"), "ts")
    sort = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert sort(one) == sort(two)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a few rows."""
    to = str(tmp_path_factory.mktemp("few"))
    tables = {
        "region": "select id r_regionkey, concat('R', id) r_name from range(5)", "nation": "select id n_nationkey, concat('N', id) n_name, id % 5 n_regionkey from range(25)",
        "customer": "select id c_custkey, concat('C', id) c_name, id % 25 c_nationkey, 'm' c_mktsegment from range(9)",
        "supplier": "select id s_suppkey, concat('Supplier#', lpad(cast(id as string), 9, '0')) s_name, id % 25 s_nationkey from range(12)",
        "orders": "select id o_orderkey, id % 9 o_custkey, 'F' o_orderstatus, cast(id as double) o_totalprice, timestamp_ntz '1996-01-01' + id * interval '1' day o_orderdate, '1-URGENT' o_orderpriority from range(40)",
        "lineitem": """select id % 40 l_orderkey, id % 7 l_partkey, id % 12 l_suppkey, cast(id % 7 as int) l_linenumber, 2.0D l_quantity, cast(id as double) l_extendedprice, 0.1D l_discount, 0.0D l_tax, 'R' l_returnflag,
            'O' l_linestatus, timestamp_ntz '1996-02-01' + id * interval '1' day l_shipdate from range(200)""",
    }
    for name, text in tables.items():
        spark.sql(text).coalesce(1).write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.mark.parametrize("name, scans", [("settlement_upsert", 1), ("payments_upsert", 1), ("processed_upsert", 1), ("unmatched_visits", 0)])
def test_line_items_are_read_no_more_than_needed(spark, folder, name, scans):
    assert plan(queries()[name](spark, folder)).count("ReadSchema: struct<l_orderkey") == scans


def test_written_rows_leave_no_shuffle_files(spark, tmp_path):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
        return {f.getName() for f in iter(lambda: found.next() if found.hasNext() else None, None) if f.getName().startswith("shuffle_")}

    before, kept = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "freed")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and rows.count() == 700 and spark.conf.get(SHUFFLE_CLEANUP, kept) in (kept, "false")


def test_packed_texts_are_equal_only_if_the_texts_are(spark):
    texts = ["", "-", "1", "01", "10", "1-2", "1a2", "12", "123", "0123", "123f", "1-2\n", "a", "A", "\u00e9", "99-", "99a", "-1", "--", "1 2", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lk.packed("t").alias("p")).collect()
    assert len({bytes(r.p) for r in rows if r.t is not None}) == len(texts) - 1 and [r.t for r in rows if r.p is None] == [None]
    assert {r.t: len(r.p) for r in rows if r.t}["0123"] == 2


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_changed_payouts_are_those_that_get_a_flag(spark, kind):
    ids = [f"{k}{'-x' * (k % 3 == 0)}" if kind == "string" else k for k in range(12)]
    sales = spark.createDataFrame([(i, "c" if k % 2 else None, str(k % 4)) for k, i in enumerate(ids * 2)], f"id {kind}, card_number string, authorization_code string")
    fact = spark.createDataFrame([(po.SALES if k % 5 else "ips_staging", i) for k, i in enumerate([*ids[:7], None])], f"staging_table string, staging_record_id {kind}")
    paid = spark.createDataFrame([(k, "c" if k % 3 else None, str(k % 5), k % 4 == 0, k % 2) for k in range(40)], "payment_id int, card_number string, authorization_code string, processed_to_final boolean, source_file_id int")
    for file_id in (None, 1):
        done = po.mark_payments_processed(paid, sales, fact, file_id).filter("processed_to_final").select("payment_id").exceptAll(paid.filter("processed_to_final").select("payment_id"))
        got = po.payments_changes(paid, sales, fact, file_id)
        assert got.columns == paid.columns and all(r.processed_to_final for r in got.collect())
        assert done.count() > 0 and sorted(r[0] for r in got.select("payment_id").collect()) == sorted(r[0] for r in done.collect())


def test_settled_rows_meet_written_payouts(spark):
    sales = spark.createDataFrame([("a", "c", "1", True), ("b", "c", "2", True), ("d", "c", "1", False), ("e", None, "1", True)], "id string, card_number string, authorization_code string, processed_to_final boolean")
    paid = spark.createDataFrame([(1, "c", "1", D(2024, 1, 2), 7, False), (2, "c", "1", D(2024, 1, 3), 8, True), (3, "c", "2", None, 9, False)],
                                 "payment_id int, card_number string, authorization_code string, payment_date timestamp_ntz, payment_amount int, processed_to_final boolean")
    fact = spark.createDataFrame([(po.SALES, i, D(2023, 1, 1), 1) for i in "abde"] + [("ips_staging", "a", D(2023, 1, 1), 1)], "staging_table string, staging_record_id string, settle_date timestamp_ntz, settle_amount int")
    df = po.settlement_changes(fact, sales, paid)
    assert sorted(tuple(r) for r in df.collect()) == [(po.SALES, "a", D(2024, 1, 2), 7), (po.SALES, "b", D(2023, 1, 1), 9)]
    assert "kerbline-paid-sales" in plan(df)
