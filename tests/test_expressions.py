"""Golden cases of the column expressions."""

import datetime as dt

from pyspark.sql import functions as F

from kerbline.functions import filters, payments, policies, stays, timeparts
from kerbline.sources import files, staging

D = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_six_time_spellings(spark):
    date = F.lit("2024-03-05 00:00:00").cast("timestamp_ntz")
    texts = ["9:05:32 AM", "9:05 PM", "14:37:55", "14:37", "143755", "1437", " 7:01 am ", "noon", None, "25:00"]
    got = each(spark, texts, lambda v: timeparts.combine_date_time(date, v))
    day = lambda *a: D(2024, 3, 5, *a)
    assert got == [day(9, 5, 32), day(21, 5), day(14, 37, 55), day(14, 37), day(14, 37, 55), day(14, 37), day(7, 1), None, None, None]


def test_boundary_differences(spark):
    a, b = (F.lit(v).cast("timestamp_ntz") for v in ("2024-01-01 23:59:59.9", "2024-01-02 00:00:00.1"))
    assert one(spark, timeparts.datediff_minute(a, b)) == 1
    assert one(spark, timeparts.datediff_second(a, b)) == 1
    assert one(spark, timeparts.datediff_day(a, b)) == 1
    assert one(spark, timeparts.datediff_minute(b, a)) == -1


def test_minute_rounding_before_1970(spark):
    got = each(spark, [D(1969, 12, 31, 23, 59, 30), D(1970, 1, 1, 0, 1), D(2024, 5, 1, 10, 0, 0, 1)], timeparts.ceil_minute, "timestamp_ntz")
    assert got == [D(1970, 1, 1), D(1970, 1, 1, 0, 1), D(2024, 5, 1, 10, 1)]


def test_week_starts_on_sunday(spark):
    got = each(spark, [D(2024, 6, 1), D(2024, 6, 2), D(2024, 6, 8, 23)], lambda v: timeparts.period_key(v, "week"), "timestamp_ntz")
    assert got == ["2024-05-26", "2024-06-02", "2024-06-02"]


def test_holidays(spark):
    days = [D(2024, 11, 28), D(2024, 11, 29), D(2024, 1, 15), D(2024, 5, 27), D(2024, 9, 2), D(2024, 6, 19), D(2024, 7, 4), D(2024, 11, 21)]
    assert each(spark, days, timeparts.is_holiday, "timestamp_ntz") == [True] * 6 + [False] * 2


def test_policies(spark):
    texts = ["North 24/7", "M-F 6-18 Pay", "M-Su 17-8", "M-F 18-6 & Sa-Su 0-23", "whatever", "M-F 6-18 & odd", None]
    got = each(spark, texts, lambda v: policies.parse_access_policy(v))
    shape = [None if g is None else (g["day_mask"], g["window_start"], g["window_end"], g["is_overnight"]) for g in got]
    assert shape == [(127, 0, 1440, False), (31, 360, 1080, False), (127, 1020, 480, True), (127, 1080, 360, True),
                     (127, 0, 1440, False), (127, 0, 1440, False), None]


def test_overnight_window(spark):
    got = each(spark, [1019, 1020, 1439, 0, 479, 480], lambda v: policies.in_access_window(v, F.lit(1020), F.lit(480), F.lit(True)), "int")
    assert got == [False, True, True, True, True, False]


def test_trip_id_matches_md5(spark):
    import hashlib

    ts = F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz")
    want = hashlib.md5(b"3_77_2024-01-02 03:04:05.678").hexdigest().upper()
    assert one(spark, stays.trip_id(F.lit(3), F.lit(77), ts)) == want
    assert one(spark, stays.trip_id(F.lit(3), F.lit(77), F.lit(None).cast("timestamp_ntz"))) == hashlib.md5(b"3_77_NULL").hexdigest().upper()


def test_file_names(spark):
    names = ["Payments_2024-03-01.csv", "my SALES 20240301.csv", "PaymentsSales_03_01_2024.csv", "wc.csv", "x_99999999.csv", ""]
    assert each(spark, names, files.infer_source) == [
        "payments_insider_payments", "payments_insider_sales", "payments_insider_payments", "windcave", "other", "other"]
    got = each(spark, names, files.report_date_from_name)
    assert got == [dt.date(2024, 2, 29)] * 3 + [None] * 3


def test_header_and_number_cleaning(spark):
    assert staging.clean_name(" Card #\n") == "card_#"
    assert staging.clean_name("GBOK / Batch ID") == "gbok__batch_id"
    assert staging.clean_name("Pole Ser No.") == "pole_ser_no"
    assert each(spark, ["12.0", " 7 ", "x", None, "1e2"], staging.as_int) == [12, 7, None, None, 100]
    assert [str(v) for v in each(spark, ["$1,234.50", "3", "-"], staging.parse_money)] == ["1234.50", "3.00", "None"]
    assert each(spark, ["007.0", "12", None], staging.strip_decimal_suffix) == ["007", "12", None]


def test_references_and_null_parts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, payments.reference_ips(null, null, F.lit(4), F.lit(9), F.lit("_CARD"))) == "_4_9_CARD"
    assert one(spark, payments.reference_card_sale(F.lit("41**11"), null)) == "4111"


def test_device_key(spark):
    df = spark.createDataFrame([("A12", "E22xx"), ("123", "E22xx"), (None, "E22xx")], "d string, t string")
    assert [r[0] for r in df.select(payments.windcave_device_key(F.col("d"), F.col("t"))).collect()] == ["A12", "E22", "E22"]


def test_list_filter_keeps_null_dates(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 31, 23, 59, 59)), (3, D(2024, 2, 1)), (4, None)], "id int, d timestamp_ntz")
    got = filters.list_filters(df, date_ranges={"d": ("2024-01-01", "2024-01-31")})
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]


def test_search_ignores_null_columns(spark):
    df = spark.createDataFrame([("Ann", None), (None, "Lee"), (None, None)], "a string, b string")
    assert filters.contains_search(df, ["a"], "nn l", ("a", "b")).count() == 0
    assert filters.contains_search(df, ["a", "b"], "LE").count() == 1
