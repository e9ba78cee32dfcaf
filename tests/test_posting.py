"""Each reject reason, interval ends, mixed rows, and conservation."""

import datetime as dt
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from kerbline.plans import posting as po

D = dt.datetime


@pytest.fixture(scope="module")
def dims(spark):
    devices = spark.createDataFrame(
        [(1, "E01", "T1", "Exit"), (2, "P02", "T2", "Portable CC Reader"), (3, "X03", "T3", None), (4, "N04", "T4", None), (5, "L05", "T5", None)],
        "device_id int, device_terminal_id string, terminal_id string, device_type string")
    assigned = spark.createDataFrame(
        [(1, 10, D(2024, 1, 1), D(2024, 2, 1)), (1, 11, D(2024, 3, 1), None), (2, 10, D(2024, 1, 1), None), (3, 12, D(2024, 1, 1), None), (5, None, D(2024, 1, 1), None)],
        "device_id int, location_id int, assign_date timestamp_ntz, end_date timestamp_ntz")
    charges = spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 10, 2)], "charge_code_id int, location_id int, program_type_id int")
    methods = spark.createDataFrame([(1, "Cash"), (2, "Visa")], "payment_method_id int, payment_method_brand string")
    systems = spark.createDataFrame([(7, "Windcave"), (8, "IPS"), (9, "PI")], "settlement_system_id int, system_name string")
    return po.Dimensions(devices, assigned, charges, methods, systems)


def windcave(spark, rows):
    return spark.createDataFrame(
        [(i, 5, ts, ts, M("2.50"), brand, f"ref{i}", "zzz", device, 0, False) for i, (device, ts, brand) in enumerate(rows)],
        "id int, source_file_id int, time timestamp_ntz, settlement_date timestamp_ntz, amount decimal(10,2), card_type string, dpstxnref string,"
        "txnref string, device_id string, voided int, processed_to_final boolean")


def test_reasons_and_interval_ends(spark, dims):
    cases = [
        (("E01", D(2024, 1, 1), "Visa"), None),  # at the start: in
        (("E01", D(2024, 2, 1), "Visa"), "NO_ACTIVE_DEVICE_ASSIGNMENT"),  # at the end: out
        (("E01", D(2024, 2, 15), "Visa"), "NO_ACTIVE_DEVICE_ASSIGNMENT"),  # gap
        (("E01", D(2030, 1, 1), "Visa"), None),  # open end
        (("Q99", D(2024, 1, 5), "Visa"), "DEVICE_NOT_FOUND"),
        (("N04", D(2024, 1, 5), "Visa"), "NO_ACTIVE_DEVICE_ASSIGNMENT"),
        (("L05", D(2024, 1, 5), "Visa"), "LOCATION_NOT_FOUND"),
        (("X03", D(2024, 1, 5), "Visa"), "CHARGE_CODE_NOT_FOUND"),
        (("E01", D(2024, 1, 5), "Other"), "PAYMENT_METHOD_NOT_FOUND"),
        (("X03", D(2024, 1, 5), "Other"), "CHARGE_CODE_NOT_FOUND"),  # two at once
    ]
    staging = windcave(spark, [c for c, _ in cases])
    resolved = po.resolve_source("windcave_staging", staging, dims, file_id=5)
    got = {r.staging_record_id: r.reject_reason_code for r in resolved.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(cases)}
    bad = po.rejected(resolved, F.lit("2024-01-01").cast("timestamp_ntz")).filter("staging_record_id = 4").first()
    assert (bad.device_id, bad.location_id, bad.payment_method_id, bad.settlement_system_id) == ("DEVICE_NOT_FOUND", "LOCATION_NOT_FOUND", "2", "7")
    check = po.conservation_check(staging, po.posted(resolved), po.rejected(resolved, F.current_timestamp())).first()
    assert (check.staged, check.posted, check.rejected, check.lost, check.in_both, check.unknown) == (10, 2, 8, 0, 0, 0)


def test_missing_settlement_system(spark, dims):
    none = dims.settlement_systems.filter("system_name = 'PI'")
    broken = po.Dimensions(dims.devices, dims.assignments, dims.charge_codes, dims.payment_methods, none)
    row = po.resolve_source("windcave_staging", windcave(spark, [("E01", D(2024, 1, 5), "Visa")]), broken).first()
    assert row.reject_reason_code == "SETTLEMENT_SYSTEM_NOT_FOUND"


def test_mixed_meter_rows(spark, dims):
    day = D(2024, 1, 5)
    staging = spark.createDataFrame(
        [(1, 5, day, "9:05:32 PM", "p1", "E01", "Coin & Card", "VISA", None, M("1.00"), M("2.00"), M("3.00"), None, False),
         (2, 5, day, "09:05", "p1", "E01", "Coin & Card", "VISA", "t2", M("0.00"), M("2.00"), M("2.00"), None, False),
         (3, 5, day, "0905", "p1", "E01", "Coins", None, "t3", M("4.00"), M("0.00"), M("4.00"), None, False),
         (4, 5, day, "0905", "p1", "E01", "Remote/PBC", "Remote", "t4", M("0.00"), M("0.00"), M("5.00"), M("0.45"), False)],
        "id int, source_file_id int, date timestamp_ntz, time string, pole string, space_name string, transaction_type string, card_type string,"
        "transaction_id string, coin decimal(10,2), credit_card decimal(10,2), total decimal(10,2), convenience_fee decimal(10,2), processed_to_final boolean")
    resolved = po.resolve_source("ips_staging", staging, dims)
    got = sorted((r.staging_record_id, r.reference_number, str(r.transaction_amount), str(r.settle_amount), r.reject_reason_code) for r in resolved.collect())
    assert got == [
        (1, "p1_1_5_CARD", "2.00", "2.00", None), (1, "p1_1_5_COIN", "1.00", "1.00", None), (2, "t2_CARD", "2.00", "2.00", None),
        (3, "t3", "4.00", "4.00", None), (4, "t4", "5.00", "5.45", "PAYMENT_METHOD_NOT_FOUND")]
    log = po.etl_run_log(staging, resolved, "ips_staging").first()
    assert (log.records_processed, log.records_created, log.records_failed, log.status) == (4, 4, 1, "incomplete")


def test_card_sale_takes_latest_payout_once(spark, dims):
    sale = spark.createDataFrame(
        [(1, 5, D(2024, 1, 5), "14:05:09", M("9.00"), "Visa", "4***1", "77", "T2", False)],
        "id int, source_file_id int, transaction_date timestamp_ntz, transaction_time string, transaction_amount decimal(10,2), card_brand string,"
        "card_number string, authorization_code string, terminal_id string, processed_to_final boolean")
    paid = spark.createDataFrame(
        [(1, D(2024, 1, 6), M("8.00"), "4***1", "77", False, 6), (2, D(2024, 1, 7), M("8.50"), "4***1", "77", False, 6)],
        "payment_id int, payment_date timestamp_ntz, payment_amount decimal(10,2), card_number string, authorization_code string, processed_to_final boolean, source_file_id int")
    row, = po.posted(po.resolve_source("payments_insider_sales_staging", sale, dims, payments=paid)).collect()
    assert (str(row.settle_amount), row.settle_date, row.program_id, row.charge_code_id, row.reference_number) == ("8.50", D(2024, 1, 7), 2, 102, "4177")
    assert po.mark_payments_processed(paid, sale, spark.createDataFrame([row.asDict()], po.posted(po.resolve_source(
        "payments_insider_sales_staging", sale, dims, payments=paid)).schema), file_id=6).filter("processed_to_final").count() == 2
