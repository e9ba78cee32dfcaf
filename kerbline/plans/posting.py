"""Posting staged rows to the fact table, or rejecting them with a reason: L1-L12.

Every source is first brought to one candidate shape; one chain of left joins
then resolves all ids, and a single reason column splits the result into
posted (reason is NULL) and rejected rows. The two sets are complements and
depend on the file alone, so running a file again gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import payments as pay
from kerbline.functions import timeparts as tp
from kerbline.functions.stays import station_area
from kerbline.operators.lookups import assignment_join, constant_key, device_assignments, held_at, latest_payment, packed
from kerbline.session import cut_lineage, written

FACT_COLUMNS = [
    "transaction_date", "transaction_amount", "settle_date", "settle_amount", "staging_table",
    "source_file_id", "staging_record_id", "payment_method_id", "device_id", "settlement_system_id",
    "location_id", "program_id", "charge_code_id", "reference_number",
]

# Reject reasons, and the text an id column holds when the id is missing.
DEVICE_NOT_FOUND = "DEVICE_NOT_FOUND"
NO_ASSIGNMENT = "NO_ACTIVE_DEVICE_ASSIGNMENT"
LOCATION_NOT_FOUND = "LOCATION_NOT_FOUND"
CHARGE_CODE_NOT_FOUND = "CHARGE_CODE_NOT_FOUND"
PAYMENT_METHOD_NOT_FOUND = "PAYMENT_METHOD_NOT_FOUND"
SETTLEMENT_NOT_FOUND = "SETTLEMENT_SYSTEM_NOT_FOUND"
MISSING_ID_TEXT = {
    "payment_method_id": "NO_PAYMENT_METHOD",
    "device_id": DEVICE_NOT_FOUND,
    "settlement_system_id": SETTLEMENT_NOT_FOUND,
    "location_id": LOCATION_NOT_FOUND,
    "charge_code_id": CHARGE_CODE_NOT_FOUND,
}

# The program a regular payment belongs to and the literal cash brand.
REGULAR_PROGRAM = 1
CASH = "Cash"


@dataclass(frozen=True)
class Dimensions:
    """The lookup tables a posting job resolves against."""

    devices: DataFrame  # device_id, device_terminal_id, terminal_id, device_type
    assignments: DataFrame  # device_id, location_id, assign_date, end_date
    charge_codes: DataFrame  # charge_code_id, location_id, program_type_id
    payment_methods: DataFrame  # payment_method_id, payment_method_brand
    settlement_systems: DataFrame  # settlement_system_id, system_name
    locations: DataFrame | None = None  # location_id; checked for cash when given


def unprocessed(staging: DataFrame, file_id: int | None) -> DataFrame:
    """Rows of one file (or of all) that have not been posted yet."""
    rows = staging.filter(~F.col("processed_to_final"))
    return rows if file_id is None else rows.filter(F.col("source_file_id") == file_id)


def _candidate(
    rows: DataFrame, table: str, *, device_key: Column, source_device: Column, lookup_ts: Column,
    transaction_date: Column, transaction_amount: Column, settle_date: Column, settle_amount: Column,
    brand: Column, reference: Column, reject_amount: Column | None = None,
    program: Column | None = None,
) -> DataFrame:
    return rows.select(
        F.lit(table).alias("staging_table"),
        F.col("source_file_id"),
        F.col("id").alias("staging_record_id"),
        device_key.alias("device_key"),
        source_device.cast("string").alias("source_device_terminal_id"),
        lookup_ts.alias("lookup_ts"),
        transaction_date.alias("transaction_date"),
        transaction_amount.alias("transaction_amount"),
        settle_date.alias("settle_date"),
        settle_amount.alias("settle_amount"),
        (reject_amount if reject_amount is not None else transaction_amount).alias("reject_amount"),
        brand.alias("brand"),
        (program if program is not None else F.lit(REGULAR_PROGRAM)).cast("int").alias("program_id"),
        reference.cast("string").alias("reference_number"),
    )


def windcave_candidates(staging: DataFrame, file_id: int | None = None) -> DataFrame:
    """L1: card settlement rows that are not voided."""
    rows = unprocessed(staging, file_id).filter(F.col("voided") == 0)
    c = F.col
    return _candidate(
        rows, "windcave_staging",
        device_key=pay.windcave_device_key(c("device_id"), c("txnref")), source_device=c("device_id"),
        lookup_ts=c("time"), transaction_date=c("time"), transaction_amount=c("amount"),
        settle_date=c("settlement_date"), settle_amount=c("amount"),
        brand=c("card_type"), reference=c("dpstxnref"),
    )


def pi_sales_candidates(sales: DataFrame, payments: DataFrame, file_id: int | None = None) -> DataFrame:
    """L2: card sales, settled from the matching payout.

    A sale with several payouts takes the latest one, so that a sale is posted once.
    """
    rows = unprocessed(sales, file_id).join(latest_payment(payments), ["card_number", "authorization_code"], "left")
    c = F.col
    at = tp.combine_date_time(c("transaction_date"), c("transaction_time"))
    return _candidate(
        rows, "payments_insider_sales_staging",
        device_key=c("terminal_id"), source_device=c("terminal_id"), lookup_ts=at,
        transaction_date=at, transaction_amount=c("transaction_amount"),
        settle_date=c("payment_date"), settle_amount=c("paid_amount"),
        brand=c("card_brand"), program=F.lit(None),
        reference=pay.reference_card_sale(c("card_number"), c("authorization_code")),
    )


def ips_candidates(staging: DataFrame, file_id: int | None = None) -> DataFrame:
    """L3: meter rows; a mixed coin-and-card row becomes up to two parts.

    The parts are exploded from each row, so the staging table is read once.
    """
    c = F.col
    kind, card = c("transaction_type"), c("card_type")
    mixed = kind == "Coin & Card"

    def part(amount: Column, settle: Column, brand: Column, suffix: str) -> Column:
        return F.struct(amount.alias("amount"), settle.alias("settle"), brand.alias("brand"), F.lit(suffix).alias("suffix"))

    settle = pay.settle_amount_ips(kind, c("total"), c("convenience_fee"))
    whole = part(c("total"), settle, pay.card_brand_ips(card, kind), "")
    coin = part(c("coin"), c("coin"), F.lit(CASH), "_COIN")
    charged = part(c("credit_card"), c("credit_card"), pay.card_brand_ips(card, kind, "card_part"), "_CARD")
    parts = F.when(
        mixed,
        F.array_compact(F.array(F.when(c("coin") > 0, coin), F.when(c("credit_card") > 0, charged))),
    ).when(kind.isNotNull(), F.array(whole))
    rows = unprocessed(staging, file_id).withColumn("part", F.explode(parts))
    at = tp.combine_date_time(c("date"), c("time"))
    return _candidate(
        rows, "ips_staging",
        device_key=c("space_name"), source_device=c("space_name"), lookup_ts=c("date"),
        transaction_date=at, transaction_amount=c("part.amount"),
        settle_date=c("date"), settle_amount=c("part.settle"), reject_amount=c("part.settle"),
        brand=c("part.brand"),
        reference=pay.reference_ips(c("transaction_id"), c("pole"), c("id"), c("source_file_id"), c("part.suffix")),
    )


def ips_cc_candidates(staging: DataFrame, file_id: int | None = None) -> DataFrame:
    """L4: meter card settlement rows."""
    c = F.col
    at = c("transaction_date_time")
    return _candidate(
        unprocessed(staging, file_id), "ips_cc_staging",
        device_key=c("pole"), source_device=c("pole"), lookup_ts=at,
        transaction_date=at, transaction_amount=c("amount"), settle_date=at, settle_amount=c("amount"),
        brand=pay.card_brand_ips(c("card_type"), F.lit(None).cast("string"), "settlement"), reference=c("transaction_reference"),
    )


def ips_mobile_candidates(staging: DataFrame, file_id: int | None = None) -> DataFrame:
    """Mobile payments; the device is named by space, else by pole."""
    c = F.col
    at = c("received_date_time")
    return _candidate(
        unprocessed(staging, file_id), "ips_mobile_staging",
        device_key=F.coalesce(c("space_name").cast("string"), c("pole")), source_device=c("space_name"), lookup_ts=at,
        transaction_date=at, transaction_amount=c("paid"), settle_date=at,
        settle_amount=pay.settle_amount_mobile(c("paid"), c("convenience_fee")), brand=c("partner_name"), reference=c("prid"),
    )


def ips_cash_candidates(staging: DataFrame, file_id: int | None = None) -> DataFrame:
    """Meter cash collections."""
    c = F.col
    at = tp.combine_date_time(c("collection_date"), c("collection_time"))
    return _candidate(
        unprocessed(staging, file_id), "ips_cash_staging",
        device_key=c("pole_ser_no"), source_device=c("pole_ser_no"), lookup_ts=at,
        transaction_date=at, transaction_amount=c("coin_revenue"), settle_date=at, settle_amount=c("coin_revenue"),
        brand=F.lit(CASH), reference=c("id"),
    )


# Which dimension column names the device, and the settlement system, per source.
DEVICE_COLUMN = {"payments_insider_sales_staging": "terminal_id"}
SETTLEMENT_NAME = {"windcave_staging": "Windcave", "payments_insider_sales_staging": "PI"}
METER_SETTLEMENT = "IPS"
CASH_ONLY = ("ips_cash_staging",)
METER_SOURCES = ("ips_staging", "ips_cc_staging", "ips_mobile_staging", "ips_cash_staging")


def resolve(candidates: DataFrame, dims: Dimensions, source: str, *, legacy_order: bool = False) -> DataFrame:
    """Ids for each candidate and the first reason, if any, why it cannot be posted.

    The reasons are tested device first. `legacy_order` tests the assignment
    first for meter sources, which hides missing devices behind it.
    """
    c = F.col
    device_column = DEVICE_COLUMN.get(source, "device_terminal_id")
    devices = dims.devices.select(
        c(device_column).alias("device_key"), "device_id", pay.program_of(c("device_type")).alias("_device_program")
    )
    named = candidates.join(device_assignments(devices, dims.assignments), "device_key", "left").withColumn(
        "program_id", F.coalesce("program_id", "_device_program")
    )
    placed = held_at(named, "lookup_ts")
    charges = dims.charge_codes.select("location_id", c("program_type_id").alias("program_id"), "charge_code_id")
    coded = placed.join(charges, ["location_id", "program_id"], "left")
    if source in CASH_ONLY:
        # A join on a constant brand has no key: look the one id up instead.
        paid = coded.withColumn("payment_method_id", constant_key(dims.payment_methods, "payment_method_brand", CASH, "payment_method_id"))
    else:
        methods = dims.payment_methods.select(c("payment_method_brand").alias("brand"), "payment_method_id")
        paid = coded.join(methods, "brand", "left")
    settled = paid.withColumn(
        "settlement_system_id",
        constant_key(dims.settlement_systems, "system_name", SETTLEMENT_NAME.get(source, METER_SETTLEMENT), "settlement_system_id"),
    )
    known_place = c("location_id").isNotNull()
    if dims.locations is not None:
        settled = settled.join(dims.locations.select("location_id", F.lit(True).alias("_place")), "location_id", "left")
        known_place = known_place & c("_place").isNotNull()
    tests = [
        (c("device_id").isNull(), DEVICE_NOT_FOUND),
        (c("assigned_device_id").isNull(), NO_ASSIGNMENT),
        (~known_place, LOCATION_NOT_FOUND),
        (c("charge_code_id").isNull(), CHARGE_CODE_NOT_FOUND),
        (c("payment_method_id").isNull(), PAYMENT_METHOD_NOT_FOUND),
        (c("settlement_system_id").isNull(), SETTLEMENT_NOT_FOUND),
    ]
    if legacy_order and source in METER_SOURCES:
        tests[0], tests[1] = tests[1], tests[0]
    reason = F.when(tests[0][0], tests[0][1])
    for failed, name in tests[1:]:
        reason = reason.when(failed, name)
    return settled.withColumn("reject_reason_code", reason)


def posted(resolved: DataFrame) -> DataFrame:
    """Rows for the fact table."""
    return resolved.filter(F.col("reject_reason_code").isNull()).select(*FACT_COLUMNS)


def rejected(resolved: DataFrame, rejected_at: Column) -> DataFrame:
    """Rows for the reject table, with ids as text and a word where the id is missing."""
    ids = [F.coalesce(F.col(n).cast("string"), F.lit(word)).alias(n) for n, word in MISSING_ID_TEXT.items()]
    return resolved.filter(F.col("reject_reason_code").isNotNull()).select(
        "staging_table", "staging_record_id", "source_file_id", "reject_reason_code",
        rejected_at.alias("rejected_at"), "source_device_terminal_id",
        F.col("transaction_date").alias("transaction_datetime"),
        F.col("reject_amount").alias("transaction_amount"), *ids,
    )


CANDIDATES = {
    "windcave_staging": windcave_candidates,
    "ips_staging": ips_candidates,
    "ips_cc_staging": ips_cc_candidates,
    "ips_mobile_staging": ips_mobile_candidates,
    "ips_cash_staging": ips_cash_candidates,
}


def resolve_source(source: str, staging: DataFrame, dims: Dimensions, *, payments: DataFrame | None = None,
                   file_id: int | None = None, legacy_order: bool = False) -> DataFrame:
    """L1-L7 for one staging table: candidates with ids and reject reason."""
    if source == "payments_insider_sales_staging":
        if payments is None:
            raise ValueError("card sales need the payments staging table")
        candidates = pi_sales_candidates(staging, payments, file_id)
    else:
        candidates = CANDIDATES[source](staging, file_id)
    return resolve(candidates, dims, source, legacy_order=legacy_order)


class Outcome(NamedTuple):
    """What posting one staging table leaves: fact rows, reject rows, and the run's log."""

    posted: DataFrame
    rejected: DataFrame
    log: DataFrame


def post_source(source: str, staging: DataFrame, dims: Dimensions, rejected_at: Column, *, payments: DataFrame | None = None,
                file_id: int | None = None, legacy_order: bool = False) -> Outcome:
    """L1-L7, L10 as one job: candidates are resolved once, and the three outputs are read from that."""
    resolved = cut_lineage(resolve_source(source, staging, dims, payments=payments, file_id=file_id, legacy_order=legacy_order))
    mine = staging.filter(~F.col("processed_to_final") if file_id is None else ~F.col("processed_to_final") & (F.col("source_file_id") == file_id))
    return Outcome(posted(resolved), rejected(resolved, rejected_at), etl_run_log(mine, resolved, source))


SALES = "payments_insider_sales_staging"


def _paid_sales(sales: DataFrame, payments: DataFrame) -> DataFrame:
    """The latest payout of each processed sale, by staging id."""
    return (
        sales.filter("processed_to_final")
        .join(latest_payment(payments.filter(~F.col("processed_to_final"))), ["card_number", "authorization_code"])
        .select(F.col("id").alias("staging_record_id"), "payment_date", "paid_amount")
    )


def _settled(sale_facts: DataFrame, paid: DataFrame, how: str) -> DataFrame:
    return (
        sale_facts.join(paid, "staging_record_id", how)
        .withColumn("settle_date", F.coalesce("payment_date", "settle_date"))
        .withColumn("settle_amount", F.coalesce("paid_amount", "settle_amount"))
        .select(*sale_facts.columns)
    )


def apply_settlement(fact: DataFrame, sales: DataFrame, payments: DataFrame) -> DataFrame:
    """Settle date and amount from payouts for processed sales; the latest payout of a sale wins.

    Only rows of card sales take part in the join; the rest pass through.
    """
    sale_rows = F.col("staging_table") == SALES
    settled = _settled(fact.filter(sale_rows), _paid_sales(sales, payments), "left")
    return settled.unionByName(fact.filter(~F.coalesce(sale_rows, F.lit(False))))


def settlement_changes(fact: DataFrame, sales: DataFrame, payments: DataFrame) -> DataFrame:
    """L8 for a stored fact table: only the rows a payout changes, for VersionedTable.upsert by staging table and id."""
    return _settled(fact.filter(F.col("staging_table") == SALES), written(_paid_sales(sales, payments), "paid-sales"), "inner")


def processed_changes(staging: DataFrame, fact: DataFrame, table: str) -> DataFrame:
    """L9 for a stored staging table: the rows to be flagged now, for VersionedTable.upsert by id."""
    done = fact.filter(F.col("staging_table") == table).select(F.col("staging_record_id").alias("id"))
    return staging.filter(~F.col("processed_to_final")).join(done, "id", "left_semi").withColumn("processed_to_final", F.lit(True)).select(*staging.columns)


def payments_changes(payments: DataFrame, sales: DataFrame, fact: DataFrame, file_id: int | None = None) -> DataFrame:
    """L9 for stored payouts: the rows to be flagged now, for VersionedTable.upsert by payment id."""
    texts = {sales.schema["id"].dataType, fact.schema["staging_record_id"].dataType} == {T.StringType()}
    key, keys = packed if texts else F.col, ["card_number", "authorization_code"]
    ids = written(fact.filter(F.col("staging_table") == SALES).select(key("staging_record_id").alias("_id")), "posted-ids")
    matched = written(sales.select(key("id").alias("_id"), *keys).join(ids, "_id", "left_semi").select(*keys), "posted-keys")
    mine = F.lit(True) if file_id is None else F.col("source_file_id") == file_id
    waiting = payments.filter(~F.col("processed_to_final") & mine)
    return waiting.join(matched, keys, "left_semi").withColumn("processed_to_final", F.lit(True)).select(*payments.columns)


def mark_processed(staging: DataFrame, fact: DataFrame, table: str) -> DataFrame:
    """Staging rows flagged as processed when their id is in the fact table."""
    done = (
        fact.filter(F.col("staging_table") == table)
        .select(F.col("staging_record_id").alias("id"))
        .distinct()
        .withColumn("_done", F.lit(True))
    )
    flag = F.col("processed_to_final") | F.col("_done").isNotNull()
    return staging.join(done, "id", "left").withColumn("processed_to_final", flag).drop("_done")


def mark_payments_processed(payments: DataFrame, sales: DataFrame, fact: DataFrame, file_id: int | None = None) -> DataFrame:
    """L9 for payouts: flagged when they match a sale that is in the fact table; the file is a parameter."""
    ids = fact.filter(F.col("staging_table") == "payments_insider_sales_staging").select(
        F.col("staging_record_id").alias("id")
    ).distinct()
    keys = ["card_number", "authorization_code"]
    matched = sales.join(ids, "id", "left_semi").select(*keys).distinct().withColumn("_done", F.lit(True))
    mine = F.lit(True) if file_id is None else F.col("source_file_id") == file_id
    flag = F.col("processed_to_final") | (F.col("_done").isNotNull() & mine)
    return payments.join(matched, keys, "left").withColumn("processed_to_final", flag).drop("_done")


def run_status(created: Column, updated: Column, failed: Column) -> Column:
    """Outcome of a run; a run without rows is complete."""
    return (
        F.when((failed > 0) & ((created > 0) | (updated > 0)), "incomplete")
        .when(failed > 0, "failed")
        .otherwise("complete")
    )


def etl_run_log(staging: DataFrame, resolved: DataFrame, table: str) -> DataFrame:
    """Per file, rows staged, posted and rejected, and the outcome."""
    staged = staging.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("records_processed"))
    ok = F.col("reject_reason_code").isNull()
    outcome = resolved.groupBy("source_file_id").agg(
        F.count_if(ok).alias("records_created"), F.count_if(~ok).alias("records_failed")
    )
    counts = staged.join(outcome, "source_file_id", "left").fillna(0, ["records_created", "records_failed"])
    return counts.select(
        F.lit(table).alias("source_table"), "source_file_id", "records_processed", "records_created",
        F.lit(0).cast("bigint").alias("records_updated"), "records_failed",
        run_status(F.col("records_created"), F.lit(0), F.col("records_failed")).alias("status"),
    )


def post_zms_cash(
    payments: DataFrame, rebates: DataFrame, stations: DataFrame, dims: Dimensions, day: str | None = None,
    folded: dict[int, int] | None = None,
) -> DataFrame:
    """Gate cash payments of a day (of every day when none is given).

    Payments at exit stations, and at stations that are not known, are left
    out. Amounts are in cents; the rebates of a ticket on that day are taken
    off as they are.
    """
    c = F.col
    cash = payments.filter(c("pay_method") == 0)
    given = rebates
    if day is not None:
        on_day = F.to_date(c("date")) == F.lit(day).cast("date")
        cash, given = cash.filter(on_day), given.filter(on_day)
    rebate = given.groupBy(c("ticket_id").alias("ticket"), F.to_date("date").alias("_day")).agg(F.sum("rebate_amount").alias("rebate"))
    at = tp.combine_date_time(c("date"), c("time"))
    priced = (
        cash.join(stations, ["garage_id", "gate_location_id"])
        .filter(station_area(c("station")) != "Exit")
        .withColumn("garage_id", pay.remap_garage(c("garage_id"), folded))
        .withColumn("transaction_date", at)
        .withColumn("_day", F.to_date("date"))
        .join(rebate, ["ticket", "_day"], "left")
    )
    devices = dims.devices.select(c("device_terminal_id").alias("station"), "device_id")
    held = assignment_join(priced.join(devices, "station"), dims.assignments, "transaction_date", carry=())
    places = dims.locations.filter(c("space_id").isNull()).select(c("facility_id").alias("garage_id"), "location_id")
    charges = dims.charge_codes.filter(c("program_type_id") == REGULAR_PROGRAM).select("location_id", "charge_code_id")
    whole = (c("amount") / 100).cast("decimal(12,2)")
    return (
        held.join(places, "garage_id")
        .join(charges, "location_id")
        .select(
            "transaction_date", whole.alias("transaction_amount"),
            c("_day").cast("timestamp_ntz").alias("settle_date"),
            (whole - F.coalesce("rebate", F.lit(0))).cast("decimal(12,2)").alias("settle_amount"),
            F.lit("zms_cash_regular").alias("staging_table"), F.lit(None).cast("bigint").alias("source_file_id"),
            c("ticket").alias("staging_record_id"), F.lit(1).alias("payment_method_id"), "device_id",
            F.lit(1).alias("settlement_system_id"), "location_id", F.lit(REGULAR_PROGRAM).alias("program_id"),
            "charge_code_id", c("ticket").cast("string").alias("reference_number"),
        )
    )


def conservation_check(staged: DataFrame, fact: DataFrame, rejects: DataFrame) -> DataFrame:
    """Staged ids that are lost, in both outcomes, or not staged at all; one row of counts."""
    ids = staged.select(F.col("id").alias("staging_record_id")).distinct().withColumn("_s", F.lit(1))
    ok = fact.select("staging_record_id").distinct().withColumn("_p", F.lit(1))
    bad = rejects.select("staging_record_id").distinct().withColumn("_r", F.lit(1))
    seen = ids.join(ok, "staging_record_id", "full").join(bad, "staging_record_id", "full")
    s, p, r = (F.col(n).isNotNull() for n in ("_s", "_p", "_r"))
    return seen.agg(
        F.count_if(s).alias("staged"), F.count_if(p).alias("posted"), F.count_if(r).alias("rejected"),
        F.count_if(s & ~p & ~r).alias("lost"), F.count_if(p & r).alias("in_both"), F.count_if(~s).alias("unknown"),
    )
