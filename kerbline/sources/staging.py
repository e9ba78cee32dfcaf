"""From raw report columns (all text) to typed staging rows: S5-S18."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions.timeparts import to_stamp

MONEY = "decimal(10,2)"

# Column renames after the header clean-up.
COIN_NAMES = {"$001": "pennies", "$005": "nickels", "$010": "dimes", "$025": "quarters", "$100": "dollars"}
RENAMES = {
    "ips": {"card_#": "card_number"},
    "ips_cc": {"amount_($)": "amount", "$_paid": "paid", **COIN_NAMES},
    "ips_mobile": {"amount_($)": "amount", "$_paid": "paid", **COIN_NAMES},
    "ips_cash": {"amount_($)": "amount", "$_paid": "paid", **COIN_NAMES},
    "coin_collection": {"amount_($)": "amount", "$_paid": "paid", **COIN_NAMES},
}

# Columns held as whole numbers, per source.
INT_COLUMNS = {
    "windcave": ("authorized", "reco", "billingid", "dpsbillingid", "catid", "merch_corp_ref", "order_number", "voided"),
    "payments_insider": ("store_number", "store_numbe", "pos_entry", "roc_text", "case_id"),
    "ips": ("transaction_hour", "vendor_id", "unrecognized_coins"),
    "ips_cc": ("batch_number",),
    "ips_mobile": ("space_name", "prid"),
    "ips_cash": ("coin_total", "unrecognized_coins", "coin_reversal_count"),
    "coin_collection": ("coin_count", "bill_count"),
}

# Columns held as money, per source.
MONEY_COLUMNS = {
    "windcave": ("amount",),
    "payments_insider": ("settled_amount", "transaction_amount", "payment_amount"),
    "ips": ("credit_card", "smart_card", "total", "coin", "bills"),
    "ips_cc": ("amount",),
    "ips_mobile": ("paid",),
    "ips_cash": ("pennies", "nickels", "dimes", "quarters", "dollars", "coin_revenue"),
    "coin_collection": ("collected_coin_amount", "coin_running_total", "collected_bill_amount", "bill_running_total"),
}

# Columns whose decimal suffix is dropped, the key date column whose
# absence marks a total row, and the remote payment type and fee.
SUFFIX_COLUMNS = {"ips": ("pole", "terminal"), "ips_cc": ("pole",), "ips_mobile": ("pole",), "ips_cash": ("pole_ser_no",)}
KEY_DATE = {
    "ips": "date", "ips_cc": "transaction_date_time", "ips_mobile": "received_date_time",
    "ips_cash": "collection_date", "coin_collection": "date",
}
REMOTE = "Remote/PBC"
CONVENIENCE_FEE = 0.45


def clean_name(name: str) -> str:
    """Stripped, lower case, blanks as underscores, without slashes, newlines and dots."""
    return re.sub(r"[/\n.]", "", name.strip().lower().replace(" ", "_"))


def normalize_headers(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Clean column names, then the given renames."""
    names = [clean_name(c) for c in df.columns]
    return df.toDF(*[(renames or {}).get(n, n) for n in names])


def drop_total_rows(df: DataFrame, key: str) -> DataFrame:
    """Leave out total rows, which have no key date."""
    return df.filter(F.col(key).isNotNull())


def _replace(df: DataFrame, columns: Iterable[str], how) -> DataFrame:
    wanted = {c: how(F.col(f"`{c}`")) for c in columns if c in df.columns}
    return df.withColumns(wanted) if wanted else df


def coerce_dates(df: DataFrame, words: tuple[str, ...] = ("date",)) -> DataFrame:
    """Text columns with one of the words in their name become timestamps; unreadable text becomes NULL."""
    dated = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and any(w in f.name for w in words)]
    return _replace(df, dated, to_stamp)


def as_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double").try_cast("int")


def coerce_ints(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Whole numbers, also from text like 12.0; NULL where unreadable."""
    return _replace(df, columns, as_int)


def strip_decimal_suffix(c: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(c, ".", 1)


def parse_money(c: Column, kind: str = MONEY) -> Column:
    """Amount without dollar signs and thousands commas; NULL where unreadable."""
    return F.trim(F.regexp_replace(c.cast("string"), "[$,]", "")).try_cast(kind)


def coerce_money(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _replace(df, columns, parse_money)


def trim_strings(df: DataFrame, null_word: str | None = None) -> DataFrame:
    """Trim all text columns; a given word (such as nan) then counts as NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if null_word is None:
        return _replace(df, texts, F.trim)
    return _replace(df, texts, lambda c: F.nullif(F.trim(c), F.lit(null_word)))


def _finish(df: DataFrame, file_id) -> DataFrame:
    file = file_id if isinstance(file_id, Column) else F.lit(file_id)
    return df.withColumns({"source_file_id": file, "processed_to_final": F.lit(False)})


def stage_windcave(raw: DataFrame, file_id, group_accounts: Iterable[str]) -> DataFrame:
    """Card settlement rows of the given accounts that are not voided."""
    df = coerce_dates(normalize_headers(raw), ("date", "time"))
    df = coerce_money(coerce_ints(df, INT_COLUMNS["windcave"]), MONEY_COLUMNS["windcave"])
    return _finish(df.filter(F.col("group_account").isin(list(group_accounts)) & (F.col("voided") == 0)), file_id)


def _stage_pi(raw: DataFrame, merchant: str) -> DataFrame:
    df = coerce_dates(normalize_headers(raw))
    df = coerce_money(coerce_ints(df, INT_COLUMNS["payments_insider"]), MONEY_COLUMNS["payments_insider"])
    for column in ("mid", "merchant_id"):
        if column in df.columns:
            df = df.filter(F.col(column) == merchant)
    return df


def stage_pi_sales(raw: DataFrame, file_id, merchant: str) -> DataFrame:
    """Card sales of one merchant that are not voided."""
    df = _stage_pi(raw, merchant)
    if "void_ind" in df.columns:
        df = df.filter(F.col("void_ind") == "N")
    return _finish(df, file_id)


def stage_pi_payments(raw: DataFrame, file_id, merchant: str) -> DataFrame:
    """Payouts to one merchant."""
    return _finish(_stage_pi(raw, merchant), file_id)


def _stage_meter(raw: DataFrame, source: str) -> DataFrame:
    df = drop_total_rows(normalize_headers(raw, RENAMES[source]), KEY_DATE[source])
    df = coerce_money(coerce_dates(df), MONEY_COLUMNS[source])
    if source == "coin_collection":
        df = _replace(df, INT_COLUMNS[source], lambda c: parse_money(c, "double").try_cast("int"))
    else:
        df = coerce_ints(df, INT_COLUMNS[source])
    return _replace(df, SUFFIX_COLUMNS.get(source, ()), strip_decimal_suffix)


def stage_ips(raw: DataFrame, file_id, fee: float = CONVENIENCE_FEE) -> DataFrame:
    """Meter rows in which money was paid; remote payments carry the fee."""
    df = _stage_meter(raw, "ips")
    remote = F.when(F.col("transaction_type") == REMOTE, F.lit(fee).cast(MONEY))
    return _finish(trim_strings(df.withColumn("convenience_fee", remote).filter(F.col("total") > 0)), file_id)


def stage_ips_cc(raw: DataFrame, file_id) -> DataFrame:
    """Meter card settlement rows."""
    return _finish(_stage_meter(raw, "ips_cc"), file_id)


def stage_ips_mobile(raw: DataFrame, file_id, fee: float = CONVENIENCE_FEE) -> DataFrame:
    """Mobile payments; every row carries the fee."""
    return _finish(_stage_meter(raw, "ips_mobile").withColumn("convenience_fee", F.lit(fee).cast(MONEY)), file_id)


def stage_ips_cash(raw: DataFrame, file_id) -> DataFrame:
    """Coin collections by denomination."""
    return _finish(_stage_meter(raw, "ips_cash"), file_id)


def stage_coin_collection(raw: DataFrame, file_id) -> DataFrame:
    """Collection card readings."""
    return _finish(_stage_meter(raw, "coin_collection"), file_id)
