"""Payment expressions: E1-E3, E5, E6, E8, E26."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Card network codes in meter reports and their payment method brands.
CARD_BRANDS = {"VISA": "Visa", "MC": "Mastercard", "DISC": "Discover", "AMEX": "American Express"}
# The same map in the card settlement report, which never carries AMEX.
CARD_BRANDS_SETTLEMENT = {"VISA": "Visa", "MC": "Mastercard", "DISC": "Discover"}

PORTABLE_READER = "Portable CC Reader"


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small literal map; NULL for a key that is not in it."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def join_text(*parts: Column) -> Column:
    """Concatenation in which a NULL part counts as empty text."""
    return F.concat(*[blank_if_null(p) for p in parts])


def card_brand_ips(card_type: Column, transaction_type: Column, kind: str = "row") -> Column:
    """Payment method brand of a meter row.

    kind: "row" for ordinary rows, "card_part" for the card part of a mixed
    row, "settlement" for the card settlement report (short map only).
    """
    if kind == "settlement":
        return F.coalesce(lookup(CARD_BRANDS_SETTLEMENT, card_type), card_type)
    by_code = lookup(CARD_BRANDS, card_type)
    no_card = card_type.isNull()
    unknown = no_card & (transaction_type == "Credit Card")
    if kind == "card_part":
        return F.when(unknown, "unknown").otherwise(F.coalesce(by_code, card_type))
    return (
        F.when(by_code.isNotNull(), by_code)
        .when(no_card & (transaction_type == "Coins"), "Cash")
        .when(unknown, "unknown")
        .when(card_type.contains("Remote") | card_type.contains("PBC"), "Remote/PBC")
        .otherwise(card_type)
    )


def windcave_device_key(device_id: Column, txnref: Column) -> Column:
    """The device id when it begins with a letter, else the first three characters of the reference."""
    return F.when(device_id.rlike("^[A-Za-z]"), device_id).otherwise(F.left(txnref, F.lit(3)))


def settle_amount_ips(transaction_type: Column, total: Column, fee: Column) -> Column:
    """Remote payments settle with the convenience fee on top."""
    return F.when(transaction_type.startswith("Remote"), total + fee).otherwise(total)


def settle_amount_mobile(paid: Column, fee: Column) -> Column:
    """Mobile payments always settle with the fee on top."""
    return paid + fee


def reference_ips(transaction_id: Column, pole: Column, row_id: Column, file_id: Column, suffix: Column | None = None) -> Column:
    """E5: transaction id, else pole, row and file; parts of a mixed row carry a suffix."""
    made = join_text(pole, F.lit("_"), row_id, F.lit("_"), file_id)
    base = F.coalesce(transaction_id, made)
    return base if suffix is None else join_text(base, suffix)


def reference_card_sale(card_number: Column, authorization_code: Column) -> Column:
    """E5: card digits without the mask, then the authorization code."""
    return join_text(F.replace(card_number, F.lit("*"), F.lit("")), authorization_code)


def program_of(device_type: Column) -> Column:
    """Program 2 (special event) for portable readers, else 1 (regular)."""
    return F.when(device_type == PORTABLE_READER, 2).otherwise(1)


def facility_from_device(device_id: Column, by_digit: dict[str, str], overrides: dict[str, str] | None = None) -> Column:
    """Overrides first, then the digit in the middle of a three-character device id."""
    digit = F.when(device_id.rlike("^.[0-9].$"), F.substring(device_id, 2, 1))
    return F.coalesce(lookup(overrides or {}, device_id), lookup(by_digit, digit))


def facility_from_charge_code(charge_code: Column, by_code: dict[int, str], overrides: dict[int, str] | None = None) -> Column:
    """Overrides first, then the charge-code sets."""
    return F.coalesce(lookup(overrides or {}, charge_code), lookup(by_code, charge_code))


def terminal_key(prefix: str, terminal_id: Column) -> Column:
    """The processor's terminal id, a fixed prefix and the reader's own id."""
    return join_text(F.lit(prefix), terminal_id)


def remap_garage(garage_id: Column, folded: dict[int, int] | None = None) -> Column:
    """A lot that is booked under another garage (12 under 2 unless told otherwise)."""
    moved = F.lit(None).cast("int")
    for lot, garage in (folded or {12: 2}).items():
        moved = F.when(garage_id == lot, garage).otherwise(moved)
    return F.coalesce(moved, garage_id)


def program_label(program_id: Column) -> Column:
    """Report label of a program."""
    return F.when(program_id == 1, "regular").otherwise("special event")
