"""Visit expressions: E7, E9-E13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.payments import blank_if_null, join_text, lookup

# Gate station areas by the first letter of the station address.
STATION_AREAS = {"A": "Exit", "E": "Entry", "H": "Cashier", "K": "POF"}

# Ticket type codes of the gate system.
TICKET_TYPES = {
    -1: "lost ticket",
    -11: "manual ticket",
    0: "KP",
    1: "value card",
    2: "normal DP",
    3: "congress",
    4: "visitor",
    5: "fixed time per day",
    7: "fixed number of entries",
    8: "pool car",
}

# Transaction type codes of the gate system.
ENTRY_TYPE = 20
EXIT_TYPE = 30
ATTEMPT_TYPES = (31, 33, 37, 40)
ACTIVITY_TYPES = (20, 30, 31, 33, 37, 40)
PAIRING_TYPES = (20, 30, 32, 33, 37, 40)
PAIRING_EXITS = (30, 32)

# Ticket numbers the gate system writes when it has no real ticket.
SENTINEL_TICKETS = (0, 31999, 410000000, 1100000000, 220000000, 610000000, 250000000, 810000000, 710000000)

# The lost-ticket charge in cents and the typical stay in minutes.
LOST_TICKET_CENTS = 3000
TYPICAL_STAY = 204

COMPLETE = "Complete"
ENTRY_ONLY = "Entry Only"
ENTRY_ONLY_PERMIT = "Entry Only - Permit Holder"
EXIT_ONLY = "Exit Only"
UNKNOWN = "Unknown"


def station_area(address: Column) -> Column:
    """Area of a gate station."""
    return F.coalesce(lookup(STATION_AREAS, F.left(address, F.lit(1))), F.lit("Unknown"))


def entry_ticket_type_desc(code: Column) -> Column:
    """Description of an entry's ticket type; NULL for an unlisted code."""
    return lookup(TICKET_TYPES, code)


def exit_ticket_type_desc(exit_code: Column, attempt_code: Column) -> Column:
    """The exit's type, else the attempted exit's; unlisted codes read `unknown`."""
    code = F.coalesce(exit_code, attempt_code)
    return F.when(code.isNotNull(), F.coalesce(lookup(TICKET_TYPES, code), F.lit("unknown")))


def exit_classification(
    *,
    has_entry: Column,
    has_exit: Column,
    has_attempt: Column,
    exit_type: Column,
    ticket_type: Column,
    parking: Column,
    amount: Column,
    t2_amount: Column,
    cashier: Column,
    ticket: Column,
    media: Column,
    permit_entry: Column,
    permit_exit: Column,
    mark_imputed: bool = True,
) -> Column:
    """Why an exit has no entry; the first rule that holds decides.

    ticket_type, parking, amount, t2_amount, cashier and ticket are those of
    the exit, else of the attempted exit. `mark_imputed` keeps the last rule
    of the first variant, which the later variant drops.
    """
    lost = ticket_type == -1
    unmanned = cashier == 0
    manned = cashier != 0
    full = amount == LOST_TICKET_CENTS
    text = F.substring(ticket.cast("string"), 1, 9)
    no_entry_rules = [
        (lost & (amount == 0) & (t2_amount == LOST_TICKET_CENTS) & unmanned, "lost ticket: POF"),
        (lost & ~full & unmanned, "lost ticket: help line"),
        (lost & full & manned, "lost ticket: cashier"),
        (lost & ~full & manned, "manual: cashier"),
        ((ticket_type == 0) & (parking == 0) & full & unmanned, "lost ticket: help line"),
        (F.substring(text, 3, 1) == "9", "permit: no entry found"),
        ((ticket_type == -11) & manned, "manual: cashier"),
        ((ticket_type == 0) & unmanned, "manual: help line"),
        ((F.substring(text, 3, 3) == "000") & (exit_type == 30) & media.isNotNull(), "permit: manual help line exit"),
        (media.isNotNull() & (parking == 1) & (exit_type == 30), "permit: manual exit"),
    ]
    (first, label), *rest = no_entry_rules
    orphan = F.when(first, label)
    for rule, name in rest:
        orphan = orphan.when(rule, name)
    left_open = has_entry & ~has_exit & ~has_attempt & permit_exit.isNull() & permit_entry.isNull()
    found = F.when(~has_entry, orphan)
    return found.when(left_open, "imputed") if mark_imputed else found


def customer_type(media: Column, customer_id: Column, employee_customer: int) -> Column:
    """Transient without permit media, employee for one customer id (a parameter), else permit."""
    return (
        F.when(media.isNull(), "transient")
        .when(customer_id == employee_customer, "employee")
        .otherwise("permit")
    )


def visit_status(
    *, has_entry: Column, has_exit: Column, has_attempt: Column, has_permit: Column,
    permit_entry: Column, permit_exit: Column, variant: str = "v1",
) -> Column:
    """Status of a gate visit joined with a permit movement. Variant v3 adds a permit-side Exit Only."""
    left = has_exit | has_attempt
    out = F.when(has_entry & left, COMPLETE)
    if variant == "v1":
        out = out.when(has_permit & permit_exit.isNotNull(), COMPLETE)
    elif variant == "v3":
        out = out.when(has_permit & permit_entry.isNotNull() & permit_exit.isNotNull(), COMPLETE)
        out = out.when(has_permit & permit_entry.isNull(), EXIT_ONLY)
    else:
        raise ValueError(f"variant must be v1 or v3, not {variant!r}")
    return (
        out.when(has_permit & permit_exit.isNull(), ENTRY_ONLY_PERMIT)
        .when(has_entry & ~left, ENTRY_ONLY)
        .when(left & ~has_entry, EXIT_ONLY)
        .otherwise(UNKNOWN)
    )


def trip_id(garage: Column, ticket: Column, entry: Column) -> Column:
    """Upper-case MD5 of garage, ticket and the entry time in milliseconds (the word NULL when absent)."""
    stamp = F.coalesce(F.date_format(entry, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("NULL"))
    return F.upper(F.md5(join_text(garage, F.lit("_"), blank_if_null(ticket), F.lit("_"), stamp).cast("binary")))
