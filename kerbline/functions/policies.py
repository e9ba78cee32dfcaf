"""Permit and staff expressions: E18-E23."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.payments import blank_if_null, lookup

# Billing words that carry no access meaning, the segment pattern,
# and the weekdays (Monday = bit 0) each day range stands for.
BILLING_WORDS = r"(?i)\b(employee|pay|pass)\b"
SEGMENT = r"(M-F|M-Su|Sa-Su)\s+(\d{1,2})-(\d{1,2})"
DAY_RANGES = {"M-F": 0b0011111, "M-Su": 0b1111111, "Sa-Su": 0b1100000}
ALL_DAYS = 0b1111111

# Card status codes.
CARD_STATUS = {0: "active", 1: "inactive", 2: "lost", 3: "defective"}


def parse_access_policy(policy: Column) -> Column:
    """Weekday bitmask and minute window of a policy text.

    `24/7` and any text with an unreadable segment mean every day, all day.
    Several segments joined by `&` union their days and keep the first
    segment's hours. A window that ends before it starts runs overnight.
    """
    cleaned = F.trim(F.regexp_replace(policy, BILLING_WORDS, ""))
    segments = F.split(cleaned, "&")
    readable = F.forall(segments, lambda s: s.rlike(SEGMENT))
    always = cleaned.contains("24/7") | ~readable
    mask = F.aggregate(
        segments,
        F.lit(0),
        lambda acc, s: acc.bitwiseOR(F.coalesce(lookup(DAY_RANGES, F.regexp_extract(s, SEGMENT, 1)), F.lit(0))),
    )
    first = segments[0]
    start = F.regexp_extract(first, SEGMENT, 2).try_cast("int") * 60
    end = F.regexp_extract(first, SEGMENT, 3).try_cast("int") * 60
    return F.when(
        policy.isNotNull(),
        F.struct(
            F.when(always, ALL_DAYS).otherwise(mask).alias("day_mask"),
            F.when(always, 0).otherwise(start).alias("window_start"),
            F.when(always, 1440).otherwise(end).alias("window_end"),
            F.when(always, False).otherwise(end < start).alias("is_overnight"),
        ),
    )


def day_allowed(day_mask: Column, date: Column) -> Column:
    """Whether the policy covers the weekday of `date`."""
    return F.getbit(day_mask, F.weekday(date)) == 1


def in_access_window(minute: Column, window_start: Column, window_end: Column, is_overnight: Column) -> Column:
    """Start inclusive, end exclusive, wrapping past midnight for overnight windows."""
    return F.when(is_overnight, (minute >= window_start) | (minute < window_end)).otherwise(
        (minute >= window_start) & (minute < window_end)
    )


def shift_period(start_hour: Column) -> Column:
    """AM when the start hour, on a 24-hour clock, is before noon."""
    return F.when(F.pmod(start_hour, F.lit(24)) < 12, "AM").otherwise("PM")


def paid_hours(start_hour: Column, end_hour: Column) -> Column:
    """Shift length less a half-hour break when longer than 6.75 hours."""
    length = end_hour - start_hour
    return F.when(length > 6.75, length - 0.5).otherwise(length)


def short_group_name(group: Column) -> Column:
    """The text after the first colon, left-trimmed; a name without a colon stays as it is."""
    part = F.split(group, ":", 3)
    return F.when(group.contains(":"), F.ltrim(part[1])).otherwise(group)


def full_name(first: Column, last: Column) -> Column:
    """First and last name, NULL when both are empty."""
    return F.nullif(F.trim(F.concat(blank_if_null(first), F.lit(" "), blank_if_null(last))), F.lit(""))


def card_status(code: Column) -> Column:
    """Status word of a permit card."""
    return F.coalesce(lookup(CARD_STATUS, code), F.lit("unknown"))
