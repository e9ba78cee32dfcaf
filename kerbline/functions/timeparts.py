"""Time expressions: E4, E14-E17 and the minute arithmetic used by occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
FAR_FUTURE = "9999-12-31 00:00:00"

# The time-of-day spellings that report files use, tried in order, each with
# the shape of its text. Only the format whose shape fits is parsed: a failed parse costs
# far more than a pattern test.
TIME_FORMATS = (
    (r"\d{1,2}:\d{2}:\d{2} [AaPp][Mm]", "h:mm:ss a"),
    (r"\d{1,2}:\d{2} [AaPp][Mm]", "h:mm a"),
    (r"\d{1,2}:\d{2}:\d{2}", "H:mm:ss"),
    (r"\d{1,2}:\d{2}", "H:mm"),
    (r"\d{6}", "HHmmss"),
    (r"\d{4}", "HHmm"),
)

# Date spellings of report files, each with the shape of its text.
DATE_FORMATS = (
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]", "M/d/yyyy h:mm:ss a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]", "M/d/yyyy h:mm a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
)

# Holidays that fall on the same (month, day) each year.
FIXED_HOLIDAYS = ((1, 1), (6, 19), (11, 11), (12, 24), (12, 25), (12, 31))


def parse_first(text: Column, formats: tuple[tuple[str, str], ...], day: Column | None = None) -> Column:
    """Timestamp by the format whose shape the text has; NULL when it has none or is no valid time.

    With `day` (yyyy-MM-dd) the text is a time of that day.
    """
    out = F.lit(None).cast(NTZ)
    for shape, form in reversed(formats):
        if day is None:
            parsed = F.try_to_timestamp(text, F.lit(form))
        else:
            parsed = F.try_to_timestamp(F.concat(day, F.lit(" "), text), F.lit(f"yyyy-MM-dd {form}"))
        out = F.when(text.rlike(f"^{shape}$"), parsed.cast(NTZ)).otherwise(out)
    return out


def combine_date_time(date: Column, time_text: Column) -> Column:
    """The date part of `date` with the time of day in `time_text`; NULL when the text is unreadable."""
    return parse_first(F.trim(time_text), TIME_FORMATS, F.date_format(date, "yyyy-MM-dd"))


def to_stamp(text: Column) -> Column:
    """Lenient text to timestamp; unreadable text becomes NULL."""
    return parse_first(F.trim(text), DATE_FORMATS)


def minute_index(ts: Column) -> Column:
    """Whole minutes since the epoch, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp_ltz")) / F.lit(60_000_000)).cast("bigint")


def minute_index_up(ts: Column) -> Column:
    """Whole minutes since the epoch, rounded up."""
    return F.ceil(F.unix_micros(ts.cast("timestamp_ltz")) / F.lit(60_000_000)).cast("bigint")


def minute_stamp(index: Column) -> Column:
    """Inverse of minute_index."""
    return F.timestamp_seconds(index * F.lit(60)).cast(NTZ)


def floor_minute(ts: Column) -> Column:
    return minute_stamp(minute_index(ts))


def ceil_minute(ts: Column) -> Column:
    return minute_stamp(minute_index_up(ts))


def datediff_minute(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two timestamps (not elapsed minutes)."""
    return minute_index(end) - minute_index(start)


def datediff_second(start: Column, end: Column) -> Column:
    """Second boundaries crossed."""
    return F.unix_seconds(end.cast("timestamp_ltz")) - F.unix_seconds(start.cast("timestamp_ltz"))


def datediff_day(start: Column, end: Column) -> Column:
    """Midnights crossed."""
    return F.datediff(F.to_date(end), F.to_date(start))


def add_minutes(ts: Column, minutes: int | float | Column) -> Column:
    """Timestamp shifted by whole minutes (may be negative)."""
    n = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return (ts + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))).cast(NTZ)


def end_or_forever(end: Column) -> Column:
    """Open interval ends count as the far future."""
    return F.coalesce(end, F.lit(FAR_FUTURE).cast(NTZ))


def in_interval(ts: Column, start: Column, end: Column) -> Column:
    """Half-open membership, [start, end), with an open end allowed."""
    return (ts >= start) & (ts < end_or_forever(end))


def calendar_columns(df: DataFrame, ts: str = "date") -> DataFrame:
    """Calendar and period columns of a minute timestamp (ISO week, Monday = 0)."""
    t = F.col(ts)
    weekday = F.weekday(t)
    hour = F.hour(t)
    period = (
        F.when(weekday > 4, "Weekend")
        .when(hour.between(6, 18), "Daytime")
        .otherwise("Evening")
    )
    return df.withColumns(
        {
            "year": F.year(t),
            "quarter": F.quarter(t),
            "month": F.month(t),
            "week": F.weekofyear(t),
            "day": F.dayofmonth(t),
            "dayofyear": F.dayofyear(t),
            "dayofweek": weekday,
            "hour": hour,
            "hms": F.date_format(t, "HH:mm:ss"),
            "weekday_type": (weekday < 5).cast("int"),
            "period": period,
        }
    )


PERIODS = ("day", "week", "month", "quarter", "year")


def _week_start(ts: Column) -> Column:
    """The Sunday on or before a date."""
    d = F.to_date(ts)
    return F.date_add(d, F.lit(1) - F.dayofweek(d))


def period_key(ts: Column, period: str) -> Column:
    """Sortable key of the report period that holds `ts`; weeks start on Sunday."""
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "week":
        return F.date_format(_week_start(ts), "yyyy-MM-dd")
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "quarter":
        return F.concat(F.year(ts), F.lit("-Q"), F.quarter(ts))
    if period == "year":
        return F.year(ts).cast("string")
    raise ValueError(f"period must be one of {PERIODS}, not {period!r}")


def period_label(ts: Column, period: str) -> Column:
    """Display label of the report period."""
    if period == "week":
        return F.concat(F.lit("Week of "), period_key(ts, "week"))
    if period == "month":
        return F.date_format(ts, "MMM yyyy")
    if period == "quarter":
        return F.concat(F.lit("Q"), F.quarter(ts), F.lit(" "), F.year(ts))
    return period_key(ts, period)


def is_holiday(date: Column) -> Column:
    """Fixed-date holidays and five rule-based ones."""
    month, day, weekday = F.month(date), F.dayofmonth(date), F.weekday(date)
    fixed = F.lit(False)
    for m, d in FIXED_HOLIDAYS:
        fixed = fixed | ((month == m) & (day == d))

    def rule(m: int, wd: int, lo: int, hi: int) -> Column:
        return (month == m) & (weekday == wd) & day.between(lo, hi)

    return (
        fixed
        | rule(11, 3, 22, 28)  # Thanksgiving, fourth Thursday
        | rule(11, 4, 23, 29)  # the day after it
        | rule(1, 0, 15, 21)  # third Monday of January
        | rule(5, 0, 25, 31)  # last Monday of May
        | rule(9, 0, 1, 7)  # first Monday of September
    )


def day_name(date: Column) -> Column:
    """Three-letter weekday name, Sun to Sat."""
    return F.date_format(date, "EEE")
