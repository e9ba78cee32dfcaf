"""Cars per garage and minute: O1-O5.

A visit counts in every minute from the one it enters in (rounded down) up to,
not including, the one it leaves in (rounded up). Visits become +1 and -1 at
their minutes, which are summed per garage and minute at once, so that the
running total works on at most one row per garage and minute of change. The
total runs day by day (see ordered_scan), and the minutes between two changes
are filled by exploding each stretch, without a join to a minute calendar.

A summary has garage_id, date (the minute), transient, permit, employee, total.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import timeparts as tp
from kerbline.operators.ordered import ordered_scan
from kerbline.session import cut_lineage

CUSTOMER_TYPES = ("transient", "permit", "employee")
MINUTES_PER_DAY = 1440


def _minute(value) -> Column:
    c = value if isinstance(value, Column) else F.lit(value).cast(tp.NTZ)
    return tp.minute_index(c)


def _ntz(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(tp.NTZ)


def visit_deltas(visits: DataFrame, *, one_sided: bool = False, sign: int = 1) -> DataFrame:
    """+1 and -1 rows (garage_id, minute, one column per customer type) of visits; open visits have no -1.

    Without `one_sided`, visits without an entry, or that end before they
    start, do not count. With it, a side that is missing is left out and the
    other still counts.
    """
    entry, left = F.col("entry_ts"), F.col("exit_ts")
    rows = visits.filter(F.col("customer_type").isin(*CUSTOMER_TYPES))
    if not one_sided:
        rows = rows.filter(entry.isNotNull() & (left.isNull() | (entry < left)))
    marks = F.array(
        F.struct(tp.minute_index(entry).alias("minute"), F.lit(sign).alias("d")),
        F.struct(tp.minute_index_up(left).alias("minute"), F.lit(-sign).alias("d")),
    )
    marked = rows.select("garage_id", "customer_type", F.inline(marks)).filter(F.col("minute").isNotNull())
    return marked.select(
        "garage_id", "minute", *[F.when(F.col("customer_type") == t, F.col("d")).otherwise(0).alias(t) for t in CUSTOMER_TYPES]
    )


def sum_deltas(deltas: DataFrame) -> DataFrame:
    """One row per garage and minute."""
    return deltas.groupBy("garage_id", "minute").agg(*[F.sum(t).cast("bigint").alias(t) for t in CUSTOMER_TYPES])


def _seeds(garages: DataFrame, first: Column, last: Column) -> DataFrame:
    """A zero delta per garage at the range start and at each midnight in the range."""
    day = F.explode(F.sequence(F.floor(first / MINUTES_PER_DAY), F.floor(last / MINUTES_PER_DAY)))
    days = garages.select("garage_id").distinct().select("garage_id", first.alias("_first"), day.alias("_day"))
    at = F.greatest("_first", (F.col("_day") * MINUTES_PER_DAY).cast("bigint"))
    return days.select("garage_id", at.alias("minute"), *[F.lit(0).alias(t) for t in CUSTOMER_TYPES])


def running_counts(deltas: DataFrame, garages: DataFrame, first: Column, last: Column) -> DataFrame:
    """Stretches [minute, until) of constant counts from `first` to `last` (minute indexes), none longer than a day.

    Deltas before `first` are gathered at `first`, those after `last` do not matter.
    """
    clipped = deltas.filter(F.col("minute") <= last).withColumn("minute", F.greatest(F.col("minute"), first))
    steps = sum_deltas(clipped.unionByName(_seeds(garages, first, last)))
    day = F.floor(F.col("minute") / MINUTES_PER_DAY)
    counts = ordered_scan(steps, ["garage_id"], ["minute"], day, sums={t: F.col(t) for t in CUSTOMER_TYPES})
    within = Window.partitionBy("garage_id", F.floor(F.col("minute") / MINUTES_PER_DAY)).orderBy("minute")
    day_end = (F.floor(F.col("minute") / MINUTES_PER_DAY) + 1) * MINUTES_PER_DAY
    until = F.least(F.coalesce(F.lead("minute").over(within), day_end), last + 1)
    return counts.withColumn("until", until.cast("bigint"))


def fill_minutes(stretches: DataFrame) -> DataFrame:
    """One row per minute of each stretch, with the total over customer types.

    Stretches are few and small, so Spark would fold them into one task, which
    then has to write all minutes. A fixed number of partitions by garage and
    day spreads the minutes first; only the stretches are shuffled.
    """
    spread = stretches.filter("minute < until").repartition(
        int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        "garage_id", F.floor(F.col("minute") / MINUTES_PER_DAY),
    )
    rows = spread.select(
        "garage_id", *CUSTOMER_TYPES, F.explode(F.sequence(F.col("minute"), F.col("until") - 1)).alias("_m")
    )
    total = sum((F.col(t) for t in CUSTOMER_TYPES[1:]), F.col(CUSTOMER_TYPES[0]))
    return rows.select("garage_id", tp.minute_stamp(F.col("_m")).alias("date"), *CUSTOMER_TYPES, total.alias("total"))


def count_occupancy(visits: DataFrame, start, end, *, one_sided: bool = False, include_end: bool = False) -> DataFrame:
    """O1: counts per garage and minute from `start` up to `end`.

    Stays are clipped to the range. With `include_end` the last minute is
    reported too; every stay still open then is clipped to close in it.
    """
    first, last = _minute(start), _minute(end)
    # Stays outside the range clip to nothing: the filter only spares reading them.
    touching = visits if one_sided or include_end else visits.filter(
        (F.col("entry_ts") < _ntz(end)) & (F.col("exit_ts").isNull() | (F.col("exit_ts") > _ntz(start))))
    clipped = touching.withColumns({
        "entry_ts": F.when(F.col("entry_ts").isNotNull(), F.least(F.greatest("entry_ts", _ntz(start)), _ntz(end))),
        "exit_ts": F.when(F.col("exit_ts").isNotNull(), F.least(F.greatest("exit_ts", _ntz(start)), _ntz(end))),
    })
    deltas = visit_deltas(clipped, one_sided=one_sided)
    return fill_minutes(running_counts(deltas, visits, first, last if include_end else last - 1))


def occupancy_range(visits: DataFrame) -> tuple[Column, Column]:
    """First minute and last whole minute of the visits, as scalar subqueries."""
    bounds = visits.agg(
        F.min(F.least("entry_ts", "exit_ts")).alias("first"), F.max(F.greatest("entry_ts", "exit_ts")).alias("last")
    )
    return (
        bounds.select(tp.minute_index(F.col("first"))).scalar(),
        bounds.select(tp.minute_index_up(F.col("last"))).scalar(),
    )


def occupancy_full_rebuild(visits: DataFrame, from_ts: str | None = None) -> DataFrame:
    """O2: the whole minute summary with calendar columns, from the first visit to the last completed minute.

    An open visit counts to the end. With `from_ts` only the minutes from then
    on are returned, still counting the cars that entered before.
    """
    first, last = occupancy_range(visits)
    begin = first if from_ts is None else _minute(from_ts)
    # A stay that ended before the first minute wanted adds nothing to it: the filter spares reading it.
    counted = visits if from_ts is None else visits.filter(F.col("exit_ts").isNull() | (F.col("exit_ts") > _ntz(from_ts)))
    summary = fill_minutes(running_counts(visit_deltas(counted), visits, begin, last - 1))
    return tp.calendar_columns(summary, "date")


def rebuild_checks(visits: DataFrame) -> DataFrame:
    """O2: duplicate visit ids and negative stays, both zero in sound data."""
    ids = visits.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("exit_ts") < F.col("entry_ts")).alias("neg"))
    return ids.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.sum("neg").alias("negative_stays"))


VERSION = ("visit_id", "garage_id", "customer_type", "entry_ts", "exit_ts")


class Increment(NamedTuple):
    """What one incremental run leaves: minute rows to put in, the (garage_id, day) they replace whole, and the ledger.

    `months` are the ledger's months that differ from the last run's; only those need to be rewritten.
    """

    rows: DataFrame
    days: DataFrame
    ledger: DataFrame
    months: DataFrame


def counted_versions(visits: DataFrame, until) -> DataFrame:
    """O3: the ledger of a summary that ends at the minute `until`: each visit as that summary counts it.

    A visit that enters later is not in it, and one that leaves later is open.
    Visits the summary leaves out (see visit_deltas) are not in it either.
    `month` is that of the entry.
    """
    c, end = F.col, _minute(until)
    left = F.when(tp.minute_index_up(c("exit_ts")) <= end, c("exit_ts"))
    counts = c("customer_type").isin(*CUSTOMER_TYPES) & c("entry_ts").isNotNull() & (c("exit_ts").isNull() | (c("entry_ts") < c("exit_ts")))
    rows = visits.filter(counts & (tp.minute_index(c("entry_ts")) <= end))
    return rows.select(*VERSION[:-1], left.alias("exit_ts"), F.trunc(F.to_date("entry_ts"), "month").alias("month"))


def version_changes(now: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O3: versions that only one of two ledgers has, with `n` (> 0: times only now, < 0: times only before); and their months.

    Each month has a digest of its versions: their number and the sums of both
    halves of their hashes, added up without a shuffle of visits. Only months
    whose digests differ are compared visit by visit. Vanished visits and
    repeated ids come out right, as versions are counted, not matched.
    """
    both = now.select(*VERSION, "month", F.lit(1).alias("_side")).unionByName(ledger.select(*VERSION, "month", F.lit(-1).alias("_side")))
    h = F.xxhash64(*VERSION)
    sums = [F.sum("_side"), F.sum(F.col("_side") * F.shiftright(h, 32)), F.sum(F.col("_side") * h.bitwiseAND(0xFFFFFFFF))]
    digests = both.groupBy("month").agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)])
    months = cut_lineage(digests.filter("_0 <> 0 or _1 <> 0 or _2 <> 0").select("month"))
    # One row per month of the table's history, so it may be broadcast at any size of the visits.
    differing = both.join(F.broadcast(months), "month", "left_semi")
    return differing.groupBy(*VERSION).agg(F.sum("_side").alias("n")).filter("n <> 0"), months


def change_deltas(changes: DataFrame) -> DataFrame:
    """O3: deltas that turn the old versions' counts into the new ones'. Unchanged parts cancel in the sum per minute."""
    times = F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))
    sides = [visit_deltas(changes.filter(f"n {sign} 0").withColumn("_time", times), sign=1 if sign == ">" else -1) for sign in "><"]
    return sum_deltas(sides[0].unionByName(sides[1])).filter(" or ".join(f"{t} <> 0" for t in CUSTOMER_TYPES))


def occupancy_incremental(summary: DataFrame, visits: DataFrame, ledger: DataFrame, last_minute: str, until: str) -> Increment:
    """O3: what makes a summary that ends at `last_minute` equal a rebuild through `until`.

    `ledger` holds the versions the summary has counted, `visits` the visits as
    they are now. Whole days are returned: those on which a count changes, that
    of `last_minute` unless the summary has it whole, and the new ones. Cars
    that stay at `last_minute` carry on. A garage new to the summary begins on
    its first changed day.
    """
    c = F.col
    now = counted_versions(visits, until)
    versions, months = version_changes(now, ledger)
    changes = cut_lineage(change_deltas(versions))
    # The summary's last row per garage is the base of the minutes after it.
    base = cut_lineage(summary.filter(c("date") == _ntz(last_minute)).select("garage_id", *CUSTOMER_TYPES))
    first = F.least(changes.agg(F.min("minute")).scalar(), _minute(last_minute) + 1)
    shifts = cut_lineage(running_counts(changes, base.unionByName(changes.select("garage_id", *CUSTOMER_TYPES)), first, _minute(until)))

    # Minutes the summary has: add the shift wherever a day has one.
    day = F.floor(c("minute") / MINUTES_PER_DAY)
    moved = shifts.filter(" or ".join(f"{t} <> 0" for t in CUSTOMER_TYPES)).filter(c("minute") <= _minute(last_minute))
    last_day = F.floor(_minute(last_minute) / MINUTES_PER_DAY)
    partial = base.filter(_minute(last_minute) % MINUTES_PER_DAY != MINUTES_PER_DAY - 1).select("garage_id", last_day.alias("_day"))
    touched = cut_lineage(moved.select("garage_id", day.alias("_day")).unionByName(partial).distinct())
    # A stretch lies within one day, so the days of a shift are found before its minutes are laid out.
    shift_rows = fill_minutes(shifts.filter(c("minute") <= _minute(last_minute)).withColumn("until", F.least("until", _minute(last_minute) + 1))
                              .withColumn("_day", day).join(touched, ["garage_id", "_day"], "left_semi"))
    # Only rows from the first touched day on are read: a filter that prunes the table's files.
    since = tp.minute_stamp(touched.agg(F.min("_day")).scalar() * MINUTES_PER_DAY)
    have = summary.filter((c("date") >= since) & (c("date") <= _ntz(last_minute))).withColumn("_day", F.floor(_minute(c("date")) / MINUTES_PER_DAY))
    held = have.join(touched, ["garage_id", "_day"], "left_semi").select("garage_id", "date", *CUSTOMER_TYPES)
    # One sum puts held rows and their shifts together, and keeps shifts of a garage that the summary lacks.
    redone = held.unionByName(shift_rows.select("garage_id", "date", *CUSTOMER_TYPES)).groupBy("garage_id", "date").agg(*[F.sum(t).alias(t) for t in CUSTOMER_TYPES])
    # Minutes after it: base plus shift.
    ahead = shifts.filter(c("until") > _minute(last_minute) + 1).withColumn("minute", F.greatest(c("minute"), _minute(last_minute) + 1))
    carried = ahead.join(base.select("garage_id", *[c(t).alias(f"_{t}") for t in CUSTOMER_TYPES]), "garage_id", "left").select(
        "garage_id", "minute", "until", *[(c(t) + F.coalesce(c(f"_{t}"), F.lit(0))).alias(t) for t in CUSTOMER_TYPES]
    )
    added = fill_minutes(carried).select("garage_id", "date", *CUSTOMER_TYPES)
    total = sum((c(t) for t in CUSTOMER_TYPES[1:]), c(CUSTOMER_TYPES[0]))
    rows = tp.calendar_columns(redone.unionByName(added).withColumn("total", total), "date")
    days = touched.unionByName(carried.select("garage_id", day.alias("_day"))).distinct().select("garage_id", F.date_from_unix_date(c("_day").cast("int")).alias("date_day"))
    return Increment(rows, days, now, months)


def apply_increment(summary: DataFrame, increment: Increment) -> DataFrame:
    """O3: the summary with the increment's days in place of its own; on a stored one VersionedTable.replace does this."""
    columns = ["garage_id", "date", *CUSTOMER_TYPES, "total"]
    kept = summary.withColumn("date_day", F.to_date("date")).join(increment.days, ["garage_id", "date_day"], "left_anti")
    return kept.select(*columns).unionByName(increment.rows.select(*columns))


def occupancy_delta_carry(base: DataFrame, visits: DataFrame, start, end) -> DataFrame:
    """Per garage, the base row's counts plus one-sided running deltas over [start, end).

    An entry before `start` is taken as unknown: the car is in the base already.
    """
    c = F.col
    known = visits.withColumn("entry_ts", F.when(c("entry_ts") >= _ntz(start), c("entry_ts"))).filter(
        (c("exit_ts").isNull()) | (c("exit_ts") >= _ntz(start))
    )
    first, last = _minute(start), _minute(end) - 1
    ran = running_counts(visit_deltas(known, one_sided=True), base.select("garage_id"), first, last)
    joined = ran.join(base.select("garage_id", *[c(t).alias(f"_{t}") for t in CUSTOMER_TYPES]), "garage_id")
    return fill_minutes(joined.select("garage_id", "minute", "until", *[(c(t) + c(f"_{t}")).alias(t) for t in CUSTOMER_TYPES]))


def occupancy_checks(summary: DataFrame) -> DataFrame:
    """Rows, garages, whether all garages have equally many rows, and how many totals are negative."""
    per = summary.groupBy("garage_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total") < 0).alias("neg"))
    return per.agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("garages"),
        (F.min("n") == F.max("n")).cast("int").alias("equal_rows"), F.sum("neg").alias("negative_totals"),
    )
