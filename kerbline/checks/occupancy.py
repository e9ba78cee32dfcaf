"""Queries: O1-O5, W6, V13 over the visits derived from orders. All minutes of all years are counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import timeparts as tp
from kerbline.operators import occupancy as oc
from kerbline.operators import ordered
from kerbline.session import written
from kerbline.sources.versions import replaced
from kerbline.streaming import jobs

START, END = "1995-01-01 00:00:00", "2001-12-31 00:00:00"

# For DuckDB: counts as stretches between changes, cut at each full hour, so that sums
# weighted by the stretch length equal sums over all minutes.
def _sweep(lo: str = "(select lo from bounds)", hi: str = "(select hi from bounds)") -> str:
    return f"""
    v as (select garage_id, customer_type, entry_ts, exit_ts from {{visits}} where exit_ts is null or entry_ts < exit_ts),
    bounds as (select date_trunc('minute', min(least(entry_ts, coalesce(exit_ts, entry_ts)))) lo,
                      date_trunc('minute', max(greatest(entry_ts, coalesce(exit_ts, entry_ts))) - interval '1' microsecond) hi from {{visits}}),
    ev as (select garage_id, customer_type, date_trunc('minute', entry_ts) m, 1 d from v
           union all
           select garage_id, customer_type, date_trunc('minute', exit_ts + interval '59999999' microsecond), -1 from v where exit_ts is not null
           union all
           select garage_id, 'none', h, 0 from (select distinct garage_id from {{visits}}) g,
                  (select unnest(generate_series(date_trunc('hour', {lo}), {hi}, interval '1' hour)) h) t where h > {lo}
           union all select distinct garage_id, 'none', {lo}, 0 from {{visits}}),
    steps as (select garage_id, greatest(m, {lo}) m, sum(case when customer_type = 'transient' then d else 0 end) tr,
                     sum(case when customer_type = 'permit' then d else 0 end) pe, sum(case when customer_type = 'employee' then d else 0 end) em
              from ev where m <= {hi} group by 1, 2),
    seg as (select garage_id, m date, date_diff('minute', m, coalesce(lead(m) over w, {hi} + interval '1' minute)) dur,
                   sum(tr) over w transient, sum(pe) over w permit, sum(em) over w employee
            from steps window w as (partition by garage_id order by m))"""


_DAILY = """select garage_id, strftime(date, '%Y-%m-%d') as "day", cast(sum(dur) as bigint) as "minutes", cast(sum(transient * dur) as bigint) transient,
    cast(sum(permit * dur) as bigint) permit, cast(sum(employee * dur) as bigint) employee, cast(max(transient + permit + employee) as bigint) peak,
    cast(sum((transient + 2 * permit + 3 * employee) * (dur * (hour(date) * 60 + minute(date)) + dur * (dur - 1) // 2)) as bigint) placed"""


def _stamp(ts: str) -> str:
    return f"timestamp '{ts}'"


def daily(summary):
    """All minutes, reduced to one row per garage and day."""
    return summary.groupBy("garage_id", F.to_date("date").alias("day")).agg(
        F.count(F.lit(1)).alias("minutes"), *[F.sum(t).alias(t) for t in oc.CUSTOMER_TYPES], F.max("total").alias("peak"),
        # Tells minutes apart, which sums per day do not.
        F.sum((F.col("transient") + 2 * F.col("permit") + 3 * F.col("employee")) * (F.hour("date") * 60 + F.minute("date"))).alias("placed"),
    )


@query("count_occupancy", f"with {_sweep(_stamp(START), _stamp('2001-12-30 23:59:00'))} {_DAILY} from seg group by 1, 2")
def count_occupancy(t: Tables):
    return daily(oc.count_occupancy(t.visits, START, END))


@query("occupancy_from_stream", f"with {_sweep(_stamp(START), _stamp('2001-12-30 23:59:00'))} {_DAILY} from seg group by 1, 2")
def occupancy_from_stream(t: Tables):
    c = F.col
    stays = t.visits.filter(c("exit_ts").isNull() | (c("exit_ts") > c("entry_ts")))
    events = stays.select("visit_id", "garage_id", "customer_type", F.inline(F.array(
        F.struct(c("entry_ts").alias("ts"), F.lit(1).alias("step")), F.struct(c("exit_ts").alias("ts"), F.lit(-1).alias("step"))))).filter("ts is not null")
    # Three micro-batches, in no order of time.
    batches = [jobs.gate_minutes(events.filter(c("visit_id") % 3 == k)) for k in range(3)]
    return daily(jobs.occupancy_from_stream(batches[0].unionByName(batches[1]).unionByName(batches[2]), START, END))


@query("occupancy_full_rebuild", f"""with {_sweep()}
    select garage_id, year(date) as "year", quarter(date) as "quarter", month(date) as "month", week(date) as "week", isodow(date) - 1 as dayofweek,
           case when isodow(date) < 6 then 1 else 0 end weekday_type,
           case when isodow(date) > 5 then 'Weekend' when hour(date) between 6 and 18 then 'Daytime' else 'Evening' end period,
           cast(sum(dur) as bigint) as "minutes", cast(sum((transient + permit + employee) * dur) as bigint) total, cast(max(transient + permit + employee) as bigint) peak,
           cast(sum(hour(date) * dur) as bigint) as "hours", cast(sum(dayofyear(date) * dur) as bigint) doy, min(strftime(date, '%H:%M:%S')) first_hms,
           max(strftime(date + to_minutes(cast(dur - 1 as int)), '%H:%M:%S')) last_hms
    from seg group by 1, 2, 3, 4, 5, 6, 7, 8""")
def occupancy_full_rebuild(t: Tables):
    keys = ["garage_id", "year", "quarter", "month", "week", "dayofweek", "weekday_type", "period"]
    return oc.occupancy_full_rebuild(t.visits).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("minutes"), F.sum("total").alias("total"), F.max("total").alias("peak"), F.sum("hour").alias("hours"),
        F.sum("dayofyear").alias("doy"), F.min("hms").alias("first_hms"), F.max("hms").alias("last_hms"),
    )


@query("occupancy_checks", f"""with {_sweep()}, per as (select garage_id, sum(dur) n, coalesce(sum(dur) filter (transient + permit + employee < 0), 0) neg from seg group by 1)
    select cast(sum(n) as bigint) row_count, count(*) garages, case when min(n) = max(n) then 1 else 0 end equal_rows, cast(sum(neg) as bigint) negative_totals from per""")
def occupancy_checks(t: Tables):
    return oc.occupancy_checks(oc.occupancy_full_rebuild(t.visits))


LAST, BETWEEN, UNTIL = "2001-03-31 23:59:00", "2001-06-14 08:17:00", "2001-09-30 11:30:00"


def known_at(t: Tables, at: str):
    """Visits as they were stored at a time: entries loaded by then, exits a month after their load."""
    c, last = F.col, F.lit(at).cast(tp.NTZ)
    known = t.visits.filter((c("entry_ts") <= last) & (c("load_ts") <= last))
    return known.withColumn("exit_ts", F.when(c("load_ts") + F.expr("interval 30 days") <= last, c("exit_ts")))


def summary_at(t: Tables, ledger):
    """The stored summary through LAST."""
    first, last = (tp.minute_index(F.lit(v).cast(tp.NTZ)) for v in (START, LAST))
    return written(oc.fill_minutes(oc.running_counts(oc.visit_deltas(ledger), t.visits, first, last)), "summary")


@query("occupancy_incremental", f"with {_sweep(_stamp(START), _stamp(UNTIL))} {_DAILY} from seg group by 1, 2")
def occupancy_incremental(t: Tables):
    ledger = oc.counted_versions(known_at(t, LAST), LAST)
    before = summary_at(t, ledger)
    return daily(oc.apply_increment(before, oc.occupancy_incremental(before, t.visits, ledger, LAST, UNTIL)))


@query("occupancy_two_increments", f"with {_sweep(_stamp(START), _stamp(UNTIL))} {_DAILY} from seg group by 1, 2")
def occupancy_two_increments(t: Tables):
    """The first run's ledger and summary are the second one's input; its range ends in the middle of a day."""
    ledger = written(oc.counted_versions(known_at(t, LAST), LAST), "ledger")
    before = summary_at(t, ledger)
    step = oc.occupancy_incremental(before, known_at(t, BETWEEN), ledger, LAST, BETWEEN)
    between = written(oc.apply_increment(before, step), "summary")
    return daily(oc.apply_increment(between, oc.occupancy_incremental(between, t.visits, step.ledger, BETWEEN, UNTIL)))


_STATE = """select visit_id, garage_id, customer_type, entry_ts, case when date_trunc('minute', exit_ts + interval '59999999' microsecond) <= timestamp '{0}' then exit_ts end exit_ts
    from ({1}) x where entry_ts is not null and (exit_ts is null or entry_ts < exit_ts) and date_trunc('minute', entry_ts) <= timestamp '{0}'"""
_KNOWN = f"""select visit_id, garage_id, customer_type, entry_ts, case when load_ts + interval '30' day <= {_stamp(LAST)} then exit_ts end exit_ts
    from {{visits}} where entry_ts <= {_stamp(LAST)} and load_ts <= {_stamp(LAST)}"""


@query("version_changes", f"""with now as ({_STATE.format(UNTIL, 'select * from {visits}')}), old as ({_STATE.format(LAST, _KNOWN)})
    select visit_id, garage_id, customer_type, entry_ts, exit_ts, cast(sum(k) as bigint) n from (select *, 1 k from now union all select *, -1 from old) x
    group by 1, 2, 3, 4, 5 having sum(k) <> 0""")
def version_changes(t: Tables):
    return oc.version_changes(oc.counted_versions(t.visits, UNTIL), oc.counted_versions(known_at(t, LAST), LAST))[0]


@query("replace_range", """
    with s as (select garage_id, date_trunc('day', min(ts)) + interval '251' hour start from {gate} where garage_id <> 3 group by 1)
    select g.event_id, g.garage_id, g.ts date, cast(g.amount as double) amount from {gate} g left join s on s.garage_id = g.garage_id where s.start is null or g.ts < s.start
    union all select p.presence_id, p.garage_id, p.entry_ts, cast(p.cost as double) from {presence} p join s on s.garage_id = p.garage_id where p.entry_ts >= s.start""")
def replace_range(t: Tables):
    """The pure half of S21: gate events up to each garage's start, presences from then on; garage 3 has no start."""
    c = F.col
    old = t.gate.select("event_id", "garage_id", c("ts").alias("date"), c("amount").cast("double").alias("amount"))
    new = t.presence.select(c("presence_id").alias("event_id"), "garage_id", c("entry_ts").alias("date"), c("cost").cast("double").alias("amount"))
    starts = old.filter("garage_id <> 3").groupBy("garage_id").agg((F.date_trunc("day", F.min("date")) + F.expr("interval 251 hours")).cast(tp.NTZ).alias("start"))
    return replaced(old, new, starts)


CARRY_START, CARRY_END = "1998-01-01 00:00:00", "2001-12-31 00:00:00"


@query("occupancy_delta_carry", f"with {_sweep(_stamp(START), _stamp('2001-12-30 23:59:00'))} {_DAILY} from seg where date >= {_stamp(CARRY_START)} group by 1, 2")
def occupancy_delta_carry(t: Tables):
    c = F.col
    at = F.lit(CARRY_START).cast(tp.NTZ)
    inside = t.visits.filter((c("entry_ts") < at) & (c("exit_ts").isNull() | (tp.ceil_minute(c("exit_ts")) >= at)) & (c("exit_ts").isNull() | (c("exit_ts") > c("entry_ts"))))
    inside = inside.filter(c("exit_ts").isNull() | (c("exit_ts") >= at))
    per = inside.groupBy("garage_id").agg(*[F.count_if(c("customer_type") == k).alias(k) for k in oc.CUSTOMER_TYPES])
    base = t.visits.select("garage_id").distinct().join(per, "garage_id", "left").fillna(0)
    return daily(oc.occupancy_delta_carry(base, t.visits, CARRY_START, CARRY_END))


@query("rebuild_checks", """select cast(count(*) filter (n > 1) as bigint) duplicate_ids, cast(sum(neg) as bigint) negative_stays
    from (select visit_id, count(*) n, count(*) filter (exit_ts < entry_ts) neg from {visits} group by 1) x""")
def rebuild_checks(t: Tables):
    return oc.rebuild_checks(t.visits)


@query("running_occupancy", """
    with e as (select garage_id, customer_type, date_trunc('minute', entry_ts) m, 1 d from {visits}
               union all select garage_id, customer_type, date_trunc('minute', exit_ts), -1 from {visits} where exit_ts is not null),
    s as (select garage_id, customer_type, m, sum(d) d from e group by 1, 2, 3)
    select garage_id, customer_type, m "minute", cast(d as bigint) delta, cast(sum(d) over (partition by garage_id, customer_type order by m) as bigint) running from s""")
def running_occupancy(t: Tables):
    marks = t.sql("""select garage_id, customer_type, inline(array(struct(entry_ts ts, 1 d), struct(exit_ts ts, -1 d))) from {visits}""")
    steps = marks.filter("ts is not null").groupBy("garage_id", "customer_type", tp.floor_minute(F.col("ts")).alias("minute")).agg(F.sum("d").alias("delta"))
    ran = ordered.ordered_scan(steps, ["garage_id", "customer_type"], ["minute"], ordered.chunk_of("minute"), sums={"running": F.col("delta")})
    return ran
