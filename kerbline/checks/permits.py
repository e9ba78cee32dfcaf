"""Queries: P1-P7, P10, P11, P16-P19, W8-W11, J9 over permits derived from customers, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import timeparts as tp
from kerbline.operators import features as fe
from kerbline.operators import modelling as ml
from kerbline.operators import permits as pm
from kerbline.session import written

c = F.col
AS_OF = "2024-02-01 00:00:00"

_ROSTER = """cards as (select c_custkey card_id, concat('L', cast(c_custkey as varchar(20))) permit, cast(c_nationkey as int) group_id, cast(c_custkey % 6 as int) status_code,
      timestamp '2023-12-20 00:00:00' + (c_custkey % 20) * interval '1' day start_date, c_custkey % 3 = 0 with_expiry from {customer}),
    groups as (select n_nationkey group_id, concat('G: ', n_name) group_name, n_regionkey customer_id from {nation}),
    owners as (select r_regionkey customer_id, r_name customer from {region} where r_regionkey <> 4),
    parkings as (select n_nationkey group_id, cast(n_nationkey % 7 as int) garage_id, cast(n_nationkey % 6 as int) policy_id from {nation} where n_nationkey <> 5
      union all select n_nationkey, 9, 2 from {nation} where n_nationkey % 8 = 0),
    policies as (select cast(r_regionkey as int) policy_id, case r_regionkey when 0 then 'M-F 6-18' when 1 then 'X 24/7' when 2 then 'M-Su 17-8' when 3 then 'Sa-Su 0-23' else 'M-F 7-19 Pay' end access_policy from {region})"""


def roster_tables(t: Tables):
    return [t.sql(f"with {_ROSTER} select * from {name}") for name in ("cards", "groups", "owners", "parkings", "policies")]


_STATUS = "case status_code when 0 then 'active' when 1 then 'inactive' when 2 then 'lost' when 3 then 'defective' else 'unknown' end"


@query("permit_roster", f"""with {_ROSTER} select card_id, permit, group_name, customer, garage_id, access_policy, {_STATUS} status from cards left join groups using (group_id) left join owners using (customer_id)
    left join parkings using (group_id) left join policies using (policy_id) where customer_id not in (3)""")
def permit_roster(t: Tables):
    return pm.permit_roster(*roster_tables(t), excluded_customers=(3,)).select("card_id", "permit", "group_name", "customer", "garage_id", "access_policy", "status")


@query("access_policies", f"""with {_ROSTER} select group_name, customer_id, garage_id, access_policy from groups join parkings using (group_id) join policies using (policy_id)""")
def access_policies(t: Tables):
    _, groups, _, parkings, policies = roster_tables(t)
    return pm.access_policies(groups, parkings, policies).select("group_name", "customer_id", "garage_id", "access_policy")


# The change log: a fifth of the entries set start dates, some groups are lost-card groups.
_LOG = """lg as (select event_id log_id, user_id card_id, ts, case when event_id % 5 = 0 then 104 when event_type = 'signup' then 2 when event_type = 'view' then 999 else 110 end property_type,
      case when event_id % 5 = 0 then concat(lpad(cast(event_id % 27 + 1 as varchar(2)), 2, '0'), '-Jan-2024') when event_type = 'error' then 'True' else 'False' end new_value,
      case when event_type = 'signup' and event_id % 4 = 0 then 'G: LOST CARDS' when event_type = 'signup' then concat('G: group ', cast(cast(floor(value) as int) % 5 as varchar(5)))
           else concat('G: group ', cast(user_id % 5 as varchar(5))) end group_detail, concat('owner ', cast(user_id % 9 as varchar(5))) customer from {events})"""


def log(t: Tables):
    return t.sql(f"with {_LOG} select * from lg")


def cards(t: Tables):
    return roster_tables(t)[0]


_STARTS = """ev as (select * from lg where property_type in (2, 104, 110) and group_detail <> ''),
    sd as (select e.card_id, k.permit, coalesce(max(case when property_type = 104 then strptime(new_value, '%d-%b-%Y')::date end), max(k.start_date)::date) eff
           from ev e left join cards k on k.card_id = e.card_id group by 1, 2)"""


@query("card_start_dates", f"with {_ROSTER}, {_LOG}, {_STARTS} select card_id, permit, strftime(eff, '%Y-%m-%d') effective_start_date from sd")
def card_start_dates(t: Tables):
    return pm.card_start_dates(log(t), cards(t))


_PERIODS = f"""{_STARTS},
    sig as (select *, case when property_type = 110 then case when new_value = 'True' then 1 else 0 end end bs, case when property_type = 2 then group_detail end gs,
              count(case when property_type = 110 then 1 end) over w bg, count(case when property_type = 2 then 1 end) over w gg, row_number() over w rn, lead(ts) over w pe
            from ev window w as (partition by card_id order by ts, log_id)),
    st as (select *, coalesce(max(bs) over (partition by card_id, bg), 0) blk, max(gs) over (partition by card_id, gg) grp from sig),
    acc as (select *, case when blk = 1 then 0 when grp like '%LOST CARDS%' then 0 else 1 end has,
              coalesce(grp, (select first(group_detail order by l.ts, l.log_id) from lg l where l.card_id = st.card_id)) g2 from st),
    isl as (select *, rn - row_number() over (partition by card_id, has order by ts, log_id) k from acc),
    per as (select card_id, has, k, max(customer) customer, min(ts) s0, max(pe) period_end, min(g2) group_at_start, max(blk) was_manually_blocked from isl group by 1, 2, 3),
    f as (select card_id, min(ts) t0 from ev group by 1),
    periods as (select sd.permit, per.card_id, customer, case when s0 = t0 then greatest(eff, s0::date)::timestamp else s0 end period_start, period_end, has has_access, group_at_start, was_manually_blocked,
                  strftime(eff, '%Y-%m-%d') effective_start_date from per join sd on sd.card_id = per.card_id join f on f.card_id = per.card_id where sd.permit is not null)"""


@query("access_periods", f"with {_ROSTER}, {_LOG}, {_PERIODS} select * from periods")
def access_periods(t: Tables):
    return pm.access_periods(log(t), cards(t))


@query("add_unlogged_permits", f"""with {_ROSTER}, {_LOG}, {_PERIODS} select * from periods
    union all select permit, card_id, customer, start_date, timestamp '{AS_OF}', 1, group_name, 0, strftime(start_date, '%Y-%m-%d') from cards left join groups using (group_id) left join owners using (customer_id)
    where not with_expiry and permit not in (select permit from periods)""")
def add_unlogged_permits(t: Tables):
    k, groups, owners, _, _ = roster_tables(t)
    roster = k.join(groups, "group_id", "left").join(owners, "customer_id", "left")
    return pm.add_unlogged_permits(pm.access_periods(log(t), k), roster, AS_OF)


# Access periods and visits per customer over several years.
_GRID_IN = """pp as (select concat('L', cast(o_custkey as varchar(20))) permit, o_custkey card_id, concat('owner ', cast(o_custkey % 9 as varchar(5))) customer, o_orderdate period_start,
      case when o_orderkey % 10 <> 0 then o_orderdate + (30 + o_orderkey % 60) * interval '1' day end period_end, case when o_orderkey % 6 = 0 then 0 else 1 end has_access,
      concat('group ', cast(o_orderkey % 3 as varchar(5))) group_at_start,
      case when o_custkey % 17 = 0 then null else case o_custkey % 5 when 0 then 'M-F 6-18' when 1 then 'X 24/7' when 2 then 'M-Su 17-8' when 3 then 'Sa-Su 0-23' else 'M-F 18-6 & Sa-Su 0-23' end end access_policy from {orders}),
    vv as (select concat('L', cast(o_custkey as varchar(20))) permit, l_shipdate + (l_partkey % 1440) * interval '1' minute entry_ts,
      case when l_linenumber % 5 <> 0 then l_shipdate + (l_partkey % 1440 + l_suppkey * 17) * interval '1' minute end exit_ts, min(garage_id) garage_id
      from (select l_orderkey, l_shipdate, l_partkey, l_linenumber, l_suppkey, cast(l_suppkey % 7 as int) garage_id from {lineitem}) l join {orders} on o_orderkey = l_orderkey group by 1, 2, 3)"""
END = "2001-12-31"


def periods(t: Tables):
    return t.sql(f"with {_GRID_IN} select * from pp")


def visits(t: Tables):
    """Visits; those without an exit last a day."""
    v = t.sql(f"with {_GRID_IN} select * from vv")
    return v.withColumn("exit_ts", F.coalesce("exit_ts", tp.add_minutes(c("entry_ts"), 1440)))


_V2 = "v2 as (select permit, entry_ts, coalesce(exit_ts, entry_ts + interval '1440' minute) exit_ts, garage_id from vv)"


@query("visit_to_policy", f"""with {_GRID_IN}, {_V2}, sp as (select permit, period_start, coalesce(period_end, timestamp '{END}') pe, access_policy from pp where has_access = 1),
      j as (select v2.*, sp.access_policy, row_number() over (partition by v2.permit, v2.entry_ts, v2.exit_ts order by period_start, sp.access_policy nulls first, garage_id) rn
            from v2 join sp on sp.permit = v2.permit and v2.entry_ts >= sp.period_start and v2.entry_ts <= sp.pe)
    select permit, entry_ts, exit_ts, garage_id, access_policy from j where rn = 1""")
def visit_to_policy(t: Tables):
    return pm.visit_to_policy(visits(t), periods(t), END)


@query("unmatched_visits", f"""with {_GRID_IN}, {_V2} select count(*) n, count(distinct permit) permits from v2 where not exists (select 1 from pp where pp.permit = v2.permit and has_access = 1
    and v2.entry_ts >= period_start and v2.entry_ts <= coalesce(period_end, timestamp '{END}'))""")
def unmatched_visits(t: Tables):
    v = written(visits(t), "visits")
    return pm.unmatched_visits(v, pm.visit_to_policy(v, periods(t), END)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("permit").alias("permits"))


_DATES = f"vd as (select distinct permit, unnest(generate_series(entry_ts::date::timestamp, exit_ts::date::timestamp, interval '1' day))::date d from v2)"


@query("visit_dates", f"with {_GRID_IN}, {_V2}, {_DATES} select permit, strftime(d, '%Y-%m-%d') date from vd")
def visit_dates(t: Tables):
    return pm.visit_dates(visits(t), END)


def _mode(col: str) -> str:
    return f"(select permit, {col} v from (select permit, {col}, row_number() over (partition by permit order by count(*) desc, {col}) rn from act group by permit, {col}) q where rn = 1)"


_GRID = f"""{_GRID_IN}, {_V2}, {_DATES}, act as (select * from pp where has_access = 1 and access_policy is not null),
    prof as (select p.permit, p.v access_policy, g.v group_name, n.v permit_name,
               case p.v when 'M-F 6-18' then 31 when 'Sa-Su 0-23' then 96 else 127 end mask from {_mode('access_policy')} p join {_mode('group_at_start')} g using (permit) join {_mode('customer')} n using (permit)),
    days as (select distinct permit, unnest(generate_series(period_start::date::timestamp, least(coalesce(period_end::date, date '{END}'), date '{END}')::timestamp, interval '1' day))::date d from act),
    grid as (select days.permit, days.d, permit_name, group_name, access_policy, case when vd.d is not null then 1 else 0 end showed_up
             from days join prof using (permit) left join vd on vd.permit = days.permit and vd.d = days.d where (mask >> (isodow(days.d) - 1)::int) & 1 = 1),
    pvd as (select vd.permit, vd.d from vd join prof using (permit) where (mask >> (isodow(vd.d) - 1)::int) & 1 = 1 and vd.permit in (select permit from grid))"""


def grid(t: Tables):
    return fe.permit_day_grid(periods(t), visits(t), "1995-01-01", END)


_HOLIDAY = """case when (month(d), day(d)) in ((1, 1), (6, 19), (11, 11), (12, 24), (12, 25), (12, 31)) or (month(d) = 11 and isodow(d) = 4 and day(d) between 22 and 28)
    or (month(d) = 11 and isodow(d) = 5 and day(d) between 23 and 29) or (month(d) = 1 and isodow(d) = 1 and day(d) between 15 and 21) or (month(d) = 5 and isodow(d) = 1 and day(d) >= 25)
    or (month(d) = 9 and isodow(d) = 1 and day(d) <= 7) then 1 else 0 end"""


@query("permit_day_grid", f"""with {_GRID} select permit, permit_name, group_name, access_policy, count(*) "days", cast(sum(showed_up) as bigint) showed, min(strftime(d, '%Y-%m-%d')) first_day, max(strftime(d, '%Y-%m-%d')) last_day,
    cast(sum({_HOLIDAY}) as bigint) holidays, cast(sum(week(d)) as bigint) as "weeks", cast(sum(isodow(d) - 1) as bigint) dows from grid group by 1, 2, 3, 4""")
def permit_day_grid(t: Tables):
    g = grid(t)
    return g.groupBy("permit", "permit_name", "group_name", "access_policy").agg(
        F.count(F.lit(1)).alias("days"), F.sum("showed_up").alias("showed"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"), F.sum("is_holiday").alias("holidays"), F.sum("week_of_year").alias("weeks"), F.sum("day_of_week").alias("dows"))


_FEATURES = f"""{_GRID},
    u as (select coalesce(g.permit, p.permit) permit, coalesce(g.d, p.d) d, case when g.d is not null then 1 else 0 end isg, case when p.d is not null then 1 else 0 end isv, showed_up
          from grid g full outer join pvd p on p.permit = g.permit and p.d = g.d),
    w1 as (select *, coalesce(sum(isv) over pr, 0) pv, coalesce(sum(isg) over pr, 0) pd, max(case when isv = 1 then d end) over pr lastv, coalesce(sum(isv) over pw, 0) wv, coalesce(sum(isg) over pw, 0) wd
           from u window pr as (partition by permit order by d rows between unbounded preceding and 1 preceding), pw as (partition by permit, isodow(d) order by d rows between unbounded preceding and 1 preceding)),
    w2 as (select w1.*, case when l.d is not null then 1 else 0 end lastweek from w1 left join pvd l on l.permit = w1.permit and l.d = w1.d - 7 where isg = 1),
    w3 as (select *, avg(showed_up) over (partition by permit order by d rows between 10 preceding and 1 preceding) r10, avg(showed_up) over (partition by permit order by d rows between 20 preceding and 1 preceding) r20,
             row_number() over (partition by permit order by d) rn, row_number() over (partition by permit, showed_up order by d) rs, min(d) over (partition by permit) d0 from w2),
    w4 as (select *, case when showed_up = 1 then 1 else -1 end * row_number() over (partition by permit, showed_up, rn - rs order by d) sg from w3),
    feat as (select *, coalesce(lag(sg) over (partition by permit order by d), 0) streak from w4)"""


@query("historical_features", f"""with {_FEATURES} select permit, count(*) "days", cast(sum(showed_up) as bigint) showed, round(sum(case when pd > 0 then pv / pd end), 3) presence_rate, round(sum(r10), 3) rate_10, round(sum(r20), 3) rate_20,
    round(sum(case when wd > 0 then wv / wd end), 3) dow_rate, cast(sum(streak) as bigint) streak, cast(sum(abs(streak)) as bigint) streak_length, cast(sum(d - lastv) as bigint) days_since, cast(sum(lastweek) as bigint) last_week,
    cast(sum(d - d0) as bigint) tenure from feat group by permit""")
def historical_features(t: Tables):
    f = features(t)
    return f.groupBy("permit").agg(
        F.count(F.lit(1)).alias("days"), F.sum("showed_up").alias("showed"), F.round(F.sum("presence_rate"), 3).alias("presence_rate"), F.round(F.sum("presence_rate_10"), 3).alias("rate_10"),
        F.round(F.sum("presence_rate_20"), 3).alias("rate_20"), F.round(F.sum("day_of_week_rate"), 3).alias("dow_rate"), F.sum("streak").alias("streak"), F.sum(F.abs("streak")).alias("streak_length"),
        F.sum("days_since_last_visit").alias("days_since"), F.sum("visited_same_last_week").alias("last_week"), F.sum("tenure_days").alias("tenure"))


def features(t: Tables):
    return fe.permit_features(periods(t), visits(t), "1995-01-01", END)


DAY = "2001-06-13"


@query("prediction_rows", f"""with {_GRID_IN}, {_V2}, act as (select * from pp where has_access = 1 and access_policy is not null),
    prof as (select p.permit, case p.v when 'M-F 6-18' then 31 when 'Sa-Su 0-23' then 96 else 127 end mask, f from {_mode('access_policy')} p join (select permit, min(period_start)::date f from act group by 1) m using (permit)
             where p.permit in (select permit from v2)),
    ok as (select * from prof where (mask >> (isodow(date '{DAY}') - 1)::int) & 1 = 1 and f <= date '{DAY}'),
    dd as (select permit, mask, unnest(generate_series(f::timestamp, timestamp '{DAY}' - interval '1' day, interval '1' day))::date d from ok),
    pd as (select * from dd where (mask >> (isodow(d) - 1)::int) & 1 = 1),
    vd as (select distinct permit, unnest(generate_series(entry_ts::date::timestamp, exit_ts::date::timestamp, interval '1' day))::date d from v2 where entry_ts < timestamp '{DAY}'),
    pv as (select vd.permit, vd.d from vd join ok using (permit) where d < date '{DAY}' and (mask >> (isodow(d) - 1)::int) & 1 = 1),
    h as (select pd.permit, pd.d, case when pv.d is not null then 1 else 0 end s, row_number() over (partition by pd.permit order by pd.d desc) k from pd left join pv on pv.permit = pd.permit and pv.d = pd.d),
    recent as (select permit, avg(s) filter (k <= 10) r10, avg(s) filter (k <= 20) r20, count(*) filter (isodow(d) = isodow(date '{DAY}')) dow_days,
                 max(s) filter (k = 1) s1, coalesce(min(k) filter (s = 1), count(*) + 1) - 1 absent, coalesce(min(k) filter (s = 0), count(*) + 1) - 1 present from h group by 1)
    select ok.permit, month(date '{DAY}') "month", week(date '{DAY}') week_of_year, isodow(date '{DAY}') - 1 day_of_week, 0 is_holiday,
      case when nd > 0 then coalesce(nv, 0) / nd end presence_rate, r10 presence_rate_10, r20 presence_rate_20, case when dow_days > 0 then coalesce(dow_visits, 0) / dow_days end day_of_week_rate,
      coalesce(case when s1 = 1 then present else -absent end, 0) streak, date '{DAY}' - lv days_since_last_visit, coalesce(lw, 0) visited_same_last_week, date '{DAY}' - f tenure_days
    from ok left join (select permit, count(*) nd from pd group by 1) a using (permit) left join recent using (permit)
    left join (select permit, count(*) nv, count(*) filter (isodow(d) = isodow(date '{DAY}')) dow_visits, max(d) lv, max(case when d = date '{DAY}' - 7 then 1 else 0 end) lw from pv group by 1) b using (permit)""")
def prediction_rows(t: Tables):
    return fe.prediction_rows(periods(t), visits(t), DAY).select("permit", *fe.FEATURES, "streak", "tenure_days")


@query("temporal_split", f"""with {_FEATURES}, k as (select * from feat where pd > 0 and r10 is not null and r20 is not null and wd > 0 and lastv is not null)
    select case when d <= date '1999-12-31' then 'train' when d <= date '2000-12-31' then 'validation' else 'test' end split, count(*) n, cast(sum(showed_up) as bigint) showed from k group by 1""")
def temporal_split(t: Tables):
    return fe.temporal_split(features(t), "1999-12-31", "2000-12-31").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("showed_up").alias("showed"))


@query("group_split", f"""with {_FEATURES}, k as (select * from feat where pd > 0 and r10 is not null and r20 is not null and wd > 0 and lastv is not null)
    select case when cast(concat('0x', left(md5(permit), 8)) as bigint) % 100 < 20 then 'test' else 'train' end split, count(*) n, count(distinct permit) permits from k group by 1""")
def group_split(t: Tables):
    return fe.group_split(features(t)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("permit").alias("permits"))


# The ten features as expressions over `feat`.
_NAMED = {"day_of_week": "isodow(d) - 1", "month": "month(d)", "week_of_year": "week(d)", "is_holiday": f"({_HOLIDAY})", "presence_rate": "pv / pd", "presence_rate_10": "r10",
          "presence_rate_20": "r20", "day_of_week_rate": "wv / wd", "days_since_last_visit": "d - lastv", "visited_same_last_week": "lastweek"}


@query("feature_drift", f"""with {_FEATURES}, k as (select * from feat where pd > 0 and r10 is not null and r20 is not null and wd > 0 and lastv is not null),
    m as (select d <= date '1999-12-31' tr, d > date '2000-12-31' te, {", ".join(f"{e} f_{n}" for n, e in _NAMED.items())} from k)
    """ + " union all ".join(f"""select '{n}' feature, round(avg(f_{n}) filter (tr), 9) train_mean, round(avg(f_{n}) filter (te), 9) test_mean,
      round(avg(f_{n}) filter (te) - avg(f_{n}) filter (tr), 9) delta from m""" for n in _NAMED))
def feature_drift(t: Tables):
    rows = fe.feature_drift(fe.temporal_split(features(t), "1999-12-31", "2000-12-31"))
    return rows.select("feature", *[F.round(n, 9).alias(n) for n in ("train_mean", "test_mean", "delta")])


@query("label_share", f"with {_GRID} select showed_up, count(*) \"days\", count(*) / (select count(*) from grid) share from grid group by 1")
def label_share(t: Tables):
    return fe.label_share(grid(t))


@query("permit_rates", f"""with {_GRID}, r as (select permit, avg(showed_up) rate from grid group by 1) select count(*) permits, round(avg(rate), 9) mean, round(stddev(rate), 9) std, round(min(rate), 9) "min",
    round(quantile_cont(rate, 0.25), 9) p25, round(quantile_cont(rate, 0.5), 9) p50, round(quantile_cont(rate, 0.75), 9) p75, round(max(rate), 9) "max" from r""")
def permit_rates(t: Tables):
    return fe.permit_rates(grid(t)).select("permits", *[F.round(n, 9).alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("policy_change_check", f"""with {_GRID_IN} select max(n) max_policies, cast(sum(m) as bigint) without_policy from (select card_id, count(distinct access_policy) n, count(*) filter (access_policy is null) m from pp group by 1) q""")
def policy_change_check(t: Tables):
    return pm.policy_change_check(periods(t))


@query("permits_present", """select count(distinct permit) permits from {visits} where customer_type = 'permit' and (exit_ts is null or exit_ts >= timestamp '2001-07-01')""")
def permits_present(t: Tables):
    return pm.permits_present(t.visits, "2001-07-01")


# Scores with ties, and outcomes that follow them loosely, made from order keys.
_SCORED = "select o_orderkey, cast(o_custkey as varchar(20)) permit, cast(o_custkey % 211 as double) / 210 show_probability, case when o_orderkey * 7919 % 211 < o_custkey % 211 * 3 / 4 + 20 then 1 else 0 end showed_up from {orders}"


def scored(t: Tables):
    return t.sql(_SCORED)


@query("roc_auc", f"""with s as ({_SCORED}), r as (select showed_up, rank() over (order by show_probability) + (count(*) over (partition by show_probability) - 1) / 2.0 place from s)
    select count(*) filter (showed_up = 1) positives, count(*) filter (showed_up = 0) negatives, round((sum(place) filter (showed_up = 1) - count(*) filter (showed_up = 1) * (count(*) filter (showed_up = 1) + 1) / 2.0)
      / (count(*) filter (showed_up = 1) * count(*) filter (showed_up = 0)), 9) auc from r""")
def roc_auc(t: Tables):
    return ml.roc_auc(scored(t)).withColumn("auc", F.round("auc", 9))


@query("class_report", f"""with s as (select showed_up a, case when show_probability >= 0.5 then 1 else 0 end p from ({_SCORED}) x), l as (select unnest([0, 1]) label),
      n as (select label, count(*) filter (a = label) support, count(*) filter (p = label) called, count(*) filter (a = label and p = label) hits from s, l group by 1)
    select label, round(case when called > 0 then hits / called else 0 end, 9) "precision", round(case when support > 0 then hits / support else 0 end, 9) recall,
      round(case when hits > 0 then 2.0 * hits / (called + support) else 0 end, 9) f1, support from n""")
def class_report(t: Tables):
    return ml.class_report(scored(t)).select("label", *[F.round(n, 9).alias(n) for n in ("precision", "recall", "f1")], "support")


@query("calibration_curve", f"""select cast(least(floor(show_probability * 10), 9) as bigint) bin, round(avg(show_probability), 9) mean_predicted, round(avg(showed_up), 9) fraction_positive, count(*) n
    from ({_SCORED}) x group by 1""")
def calibration_curve(t: Tables):
    return ml.calibration_curve(scored(t)).select("bin", F.round("mean_predicted", 9).alias("mean_predicted"), F.round("fraction_positive", 9).alias("fraction_positive"), "n")


_FIT = f"""c as (select show_probability p, count(*) n, sum(showed_up) h, row_number() over (order by show_probability) i from ({_SCORED}) x group by 1),
    k as (select i, sum(n) over (order by i) n, sum(h) over (order by i) h from c), k0 as (select 0 i, 0 n, 0 h union all select * from k),
    m as (select a.i + 1 j, b.i k, (b.h - a.h) / (b.n - a.n) mean from k0 a join k0 b on b.i > a.i),
    low as (select j, c.i, min(mean) mean from m join c on c.i between j and k group by 1, 2),
    fit as (select i, max(mean) v from low group by 1)"""


@query("isotonic_steps", f"with {_FIT} select min(p) low, max(p) high, cast(sum(n) as bigint) n, round(max(v), 9) \"value\" from fit join c using (i) group by round(v, 12)")
def isotonic_steps(t: Tables):
    return ml.isotonic_steps(scored(t)).withColumn("value", F.round("value", 9))


@query("calibrated", f"with {_FIT} select o_orderkey, show_probability, round(v, 9) calibrated from ({_SCORED}) x join c on p = show_probability join fit using (i)")
def calibrated(t: Tables):
    return ml.calibrated(scored(t), ml.isotonic_steps(scored(t))).select("o_orderkey", "show_probability", F.round("calibrated", 9).alias("calibrated"))


_ONE = f"select permit, max(show_probability) show_probability from ({_SCORED}) x where o_orderkey % 3 = 0 group by 1"
_ACTIVE = "select cast(c_custkey as varchar(20)) permit from {customer}"


@query("with_dormant", f"""with s as ({_ONE}), a as (select distinct permit from ({_ACTIVE}) x) select a.permit, coalesce(show_probability, 0.02) show_probability,
    case when coalesce(show_probability, 0.02) >= 0.5 then 1 else 0 end predicted from a left join s on s.permit = a.permit""")
def with_dormant(t: Tables):
    return ml.with_dormant(t.sql(_ONE), t.sql(_ACTIVE))


@query("expected_total", f"""with s as ({_ONE}), a as (select distinct permit from ({_ACTIVE}) x), r as (select coalesce(show_probability, 0.02) p from a left join s on s.permit = a.permit)
    select round(sum(p), 6) expected, count(*) filter (p >= 0.5) predicted from r""")
def expected_total(t: Tables):
    return ml.expected_total(ml.with_dormant(t.sql(_ONE), t.sql(_ACTIVE))).withColumn("expected", F.round("expected", 6))
