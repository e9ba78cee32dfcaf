"""Queries: E1-E23, E26 over text and codes derived from the line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import payments as pay
from kerbline.functions import policies as pol
from kerbline.functions import stays as st
from kerbline.functions import timeparts as tp

c = F.col
KEY = "id"

_CARDS = """cards as (select id, case l_linenumber % 8 when 0 then 'VISA' when 1 then 'MC' when 2 then 'DISC' when 3 then 'AMEX' when 4 then 'x Remote y'
    when 5 then 'PBC' when 6 then 'JCB' end card_type,
    case l_partkey % 4 when 0 then 'Coins' when 1 then 'Credit Card' when 2 then 'Remote/PBC' else 'Coin & Card' end txn_type from {staging})"""


def cards(t: Tables):
    return t.sql(f"with {_CARDS} select * from cards")


_BRAND = "case card_type when 'VISA' then 'Visa' when 'MC' then 'Mastercard' when 'DISC' then 'Discover' when 'AMEX' then 'American Express'"


@query("card_brand_ips", f"""with {_CARDS} select id,
    case when card_type in ('VISA', 'MC', 'DISC', 'AMEX') then {_BRAND} end when card_type is null and txn_type = 'Coins' then 'Cash'
         when card_type is null and txn_type = 'Credit Card' then 'unknown' when card_type like '%Remote%' or card_type like '%PBC%' then 'Remote/PBC' else card_type end brand,
    case when card_type = 'AMEX' then 'AMEX' else {_BRAND} else card_type end end settled_brand from cards""")
def card_brand_ips(t: Tables):
    return cards(t).select(
        KEY, pay.card_brand_ips(c("card_type"), c("txn_type")).alias("brand"),
        pay.card_brand_ips(c("card_type"), c("txn_type"), "settlement").alias("settled_brand"),
    )


@query("windcave_device_key", """select id, case when l_linenumber % 2 = 0 then terminal else left('77' || terminal, 3) end device_key from {staging}""")
def windcave_device_key(t: Tables):
    device = F.when(c("l_linenumber") % 2 == 0, c("terminal")).otherwise(c("l_partkey").cast("string"))
    return t.staging.select(KEY, pay.windcave_device_key(device, F.concat(F.lit("77"), "terminal")).alias("device_key"))


@query("settle_amount", f"""with {_CARDS} select s.id, cast(case when txn_type like 'Remote%' then amount + cast(0.45 as decimal(10,2)) else amount end as double) meter,
    cast(amount + cast(0.45 as decimal(10,2)) as double) mobile from {{staging}} s join cards using (id)""")
def settle_amount(t: Tables):
    rows = t.staging.join(cards(t), KEY)
    fee = F.lit(0.45).cast("decimal(10,2)")
    return rows.select(KEY, pay.settle_amount_ips(c("txn_type"), c("amount"), fee).alias("meter"), pay.settle_amount_mobile(c("amount"), fee).alias("mobile"))


_TIMES = """times as (select id, o_orderdate, l_linenumber % 7 k, cast(l_partkey % 12 + 1 as int) h12, cast(l_partkey % 24 as int) h, cast(l_suppkey % 60 as int) mi,
    cast(quantity % 60 as int) se, case when l_partkey % 2 = 0 then 'AM' else 'PM' end ap from {staging})"""
_TEXT = """case k when 0 then concat(cast(h12 as varchar(2)), ':', lpad(cast(mi as varchar(2)), 2, '0'), ':', lpad(cast(se as varchar(2)), 2, '0'), ' ', ap)
    when 1 then concat(cast(h12 as varchar(2)), ':', lpad(cast(mi as varchar(2)), 2, '0'), ' ', ap)
    when 2 then concat(lpad(cast(h as varchar(2)), 2, '0'), ':', lpad(cast(mi as varchar(2)), 2, '0'), ':', lpad(cast(se as varchar(2)), 2, '0'))
    when 3 then concat(lpad(cast(h as varchar(2)), 2, '0'), ':', lpad(cast(mi as varchar(2)), 2, '0'))
    when 4 then concat(lpad(cast(h as varchar(2)), 2, '0'), lpad(cast(mi as varchar(2)), 2, '0'), lpad(cast(se as varchar(2)), 2, '0'))
    when 5 then concat(lpad(cast(h as varchar(2)), 2, '0'), lpad(cast(mi as varchar(2)), 2, '0')) else 'noon' end"""


@query("combine_date_time", f"""with {_TIMES} select id,
    case when k < 2 then o_orderdate + (h12 % 12 + case when ap = 'PM' then 12 else 0 end) * interval '1' hour + mi * interval '1' minute + (case when k = 0 then se else 0 end) * interval '1' second
         when k < 6 then o_orderdate + h * interval '1' hour + mi * interval '1' minute + (case when k in (2, 4) then se else 0 end) * interval '1' second end stamp from times""")
def combine_date_time(t: Tables):
    rows = t.sql(f"with {_TIMES} select id, o_orderdate, {_TEXT} time_text from times")
    return rows.select(KEY, tp.combine_date_time(c("o_orderdate"), c("time_text")).alias("stamp"))


@query("reference_number", """select id, coalesce(case when l_linenumber % 2 = 0 then terminal end, coalesce(terminal, '') || '_' || l_partkey || '_' || source_file_id) || '_COIN' meter,
    '4111' || l_partkey || l_suppkey sale from {staging}""")
def reference_number(t: Tables):
    txid = F.when(c("l_linenumber") % 2 == 0, c("terminal"))
    return t.staging.select(
        KEY, pay.reference_ips(txid, c("terminal"), c("l_partkey"), c("source_file_id"), F.lit("_COIN")).alias("meter"),
        pay.reference_card_sale(F.concat(F.lit("41**11****"), "l_partkey"), c("l_suppkey")).alias("sale"),
    )


@query("program_of", """select device_id, case when device_type = 'Portable CC Reader' then 2 else 1 end program_id,
    case when device_type = 'Portable CC Reader' then 'special event' else 'regular' end "label" from {device}""")
def program_of(t: Tables):
    return t.device.select("device_id", pay.program_of(c("device_type")).alias("program_id")).withColumn("label", pay.program_label(c("program_id")))


@query("station_area", """select event_id, case left(station, 1) when 'A' then 'Exit' when 'E' then 'Entry' when 'H' then 'Cashier' when 'K' then 'POF' else 'Unknown' end area
    from (select event_id, case user_id % 5 when 0 then 'H' || user_id when 1 then 'K' || user_id when 2 then 'Z9' else station end station from {gate}) x""")
def station_area(t: Tables):
    address = (F.when(c("user_id") % 5 == 0, F.concat(F.lit("H"), "user_id")).when(c("user_id") % 5 == 1, F.concat(F.lit("K"), "user_id"))
               .when(c("user_id") % 5 == 2, "Z9").otherwise(c("station")))
    return t.gate.select("event_id", st.station_area(address).alias("area"))


BY_DIGIT = {"1": "North", "2": "South", "4": "Lake"}


@query("facility_from_code", """select id, case when d = 'E24' then 'Moved' when substr(d, 2, 1) = '1' and length(d) = 3 then 'North' when substr(d, 2, 1) = '2' and length(d) = 3 then 'South'
      when substr(d, 2, 1) = '4' and length(d) = 3 then 'Lake' end by_device,
      case cc when 82001 then 'North' when 82002 then 'Special' when 82003 then 'Lake' end by_code, '00' || l_suppkey terminal_key
    from (select id, l_suppkey, 'E' || (l_partkey % 200) d, 82000 + l_suppkey % 6 cc from {staging}) x""")
def facility_from_code(t: Tables):
    d = F.concat(F.lit("E"), c("l_partkey") % 200)
    code = (82000 + c("l_suppkey") % 6).cast("int")
    return t.staging.select(
        KEY, pay.facility_from_device(d, BY_DIGIT, {"E24": "Moved"}).alias("by_device"),
        pay.facility_from_charge_code(code, {82001: "North", 82002: "South", 82003: "Lake"}, {82002: "Special"}).alias("by_code"),
        pay.terminal_key("00", c("l_suppkey")).alias("terminal_key"),
    )


_TT = "case {0} when -1 then 'lost ticket' when -11 then 'manual ticket' when 0 then 'KP' when 1 then 'value card' when 2 then 'normal DP' when 3 then 'congress' when 4 then 'visitor' when 5 then 'fixed time per day' when 7 then 'fixed number of entries' when 8 then 'pool car' end"


@query("ticket_type_desc", f"""select id, {_TT.format('a')} entry_desc,
      case when coalesce(b, a) is not null then coalesce({_TT.format('coalesce(b, a)')}, 'unknown') end exit_desc
    from (select id, cast(l_partkey % 22 - 11 as int) a, case when l_linenumber % 2 = 0 then cast(l_suppkey % 12 as int) end b from {{staging}}) x""")
def ticket_type_desc(t: Tables):
    a, b = (c("l_partkey") % 22 - 11).cast("int"), F.when(c("l_linenumber") % 2 == 0, (c("l_suppkey") % 12).cast("int"))
    return t.staging.select(KEY, st.entry_ticket_type_desc(a).alias("entry_desc"), st.exit_ticket_type_desc(b, a).alias("exit_desc"))


@query("customer_type", """select presence_id, case when state = 5 then 'transient' when customer_id = 9 then 'employee' else 'permit' end kind from {presence}""")
def customer_type(t: Tables):
    return t.presence.select("presence_id", st.customer_type(F.when(c("state") != 5, c("media")), c("customer_id"), 9).alias("kind"))


@query("trip_id", """select visit_id, upper(md5(garage_id || '_' || permit || '_' || coalesce(strftime(case when visit_id % 7 <> 0 then entry_ts end, '%Y-%m-%d %H:%M:%S.%g'), 'NULL'))) trip_id from {visits}""")
def trip_id(t: Tables):
    return t.visits.select("visit_id", st.trip_id(c("garage_id"), c("permit"), F.when(c("visit_id") % 7 != 0, c("entry_ts"))).alias("trip_id"))


@query("calendar_columns", """select visit_id, year(entry_ts) as "year", quarter(entry_ts) as "quarter", month(entry_ts) as "month", week(entry_ts) as "week", day(entry_ts) as "day",
    dayofyear(entry_ts) as dayofyear, isodow(entry_ts) - 1 as dayofweek, hour(entry_ts) as "hour", strftime(entry_ts, '%H:%M:%S') hms,
    case when isodow(entry_ts) < 6 then 1 else 0 end weekday_type, case when isodow(entry_ts) > 5 then 'Weekend' when hour(entry_ts) between 6 and 18 then 'Daytime' else 'Evening' end period from {visits}""")
def calendar_columns(t: Tables):
    return tp.calendar_columns(t.visits.select("visit_id", "entry_ts"), "entry_ts").drop("entry_ts")


@query("period_key_label", """select visit_id, strftime(date_trunc('day', entry_ts) - to_days(cast(dayofweek(entry_ts) as int)), '%Y-%m-%d') week_key,
    year(entry_ts) || '-Q' || quarter(entry_ts) quarter_key, strftime(entry_ts, '%b %Y') month_label, 'Q' || quarter(entry_ts) || ' ' || year(entry_ts) quarter_label from {visits}""")
def period_key_label(t: Tables):
    e = c("entry_ts")
    return t.visits.select(
        "visit_id", tp.period_key(e, "week").alias("week_key"), tp.period_key(e, "quarter").alias("quarter_key"),
        tp.period_label(e, "month").alias("month_label"), tp.period_label(e, "quarter").alias("quarter_label"),
    )


@query("datediff", """select visit_id, date_diff('minute', entry_ts, exit_ts) "minutes", date_diff('second', entry_ts, exit_ts) "seconds", date_diff('day', entry_ts, exit_ts) "days" from {visits}""")
def datediff(t: Tables):
    a, b = c("entry_ts"), c("exit_ts")
    return t.visits.select(
        "visit_id", tp.datediff_minute(a, b).alias("minutes"), tp.datediff_second(a, b).alias("seconds"), tp.datediff_day(a, b).alias("days"))


@query("is_holiday", """select strftime(d, '%Y-%m-%d') "day", case when (month(d), day(d)) in ((1, 1), (6, 19), (11, 11), (12, 24), (12, 25), (12, 31))
      or (month(d) = 11 and isodow(d) = 4 and day(d) between 22 and 28) or (month(d) = 11 and isodow(d) = 5 and day(d) between 23 and 29)
      or (month(d) = 1 and isodow(d) = 1 and day(d) between 15 and 21) or (month(d) = 5 and isodow(d) = 1 and day(d) >= 25) or (month(d) = 9 and isodow(d) = 1 and day(d) <= 7)
      then 1 else 0 end holiday from (select distinct cast(l_shipdate as date) d from {lineitem}) x""")
def is_holiday(t: Tables):
    return t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct().withColumn("holiday", tp.is_holiday(c("day")).cast("int"))


_POLICIES = """policies as (select p_partkey, case p_partkey % 10 when 0 then 'North 24/7' when 1 then 'SLS M-F 6-18 Pay' when 2 then 'M-Su 17-8' when 3 then 'M-F 18-6 & Sa-Su 0-23'
    when 4 then 'anything' when 5 then 'Sa-Su 9-12 employee' when 6 then 'M-F 4-22 & odd' when 7 then 'Employee 24/7 pass' when 8 then 'M-F  7-19' when 9 then 'M-Su 0-24' end policy from {part})"""


@query("parse_access_policy", f"""with {_POLICIES} select p_partkey, policy,
    case p_partkey % 10 when 1 then 31 when 3 then 127 when 5 then 96 when 8 then 31 else 127 end day_mask,
    case p_partkey % 10 when 1 then 360 when 2 then 1020 when 3 then 1080 when 5 then 540 when 8 then 420 else 0 end window_start,
    case p_partkey % 10 when 1 then 1080 when 2 then 480 when 3 then 360 when 5 then 720 when 8 then 1140 else 1440 end window_end,
    p_partkey % 10 in (2, 3) is_overnight from policies""")
def parse_access_policy(t: Tables):
    # Each distinct text is parsed once.
    rows = t.sql(f"with {_POLICIES} select * from policies")
    parsed = rows.select("policy").distinct().select("policy", pol.parse_access_policy(c("policy")).alias("p"))
    return rows.join(parsed, "policy").select("p_partkey", "policy", "p.*")


@query("in_access_window", f"""with {_POLICIES}, w as (select p_partkey, p_size * 29 % 1440 m, p_partkey % 10 k from {{part}})
    select p_partkey, case k when 1 then m >= 360 and m < 1080 when 2 then m >= 1020 or m < 480 when 3 then m >= 1080 or m < 360 when 5 then m >= 540 and m < 720
           when 8 then m >= 420 and m < 1140 else true end inside from w""")
def in_access_window(t: Tables):
    rows = t.sql(f"with {_POLICIES} select policies.*, p_size * 29 % 1440 m from policies join {{part}} using (p_partkey)")
    p = rows.withColumn("p", pol.parse_access_policy(c("policy")))
    return p.select("p_partkey", pol.in_access_window(c("m"), c("p.window_start"), c("p.window_end"), c("p.is_overnight")).alias("inside"))


@query("shift_hours", """select shift_id, case when start_hour - 24 * floor(start_hour / 24) < 12 then 'AM' else 'PM' end period,
    case when end_hour - start_hour > 6.75 then end_hour - start_hour - 0.5 else end_hour - start_hour end paid from {shifts}""")
def shift_hours(t: Tables):
    return t.shifts.select("shift_id", pol.shift_period(c("start_hour")).alias("period"), pol.paid_hours(c("start_hour"), c("end_hour")).alias("paid"))


@query("rename_groups", """select log_id, case ltrim(split_part(group_detail, ':', 2)) when 'group 1' then 'Daily' when 'group 2' then 'Monthly'
    else ltrim(split_part(group_detail, ':', 2)) end group_name from {access_log}""")
def rename_groups(t: Tables):
    from kerbline.operators.permits import rename_groups as rename

    names = t.region.select(
        F.concat(F.lit("group "), "r_regionkey").alias("old_name"),
        F.when(c("r_regionkey") == 1, "Daily").when(c("r_regionkey") == 2, "Monthly").alias("new_name"),
    ).filter("new_name is not null")
    return rename(t.access_log.select("log_id", c("group_detail").alias("group_name")), names)


@query("full_name", """select c_custkey, nullif(trim(coalesce(a, '') || ' ' || coalesce(b, '')), '') "name" from (select c_custkey, case when c_custkey % 3 <> 0 then c_name end a,
    case when c_custkey % 2 <> 0 then c_mktsegment end b from {customer}) x""")
def full_name(t: Tables):
    a, b = F.when(c("c_custkey") % 3 != 0, c("c_name")), F.when(c("c_custkey") % 2 != 0, c("c_mktsegment"))
    return t.customer.select("c_custkey", pol.full_name(a, b).alias("name"))


@query("card_status", """select c_custkey, case c_custkey % 6 when 0 then 'active' when 1 then 'inactive' when 2 then 'lost' when 3 then 'defective' else 'unknown' end status from {customer}""")
def card_status(t: Tables):
    return t.customer.select("c_custkey", pol.card_status((c("c_custkey") % 6).cast("int")).alias("status"))


@query("remap_garage", """select visit_id, case when garage_id = 3 then 2 else garage_id end garage_id from {visits}""")
def remap_garage(t: Tables):
    return t.visits.select("visit_id", pay.remap_garage(c("garage_id"), {3: 2}).alias("garage_id"))
