"""Queries: A1-A15 and the list operators, over the derived fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import filters as fl
from kerbline.plans import reports as rp

START, END = "1995-01-01", "2001-12-31"


def dims(t: Tables) -> dict:
    return {
        "charge_code": t.charge, "location": t.location, "facility": t.facility,
        "settlement": t.settlement, "method": t.method, "device": t.device,
    }


_JOINED = """
    joined as (
      select f.*, cast(cc.charge_code as varchar) charge_code, fa.facility_name, fa.facility_type, ss.system_name,
             pm.payment_method_type, d.device_terminal_id, d.device_type,
             case when f.program_id = 1 then 'regular' else 'special event' end program_type
      from {fact} f join {charge} cc using (charge_code_id)
      join {location} l on l.location_id = f.location_id join {facility} fa on fa.facility_id = l.facility_id
      join {settlement} ss on ss.settlement_system_id = f.settlement_system_id
      join {method} pm on pm.payment_method_id = f.payment_method_id join {device} d on d.device_id = f.device_id
      where f.settle_date >= timestamp '1995-01-01' and f.settle_date < timestamp '2002-01-01')
"""
_TOTALS = """
    count(*) transaction_count, cast(sum(transaction_amount) as double) total_transaction_amount,
    cast(sum(settle_amount) as double) total_settle_amount,
    min(transaction_date) earliest_transaction_date, max(transaction_date) latest_transaction_date
"""


@query("settle_rollup_4", f"""with {_JOINED}
    select case when grouping(charge_code) = 1 then '*** GRAND TOTAL ***' else charge_code end charge_code,
           case when grouping(facility_name) = 1 then '** Subtotal **' else facility_name end facility_name,
           case when grouping(program_type) = 1 then '* Subtotal *' else program_type end program_type,
           case when grouping(device_terminal_id) = 1 then 'Subtotal' else device_terminal_id end device_terminal_id,
           {_TOTALS}, grouping(charge_code) is_charge_code_total, grouping(facility_name) is_facility_total,
           grouping(program_type) is_program_type_total, grouping(device_terminal_id) is_device_total,
           grouping(charge_code, facility_name, program_type, device_terminal_id) grouping_level
    from joined group by rollup(charge_code, facility_name, program_type, device_terminal_id)""")
def settle_rollup_4(t: Tables):
    return rp.settle_rollup_4(t.fact, dims(t), START, END)


_ROLLUP_5 = f"""with {_JOINED}
    select case when grouping(charge_code) = 1 then '*** GRAND TOTAL ***' else charge_code end charge_code,
           case when grouping(facility_name) = 1 then '** Subtotal **' else facility_name end facility_name,
           case when grouping(payment_method_type) = 1 then '* Subtotal *' else payment_method_type end payment_method_type,
           case when grouping(device_type) = 1 then 'Subtotal' else device_type end device_type,
           case when grouping(device_terminal_id) = 1 then 'Subtotal' else device_terminal_id end device_terminal_id,
           {_TOTALS}, grouping(charge_code) is_charge_code_total, grouping(facility_name) is_facility_total,
           grouping(payment_method_type) is_payment_method_type_total, grouping(device_type) is_device_type_total,
           grouping(device_terminal_id) is_device_total,
           grouping(charge_code, facility_name, payment_method_type, device_type, device_terminal_id) grouping_level
    from joined group by rollup(charge_code, facility_name, payment_method_type, device_type, device_terminal_id)"""


@query("settle_rollup_5", _ROLLUP_5)
def settle_rollup_5(t: Tables):
    return rp.settle_rollup_5(t.fact, dims(t), START, END)


ROLLUP_LEVELS = [
    ("charge_code", "is_charge_code_total"), ("facility_name", "is_facility_total"),
    ("payment_method_type", "is_payment_method_type_total"), ("device_type", "is_device_type_total"),
    ("device_terminal_id", "is_device_total"),
]


@query("rollup_order", _ROLLUP_5 + """ order by is_charge_code_total desc, charge_code nulls first, is_facility_total desc,
    facility_name nulls first, is_payment_method_type_total desc, payment_method_type nulls first, is_device_type_total desc,
    device_type nulls first, is_device_total desc, device_terminal_id nulls first""")
def rollup_order(t: Tables):
    return rp.rollup_order(rp.settle_rollup_5(t.fact, dims(t), START, END), ROLLUP_LEVELS)


@query("settle_totals", """select count(*) total_transactions, cast(sum(coalesce(settle_amount, transaction_amount)) as double) total_settled
    from {fact} where settle_date >= timestamp '1995-01-01' and settle_date < timestamp '2002-01-01'""")
def settle_totals(t: Tables):
    return rp.settle_totals(t.fact, START, END)


SOURCES = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")


@query("source_pivot", """
    select strftime(day, '%Y-%m-%d') "day", """ + ", ".join(f"count(*) filter (staging_table = '{s}') \"{s}\"" for s in SOURCES) + """
    from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval '1' day)) as day) c
    left join {fact} f on date_trunc('day', f.settle_date) = c.day group by day""")
def source_pivot(t: Tables):
    return rp.source_pivot(t.fact, START, END, SOURCES)


_PERIOD_SQL = {
    "day": ("strftime(settle_date, '%Y-%m-%d')", "strftime(settle_date, '%Y-%m-%d')"),
    "week": ("strftime(date_trunc('day', settle_date) - to_days(cast(dayofweek(settle_date) as int)), '%Y-%m-%d')",
             "'Week of ' || strftime(date_trunc('day', settle_date) - to_days(cast(dayofweek(settle_date) as int)), '%Y-%m-%d')"),
    "month": ("strftime(settle_date, '%Y-%m')", "strftime(settle_date, '%b %Y')"),
    "quarter": ("year(settle_date) || '-Q' || quarter(settle_date)", "'Q' || quarter(settle_date) || ' ' || year(settle_date)"),
    "year": ("cast(year(settle_date) as varchar)", "cast(year(settle_date) as varchar)"),
}


def _revenue(period: str, where: str = "") -> str:
    key, label = _PERIOD_SQL[period]
    return f"""with {_JOINED} select {key} period_key, {label} period_label, count(*) transaction_count,
        cast(sum(settle_amount) as double) amount from joined {where} group by 1, 2"""


for _p in _PERIOD_SQL:
    query(f"revenue_by_{_p}", _revenue(_p))(
        lambda t, p=_p: rp.revenue_by_period(t.fact, dims(t), START, END, p)
    )


@query("revenue_filtered", _revenue("month", "where device_type = 'Cashier' and facility_type = 'garage' and payment_method_type = 'card'"))
def revenue_filtered(t: Tables):
    wanted = {"device_type": "Cashier", "facility_type": "garage", "payment_method_type": "card", "charge_code": None}
    return rp.revenue_by_period(t.fact, dims(t), START, END, "month", wanted)


@query("revenue_summary", f"""with {_JOINED}, p as (select strftime(settle_date, '%Y-%m') k, count(*) n, sum(settle_amount) a from joined group by 1)
    select cast(sum(a) as double) total_revenue, cast(sum(n) as bigint) transaction_count,
           cast(sum(a) as double) / cast(sum(n) as double) avg_per_transaction, count(*) period_count from p""")
def revenue_summary(t: Tables):
    return rp.revenue_summary(rp.revenue_by_period(t.fact, dims(t), START, END, "month"))


@query("filter_options", """
    select distinct 'system_name' "filter", system_name "value" from {settlement}
    union all select distinct 'payment_method_type', payment_method_type from {method}
    union all select distinct 'charge_code', cast(charge_code as varchar) from {charge}
    union all select distinct 'device_type', device_type from {device} where device_type is not null
    union all select distinct 'facility_type', facility_type from {facility}
    union all select distinct 'facility_name', facility_name from {facility}""")
def filter_options(t: Tables):
    return rp.filter_options(dims(t))


AS_OF = "1999-06-15"


@query("facility_wow", f"""
    with j as (select fa.facility_name, fa.facility_type, f.settle_amount s, cast(f.settle_date as date) d
               from {{fact}} f join {{location}} l on l.location_id = f.location_id join {{facility}} fa on fa.facility_id = l.facility_id),
    r as (select facility_name, facility_type, count(*) n, sum(s) s from j where d >= date '{AS_OF}' - 7 and d < date '{AS_OF}' group by 1, 2),
    p as (select facility_name, facility_type, sum(s) s from j where d >= date '{AS_OF}' - 14 and d < date '{AS_OF}' - 7 group by 1, 2)
    select r.facility_name, r.facility_type, n transaction_count, cast(r.s as double) total_settled,
           cast(r.s - p.s as double) raw_change,
           case when p.s <> 0 then cast(round(cast(cast(r.s - p.s as decimal(20,4)) * 100 as double) / cast(abs(p.s) as double), 1) as double) end percent_change
    from r left join p on p.facility_name = r.facility_name and p.facility_type = r.facility_type""")
def facility_wow(t: Tables):
    return rp.facility_wow(t.fact, dims(t), AS_OF)


@query("recent_summary", f"""select count(*) total_transactions, cast(sum(settle_amount) as double) total_settled, max(settle_date) last_settle_date
    from {{fact}} where cast(settle_date as date) >= date '{AS_OF}' - 30 and cast(settle_date as date) < date '{AS_OF}'""")
def recent_summary(t: Tables):
    return rp.recent_summary(t.fact, AS_OF)


def uploads(t: Tables):
    """Orders as uploaded files."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("file-"), F.col("o_orderkey")).alias("original_filename"),
        F.col("o_orderdate").alias("upload_date"), F.col("o_custkey").alias("uploaded_by"),
    )


@query("recent_uploads", """
    select o_orderkey id, 'file-' || o_orderkey original_filename, o_orderdate upload_date, o_custkey uploaded_by,
           trim(c_name || ' ' || c_mktsegment) uploaded_by_name
    from (select * from {orders} order by o_orderdate desc, o_orderkey desc limit 10) o left join {customer} on c_custkey = o_custkey""")
def recent_uploads(t: Tables):
    people = t.customer.select(F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"))
    return rp.recent_uploads(uploads(t), people)


def transactions(t: Tables):
    """Line items as a flat transaction table."""
    return t.staging.select(
        "id", F.col("o_orderdate").alias("transaction_date"), F.col("amount").alias("transaction_amount"), "settle_amount",
        F.col("o_custkey").alias("mid"), F.col("brand").alias("payment_type"), F.col("staging_table").alias("source"),
        F.when(F.col("l_suppkey") % 2 == 0, "garage").otherwise("meter").alias("location_type"), "terminal",
    )


_TX = """tx as (select id, o_orderdate transaction_date, amount transaction_amount, settle_amount, o_custkey mid, brand payment_type,
    staging_table source, case when l_suppkey % 2 = 0 then 'garage' else 'meter' end location_type, terminal from {staging})"""


@query("transaction_stats", f"""with {_TX} select count(*) total_records, count(distinct mid) unique_merchants, min(transaction_date) earliest_transaction,
    max(transaction_date) latest_transaction, cast(sum(settle_amount) as double) total_settled_amount,
    cast(sum(settle_amount) as double) / count(settle_amount) avg_settled_amount from tx""")
def transaction_stats(t: Tables):
    return rp.transaction_stats(transactions(t))


@query("sketched_stats", f"""with {_TX}, y as (select year(transaction_date) "year", count(*) total_records, min(transaction_date) earliest_transaction, max(transaction_date) latest_transaction,
      cast(sum(settle_amount) as double) total_settled_amount, count(distinct mid) unique_merchants, count(distinct transaction_date::date) n_days from tx group by 1)
    select *, true near from y""")
def sketched_stats(t: Tables):
    """Years from stored days: all numbers, and whether the merged sketches come within 2 % of the distinct merchants."""
    tx = transactions(t)
    year = F.year("day").alias("year")
    days = rp.daily_sketches(tx)
    got = rp.stats_from_sketches(days.withColumn("year", year), by=("year",)).withColumnRenamed("unique_merchants", "_estimate").drop("avg_settled_amount")
    exact = tx.groupBy(F.year("transaction_date").alias("year")).agg(F.countDistinct("mid").alias("unique_merchants"))
    stored = days.groupBy(year).agg(F.count(F.lit(1)).alias("n_days"))
    near = F.abs(F.col("_estimate") - F.col("unique_merchants")) <= F.greatest(0.02 * F.col("unique_merchants"), F.lit(1))
    return got.join(exact, "year").join(stored, "year").withColumn("near", near).drop("_estimate")


_SUMS = """count(*) total_count, cast(sum(transaction_amount) as double) total_amount, cast(sum(settle_amount) as double) total_settle_amount,
    min(transaction_date) "start", max(transaction_date) "end" """


@query("transaction_summary", f"""with {_TX}
    select 'total' breakdown, null "value", {_SUMS} from tx
    union all select 'payment_type', payment_type, {_SUMS} from tx group by payment_type
    union all select 'location_type', location_type, {_SUMS} from tx group by location_type
    union all select 'source', source, {_SUMS} from tx group by source""")
def transaction_summary(t: Tables):
    return rp.transaction_summary(transactions(t))


@query("daily_summary", f"""with {_TX} select strftime(transaction_date, '%Y-%m-%d') "day", source, location_type, payment_type, count(*) transaction_count,
    cast(sum(transaction_amount) as double) total_amount, cast(sum(settle_amount) as double) total_settle_amount,
    cast(sum(transaction_amount) as double) / count(transaction_amount) avg_transaction_amount from tx group by 1, 2, 3, 4""")
def daily_summary(t: Tables):
    return rp.daily_summary(transactions(t))


@query("search_transactions", f"""with {_TX} select * replace (cast(transaction_amount as double) as transaction_amount, cast(settle_amount as double) as settle_amount)
    from tx where transaction_date >= timestamp '1997-01-01' and transaction_date <= timestamp '1998-12-31'
    and source = 'A_F' and payment_type = 'Visa' and transaction_amount >= 1000 and transaction_amount <= 90000""")
def search_transactions(t: Tables):
    return fl.search_transactions(
        transactions(t), start="1997-01-01", end="1998-12-31", equals={"source": "A_F", "payment_type": "Visa", "location_type": None},
        min_amount=1000, max_amount=90000,
    )


@query("search_page", f"""with {_TX} select id, transaction_date, cast(transaction_amount as double) transaction_amount from tx
    where location_type = 'garage' order by transaction_date desc, id limit 50 offset 100""")
def search_page(t: Tables):
    found = fl.search_transactions(
        transactions(t), equals={"location_type": "garage"}, order_by=(F.col("transaction_date").desc(), F.col("id")), limit=50, offset=100
    )
    return found.select("id", "transaction_date", "transaction_amount")


@query("contains_search", """select c_custkey, c_name, c_mktsegment from {customer}
    where lower(c_name) like '%77%' or lower(c_mktsegment) like '%77%' or lower(trim(c_name || ' ' || c_mktsegment)) like '%77%'
    or false""")
def contains_search(t: Tables):
    return fl.contains_search(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "77", ("c_name", "c_mktsegment"))


@query("contains_search_name", """select c_custkey, c_name, c_mktsegment from {customer} where lower(c_name || ' ' || c_mktsegment) like '%9 mach%'""")
def contains_search_name(t: Tables):
    return fl.contains_search(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "9 MACH", ("c_name", "c_mktsegment"))


@query("list_filters", """select wo_id, status, initiate_ts, finish_ts from {work_orders} where status <> 'OPEN' and status = 'CLOSED'
    and (finish_ts is null or (finish_ts >= timestamp '1997-03-01' and finish_ts < timestamp '1999-04-01'))""")
def list_filters(t: Tables):
    return fl.list_filters(
        t.work_orders, equals={"status": "CLOSED", "description": None}, date_ranges={"finish_ts": ("1997-03-01", "1999-03-31")},
    ).select("wo_id", "status", "initiate_ts", "finish_ts")


@query("list_filters_open", """select wo_id, status from {work_orders} where finish_ts is null and parent_id is not null""")
def list_filters_open(t: Tables):
    return fl.list_filters(t.work_orders, present=("parent_id",), absent=("finish_ts",)).select("wo_id", "status")


_FILES = """
    files as (select o_orderkey id, case when o_orderkey % 11 <> 0 then (o_orderkey % 4) * 2 end records_processed, o_orderkey % 3 <> 0 is_processed,
                     o_orderdate upload_date from {orders}),
    log as (select case when l_returnflag = 'R' then l_orderkey else -l_orderkey end source_file_id, case l_linenumber % 4 when 0 then 'complete' when 1 then 'failed' when 2 then 'running' else 'completed' end status,
                   l_linenumber + 1 records_processed, l_linenumber records_created, 1 records_failed,
                   case when l_linenumber % 4 = 1 then 'bad row ' || cast(l_suppkey as varchar(20)) end error_message
            from {lineitem})"""


def file_tables(t: Tables):
    files = t.sql("""select o_orderkey id, case when o_orderkey % 11 <> 0 then (o_orderkey % 4) * 2 end records_processed, o_orderkey % 3 <> 0 is_processed,
        o_orderdate upload_date from {orders}""")
    log = t.sql("""select case when l_returnflag = 'R' then l_orderkey else -l_orderkey end source_file_id, case l_linenumber % 4 when 0 then 'complete' when 1 then 'failed' when 2 then 'running' else 'completed' end status,
        l_linenumber + 1 records_processed, l_linenumber records_created, 1 records_failed,
        case when l_linenumber % 4 = 1 then 'bad row ' || cast(l_suppkey as varchar(20)) end error_message
        from {lineitem}""")
    return files, log


_FILE_STATUS = f"""with {_FILES}
    select f.id, f.records_processed, f.is_processed, f.upload_date,
      case when f.is_processed and f.records_processed = 0 then 'complete' when f.records_processed is null then 'not_started'
           when max(case when l.status in ('complete','completed') then 1 else 0 end) = 1 then 'complete'
           when max(case when l.status = 'running' then 1 else 0 end) = 1 then 'in_progress'
           when max(case when l.status = 'failed' then 1 else 0 end) = 1 then 'failed' else 'not_complete' end status,
      cast(sum(l.records_created) as bigint) records_created, cast(sum(l.records_failed) as bigint) records_failed,
      case when sum(l.records_created) = sum(l.records_processed) then '' else max(l.error_message) end error_message,
      case when f.records_processed > 0 and sum(l.records_created) > 0
           then cast(sum(l.records_created) as double) / cast(f.records_processed as double) * 100.0 end percent_complete,
      case when max(case when l.status in ('complete','completed') then 1 else 0 end) = 0 then 1 else 0 end needs_etl,
      case when f.records_processed > 0 and max(case when l.status = 'running' then 1 else 0 end) = 0 then 1 else 0 end can_process
    from files f left join log l on l.source_file_id = f.id group by f.id, f.records_processed, f.is_processed, f.upload_date"""


@query("file_status", _FILE_STATUS)
def file_status(t: Tables):
    return rp.file_status(*file_tables(t))


@query("file_status_complete", _FILE_STATUS + " having max(case when l.status in ('complete','completed') then 1 else 0 end) = 1")
def file_status_complete(t: Tables):
    return rp.file_status(*file_tables(t), status="complete")


@query("file_status_not_complete", _FILE_STATUS.replace("group by f.id", "where f.records_processed is not null group by f.id")
       + " having coalesce(sum(l.records_created), 0) < max(f.records_processed)")
def file_status_not_complete(t: Tables):
    return rp.file_status(*file_tables(t), status="not_complete")


@query("citation_summary", """
    with one as (select * from (select *, row_number() over (partition by ticketid order by issue_ts, status) rn from {citations}) x where rn = 1)
    select strftime(issue_ts, '%Y-%m-%d') report_date, count(*) filter (status <> 'Void Approved') citations,
           cast(sum(case when status <> 'Void Approved' then amount else 0 end) as double) total_amount,
           count(*) filter (status = 'Warning') warnings,
           count(*) filter (violation = 'TOW FEE' and status <> 'Void Approved') tows,
           count(*) filter (status = 'Void Approved') voids
    from one group by 1""")
def citation_summary(t: Tables):
    return rp.citation_summary(t.citations)


@query("citation_breakdown", """
    with one as (select * from (select *, row_number() over (partition by ticketid order by issue_ts, status) rn from {citations}) x where rn = 1)
    select 'hour' kind, cast(h as varchar) "label", count(ticketid) "count"
    from (select unnest(range(24)) h) hs left join one on hour(issue_ts) = h group by h
    union all select 'violation', violation, count(*) from one group by violation
    union all select 'status', status, count(*) from one group by status
    union all select 'badge', badge, count(*) from one group by badge""")
def citation_breakdown(t: Tables):
    return rp.citation_breakdown(t.citations)


@query("load_window", """select garage_id, load_ts, min(entry_ts) min_entry, min(exit_ts) min_exit, max(entry_ts) max_entry, max(exit_ts) max_exit
    from {visits} where load_ts >= timestamp '1996-01-01' group by 1, 2""")
def load_window(t: Tables):
    return rp.load_window(t.visits, "1996-01-01")


@query("weekday_order", """select o_orderkey, strftime(o_orderdate, '%a') "day" from {orders}
    order by dayofweek(o_orderdate), o_orderkey""")
def weekday_order(t: Tables):
    day = t.orders.select("o_orderkey", F.date_format("o_orderdate", "EEE").alias("day"))
    return day.orderBy(fl.weekday_rank(F.col("day")), "o_orderkey")


@query("text_order", """select s_suppkey, nullif(device_type, 'Exit') kind from (select s_suppkey, case s_suppkey % 4 when 0 then 'Exit'
    when 1 then 'cashier' when 2 then 'Portable' end device_type from {supplier}) x order by lower(coalesce(kind, '')), s_suppkey""")
def text_order(t: Tables):
    kinds = t.sql("""select s_suppkey, nullif(case s_suppkey % 4 when 0 then 'Exit' when 1 then 'cashier' when 2 then 'Portable' end, 'Exit') kind
        from {supplier}""")
    return kinds.orderBy(fl.text_sort_key(F.col("kind")), "s_suppkey")
