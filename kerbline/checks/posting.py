"""Queries: L1-L12 over staging tables derived from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import timeparts as tp
from kerbline.plans import posting as po
from kerbline.session import written
from kerbline.sources.versions import merged

c = F.col


def dims(t: Tables, with_locations: bool = False) -> po.Dimensions:
    # Locations that end in 7 stand under an id that no assignment has.
    places = t.location.withColumn("location_id", F.when(c("location_id") % 10 == 7, -c("location_id") - 1).otherwise(c("location_id"))) if with_locations else None
    return po.Dimensions(t.device, t.assign, t.charge, t.method, t.settlement, places)


# Staging tables, in SQL that both engines run.
_STAGED = {
    "windcave_staging": """select id, source_file_id, at_time as time, l_shipdate settlement_date, amount, brand card_type, id dpstxnref, concat('x', terminal) txnref,
        terminal device_id, case when l_linenumber % 5 = 0 then 1 else 0 end voided, l_linenumber % 6 = 0 processed_to_final from {staging}""",
    "payments_insider_sales_staging": """select id, source_file_id, o_orderdate transaction_date, '14:05:09' transaction_time, amount transaction_amount, brand card_brand,
        concat('4*', cast(l_partkey as varchar(20))) card_number, cast(l_suppkey as varchar(20)) authorization_code, terminal terminal_id, l_linenumber % 6 = 0 processed_to_final from {staging}""",
    "ips_staging": """select id, source_file_id, o_orderdate date, '9:05:32 PM' as time, concat('P', cast(l_partkey as varchar(20))) pole, terminal space_name,
        case l_partkey % 4 when 0 then 'Coins' when 1 then 'Credit Card' when 2 then 'Remote/PBC' else 'Coin & Card' end transaction_type,
        case when l_partkey % 4 <> 0 then card_type end card_type, case when l_linenumber % 2 = 0 then id end transaction_id,
        case when l_linenumber % 3 = 0 then cast(0 as decimal(10,2)) else cast(quantity as decimal(10,2)) end coin,
        case when l_linenumber % 4 = 0 then cast(0 as decimal(10,2)) else cast(amount as decimal(10,2)) end credit_card, cast(amount as decimal(10,2)) total,
        case when l_partkey % 4 = 2 then cast(0.45 as decimal(10,2)) end convenience_fee, l_linenumber % 6 = 0 processed_to_final from {staging}""",
    "ips_cc_staging": """select id, source_file_id, at_time transaction_date_time, id transaction_reference, terminal pole, card_type, amount, l_linenumber % 6 = 0 processed_to_final from {staging}""",
    "ips_mobile_staging": """select id, source_file_id, at_time received_date_time, terminal pole, case when l_linenumber % 9 = 0 then 12345 end space_name, l_partkey prid, amount paid,
        cast(0.45 as decimal(10,2)) convenience_fee, brand partner_name, l_linenumber % 6 = 0 processed_to_final from {staging}""",
    "ips_cash_staging": """select id, source_file_id, o_orderdate collection_date, '1437' collection_time, terminal pole_ser_no, amount coin_revenue, l_linenumber % 6 = 0 processed_to_final from {staging}""",
}
_PAYMENTS = """select concat(case when l_returnflag = 'R' then '4*' else '9*' end, cast(l_partkey as varchar(20))) card_number, cast(l_suppkey as varchar(20)) authorization_code, id payment_id, l_shipdate payment_date,
    cast(settle_amount as decimal(12,2)) payment_amount, l_orderkey % 9 = 0 processed_to_final, source_file_id from {staging}"""

_LATEST = f"""pay as ({_PAYMENTS}), lp as (select * from (select *, row_number() over (partition by card_number, authorization_code order by payment_date desc, payment_id desc) rn from pay) q where rn = 1)"""


def staged(t: Tables, table: str):
    return t.sql(_STAGED[table])


def payments(t: Tables):
    return t.sql(_PAYMENTS)


# For DuckDB: candidate columns of each source.
_BRAND = "case card_type when 'VISA' then 'Visa' when 'MC' then 'Mastercard' when 'DISC' then 'Discover' {amex} else card_type end"
_CAND = {
    "windcave_staging": """select id, source_file_id, device_id k, device_id src, time lt, time td, amount ta, settlement_date sd, amount sa, amount ra, card_type b, 1 prog, dpstxnref ref from s where voided = 0""",
    "payments_insider_sales_staging": """select s.id, s.source_file_id, terminal_id k, terminal_id src, transaction_date + interval '14:05:09' hour to second lt, transaction_date + interval '14:05:09' hour to second td,
        transaction_amount ta, lp.payment_date sd, lp.payment_amount sa, transaction_amount ra, card_brand b, cast(null as int) prog, replace(s.card_number, '*', '') || s.authorization_code ref
        from s left join lp on lp.card_number = s.card_number and lp.authorization_code = s.authorization_code""".replace("interval '14:05:09' hour to second", "interval '50709' second"),
    "ips_staging": f"""select id, source_file_id, space_name k, space_name src, date lt, date + interval '75932' second td, total ta, date sd,
          case when transaction_type like 'Remote%' then total + convenience_fee else total end sa, case when transaction_type like 'Remote%' then total + convenience_fee else total end ra,
          case when card_type in ('VISA', 'MC') then {_BRAND.format(amex='')} when card_type is null and transaction_type = 'Coins' then 'Cash' when card_type is null and transaction_type = 'Credit Card' then 'unknown' else card_type end b,
          1 prog, coalesce(transaction_id, pole || '_' || id || '_' || source_file_id) ref from s where transaction_type <> 'Coin & Card'
        union all select id, source_file_id, space_name, space_name, date, date + interval '75932' second, coin, date, coin, coin, 'Cash', 1, coalesce(transaction_id, pole || '_' || id || '_' || source_file_id) || '_COIN'
          from s where transaction_type = 'Coin & Card' and coin > 0
        union all select id, source_file_id, space_name, space_name, date, date + interval '75932' second, credit_card, date, credit_card, credit_card, {_BRAND.format(amex='')}, 1,
          coalesce(transaction_id, pole || '_' || id || '_' || source_file_id) || '_CARD' from s where transaction_type = 'Coin & Card' and credit_card > 0""",
    "ips_cc_staging": f"""select id, source_file_id, pole k, pole src, transaction_date_time lt, transaction_date_time td, amount ta, transaction_date_time sd, amount sa, amount ra, {_BRAND.format(amex='')} b, 1 prog, transaction_reference ref from s""",
    "ips_mobile_staging": """select id, source_file_id, coalesce(cast(space_name as varchar), pole) k, cast(space_name as varchar) src, received_date_time lt, received_date_time td, paid ta, received_date_time sd,
        paid + convenience_fee sa, paid ra, partner_name b, 1 prog, cast(prid as varchar) ref from s""",
    "ips_cash_staging": """select id, source_file_id, pole_ser_no k, pole_ser_no src, collection_date + interval '52620' second lt, collection_date + interval '52620' second td, coin_revenue ta,
        collection_date + interval '52620' second sd, coin_revenue sa, coin_revenue ra, 'Cash' b, 1 prog, id ref from s""",
}
_SYSTEM = {"windcave_staging": 2, "payments_insider_sales_staging": 1}


def _resolved(table: str, legacy: bool = False) -> str:
    place = "or da.location_id % 10 = 7" if table == "ips_cash_staging" else ""
    tests = ["when d.device_id is null then 'DEVICE_NOT_FOUND'", "when da.device_id is null then 'NO_ACTIVE_DEVICE_ASSIGNMENT'"]
    if legacy:
        tests.reverse()
    return f"""s as (select * from ({_STAGED[table]}) x where not processed_to_final), {_LATEST}, cand as ({_CAND[table]}),
      r as (select cand.*, d.device_id, da.location_id, coalesce(prog, case when d.device_type = 'Portable CC Reader' then 2 else 1 end) program_id, cc.charge_code_id, pm.payment_method_id,
              {_SYSTEM.get(table, 0)} settlement_system_id,
              case {' '.join(tests)} when da.location_id is null {place} then 'LOCATION_NOT_FOUND' when cc.charge_code_id is null then 'CHARGE_CODE_NOT_FOUND'
                   when pm.payment_method_id is null then 'PAYMENT_METHOD_NOT_FOUND' end reason
            from cand left join {{device}} d on d.device_terminal_id = cand.k
            left join {{assign}} da on da.device_id = d.device_id and cand.lt >= da.assign_date and cand.lt < coalesce(da.end_date, timestamp '9999-12-31 00:00:00')
            left join {{charge}} cc on cc.location_id = da.location_id and cc.program_type_id = coalesce(prog, case when d.device_type = 'Portable CC Reader' then 2 else 1 end)
            left join {{method}} pm on pm.payment_method_brand = cand.b)"""


def _post_sql(table: str) -> str:
    return f"""with {_resolved(table)} select td transaction_date, cast(ta as double) transaction_amount, sd settle_date, cast(sa as double) settle_amount, '{table}' staging_table, source_file_id,
        id staging_record_id, payment_method_id, device_id, settlement_system_id, location_id, program_id, charge_code_id, ref reference_number from r where reason is null"""


def _reject_sql(table: str, legacy: bool = False) -> str:
    return f"""with {_resolved(table, legacy)} select '{table}' staging_table, id staging_record_id, source_file_id, reason reject_reason_code, timestamp '2024-01-01' rejected_at, src source_device_terminal_id,
        td transaction_datetime, cast(ra as double) transaction_amount, coalesce(cast(payment_method_id as varchar), 'NO_PAYMENT_METHOD') payment_method_id,
        coalesce(cast(device_id as varchar), 'DEVICE_NOT_FOUND') device_id, cast(settlement_system_id as varchar) settlement_system_id,
        coalesce(cast(location_id as varchar), 'LOCATION_NOT_FOUND') location_id, coalesce(cast(charge_code_id as varchar), 'CHARGE_CODE_NOT_FOUND') charge_code_id from r where reason is not null"""


def rejected(rows):
    return po.rejected(rows, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def resolved(t: Tables, table: str, legacy: bool = False):
    return po.resolve_source(table, staged(t, table), dims(t, table == "ips_cash_staging"), payments=payments(t), legacy_order=legacy)


_SHORT_NAME = {
    "windcave_staging": "windcave", "payments_insider_sales_staging": "pi_sales", "ips_staging": "ips", "ips_cc_staging": "ips_cc",
    "ips_mobile_staging": "ips_mobile", "ips_cash_staging": "ips_cash",
}
for _table, _name in _SHORT_NAME.items():
    query(f"post_{_name}", _post_sql(_table))(lambda t, x=_table: po.posted(resolved(t, x)))
    query(f"reject_{_name}", _reject_sql(_table))(lambda t, x=_table: rejected(resolved(t, x)))

query("reject_legacy_order", _reject_sql("ips_cc_staging", legacy=True))(lambda t: rejected(resolved(t, "ips_cc_staging", True)))


@query("apply_settlement", f"""with s as ({_STAGED['payments_insider_sales_staging']}), pay as ({_PAYMENTS}),
      lp as (select * from (select *, row_number() over (partition by card_number, authorization_code order by payment_date desc, payment_id desc) rn from pay where not processed_to_final) q where rn = 1),
      n as (select s.id, lp.payment_date, lp.payment_amount from s join lp using (card_number, authorization_code) where s.processed_to_final)
    select f.staging_record_id, f.staging_table, coalesce(n.payment_date, f.settle_date) settle_date, cast(coalesce(n.payment_amount, f.settle_amount) as double) settle_amount
    from (select * exclude staging_table, case when device_id % 2 = 0 then 'payments_insider_sales_staging' else 'ips_staging' end staging_table from {{fact}}) f
    left join n on n.id = f.staging_record_id and f.staging_table = 'payments_insider_sales_staging'""")
def apply_settlement(t: Tables):
    fact = t.fact.withColumn("staging_table", F.when(c("device_id") % 2 == 0, "payments_insider_sales_staging").otherwise("ips_staging"))
    done = po.apply_settlement(fact, staged(t, "payments_insider_sales_staging"), payments(t))
    return done.select("staging_record_id", "staging_table", "settle_date", "settle_amount")


@query("settlement_upsert", like="apply_settlement")
def settlement_upsert(t: Tables):
    """The fact table with only the settled rows put in by key."""
    fact = t.fact.withColumn("staging_table", F.when(c("device_id") % 2 == 0, "payments_insider_sales_staging").otherwise("ips_staging"))
    kept = ["staging_record_id", "staging_table", "settle_date", "settle_amount"]
    changes = written(po.settlement_changes(fact, staged(t, "payments_insider_sales_staging"), payments(t)).select(*kept), "settled")
    return merged(fact.select(*kept), changes, ["staging_table", "staging_record_id"])


@query("mark_processed", f"""with {_resolved('windcave_staging')}, w as ({_STAGED['windcave_staging']}) select w.id, w.processed_to_final or r.id is not null processed_to_final
    from w left join (select distinct id from r where reason is null) r on r.id = w.id""")
def mark_processed(t: Tables):
    fact = po.posted(resolved(t, "windcave_staging"))
    return po.mark_processed(staged(t, "windcave_staging"), fact, "windcave_staging").select("id", "processed_to_final")


@query("processed_upsert", like="mark_processed")
def processed_upsert(t: Tables):
    staging, fact = staged(t, "windcave_staging"), po.posted(resolved(t, "windcave_staging"))
    kept = ["id", "processed_to_final"]
    return merged(staging.select(*kept), written(po.processed_changes(staging, fact, "windcave_staging").select(*kept), "processed"), ["id"])


@query("mark_payments_processed", f"""with {_resolved('payments_insider_sales_staging')}, ok as (select distinct x.card_number, x.authorization_code from ({_STAGED['payments_insider_sales_staging']}) x join r on r.id = x.id and r.reason is null)
    select p.payment_id, p.processed_to_final or ok.card_number is not null processed_to_final from pay p left join ok on ok.card_number = p.card_number and ok.authorization_code = p.authorization_code""")
def mark_payments_processed(t: Tables):
    table = "payments_insider_sales_staging"
    return po.mark_payments_processed(payments(t), staged(t, table), po.posted(resolved(t, table))).select("payment_id", "processed_to_final")


@query("payments_upsert", like="mark_payments_processed")
def payments_upsert(t: Tables):
    table = "payments_insider_sales_staging"
    kept = ["payment_id", "processed_to_final"]
    changes = written(po.payments_changes(payments(t), staged(t, table), po.posted(resolved(t, table))).select(*kept), "paid")
    return merged(payments(t).select(*kept), changes, ["payment_id"])


@query("post_source", f"""with {_resolved('ips_mobile_staging')} select id, source_file_id, coalesce(reason, 'posted') outcome,
      case when count(*) filter (reason is not null) over f > 0 and count(*) filter (reason is null) over f > 0 then 'incomplete'
           when count(*) filter (reason is not null) over f > 0 then 'failed' else 'complete' end status from r window f as (partition by source_file_id)""")
def post_source(t: Tables):
    """All outputs of one job over one table: every id with its outcome, and the status of its file."""
    out = po.post_source("ips_mobile_staging", staged(t, "ips_mobile_staging"), dims(t), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    key = [c("staging_record_id").alias("id"), "source_file_id"]
    ids = out.posted.select(*key, F.lit("posted").alias("outcome")).unionByName(out.rejected.select(*key, c("reject_reason_code").alias("outcome")))
    return ids.join(out.log.select("source_file_id", "status"), "source_file_id")


@query("etl_run_log", f"""with {_resolved('ips_staging')}, n as (select source_file_id, count(*) p from s group by 1),
      o as (select source_file_id, count(*) filter (reason is null) ok, count(*) filter (reason is not null) bad from r group by 1)
    select 'ips_staging' source_table, n.source_file_id, p records_processed, coalesce(ok, 0) records_created, 0 records_updated, coalesce(bad, 0) records_failed,
      case when coalesce(bad, 0) > 0 and coalesce(ok, 0) > 0 then 'incomplete' when coalesce(bad, 0) > 0 then 'failed' else 'complete' end status from n left join o on o.source_file_id = n.source_file_id""")
def etl_run_log(t: Tables):
    rows = staged(t, "ips_staging").filter(~c("processed_to_final"))
    return po.etl_run_log(rows, resolved(t, "ips_staging"), "ips_staging")


@query("conservation_check", f"""with {_resolved('windcave_staging')} select count(distinct cand.id) staged, count(distinct cand.id) filter (r.reason is null) posted, count(distinct cand.id) filter (r.reason is not null) rejected,
    0 lost, 0 in_both, 0 unknown from cand join r on r.id = cand.id""")
def conservation_check(t: Tables):
    rows = resolved(t, "windcave_staging")
    ready = po.unprocessed(staged(t, "windcave_staging"), None).filter("voided = 0")
    return po.conservation_check(ready, po.posted(rows), rejected(rows))


_CASH = """cash as (select l_orderkey * 10 + l_linenumber ticket, cast(l_partkey % 24 as int) garage_id, cast(l_suppkey as int) gate_location_id, o_orderdate date, '10:30:00' as time,
        cast(quantity * 100 as int) amount, case when l_linenumber = 7 then 1 else 0 end pay_method from {staging}),
    stn as (select s_nationkey garage_id0, s_suppkey gate_location_id, case when s_suppkey % 10 = 3 then concat('A', s_name) when s_suppkey % 10 <> 4 then s_name end station from {supplier}),
    reb as (select case when l_returnflag = 'R' then 1 else -1 end * (l_orderkey * 10 + l_linenumber) ticket_id, o_orderdate date, cast(l_partkey % 5 as decimal(12,2)) rebate_amount from {staging})"""


@query("post_zms_cash", f"""with {_CASH}, rs as (select ticket_id, date, sum(rebate_amount) rebate from reb group by 1, 2)
    select p.date + interval '37800' second transaction_date, amount / 100.0 transaction_amount, p.date settle_date, cast(amount / 100.0 - coalesce(rebate, 0) as double) settle_amount,
      'zms_cash_regular' staging_table, cast(null as bigint) source_file_id, ticket staging_record_id, 1 payment_method_id, d.device_id, 1 settlement_system_id, l.location_id, 1 program_id, cc.charge_code_id,
      cast(ticket as varchar) reference_number
    from cash p join stn using (gate_location_id) left join rs on rs.ticket_id = p.ticket and rs.date = p.date join {{device}} d on d.device_terminal_id = stn.station
    join {{assign}} da on da.device_id = d.device_id and p.date + interval '37800' second >= da.assign_date and p.date + interval '37800' second < coalesce(da.end_date, timestamp '9999-12-31 00:00:00')
    join {{location}} l on l.facility_id = case when p.garage_id = 12 then 2 else p.garage_id end and l.space_id is null
    join {{charge}} cc on cc.location_id = l.location_id and cc.program_type_id = 1
    where pay_method = 0 and station not like 'A%'""".replace("amount / 100.0 transaction_amount", "cast(amount / 100.0 as double) transaction_amount"))
def post_zms_cash(t: Tables):
    cash, reb = t.sql(f"with {_CASH} select * from cash"), t.sql(f"with {_CASH} select * from reb")
    # One row per gate location and garage that uses it.
    stations = t.sql(f"with {_CASH} select distinct garage_id, gate_location_id, station from cash join stn using (gate_location_id)")
    return po.post_zms_cash(cash, reb, stations.filter("station is not null"), po.Dimensions(t.device, t.assign, t.charge, t.method, t.settlement, t.location))
