"""Queries: S1-S3, S5-S19 over report rows rendered as text from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.sources import files as fi
from kerbline.sources import staging as sg
from kerbline.sources import validation as va

c = F.col

# File names made from order keys, of every kind and date spelling.
_NAMES = """nm as (select o_orderkey, case o_orderkey % 11 when 0 then 'Payments_' when 1 then 'Daily Sales ' when 2 then 'Transaction Summary ' when 3 then 'DailyBankRecon_'
    when 4 then 'PBP-' when 5 then 'Collection Report ' when 6 then 'x Coin Collector Card ' when 7 then 'Windcave' when 8 then 'WC_' when 9 then 'notes ' else 'paymentsSales' end || case o_orderkey % 5
    when 0 then cast(cast(o_orderdate as date) as varchar(10)) when 1 then replace(cast(cast(o_orderdate as date) as varchar(10)), '-', '')
    when 2 then concat(lpad(cast(month(o_orderdate) as varchar(2)), 2, '0'), '_', lpad(cast(day(o_orderdate) as varchar(2)), 2, '0'), '_', cast(year(o_orderdate) as varchar(4)))
    when 3 then 'undated' else '99999999' end || '.csv' name, o_orderdate from {orders})"""


def names(t: Tables):
    return t.sql(f"with {_NAMES} select * from nm")


@query("infer_source", f"""with {_NAMES} select o_orderkey, name, case when lower(name) like 'payments%' then 'payments_insider_payments' when lower(name) like '%sales%' then 'payments_insider_sales'
    when lower(name) like 'transaction summary%' then 'ips' when lower(name) like 'dailybankrecon%' then 'ips_cc' when lower(name) like 'pbp%' then 'ips_mobile'
    when lower(name) like 'collection report%' then 'ips_cash' when lower(name) like '%coin collector card%' then 'coin_collection' when lower(name) like 'windcave%' or lower(name) like 'wc%' then 'windcave'
    else 'other' end source from nm""")
def infer_source(t: Tables):
    return names(t).select("o_orderkey", "name", fi.infer_source(c("name")).alias("source"))


@query("report_date_from_name", f"""with {_NAMES} select o_orderkey, case when o_orderkey % 5 < 3 then strftime(o_orderdate - interval '1' day, '%Y-%m-%d') end report_date from nm""")
def report_date_from_name(t: Tables):
    return names(t).select("o_orderkey", fi.report_date_from_name(c("name")).alias("report_date"))


@query("file_dedup", """with f as (select doc_id path, sha256(text) file_hash from documents), known as (select distinct file_hash from f join labels l on l.doc_id = f.path where l.toxic = 1)
    select min(path) path, file_hash from f where file_hash not in (select file_hash from known) group by file_hash""")
def file_dedup(t: Tables):
    files = t.documents.select(c("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    known = files.join(t.labels.filter("toxic = 1").select(c("doc_id").alias("path")), "path", "left_semi").select("file_hash")
    return fi.file_dedup(files, known)


# Line items as text rows of each report, with a total row at the end.
_MONEY = "concat('$', cast(floor(amount / 1000) as varchar(10)), ',', lpad(cast(amount - floor(amount / 1000) * 1000 as varchar(12)), 6, '0'))"
_DATE = "concat(cast(month(l_shipdate) as varchar(2)), '/', cast(day(l_shipdate) as varchar(2)), '/', cast(year(l_shipdate) as varchar(4)))"


def raw(t: Tables, columns: str, key: str):
    """A raw report: text columns and a total row without a key date."""
    rows = t.sql(f"select {columns} from {{staging}}")
    total = t.staging.agg(F.sum("amount").cast("string").alias("sum")).select(*[
        (c("sum") if n == "Note" else F.lit(None)).cast("string").alias(n) for n in rows.columns])
    return rows.unionByName(total) if key else rows


@query("stage_windcave", """select id, o_orderdate "time", l_shipdate settlement_date, cast(amount as double) amount, case l_linenumber % 3 when 0 then 'Acc_A' else 'Acc_B' end group_account, 0 voided,
    case when l_partkey % 5 <> 0 then quantity end catid, 77 source_file_id, false processed_to_final from {staging} where l_linenumber % 3 <> 2 and l_partkey % 4 <> 0""")
def stage_windcave(t: Tables):
    r = raw(t, f"""id as `Id`, cast(o_orderdate as string) as ` Time `, {_DATE} as `Settlement Date`, cast(amount as string) as `Amount`,
        case l_linenumber % 3 when 0 then 'Acc_A' when 1 then 'Acc_B' else 'Acc_C' end as `Group/ Account`, case when l_partkey % 4 = 0 then '1.0' else '0' end as `Voided`,
        case when l_partkey % 5 <> 0 then concat(cast(quantity as string), '.0') else 'n.a.' end as `CatId.`""", "")
    return sg.stage_windcave(r, 77, ["Acc_A", "Acc_B"])


@query("stage_pi_sales", """select id, '0080' mid, 'N' void_ind, l_shipdate settled_date, cast(amount as double) settled_amount, o_orderdate transaction_date, '14:05:09' transaction_time,
    lpad(cast(l_suppkey as varchar), 8, '0') terminal_id, cast(l_partkey as int) pos_entry, source_file_id, false processed_to_final from {staging} where l_suppkey % 4 <> 0 and l_linenumber % 3 <> 0""")
def stage_pi_sales(t: Tables):
    r = raw(t, f"""id, case when l_suppkey % 4 = 0 then '0081' else '0080' end as `MID`, case when l_linenumber % 3 = 0 then 'Y' else 'N' end as `Void Ind`, {_DATE} as `Settled Date`,
        {_MONEY} as `Settled Amount`, cast(o_orderdate as string) as `Transaction Date`, '14:05:09' as `Transaction Time`, lpad(cast(l_suppkey as string), 8, '0') as `Terminal ID`,
        cast(l_partkey as string) as `POS Entry`, cast(source_file_id as bigint) file""", "")
    return sg.stage_pi_sales(r, c("file"), "0080").drop("file")


@query("stage_pi_payments", """select id, '0080' merchant_id, l_shipdate payment_date, cast(amount as double) payment_amount, 5 source_file_id, false processed_to_final from {staging} where l_suppkey % 4 <> 0""")
def stage_pi_payments(t: Tables):
    r = raw(t, f"id, case when l_suppkey % 4 = 0 then '0081' else '0080' end as `Merchant ID`, {_DATE} as `Payment Date`, {_MONEY} as `Payment Amount`", "")
    return sg.stage_pi_payments(r, 5, "0080")


@query("stage_ips", """select id note, l_shipdate date, cast(l_partkey as varchar) pole, lpad(cast(l_suppkey as varchar), 5, '0') terminal, case when l_linenumber % 2 = 0 then 'Remote/PBC' else 'Coins' end transaction_type,
    cast(amount as double) total, case when l_linenumber % 2 = 0 then cast(0.45 as double) end convenience_fee, cast(l_partkey % 24 as int) transaction_hour, 'c' || l_suppkey card_number, 9 source_file_id,
    false processed_to_final from {staging} where l_partkey % 7 <> 0""")
def stage_ips(t: Tables):
    r = raw(t, f"""id as `Note`, {_DATE} as `Date`, concat(cast(l_partkey as string), '.0') as `Pole`, lpad(cast(l_suppkey as string), 5, '0') as `Terminal`,
        case when l_linenumber % 2 = 0 then 'Remote/PBC' else 'Coins' end as `Transaction Type`, case when l_partkey % 7 = 0 then '0.00' else cast(amount as string) end as `Total`,
        concat(cast(l_partkey % 24 as string), '.0') as `Transaction Hour`, concat('  c', cast(l_suppkey as string), ' ') as `Card #`""", "date")
    return sg.stage_ips(r, 9)


@query("stage_ips_cc", """select id note, at_time transaction_date_time, cast(l_suppkey as varchar) pole, cast(amount as double) amount, quantity batch_number, 9 source_file_id, false processed_to_final from {staging}""")
def stage_ips_cc(t: Tables):
    r = raw(t, """id as `Note`, cast(at_time as string) as `Transaction Date Time`, concat(cast(l_suppkey as string), '.0') as `Pole`, cast(amount as string) as `Amount ($)`,
        cast(quantity as string) as `Batch Number`""", "transaction_date_time")
    return sg.stage_ips_cc(r, 9)


@query("stage_ips_mobile", """select id note, at_time received_date_time, cast(l_suppkey as varchar) pole, case when l_linenumber % 3 <> 0 then cast(l_partkey as int) end space_name, quantity prid, cast(amount as double) paid,
    cast(0.45 as double) convenience_fee, 9 source_file_id, false processed_to_final from {staging}""")
def stage_ips_mobile(t: Tables):
    r = raw(t, """id as `Note`, cast(at_time as string) as `Received Date Time`, cast(l_suppkey as string) as `Pole`, case when l_linenumber % 3 <> 0 then concat(cast(l_partkey as string), '.0') end as `Space Name`,
        cast(quantity as string) as `PRID`, cast(amount as string) as `$ Paid`""", "received_date_time")
    return sg.stage_ips_mobile(r, 9)


@query("stage_ips_cash", """select id note, l_shipdate collection_date, lpad(cast(l_suppkey as varchar), 6, '0') pole_ser_no, cast(quantity as double) pennies, cast(quantity * 2 as double) as "quarters",
    quantity coin_total, 9 source_file_id, false processed_to_final from {staging}""")
def stage_ips_cash(t: Tables):
    r = raw(t, f"""id as `Note`, {_DATE} as `Collection Date`, concat(lpad(cast(l_suppkey as string), 6, '0'), '.0') as `Pole Ser No.`, cast(quantity as string) as `$0.01`, cast(quantity * 2 as string) as `$0.25`,
        concat(cast(quantity as string), '.0') as `Coin Total`""", "collection_date")
    return sg.stage_ips_cash(r, 9)


@query("stage_coin_collection", """select id note, l_shipdate date, lpad(cast(l_suppkey as varchar), 6, '0') card_number, cast(amount as double) collected_coin_amount, quantity + 1000 coin_count, 9 source_file_id,
    false processed_to_final from {staging}""")
def stage_coin_collection(t: Tables):
    r = raw(t, f"""id as `Note`, {_DATE} as `Date`, lpad(cast(l_suppkey as string), 6, '0') as `Card Number`, {_MONEY} as `Collected Coin Amount`,
        concat('1,', lpad(cast(quantity as string), 3, '0')) as `Coin Count`""", "date")
    return sg.stage_coin_collection(r, 9)


@query("coercions", """select id, case when l_linenumber % 4 <> 0 then quantity end as_int, cast(l_suppkey as varchar) no_suffix, case when l_linenumber % 4 <> 1 then cast(amount as double) end money,
    case when l_linenumber % 4 <> 2 then terminal end trimmed from {staging}""")
def coercions(t: Tables):
    r = t.sql(f"""select id, case when l_linenumber % 4 <> 0 then concat(' ', cast(quantity as string), '.0') else 'many' end n, concat(cast(l_suppkey as string), '.0') p,
        case when l_linenumber % 4 <> 1 then {_MONEY} else '-' end m, case when l_linenumber % 4 <> 2 then concat(' ', terminal, '  ') else ' nan ' end s from {{staging}}""")
    d = sg.trim_strings(r.select("id", "n", "p", "m", "s"), "nan")
    return d.select("id", sg.as_int(c("n")).alias("as_int"), sg.strip_decimal_suffix(c("p")).alias("no_suffix"), sg.parse_money(c("m"), "decimal(12,2)").alias("money"), c("s").alias("trimmed"))


@query("validate_pi", """select 'card_number' "column", 'null values' problem, count(*) filter (l_partkey % 50 = 0) "rows" from {staging}
    union all select 'settled_currency', 'bad currency code', count(*) filter (l_suppkey % 40 = 0) from {staging} union all select 'void_ind', 'missing column', count(*) from {staging}""")
def validate_pi(t: Tables):
    rows = t.staging.select("id", F.when(c("l_partkey") % 50 != 0, c("terminal")).alias("card_number"), F.when(c("l_suppkey") % 40 == 0, "US").otherwise("USD").alias("settled_currency"), "amount")
    return va.validate_pi(rows, ("card_number", "amount", "settled_currency", "void_ind"), ("settled_currency",))


@query("pending_by_source", """select 'windcave' source, count(*) filter (l_linenumber % 6 <> 0) pending from {staging} union all select 'ips', count(*) filter (l_returnflag <> 'R') from {staging}
    union all select 'files', count(*) filter (o_orderkey % 3 <> 0) from {orders}""")
def pending_by_source(t: Tables):
    from kerbline.plans.reports import pending_by_source as pending

    return pending({
        "windcave": t.staging.select((c("l_linenumber") % 6 == 0).alias("processed_to_final")),
        "ips": t.staging.select((c("l_returnflag") == "R").alias("processed_to_final")),
        "files": t.orders.select((c("o_orderkey") % 3 == 0).alias("processed_to_final")),
    })


# Records of one to three lines, cut into blocks wherever 997 places are full.
_LINES = '''ln as (select cast(floor(place / 997) as bigint) block, place, value from (
    select o_orderkey * 10 place, case o_orderkey % 4 when 0 then concat(cast(o_orderkey as varchar(20)), ',', o_orderstatus) when 1 then concat(cast(o_orderkey as varchar(20)), ',"', o_orderpriority)
           when 2 then concat('"say ""', o_orderpriority, '""') else concat('"', cast(o_orderkey as varchar(20)), '","x""",""') end value from {orders}
    union all select o_orderkey * 10 + 1, case o_orderkey % 4 when 1 then concat(o_orderstatus, '"') when 3 then 'a, b' else '' end from {orders}
    union all select o_orderkey * 10 + 2, case when o_orderkey % 4 = 2 then concat(o_orderstatus, '",', cast(o_orderkey as varchar(20))) else '  ' end from {orders}) x)'''


@query("csv_records", f"""with {_LINES}, q as (select *, (length(value) - length(replace(value, '"', ''))) % 2 odd from ln),
      s as (select *, sum(odd) over (order by place) - odd before from q),
      n as (select *, sum(case when before % 2 = 0 then 1 else 0 end) over (order by place) rec from s)
    select min(block) block, min(place) place, string_agg(value, chr(10) order by place) record from n group by rec having count(*) > 1 or trim(min(value)) <> ''""")
def csv_records(t: Tables):
    return fi.csv_records(t.sql(f"with {_LINES} select * from ln"))
