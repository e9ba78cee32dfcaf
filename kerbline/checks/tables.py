"""Views over the shared test tables that play the part of the domain tables.

The text of each view runs on Spark and on DuckDB. A view may use the test
tables and earlier views; names in braces stand for them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kerbline.session import configure

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


view("facility", """
    select n_nationkey facility_id, n_name facility_name,
           case n_nationkey % 3 when 0 then 'garage' when 1 then 'lot' else 'meter' end facility_type,
           n_regionkey region_id from {nation}""")
view("device", """
    select s_suppkey device_id, case when s_suppkey % 10 = 8 then concat('none ', s_name) else s_name end device_terminal_id,
           case when s_suppkey % 10 = 8 then concat('none ', s_name) else s_name end terminal_id,
           case s_suppkey % 4 when 0 then 'Exit' when 1 then 'Cashier' when 2 then 'Portable CC Reader' end device_type
    from {supplier}""")
view("assign", """
    select s_suppkey * 3 + k assignment_id, case when s_suppkey % 10 = 9 then -s_suppkey else s_suppkey end device_id, (s_nationkey + k) % 25 location_id,
           timestamp '1995-01-01 00:00:00' + (k * 800) * interval '1' day assign_date,
           case when k < 2 then timestamp '1995-01-01 00:00:00' + (k * 800 + 700) * interval '1' day end end_date
    from (select s_suppkey, s_nationkey, 0 k from {supplier} union all select s_suppkey, s_nationkey, 1 from {supplier}
          union all select s_suppkey, s_nationkey, 2 from {supplier}) x""")
view("location", """
    select n_nationkey location_id, n_nationkey facility_id,
           case when n_nationkey % 5 = 4 then n_nationkey + 100 end space_id from {nation}""")
view("space", """
    select n_nationkey + 100 space_id, concat('S-', n_name) space_number, n_nationkey facility_id from {nation}
    where n_nationkey % 5 = 4""")
view("charge", """
    select n_nationkey * 10 + p charge_code_id, 82000 + n_regionkey charge_code, case when n_nationkey = 24 then -1 else n_nationkey end location_id, p program_type_id
    from (select n_nationkey, n_regionkey, 1 p from {nation} union all select n_nationkey, n_regionkey, 2 from {nation}) x""")
view("method", """
    select cast(dense_rank() over (order by b) as int) payment_method_id, b payment_method_brand,
           case when b in ('Visa', 'Mastercard') then 'card' when b = 'Cash' then 'cash' else 'other' end payment_method_type
    from (select distinct case o_orderpriority when '1-URGENT' then 'Visa' when '2-HIGH' then 'Mastercard'
                 when '3-MEDIUM' then 'Cash' when '5-LOW' then 'None' else o_orderpriority end b
          from {orders}) t""")
view("settlement", """
    select r_regionkey settlement_system_id,
           case r_regionkey when 0 then 'IPS' when 1 then 'PI' when 2 then 'Windcave' else r_name end system_name
    from {region}""")
# Rows that are to find no match keep their place in a table with a key nothing else has.
# One staging row per line item, with the six-column row key as its id.
view("staging", """
    select cast(l_orderkey as varchar(20)) || '-' || cast(l_partkey as varchar(20)) || '-' || cast(l_suppkey as varchar(20))
             || '-' || cast(l_linenumber as varchar(20)) || '-' || cast(cast(l_quantity as int) as varchar(20))
             || '-' || cast(cast(l_shipdate as date) as varchar(20)) id,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) quantity,
           o_orderdate, l_shipdate,
           o_orderdate + (o_orderkey * 37 % 1440) * interval '1' minute + (l_partkey % 60) * interval '1' second at_time,
           cast(l_extendedprice as decimal(12,2)) amount,
           cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(14,4)) settle_amount,
           concat('Supplier#', lpad(cast(l_suppkey as varchar(20)), 9, '0')) terminal,
           case o_orderpriority when '1-URGENT' then 'VISA' when '2-HIGH' then 'MC' when '3-MEDIUM' then 'Cash'
                else o_orderpriority end card_type,
           case o_orderpriority when '1-URGENT' then 'Visa' when '2-HIGH' then 'Mastercard' when '3-MEDIUM' then 'Cash'
                else o_orderpriority end brand,
           concat(l_returnflag, '_', l_linestatus) staging_table, o_orderkey source_file_id, o_custkey, l_returnflag, l_linestatus
    from {lineitem} join {orders} on l_orderkey = o_orderkey""")
view("fact", """
    select s.id staging_record_id, s.o_orderdate transaction_date, s.amount transaction_amount, s.l_shipdate settle_date,
           s.settle_amount, s.staging_table, s.source_file_id, pm.payment_method_id, d.device_id,
           cast(s.l_partkey % 5 as int) settlement_system_id, a.location_id,
           case when d.device_type = 'Portable CC Reader' then 2 else 1 end program_id, c.charge_code_id
    from {staging} s
    join {device} d on d.device_terminal_id = s.terminal
    join {assign} a on a.device_id = d.device_id and s.o_orderdate >= a.assign_date
         and s.o_orderdate < coalesce(a.end_date, timestamp '9999-12-31 00:00:00')
    join {method} pm on pm.payment_method_brand = s.brand
    join {charge} c on c.location_id = a.location_id
         and c.program_type_id = case when d.device_type = 'Portable CC Reader' then 2 else 1 end""")
view("gate", """
    select event_id, cast(user_id % 7 + 1 as int) garage_id, user_id * 100 + day(ts) ticket,
           case event_type when 'view' then 20 when 'purchase' then 30 when 'error' then 31 when 'signup' then 33 else 40 end txn_type,
           ts, value amount, user_id, cast(user_id % 4 - 1 as int) ticket_type, cast(user_id % 2 as int) cashier,
           case event_type when 'view' then concat('E', cast(user_id % 9 as varchar(5)))
                else concat('A', cast(user_id % 9 as varchar(5))) end station
    from {events}""")
view("presence", """
    select o_orderkey presence_id, cast(o_custkey % 7 + 1 as int) garage_id, cast(o_custkey % 150 * 100 + o_orderkey % 30 + 1 as bigint) ticket,
           cast(o_orderkey % 5 + 1 as int) state, concat('L', cast(o_custkey as varchar(20))) media, o_custkey % 40 customer_id,
           timestamp '2024-01-01 00:00:00' + (o_orderkey % 30) * interval '1' day + (o_orderkey * 37 % 1440) * interval '1' minute entry_ts,
           timestamp '2024-01-01 00:00:00' + (o_orderkey % 30) * interval '1' day + (o_orderkey * 37 % 1440 + o_custkey % 600) * interval '1' minute exit_ts,
           cast(o_totalprice as decimal(12,2)) cost, cast(o_custkey % 100 as decimal(12,2)) paid
    from {orders}""")
view("visits", """
    select o_orderkey visit_id, cast(o_custkey % 7 + 1 as int) garage_id, o_custkey permit,
           case o_orderstatus when 'F' then 'transient' when 'O' then 'permit' else 'employee' end customer_type,
           o_orderdate + (o_orderkey*37 % 1440) * interval '1' minute + (o_orderkey*13 % 60) * interval '1' second entry_ts,
           case when o_orderkey % 50 <> 0 then o_orderdate + (o_orderkey*37 % 1440 + 15 + o_custkey % 600) * interval '1' minute
                + (o_orderkey*7 % 60) * interval '1' second end exit_ts,
           o_orderdate + 2 * interval '1' day load_ts
    from {orders}""")
view("access_log", """
    select event_id log_id, user_id card_id, ts, case event_type when 'signup' then 2 when 'error' then 110 when 'purchase' then 110 else 7 end property_type,
           case event_type when 'error' then 'True' when 'purchase' then 'False'
                else concat('G: group ', cast(cast(floor(value) as int) % 5 as varchar(5))) end new_value,
           concat('G: group ', cast(user_id % 5 as varchar(5))) group_detail
    from {events}""")
view("citations", """
    select event_id ticketid, ts issue_ts, event_type violation,
           case event_id % 10 when 0 then 'Void Approved' when 1 then 'Warning' else 'Issued' end status,
           cast(user_id % 12 as varchar(10)) badge, cast(value as decimal(12,2)) amount from {events}
    union all
    select event_id, ts + interval '1' second, event_type, 'Issued', cast(user_id % 12 as varchar(10)), cast(value as decimal(12,2))
    from {events} where event_id % 20 = 0""")
view("work_orders", """
    select o_orderkey wo_id, case o_orderstatus when 'O' then 'OPEN' when 'P' then 'HOLD' else 'CLOSED' end status,
           o_orderdate initiate_ts, case when o_orderstatus = 'F' then last_ship end finish_ts,
           case when o_orderkey % 3 = 1 then o_orderkey - 1 end parent_id, o_orderpriority description, o_custkey
    from {orders} left join (select l_orderkey, max(l_shipdate) last_ship from {lineitem} group by l_orderkey) l
         on l_orderkey = o_orderkey""")


view("shifts", """
    select o_orderkey shift_id, cast(o_orderdate as date) - cast(datediff(day, timestamp '1995-01-01 00:00:00', o_orderdate) % 7 as int) week_start,
           case cast(datediff(day, timestamp '1995-01-01 00:00:00', o_orderdate) % 7 as int) when 0 then 'Sun' when 1 then 'Mon' when 2 then 'Tue' when 3 then 'Wed'
                when 4 then 'Thu' when 5 then 'Fri' else 'Sat' end day_of_week,
           concat('Garage ', cast(o_custkey % 7 as varchar(5))) location, cast(o_custkey % 4 as int) booth,
           cast(5 + o_orderkey % 13 as double) + 0.5 start_hour, cast(9 + o_orderkey % 13 + o_custkey % 6 as double) end_hour,
           o_custkey, o_orderstatus
    from {orders}""")
view("shift_assignments", """
    select o_orderkey * 2 assignment_id, case when o_orderstatus = 'P' then -o_orderkey else o_orderkey end shift_id, o_custkey employee_id from {orders}""")
view("employees", """
    select c_custkey employee_id, c_name first_name, c_mktsegment last_name, c_nationkey job from {customer}""")
view("time_off", """
    select o_orderkey request_id, o_custkey employee_id, o_orderdate + 3 * interval '1' day request_date, o_orderdate submit_date,
           o_custkey + 1 submit_by, case when o_orderkey % 4 = 0 then o_custkey + 2 end updated_by, o_orderkey % 10 = 0 is_cancelled
    from {orders}""")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Spark DataFrames of the test tables and of the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names_in(text)})


def duckdb_sql(text: str) -> str:
    """Text for DuckDB: the views it needs as leading CTEs, braces resolved."""
    needed: list[str] = []

    def collect(sql: str) -> None:
        for name in names_in(sql):
            if name in VIEWS and name not in needed:
                collect(VIEWS[name])
                needed.append(name)

    def plain(sql: str) -> str:
        named = re.sub(r"\{(\w+)\}", lambda m: f"v_{m.group(1)}" if m.group(1) in VIEWS else m.group(1), sql)
        return named.replace("datediff(day,", "datediff('day',")

    collect(text)
    ctes = ", ".join(f"v_{n} as ({plain(VIEWS[n])})" for n in needed)
    body = plain(text).strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
