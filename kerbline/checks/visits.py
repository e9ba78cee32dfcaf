"""Queries: J6-J8, V1-V13, A21 over gate events and presence rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.checks.registry import query
from kerbline.checks.tables import Tables
from kerbline.functions import timeparts as tp
from kerbline.operators import visits as vs
from kerbline.plans import reports as rp
from kerbline.session import written
from kerbline.sources.versions import merged

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
EMPLOYER = 7


def gate(t: Tables):
    """Gate events with all detail columns."""
    c = F.col
    return t.gate.select(
        "event_id", "garage_id", "ticket", "txn_type", "ts", "station", "ticket_type", (c("user_id") % 2).cast("int").alias("parking"),
        F.when(c("user_id") % 3 == 0, 3000).otherwise(F.floor("amount") * 100).cast("int").alias("amount"),
        F.lit(3000).alias("t2_amount"), "cashier", (c("user_id") % 5).cast("int").alias("shift"),
        F.when(c("event_id") % 3 == 0, F.lit("2000-01-01 00:00:00").cast(tp.NTZ)).otherwise(tp.add_minutes(c("ts"), -90)).alias("other_ts"),
    )


_GATE = """g as (select event_id, garage_id, ticket, txn_type, ts, station, ticket_type, cast(user_id % 2 as int) parking,
    cast(case when user_id % 3 = 0 then 3000 else floor(amount) * 100 end as int) amount, 3000 t2_amount, cashier, cast(user_id % 5 as int) shift,
    case when event_id % 3 = 0 then timestamp '2000-01-01 00:00:00' else ts - interval '90' minute end other_ts from {gate})"""


def presence(t: Tables):
    return t.presence


def payments(t: Tables):
    c = F.col
    return t.gate.filter("txn_type = 30").select(
        "garage_id", "ticket", "ts", c("event_id").alias("payment_id"), c("amount").cast("decimal(12,2)").alias("cost"),
        (c("amount").cast("decimal(12,2)") - 1).cast("decimal(12,2)").alias("paid"),
    )


def current(t: Tables):
    """Half of the presence rows as those present now."""
    return t.presence.filter("state in (1, 2)")


def history(t: Tables):
    return t.presence.filter("state not in (1, 2)")


def cards(t: Tables):
    # Cards of one segment bear a medium that no presence has.
    return t.customer.select(F.concat(F.when(F.col("c_mktsegment") != "BUILDING", "L").otherwise("none "), "c_custkey").alias("media"))


def holders(t: Tables):
    c = F.col
    return t.customer.select(
        F.concat(F.lit("L"), "c_custkey").alias("media"), c("c_name").alias("card_holder"), c("c_mktsegment").alias("group_name"),
        F.concat(F.lit("C"), c("c_nationkey")).alias("customer_name"),
        F.when(c("c_nationkey") != 3, c("c_nationkey")).alias("customer_id"),
    )


_PERMIT_VISITS = """pv as (
    select presence_id, garage_id, ticket, media, state, entry_ts, case when state = 3 then exit_ts end exit_ts, cost, paid
    from {presence} where state in (3, 4) and ticket <> 0 and cast(exit_ts as date) >= date '2024-01-01' and cast(entry_ts as date) < date '2024-02-01'
      and not (state = 3 and entry_ts = exit_ts)
    union all
    select presence_id, garage_id, ticket, media, state, entry_ts, null, cost, paid from {presence}
    where state = 1 and ticket <> 0 and cast(entry_ts as date) >= date '2023-12-30' and cast(entry_ts as date) < date '2024-02-01'
      and media in (select case when c_mktsegment <> 'BUILDING' then 'L' else 'none ' end || c_custkey from {customer}))"""


@query("permit_visits", f"with {_PERMIT_VISITS} select * replace (cast(cost as double) as cost, cast(paid as double) as paid) from pv")
def permit_visits(t: Tables):
    return vs.permit_visits(history(t), current(t), cards(t), START, END)


# Virtual tickets of a few permits only, so that some gate tickets stay.
def virtual(t: Tables):
    # Tickets of the other customers are moved to numbers that no gate event has.
    return t.presence.select("garage_id", F.when(F.col("customer_id") < 20, F.col("ticket")).otherwise(-F.col("ticket") - 1).alias("ticket"))


_TICKETS = """k as (select distinct garage_id, ticket from g where txn_type in (20, 30, 32, 33, 37, 40)
      and ts >= timestamp '2023-12-30' and ts < timestamp '2024-02-01' and ticket not in (0, 31999, 410000000)
      and (garage_id, ticket) not in (select (garage_id, ticket) from {presence} where customer_id < 20 and ticket <> 0))"""


@query("kp_tickets", f"with {_GATE}, {_TICKETS.replace('(garage_id, ticket) not in (select (garage_id, ticket) from {presence} where customer_id < 20 and ticket <> 0)', 'not exists (select 1 from {presence} p where p.customer_id < 20 and p.ticket <> 0 and p.garage_id = g.garage_id and p.ticket = g.ticket)')} select * from k")
def kp_tickets(t: Tables):
    return vs.kp_tickets(gate(t), [virtual(t), virtual(t)], START, END)


_K = _TICKETS.replace("(garage_id, ticket) not in (select (garage_id, ticket) from {presence} where customer_id < 20 and ticket <> 0)",
                      "not exists (select 1 from {presence} p where p.customer_id < 20 and p.ticket <> 0 and p.garage_id = g.garage_id and p.ticket = g.ticket)")
_KP_VISITS = f"""{_GATE}, {_K},
    e as (select * from (select garage_id, ticket, ts, station, row_number() over (partition by garage_id, ticket order by ts desc, event_id desc) rn
          from g where txn_type = 20 and ts >= timestamp '2023-12-30' and ts < timestamp '2024-02-01') x where rn = 1),
    b as (select k.garage_id, k.ticket, e.ts entry_ts, e.station entry_station, coalesce(e.ts, timestamp '2023-12-30') f
          from k left join e on e.garage_id = k.garage_id and e.ticket = k.ticket),
    x as (select * from (select b.garage_id, b.ticket, g.ts, g.station, row_number() over (partition by b.garage_id, b.ticket order by g.ts, g.event_id) rn
          from b join g on g.garage_id = b.garage_id and g.ticket = b.ticket and g.txn_type in (30, 32) and g.ts >= f and g.ts <= f + interval '48' hour) q where rn = 1),
    p as (select * from (select b.garage_id, b.ticket, cast(g.amount as decimal(12,2)) cost, cast(cast(g.amount as decimal(12,2)) - 1 as decimal(12,2)) paid,
                 row_number() over (partition by b.garage_id, b.ticket order by g.ts, g.event_id) rn
          from b join {{gate}} g on g.garage_id = b.garage_id and g.ticket = b.ticket and g.txn_type = 30 and g.ts >= f and g.ts <= f + interval '48' hour) q where rn = 1),
    kv as (select b.garage_id, b.ticket, b.entry_ts, b.entry_station, x.ts exit_ts, x.station exit_station, case when x.ts is not null then 3 else 4 end state,
                  coalesce(p.cost, 0) cost, coalesce(p.paid, 0) paid
           from b left join x on x.garage_id = b.garage_id and x.ticket = b.ticket left join p on p.garage_id = b.garage_id and p.ticket = b.ticket
           where coalesce(x.ts, b.entry_ts) >= timestamp '2024-01-01')"""


def kp(t: Tables):
    return vs.kp_visits(gate(t), payments(t), vs.kp_tickets(gate(t), [virtual(t)], START, END), START, END)


@query("kp_visits", f"with {_KP_VISITS} select * replace (cast(cost as double) as cost, cast(paid as double) as paid) from kv")
def kp_visits(t: Tables):
    return kp(t)


@query("visit_report", f"""with {_KP_VISITS}, {_PERMIT_VISITS}
    select 'PERMIT' visit_type, garage_id, cast(presence_id as varchar) visit_key, ticket, media card_number, entry_ts, exit_ts,
           date_diff('minute', entry_ts, exit_ts) duration_minutes, cast(cost as double) cost, cast(paid as double) paid,
           case state when 1 then 'Currently Parked' when 3 then 'Paired' when 4 then 'Lost Exit' end pair_status from pv
    union all
    select 'KP', garage_id, cast(ticket as varchar), ticket, null, entry_ts, exit_ts, date_diff('minute', entry_ts, exit_ts), cast(cost as double), cast(paid as double),
           case state when 3 then 'Paired' else 'No Exit Found' end from kv""")
def visit_report(t: Tables):
    return vs.visit_report(vs.permit_visits(history(t), current(t), cards(t), START, END), kp(t)).orderBy("entry_ts")


@query("tickets_with_activity", f"""with {_GATE} select distinct garage_id, ticket from g where txn_type in (20, 30, 31, 33, 37, 40)
    and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and ticket not in (0, 31999, 410000000)""")
def tickets_with_activity(t: Tables):
    return vs.tickets_with_activity(gate(t), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


A, B = "2024-01-08 00:00:00", "2024-01-22 00:00:00"


def _pick(name: str, types: str, lo: str, hi: str, order: str, op: str) -> str:
    return f"""{name} as (select * from (select *, row_number() over (partition by garage_id, ticket order by ts {order}, event_id {order}) rn from g
        where txn_type in ({types}) and ts >= timestamp '{lo}' and ts {op} timestamp '{hi}') q where rn = 1)"""


_PICKS = {
    "v1": f"""a as (select distinct garage_id, ticket from g where ts >= timestamp '{A}' and ts < timestamp '{B}'),
        {_pick('e', '20', '2024-01-01 00:00:00', B, 'desc', '<')}, {_pick('x', '30', A, '2024-01-29 00:00:00', 'asc', '<')},
        {_pick('f', '31, 33, 37, 40', A, '2024-01-29 00:00:00', 'asc', '<')}""",
    "v3": f"""a as (select distinct garage_id, ticket from g where ts >= timestamp '{A}' and ts <= timestamp '{B}'),
        {_pick('e', '20', A, B, 'desc', '<=')}, {_pick('x', '30', A, B, 'desc', '<=')}, {_pick('f', '31, 33, 37, 40', A, B, 'desc', '<=')}""",
}
_ON = "on {0}.garage_id = a.garage_id and {0}.ticket = a.ticket"


def _picked(variant: str) -> str:
    return f"""with {_GATE}, {_PICKS[variant]} select a.garage_id, a.ticket, e.ts e_ts, x.ts x_ts, f.ts f_ts, e.station e_station, x.amount x_amount, f.txn_type f_type
        from a left join e {_ON.format('e')} left join x {_ON.format('x')} left join f {_ON.format('f')}"""


def _flat(picks):
    c = F.col
    return picks.select(
        "garage_id", "ticket", c("e.ts").alias("e_ts"), c("x.ts").alias("x_ts"), c("f.ts").alias("f_ts"), c("e.station").alias("e_station"),
        c("x.amount").alias("x_amount"), c("f.txn_type").alias("f_type"),
    )


@query("pick_events_v1", _picked("v1"))
def pick_events_v1(t: Tables):
    return _flat(vs.pick_events(gate(t), A, B, "v1"))


@query("pick_events_v3", _picked("v3"))
def pick_events_v3(t: Tables):
    return _flat(vs.pick_events(gate(t), A, B, "v3"))


def gate_like_presence(t: Tables):
    """Presence rows as gate events too, so that movements and gate visits meet: state 4 has no entry, state 5 no exit."""
    return t.sql("""
        select presence_id * 2 event_id, garage_id, ticket, 20 txn_type, entry_ts ts, concat('E', cast(garage_id as varchar(5))) station,
               cast(presence_id % 13 - 2 as int) ticket_type, cast(presence_id % 2 as int) parking, 0 amount, 0 t2_amount, 0 cashier, 0 shift, entry_ts other_ts
        from {presence} where state <> 4
        union all
        select presence_id * 2 + 1, garage_id, ticket, case when presence_id % 3 = 0 then 31 else 30 end, exit_ts, concat('A', cast(garage_id as varchar(5))),
               case when presence_id % 2 = 0 then -1 else cast(presence_id % 13 - 2 as int) end, cast(presence_id % 2 as int),
               case when presence_id % 5 = 0 then 3000 else 0 end, 3000, cast(presence_id % 3 as int), 1,
               case when presence_id % 7 = 0 then timestamp '2000-01-01 00:00:00' else exit_ts - interval '70' minute end
        from {presence} where state <> 5""")


_GATE_LIKE = """g as (
        select presence_id * 2 event_id, garage_id, ticket, 20 txn_type, entry_ts ts, 'E' || garage_id station,
               cast(presence_id % 13 - 2 as int) ticket_type, cast(presence_id % 2 as int) parking, 0 amount, 0 t2_amount, 0 cashier, 0 shift, entry_ts other_ts
        from {presence} where state <> 4
        union all
        select presence_id * 2 + 1, garage_id, ticket, case when presence_id % 3 = 0 then 31 else 30 end, exit_ts, 'A' || garage_id,
               case when presence_id % 2 = 0 then -1 else cast(presence_id % 13 - 2 as int) end, cast(presence_id % 2 as int),
               case when presence_id % 5 = 0 then 3000 else 0 end, 3000, cast(presence_id % 3 as int), 1,
               case when presence_id % 7 = 0 then timestamp '2000-01-01 00:00:00' else exit_ts - interval '70' minute end
        from {presence} where state <> 5)"""

_HOLDERS = """h as (select 'L' || c_custkey media, c_name card_holder, c_mktsegment group_name, 'C' || c_nationkey customer_name,
    case when c_nationkey <> 3 then c_nationkey end customer_id from {customer})"""

_MOVES = {
    "v1": f"""m0 as (select garage_id, ticket, media, entry_ts, exit_ts, state from {{presence}}
                 where state not in (1, 2) and ticket <> 0 and entry_ts <> exit_ts and entry_ts < timestamp '{B}' and exit_ts >= timestamp '{A}'),
        m1 as (select garage_id, ticket, media, entry_ts, cast(null as timestamp) exit_ts, state from {{presence}}
                 where state = 1 and ticket <> 0 and cast(entry_ts as date) < timestamp '{B}')""",
    "v3": f"""m0 as (select garage_id, ticket, media, case when entry_ts between timestamp '{A}' and timestamp '{B}' then entry_ts end entry_ts,
                        case when exit_ts between timestamp '{A}' and timestamp '{B}' then exit_ts end exit_ts, state from {{presence}}
                 where state not in (1, 2) and ticket <> 0 and entry_ts <> exit_ts
                   and (entry_ts between timestamp '{A}' and timestamp '{B}' or exit_ts between timestamp '{A}' and timestamp '{B}')),
        m1 as (select garage_id, ticket, media, entry_ts, cast(null as timestamp) exit_ts, state from {{presence}}
                 where state = 1 and ticket <> 0 and entry_ts between timestamp '{A}' and timestamp '{B}')""",
}
_M = """m as (select m0.garage_id, m0.ticket, m0.media, entry_ts, exit_ts, card_holder, group_name, customer_name, customer_id, state from m0 left join h on h.media = m0.media
         union
         select m1.garage_id, m1.ticket, m1.media, entry_ts, exit_ts, card_holder, group_name, customer_name, customer_id, state from m1 join h on h.media = m1.media where customer_id is not null)"""


@query("permit_movements_v1", f"with {_HOLDERS}, {_MOVES['v1']}, {_M} select * from m")
def permit_movements_v1(t: Tables):
    return vs.permit_movements(history(t), current(t), holders(t), A, B, "v1")


@query("permit_movements_v3", f"with {_HOLDERS}, {_MOVES['v3']}, {_M} select * from m")
def permit_movements_v3(t: Tables):
    return vs.permit_movements(history(t), current(t), holders(t), A, B, "v3")


def joined(t: Tables, variant: str):
    picks = vs.pick_events(gate_like_presence(t), A, B, variant)
    return vs.visit_full_outer(picks, vs.permit_movements(history(t), current(t), holders(t), A, B, variant), variant)


def _assembled_sql(variant: str) -> str:
    extra = " or f.ts = m.exit_ts" if variant == "v3" else ""
    if variant == "v1":
        permit_rules = "when m.ticket is not null and m.exit_ts is not null then 'Complete'"
    else:
        permit_rules = """when m.ticket is not null and m.entry_ts is not null and m.exit_ts is not null then 'Complete'
            when m.ticket is not null and m.entry_ts is null then 'Exit Only'"""
    imputed = "when e.ts is not null and x.ts is null and f.ts is null and m.exit_ts is null and m.entry_ts is null then 'imputed'" if variant == "v1" else ""
    types = """case c when -1 then 'lost ticket' when -11 then 'manual ticket' when 0 then 'KP' when 1 then 'value card' when 2 then 'normal DP' when 3 then 'congress'
        when 4 then 'visitor' when 5 then 'fixed time per day' when 7 then 'fixed number of entries' when 8 then 'pool car' end"""
    return f"""{_GATE_LIKE}, {_PICKS[variant]}, {_HOLDERS}, {_MOVES[variant]}, {_M},
      p as (select a.garage_id, a.ticket, e e, x x, f f from a left join e {_ON.format('e')} left join x {_ON.format('x')} left join f {_ON.format('f')}),
      j as (select coalesce(p.garage_id, m.garage_id) garage_id, coalesce(p.ticket, m.ticket) ticket, p.ticket gticket, p.e e, p.x x, p.f f, m m
            from p full outer join m on p.garage_id = m.garage_id and p.ticket = m.ticket
                 and (p.e.ts = m.entry_ts or p.x.ts = m.exit_ts {extra.replace('f.ts', 'p.f.ts')})),
      asm as (select garage_id, ticket,
        case when e.ts is not null and (x.ts is not null or f.ts is not null) then 'Complete' {permit_rules}
             when m.ticket is not null and m.exit_ts is null then 'Entry Only - Permit Holder'
             when e.ts is not null and x.ts is null and f.ts is null then 'Entry Only'
             when (x.ts is not null or f.ts is not null) and e.ts is null then 'Exit Only' else 'Unknown' end status,
        coalesce(m.entry_ts, e.ts) entry_ts,
        case when e.ts is not null then null when x.other_ts >= timestamp '2000-01-02' then x.other_ts when f.other_ts >= timestamp '2000-01-02' then f.other_ts
             when x.other_ts = timestamp '2000-01-01' and f.other_ts = timestamp '2000-01-01' then x.ts - interval '204' minute end entry_guess,
        coalesce(m.exit_ts, x.ts) exit_ts, coalesce(f.ts, m.exit_ts) attempt_ts, coalesce(x.other_ts, f.other_ts) exit_other_ts,
        coalesce(x.txn_type, f.txn_type) exit_txn_type, e.ticket_type entry_ticket_type, {types.replace('case c', 'case e.ticket_type')} entry_ticket_desc,
        coalesce(x.ticket_type, f.ticket_type) exit_ticket_type,
        case when coalesce(x.ticket_type, f.ticket_type) is not null then coalesce({types.replace('case c', 'case coalesce(x.ticket_type, f.ticket_type)')}, 'unknown') end exit_ticket_desc,
        case when e.ts is null then
          case when coalesce(x.ticket_type, f.ticket_type) = -1 and coalesce(x.amount, f.amount) = 0 and coalesce(x.t2_amount, f.t2_amount) = 3000 and coalesce(x.cashier, f.cashier) = 0 then 'lost ticket: POF'
               when coalesce(x.ticket_type, f.ticket_type) = -1 and coalesce(x.amount, f.amount) <> 3000 and coalesce(x.cashier, f.cashier) = 0 then 'lost ticket: help line'
               when coalesce(x.ticket_type, f.ticket_type) = -1 and coalesce(x.amount, f.amount) = 3000 and coalesce(x.cashier, f.cashier) <> 0 then 'lost ticket: cashier'
               when coalesce(x.ticket_type, f.ticket_type) = -1 and coalesce(x.amount, f.amount) <> 3000 and coalesce(x.cashier, f.cashier) <> 0 then 'manual: cashier'
               when coalesce(x.ticket_type, f.ticket_type) = 0 and coalesce(x.parking, f.parking) = 0 and coalesce(x.amount, f.amount) = 3000 and coalesce(x.cashier, f.cashier) = 0 then 'lost ticket: help line'
               when substr(cast(coalesce(x.ticket, f.ticket) as varchar), 3, 1) = '9' then 'permit: no entry found'
               when coalesce(x.ticket_type, f.ticket_type) = -11 and coalesce(x.cashier, f.cashier) <> 0 then 'manual: cashier'
               when coalesce(x.ticket_type, f.ticket_type) = 0 and coalesce(x.cashier, f.cashier) = 0 then 'manual: help line'
               when substr(cast(coalesce(x.ticket, f.ticket) as varchar), 3, 3) = '000' and x.txn_type = 30 and m.media is not null then 'permit: manual help line exit'
               when m.media is not null and coalesce(x.parking, f.parking) = 1 and x.txn_type = 30 then 'permit: manual exit' end
          {imputed} end exit_classification,
        cast(coalesce(x.amount, f.amount) / 100.0 as double) amount, coalesce(x.cashier, f.cashier) cashier,
        e.station entry_station, x.station exit_station, f.station attempt_station, m.media permit_number, m.customer_id customer_id,
        case when m.media is null then 'transient' when m.customer_id = {EMPLOYER} then 'employee' else 'permit' end customer_type
      from j)"""


_ASM_COLUMNS = ["garage_id", "ticket", "status", "entry_ts", "entry_guess", "exit_ts", "attempt_ts", "exit_other_ts", "exit_txn_type", "entry_ticket_type",
                "entry_ticket_desc", "exit_ticket_type", "exit_ticket_desc", "exit_classification", "amount", "cashier", "entry_station", "exit_station",
                "attempt_station", "permit_number", "customer_id", "customer_type"]


def assembled(t: Tables, variant: str):
    return vs.assemble_visits(joined(t, variant), employee_customer=EMPLOYER, variant=variant)


for _v in ("v1", "v3"):
    query(f"assemble_visits_{_v}", f"with {_assembled_sql(_v)} select {', '.join(_ASM_COLUMNS)} from asm")(
        lambda t, v=_v: assembled(t, v).select(*_ASM_COLUMNS)
    )


def _ticket_alone(sql: str) -> str:
    """The same text with the garage left out of every key and taken from the first side that has one."""
    for old, new in (("partition by garage_id, ticket", "partition by ticket"), ("select distinct garage_id, ticket from g", "select distinct ticket from g"),
                     ("select a.garage_id, a.ticket", "select a.ticket"), ("coalesce(p.garage_id, m.garage_id) garage_id", "coalesce(p.e.garage_id, p.x.garage_id, p.f.garage_id, m.garage_id) garage_id"),
                     ("p.garage_id = m.garage_id and ", ""), *((f"{n}.garage_id = a.garage_id and ", "") for n in "exf")):
        sql = sql.replace(old, new)
    return sql


for _v in ("v1", "v3"):
    query(f"assemble_visits_by_ticket_{_v}" if _v == "v3" else "assemble_visits_by_ticket", f"with {_ticket_alone(_assembled_sql(_v))} select {', '.join(_ASM_COLUMNS)} from asm")(
        lambda t, v=_v: vs.assemble_visits(
            vs.pair_by_ticket(gate_like_presence(t), vs.permit_movements(history(t), current(t), holders(t), A, B, v), A, B, v), employee_customer=EMPLOYER, variant=v).select(*_ASM_COLUMNS)
    )

AS_OF = "2024-01-21 15:00:00"
_ODD = "(status = 'Exit Only' and (entry_guess > exit_ts or date_diff('day', entry_guess, exit_ts) > 8))"
_SHORT = ["garage_id", "ticket", "trip_id", "status", "entry_ts", "exit_ts", "length_of_stay", "impute_duration", "customer_type", "exit_classification"]


def _trip(entry: str) -> str:
    return f"upper(md5(garage_id || '_' || ticket || '_' || coalesce(strftime({entry}, '%Y-%m-%d %H:%M:%S.%g'), 'NULL')))"


_FINAL = {
    "v1": f"""select garage_id, ticket, {_trip('fin_entry')} trip_id, status, fin_entry entry_ts,
          case when status = 'Entry Only' and entry_ts >= timestamp '2024-01-21' then null when status = 'Entry Only' then entry_ts + interval '204' minute
               else coalesce(exit_ts, attempt_ts) end exit_ts,
          case when odd or status = 'Entry Only' then cast(204 as double)
               else cast(date_diff('second', coalesce(entry_ts, entry_guess), coalesce(exit_ts, attempt_ts)) as double) / 60.0 end length_of_stay,
          case when odd or status = 'Entry Only' or (status = 'Exit Only' and exit_other_ts = timestamp '2000-01-01') then cast(204 as double) end impute_duration,
          customer_type, exit_classification
      from (select *, case when odd then exit_ts - interval '204' minute else coalesce(entry_ts, entry_guess) end fin_entry
            from (select *, coalesce({_ODD}, false) odd from asm) q) r""",
    "v3": f"""select garage_id, ticket, {_trip('fin_entry')} trip_id, status, case when status = 'Exit Only' then null else coalesce(entry_ts, entry_guess) end entry_ts,
          case when status = 'Entry Only' and entry_ts >= timestamp '2024-01-21' then null else coalesce(exit_ts, attempt_ts) end exit_ts,
          case when status = 'Exit Only' or status like 'Entry Only%' then null
               else cast(date_diff('second', coalesce(entry_ts, entry_guess), coalesce(exit_ts, attempt_ts)) as double) / 60.0 end length_of_stay,
          cast(null as double) impute_duration, customer_type, exit_classification
      from (select *, case when odd then exit_ts - interval '204' minute else coalesce(entry_ts, entry_guess) end fin_entry
            from (select *, coalesce({_ODD}, false) odd from asm) q) r""",
}


@query("impute_visits", f"with {_assembled_sql('v1')} {_FINAL['v1']}")
def impute_visits(t: Tables):
    return vs.impute_visits(assembled(t, "v1"), AS_OF).select(*_SHORT)


@query("finalize_visits_v3", f"with {_assembled_sql('v3')} {_FINAL['v3']}")
def finalize_visits_v3(t: Tables):
    return vs.finalize_visits_v3(assembled(t, "v3"), AS_OF).select(*_SHORT)


# New and stored visits with all status pairs, both from orders: the stored ones are a shifted, thinned copy.
_STATUS = "case {0} % 4 when 0 then 'Complete' when 1 then 'Entry Only' when 2 then 'Entry Only - Permit Holder' else 'Exit Only' end"


def _visit_sql(which: str) -> str:
    k, keep, minutes = ("o_orderkey", "true", "0") if which == "new" else ("(o_orderkey / 4)", "o_orderpriority <> '5-LOW'", "case when o_orderkey % 3 = 0 then 0 else 45 end")
    if which == "stored":
        k = "cast(floor(o_orderkey / 4) as bigint)"
    status = _STATUS.format(k)
    entry = f"o_orderdate + (o_orderkey * 37 % 1440 - {minutes}) * interval '1' minute"
    left = f"o_orderdate + (o_orderkey * 37 % 1440 + 20 + o_custkey % 600 - {minutes}) * interval '1' minute"
    return f"""select concat('{which}-', cast(o_orderkey as varchar(20))) trip_id, cast(o_custkey % 7 + 1 as int) garage_id, o_orderkey + 1000000 ticket,
        {status} status, case when {k} % 4 <> 3 then {entry} end entry_ts, case when {k} % 4 in (0, 3) then {left} end exit_ts,
        cast(null as double) length_of_stay, cast(null as double) impute_duration, case when o_custkey % 3 = 0 then 'permit' else 'transient' end customer_type,
        cast(o_custkey % 50 as int) cashier, o_orderdate + 2 * interval '1' day load_ts, cast(null as timestamp) update_ts
        from {{orders}} where {keep}"""


def new_visits(t: Tables):
    return t.sql(_visit_sql("new"))


def stored_visits(t: Tables):
    return t.sql(_visit_sql("stored"))


_RECON = f"""nv as ({_visit_sql('new')}), sv as ({_visit_sql('stored')}),
    cand as (select n.trip_id, s.trip_id sid, s.status ss, s.entry_ts se, s.exit_ts sx,
               case when n.exit_ts = s.exit_ts then 1 when n.entry_ts = s.entry_ts then 2 when s.entry_ts is null or s.exit_ts is null then 3
                    else 4 end pr,
               coalesce(abs(date_diff('minute', s.exit_ts, coalesce(n.entry_ts, n.exit_ts))), 99999) > 7 * 1440 far
             from nv n join sv s on s.garage_id = n.garage_id and s.ticket = n.ticket),
    best as (select * from (select *, row_number() over (partition by trip_id order by pr, coalesce(se, sx) desc, sid desc) rn from cand where pr is not null) q where rn = 1),
    r as (select n.*, b.sid stored_trip_id, b.ss stored_status, b.se stored_entry_ts, b.sx stored_exit_ts,
            case when b.pr = 4 and b.far then 'Report' when b.ss is null then case n.status when 'Complete' then 'Insert 2' when 'Entry Only' then 'Insert 3' when 'Entry Only - Permit Holder' then 'Insert 4' else 'Insert 5' end
                 when n.status = 'Complete' then case b.ss when 'Complete' then 'Ignore 1' when 'Entry Only' then 'Update 2' when 'Entry Only - Permit Holder' then 'Update 3'
                      else case when n.exit_ts = b.sx then 'Ignore' else 'Insert 6' end end
                 when n.status = 'Entry Only' then case b.ss when 'Complete' then case when n.entry_ts = b.se then 'Ignore' else 'Insert 8' end when 'Entry Only' then 'Update 4' else 'Report' end
                 when n.status = 'Entry Only - Permit Holder' then case b.ss when 'Complete' then case when n.entry_ts = b.se then 'Ignore' else 'Insert 7' end
                      when 'Entry Only - Permit Holder' then 'Update 5' else 'Report' end
                 else case b.ss when 'Complete' then case when n.exit_ts = b.sx then 'Ignore 2' else 'Update 1' end when 'Entry Only' then 'Update 6'
                      when 'Entry Only - Permit Holder' then 'Update 7' else case when n.exit_ts = b.sx then 'Update 8' else 'Insert 1' end end end handler
          from nv n left join best b on b.trip_id = n.trip_id)"""


@query("reconcile_visits", f"with {_RECON} select trip_id, status, stored_trip_id, stored_status, stored_entry_ts, stored_exit_ts, handler from r")
def reconcile_visits(t: Tables):
    return vs.reconcile_visits(new_visits(t), stored_visits(t)).select(
        "trip_id", "status", "stored_trip_id", "stored_status", "stored_entry_ts", "stored_exit_ts", "handler")


@query("visit_status_crosstab", f"""with {_RECON} select status, count(*) filter (stored_status = 'Complete') complete, count(*) filter (stored_status = 'Entry Only') entry_only,
    count(*) filter (stored_status = 'Entry Only - Permit Holder') entry_only_permit_holder, count(*) filter (stored_status = 'Exit Only') exit_only,
    count(*) filter (stored_status is null) "none" from r group by status""")
def visit_status_crosstab(t: Tables):
    return rp.visit_status_crosstab(vs.reconcile_visits(new_visits(t), stored_visits(t)))


NOW = "2002-01-01 00:00:00"
_KEEP = "trip_id, garage_id, ticket, status, entry_ts, exit_ts, length_of_stay, impute_duration, cashier, update_ts"


@query("apply_visit_updates", f"""with {_RECON},
    u as (select stored_trip_id trip_id, exit_ts ux, cashier uc from r where handler in ('Update 1', 'Update 2', 'Update 6', 'Update 7'))
    select s.trip_id, s.garage_id, s.ticket, case when u.trip_id is not null then 'Complete' else s.status end status, s.entry_ts,
           case when u.trip_id is not null then ux else s.exit_ts end exit_ts,
           case when u.trip_id is not null then cast(date_diff('second', s.entry_ts, ux) as double) / 60.0 else s.length_of_stay end length_of_stay,
           cast(null as double) impute_duration, case when u.trip_id is not null then uc else s.cashier end cashier,
           case when u.trip_id is not null then timestamp '{NOW}' end update_ts
    from sv s left join u on u.trip_id = s.trip_id
    union all
    select case when handler in ('Insert 1', 'Insert 5') then {_trip("(exit_ts - interval '204' minute)")} else trip_id end, garage_id, ticket, status,
           case when handler in ('Insert 1', 'Insert 5') then exit_ts - interval '204' minute else entry_ts end, exit_ts,
           case when handler in ('Insert 1', 'Insert 5') then cast(204 as double) else length_of_stay end, case when handler in ('Insert 1', 'Insert 5') then cast(204 as double) end, cashier, null
    from r where handler like 'Insert%'""")
def apply_visit_updates(t: Tables):
    stored = stored_visits(t)
    done = vs.apply_visit_updates(stored, vs.reconcile_visits(new_visits(t), stored), NOW)
    return done.select(*[c.strip() for c in _KEEP.split(",")])


@query("visit_upsert", like="apply_visit_updates")
def visit_upsert(t: Tables):
    """The stored visits with only the changed and new ones put in by id."""
    stored = stored_visits(t)
    changes = vs.visit_changes(stored, vs.reconcile_visits(new_visits(t), stored), NOW)
    return merged(stored, changes, ["trip_id"]).select(*[c.strip() for c in _KEEP.split(",")])


_UNRECONCILED = f"""{_RECON}, ins as (select case when handler in ('Insert 1', 'Insert 5') then {_trip("(exit_ts - interval '204' minute)")} else trip_id end tid, trip_id, status, handler, exit_ts from r where handler like 'Insert%'),
    ord as (select *, row_number() over (partition by tid order by exit_ts desc nulls last, status desc, trip_id desc) rn from ins),
    un as (select trip_id, status, handler, case when stored_status = 'Complete' then 'stored visit too far away' else 'no rule' end reason from r where handler = 'Report'
           union all select trip_id, status, handler, case when tid in (select trip_id from sv) then 'id already stored' else 'id repeated in the batch' end from ord
           where rn > 1 or tid in (select trip_id from sv))"""


@query("unreconciled_visits", f"with {_UNRECONCILED} select * from un")
def unreconciled_visits(t: Tables):
    stored = stored_visits(t)
    return vs.unreconciled_visits(stored, vs.reconcile_visits(new_visits(t), stored), NOW)


@query("visit_conservation", f"""with {_UNRECONCILED} select count(*) n_new, count(*) filter (handler like 'Ignore%') ignored, count(*) filter (handler like 'Update%') updated,
    (select count(*) from ord where rn = 1 and tid not in (select trip_id from sv)) inserted, (select count(*) from un) unreconciled,
    count(*) - count(*) filter (handler like 'Ignore%') - count(*) filter (handler like 'Update%') - (select count(*) from ord where rn = 1 and tid not in (select trip_id from sv))
      - (select count(*) from un) lost from r""")
def visit_conservation(t: Tables):
    stored = written(stored_visits(t), "stored")
    done = written(vs.reconcile_visits(new_visits(t), stored), "reconciled")
    before, after = stored.count(), vs.apply_visit_updates(stored, done, NOW).count()
    left = vs.unreconciled_visits(stored, done, NOW).count()
    n = lambda kind: F.count(F.when(F.col("handler").startswith(kind), 1))
    return done.agg(F.count(F.lit(1)).alias("n_new"), n("Ignore").alias("ignored"), n("Update").alias("updated")).select(
        "*", F.lit(after - before).alias("inserted"), F.lit(left).alias("unreconciled"),
        (F.col("n_new") - F.col("ignored") - F.col("updated") - (after - before) - left).alias("lost"))


STALE = "1999-06-01 00:00:00"


@query("close_stale_visits", f"""with sv as ({_visit_sql('stored')}),
    q as (select *, customer_type = 'transient' and status = 'Entry Only' and exit_ts is null and entry_ts <= timestamp '{STALE}' - interval '48' hour a,
                 coalesce(customer_type = 'transient' and status = 'Exit Only' and entry_ts is null and exit_ts <= timestamp '{STALE}' - interval '24' hour, false) b from sv)
    select case when b then {_trip("(exit_ts - interval '204' minute)")} else trip_id end trip_id, garage_id, ticket, status,
           case when b then exit_ts - interval '204' minute else entry_ts end entry_ts, case when coalesce(a, false) then entry_ts + interval '204' minute else exit_ts end exit_ts,
           case when coalesce(a or b, false) then cast(204 as double) end length_of_stay, case when coalesce(a or b, false) then cast(204 as double) end impute_duration, cashier,
           case when coalesce(a or b, false) then timestamp '{STALE}' end update_ts from q""")
def close_stale_visits(t: Tables):
    return vs.close_stale_visits(stored_visits(t), STALE).select(*[c.strip() for c in _KEEP.split(",")])


@query("stale_upsert", like="close_stale_visits")
def stale_upsert(t: Tables):
    stored = stored_visits(t)
    changes, gone = vs.stale_changes(stored, STALE)
    return merged(stored, changes, ["trip_id"], gone).select(*[c.strip() for c in _KEEP.split(",")])


@query("stale_minutes", f"""with sv as ({_visit_sql('stored')}),
    q as (select garage_id, customer_type, entry_ts a, entry_ts + interval '204' minute b from sv
          where customer_type = 'transient' and status = 'Entry Only' and exit_ts is null and entry_ts <= timestamp '{STALE}' - interval '48' hour
          union all select garage_id, customer_type, exit_ts - interval '204' minute, exit_ts from sv
          where customer_type = 'transient' and status = 'Exit Only' and entry_ts is null and exit_ts <= timestamp '{STALE}' - interval '24' hour)
    select garage_id, count(*) visits, cast(sum(date_diff('minute', a, b) + 1) as bigint) car_minutes from q group by 1""")
def stale_minutes(t: Tables):
    marks = vs.stale_minutes(vs.close_stale_visits(stored_visits(t), STALE))
    return marks.groupBy("garage_id").agg(
        F.count_if(F.col("delta") == 1).alias("visits"), (-F.sum(F.col("minute") * F.col("delta"))).alias("car_minutes"))
