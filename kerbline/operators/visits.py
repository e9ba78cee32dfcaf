"""Pairing gate events and permit movements into visits: J7, J8, V1-V13.

Gate events carry garage_id, ticket, txn_type, ts, station, ticket_type,
parking, amount, t2_amount, cashier, shift and other_ts (the second time stamp
an exit row has). Movements carry garage_id, ticket, media, entry_ts, exit_ts
and the holder's names. Picks are grouped max_by and min_by, so a ticket with
very many events leaves each map task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import stays as st
from kerbline.functions import timeparts as tp
from kerbline.operators.lookups import anti_join_presence

TICKET = ["garage_id", "ticket"]
GATE_DETAIL = ["ts", "txn_type", "station", "ticket_type", "parking", "amount", "t2_amount", "cashier", "shift", "other_ts"]
NO_OTHER_TIME = "2000-01-01"


def _ntz(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(tp.NTZ)


def _shifted(value, hours: int) -> Column:
    return tp.add_minutes(_ntz(value), hours * 60)


# --- permit and ticket visits of a report range -------------------------------------------------

def permit_visits(history: DataFrame, current: DataFrame, cards: DataFrame, start: str, end: str) -> DataFrame:
    """V1: closed permit visits (states 3 and 4) and open ones (state 1) whose card still exists.

    `cards` holds the media numbers of cards that have a group and a customer.
    """
    c = F.col
    ceiling, floor = _shifted(end, 24), _shifted(start, -48)
    whole = c("state") == 3
    closed = history.filter(
        c("state").isin(3, 4) & (c("ticket") != 0)
        & (F.to_date("exit_ts") >= F.to_date(_ntz(start))) & (F.to_date("entry_ts") < F.to_date(ceiling))
        & ~(whole & (c("entry_ts") == c("exit_ts")))
    ).withColumn("exit_ts", F.when(whole, c("exit_ts")))
    still_in = current.filter(
        (c("state") == 1) & (c("ticket") != 0) & (F.to_date("entry_ts") >= F.to_date(floor)) & (F.to_date("entry_ts") < F.to_date(ceiling))
    ).join(cards.select("media").distinct(), "media", "left_semi").withColumn("exit_ts", F.lit(None).cast(tp.NTZ))
    columns = ["presence_id", "garage_id", "ticket", "media", "state", "entry_ts", "exit_ts", "cost", "paid"]
    return closed.select(*columns).unionByName(still_in.select(*columns))


def kp_tickets(gate: DataFrame, presence: list[DataFrame], start: str, end: str) -> DataFrame:
    """V2: tickets active from 48 hours before the range, without sentinels and permit virtual tickets."""
    c = F.col
    active = gate.filter(
        c("txn_type").isin(*st.PAIRING_TYPES) & (c("ts") >= _shifted(start, -48)) & (c("ts") < _shifted(end, 24))
        & ~c("ticket").isin(*st.SENTINEL_TICKETS)
    ).select(*TICKET).distinct()
    return anti_join_presence(active, *presence, keys=TICKET)


def last_before(events: DataFrame, keys: list[str], wanted: Column, columns: list[str], order: list[str]) -> DataFrame:
    """The latest wanted event per key, as one struct column `pick`."""
    return events.filter(wanted).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("pick"))


def first_after(base: DataFrame, events: DataFrame, keys: list[str], base_ts: str, hours: int, columns: list[str], order: list[str]) -> DataFrame:
    """Per base row, the earliest event from its time to `hours` later, as one struct column `pick`.

    Base rows are unique per key, so the pick is a grouped minimum over the matching events.
    """
    anchored = events.join(base.select(*keys, F.col(base_ts).alias("_from")), keys)
    near = anchored.filter((F.col("ts") >= F.col("_from")) & (F.col("ts") <= tp.add_minutes(F.col("_from"), hours * 60)))
    return near.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("pick"))


def kp_visits(gate: DataFrame, payments: DataFrame, tickets: DataFrame, start: str, end: str) -> DataFrame:
    """V3: per ticket the latest entry, then the first exit and first payment within 48 hours of it."""
    c = F.col
    floor, ceiling = _shifted(start, -48), _shifted(end, 24)
    entry = last_before(
        gate, TICKET, (c("txn_type") == st.ENTRY_TYPE) & (c("ts") >= floor) & (c("ts") < ceiling), ["ts", "station"], ["ts", "event_id"]
    )
    base = tickets.join(entry, TICKET, "left").select(
        *TICKET, c("pick.ts").alias("entry_ts"), c("pick.station").alias("entry_station"), F.coalesce("pick.ts", floor).alias("_from")
    )
    # Every base time lies in [floor, ceiling), so nothing outside is within 48 hours after one.
    reach = (c("ts") >= floor) & (c("ts") <= tp.add_minutes(ceiling, 48 * 60))
    left = first_after(base, gate.filter(c("txn_type").isin(*st.PAIRING_EXITS) & reach), TICKET, "_from", 48, ["ts", "station"], ["ts", "event_id"])
    paid = first_after(base, payments.filter(reach), TICKET, "_from", 48, ["cost", "paid"], ["ts", "payment_id"])
    joined = base.join(left.withColumnRenamed("pick", "x"), TICKET, "left").join(paid.withColumnRenamed("pick", "p"), TICKET, "left")
    exit_ts = c("x.ts")
    return joined.filter(F.coalesce(exit_ts, c("entry_ts")) >= _ntz(start)).select(
        *TICKET, "entry_ts", "entry_station", exit_ts.alias("exit_ts"), c("x.station").alias("exit_station"),
        F.when(exit_ts.isNotNull(), 3).otherwise(4).alias("state"),
        F.coalesce(c("p.cost"), F.lit(0)).alias("cost"), F.coalesce(c("p.paid"), F.lit(0)).alias("paid"),
    )


def visit_report(permit: DataFrame, kp: DataFrame) -> DataFrame:
    """V4: permit and ticket visits in one list, with minutes and pairing status."""
    c = F.col
    none = F.lit(None).cast("string")
    permit_status = F.when(c("state") == 1, "Currently Parked").when(c("state") == 3, "Paired").when(c("state") == 4, "Lost Exit")
    kp_status = F.when(c("state") == 3, "Paired").otherwise("No Exit Found")

    def rows(df: DataFrame, kind: str, key: Column, media: Column, status: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("visit_type"), "garage_id", key.cast("string").alias("visit_key"), "ticket", media.alias("card_number"),
            "entry_ts", "exit_ts", tp.datediff_minute(c("entry_ts"), c("exit_ts")).alias("duration_minutes"), "cost", "paid",
            status.alias("pair_status"),
        )

    return rows(permit, "PERMIT", c("presence_id"), c("media"), permit_status).unionByName(rows(kp, "KP", c("ticket"), none, kp_status))


# --- gate visits joined with permit movements ---------------------------------------------------

def tickets_with_activity(gate: DataFrame, start: str, end: str) -> DataFrame:
    """V5: distinct tickets with any entry, exit or attempt in the range."""
    c = F.col
    return gate.filter(
        c("txn_type").isin(*st.ACTIVITY_TYPES) & (c("ts") >= _ntz(start)) & (c("ts") < _ntz(end)) & ~c("ticket").isin(*st.SENTINEL_TICKETS)
    ).select(*TICKET).distinct()


def pick_events(gate: DataFrame, start: str, end: str, variant: str = "v1", keys: list[str] | None = None) -> DataFrame:
    """V6: per active ticket its entry (e), exit (x) and attempted exit (f), in one grouped pass.

    v1 looks a week back for the latest entry and a week ahead for the earliest
    exit and attempt; v3 takes the latest of each inside the range, both ends in.
    """
    c = F.col
    keys = keys or TICKET
    ts, kind = c("ts"), c("txn_type")
    if variant == "v1":
        inside = (ts >= _ntz(start)) & (ts < _ntz(end))
        entry_when = (ts >= _shifted(start, -7 * 24)) & (ts < _ntz(end))
        exit_when = (ts >= _ntz(start)) & (ts < _shifted(end, 7 * 24))
        take_exit = F.min_by
    elif variant == "v3":
        inside = entry_when = exit_when = ts.between(_ntz(start), _ntz(end))
        take_exit = F.max_by
    else:
        raise ValueError(f"variant must be v1 or v3, not {variant!r}")
    at = F.struct("ts", "event_id")
    detail = F.struct(*[n for n in [*keys, "garage_id", *GATE_DETAIL] if n in gate.columns and n not in keys])

    def pick(take, wanted: Column, name: str) -> Column:
        return take(detail, F.when(wanted, at)).alias(name)

    return (
        gate.filter(kind.isin(*st.ACTIVITY_TYPES) & (entry_when | exit_when) & ~c("ticket").isin(*st.SENTINEL_TICKETS))
        .groupBy(*keys)
        .agg(
            pick(F.max_by, (kind == st.ENTRY_TYPE) & entry_when, "e"),
            pick(take_exit, (kind == st.EXIT_TYPE) & exit_when, "x"),
            pick(take_exit, kind.isin(*st.ATTEMPT_TYPES) & exit_when, "f"),
            F.max(inside).alias("_active"),
        )
        .filter("_active").drop("_active")
    )


MOVEMENT = ["garage_id", "ticket", "media", "entry_ts", "exit_ts", "card_holder", "group_name", "customer_name", "customer_id", "state"]


def permit_movements(history: DataFrame, current: DataFrame, holders: DataFrame, start: str, end: str, variant: str = "v1") -> DataFrame:
    """V7: permit movements that touch the range: closed ones, and present ones of existing customers.

    `holders` maps media to card_holder, group_name, customer_name, customer_id.
    v3 blanks the side of a movement that lies outside the range.
    """
    c = F.col
    lo, hi = _ntz(start), _ntz(end)
    entry, left = c("entry_ts"), c("exit_ts")
    own = [n for n in MOVEMENT if n not in holders.columns or n == "media"]
    closed = history.select(*own).filter((c("ticket") != 0) & (entry != left))
    present = current.select(*own).filter((c("ticket") != 0) & (c("state") != 2)).withColumn("exit_ts", F.lit(None).cast(tp.NTZ))
    if variant == "v1":
        closed = closed.filter((entry < hi) & (left >= lo))
        present = present.filter(F.to_date(entry).cast(tp.NTZ) < hi)
    else:
        closed = closed.filter(entry.between(lo, hi) | left.between(lo, hi))
        closed = closed.withColumns({"entry_ts": F.when(entry.between(lo, hi), entry), "exit_ts": F.when(left.between(lo, hi), left)})
        present = present.filter(entry.between(lo, hi))
    named = closed.join(holders, "media", "left").select(*MOVEMENT)
    known = present.join(holders.filter(c("customer_id").isNotNull()), "media").select(*MOVEMENT)
    return named.union(known).distinct()


def visit_full_outer(picks: DataFrame, movements: DataFrame, variant: str = "v1", keys: list[str] | None = None) -> DataFrame:
    """Gate visits full-outer-joined with movements of the same ticket and the same entry or exit time.

    There is one gate visit per ticket, so every movement meets at most one:
    a left join keyed on the ticket alone, which may be split where a ticket is
    hot, and a test of the times afterwards. Gate visits that no movement
    claimed are added by an anti join on their distinct keys.
    """
    c = F.col
    keys = keys or TICKET
    same = (c("g.e.ts") == c("m.entry_ts")) | (c("g.x.ts") == c("m.exit_ts"))
    if variant == "v3":
        same = same | (c("g.f.ts") == c("m.exit_ts"))
    gate = picks.select(*keys, F.struct("e", "x", "f").alias("g"))
    moved = movements.select(*keys, F.struct(*MOVEMENT).alias("m"))
    tried = moved.join(gate, keys, "left").withColumn("_hit", F.coalesce(same, F.lit(False)))
    by_movement = tried.select(*keys, F.when(c("_hit"), c("g")).alias("g"), "m")
    claimed = tried.filter("_hit").select(*keys).distinct()
    alone = gate.join(claimed, keys, "left_anti").select(*keys, "g", F.lit(None).cast(by_movement.schema["m"].dataType).alias("m"))
    return by_movement.unionByName(alone)


def pair_by_ticket(gate: DataFrame, movements: DataFrame, start: str, end: str, variant: str = "v1") -> DataFrame:
    """V6, J8 with the ticket alone as key: an entry in one garage and an exit in another are one visit.

    Its garage is the first that is there of the entry's, the exit's, the
    attempt's and the movement's.
    """
    keys = ["ticket"]
    joined = visit_full_outer(pick_events(gate, start, end, variant, keys), movements, variant, keys)
    garage = F.coalesce(*[F.col(f"{side}.garage_id") for side in ("g.e", "g.x", "g.f", "m")])
    return joined.select(garage.alias("garage_id"), "ticket", "g", "m")


def assemble_visits(joined: DataFrame, *, employee_customer: int, variant: str = "v1", minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """V8: status, times, classification and amounts of each joined visit."""
    c = F.col
    e, x, f, m = (lambda n, s=s: c(f"{s}.{n}") for s in ("g.e", "g.x", "g.f", "m"))
    no_other = F.lit(NO_OTHER_TIME).cast(tp.NTZ)
    has_e, has_x, has_f = e("ts").isNotNull(), x("ts").isNotNull(), f("ts").isNotNull()

    def either(name: str) -> Column:
        return F.coalesce(x(name), f(name))

    guess = (
        F.when(has_e, F.lit(None).cast(tp.NTZ))
        .when(F.to_date(x("other_ts")) > F.to_date(no_other), x("other_ts"))
        .when(F.to_date(f("other_ts")) > F.to_date(no_other), f("other_ts"))
        .when((F.to_date(x("other_ts")) == F.to_date(no_other)) & (F.to_date(f("other_ts")) == F.to_date(no_other)), tp.add_minutes(x("ts"), -minutes))
    )
    status = st.visit_status(
        has_entry=has_e, has_exit=has_x, has_attempt=has_f, has_permit=m("ticket").isNotNull(),
        permit_entry=m("entry_ts"), permit_exit=m("exit_ts"), variant=variant,
    )
    reason = st.exit_classification(
        has_entry=has_e, has_exit=has_x, has_attempt=has_f, exit_type=x("txn_type"), ticket_type=either("ticket_type"),
        parking=either("parking"), amount=either("amount"), t2_amount=either("t2_amount"), cashier=either("cashier"),
        ticket=F.when(has_x | has_f, c("ticket")), media=m("media"), permit_entry=m("entry_ts"), permit_exit=m("exit_ts"),
        mark_imputed=variant == "v1",
    )
    money = "decimal(12,2)"
    return joined.select(
        "garage_id", "ticket", status.alias("status"),
        F.coalesce(m("entry_ts"), e("ts")).alias("entry_ts"), guess.alias("entry_guess"),
        F.coalesce(m("exit_ts"), x("ts")).alias("exit_ts"), F.coalesce(f("ts"), m("exit_ts")).alias("attempt_ts"),
        either("other_ts").alias("exit_other_ts"),
        F.coalesce(x("txn_type"), f("txn_type")).alias("exit_txn_type"), e("ticket_type").alias("entry_ticket_type"),
        st.entry_ticket_type_desc(e("ticket_type")).alias("entry_ticket_desc"), either("ticket_type").alias("exit_ticket_type"),
        st.exit_ticket_type_desc(x("ticket_type"), f("ticket_type")).alias("exit_ticket_desc"), reason.alias("exit_classification"),
        e("parking").alias("entry_parking"), either("parking").alias("exit_parking"),
        (either("amount") / 100).cast(money).alias("amount"), (either("t2_amount") / 100).cast(money).alias("t2_amount"),
        either("cashier").alias("cashier"), either("shift").alias("shift"),
        e("station").alias("entry_station"), x("station").alias("exit_station"), f("station").alias("attempt_station"),
        m("media").alias("permit_number"), m("card_holder").alias("permit_name"), m("group_name").alias("group_name"),
        m("customer_name").alias("customer_name"), m("customer_id").alias("customer_id"),
        st.customer_type(m("media"), m("customer_id"), employee_customer).alias("customer_type"),
    )


def _stay(entry: Column, left: Column) -> Column:
    return tp.datediff_second(entry, left) / F.lit(60.0)


def impute_visits(assembled: DataFrame, as_of: str, minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """V9: final entry and exit of the first variant, with missing sides imputed.

    An Exit Only visit whose guessed entry lies after the exit, or more than
    eight days before it, gets a typical stay; an Entry Only visit too, unless
    it entered on the day of `as_of`, which stays open.
    """
    c = F.col
    status = c("status")
    found = F.coalesce("entry_ts", "entry_guess")
    left = F.coalesce("exit_ts", "attempt_ts")
    odd = (status == st.EXIT_ONLY) & ((c("entry_guess") > c("exit_ts")) | (tp.datediff_day(c("entry_guess"), c("exit_ts")) > 8))
    odd = F.coalesce(odd, F.lit(False))
    entry_only = status == st.ENTRY_ONLY
    today = F.to_date(_ntz(as_of)).cast(tp.NTZ)
    entry = F.when(odd, tp.add_minutes(c("exit_ts"), -minutes)).otherwise(found)
    end = F.when(entry_only & (c("entry_ts") >= today), F.lit(None).cast(tp.NTZ)).when(entry_only, tp.add_minutes(c("entry_ts"), minutes)).otherwise(left)
    typical = F.lit(float(minutes))
    no_other = (status == st.EXIT_ONLY) & (c("exit_other_ts") == F.lit(NO_OTHER_TIME).cast(tp.NTZ))
    return assembled.withColumns({
        "trip_id": st.trip_id(c("garage_id"), c("ticket"), entry),
        "entry_ts": entry,
        "exit_ts": end,
        "length_of_stay": F.when(odd | entry_only, typical).otherwise(_stay(found, left)),
        "impute_duration": F.when(odd | entry_only | F.coalesce(no_other, F.lit(False)), typical),
    }).drop("entry_guess", "attempt_ts", "exit_other_ts")


def finalize_visits_v3(assembled: DataFrame, as_of: str) -> DataFrame:
    """Final entry and exit of the later variant, which imputes nothing at extract."""
    c = F.col
    status = c("status")
    found = F.coalesce("entry_ts", "entry_guess")
    left = F.coalesce("exit_ts", "attempt_ts")
    today = F.to_date(_ntz(as_of)).cast(tp.NTZ)
    open_sided = (status == st.EXIT_ONLY) | status.startswith("Entry Only")
    nothing = F.lit(None).cast(tp.NTZ)
    odd = (status == st.EXIT_ONLY) & ((c("entry_guess") > c("exit_ts")) | (tp.datediff_day(c("entry_guess"), c("exit_ts")) > 8))
    key_entry = F.when(F.coalesce(odd, F.lit(False)), tp.add_minutes(c("exit_ts"), -st.TYPICAL_STAY)).otherwise(found)
    return assembled.withColumns({
        "trip_id": st.trip_id(c("garage_id"), c("ticket"), key_entry),
        "entry_ts": F.when(status == st.EXIT_ONLY, nothing).otherwise(found),
        "exit_ts": F.when((status == st.ENTRY_ONLY) & (c("entry_ts") >= today), nothing).otherwise(left),
        "length_of_stay": F.when(~open_sided, _stay(found, left)),
        "impute_duration": F.lit(None).cast("double"),
    }).drop("entry_guess", "attempt_ts", "exit_other_ts")


# --- reconciling new visits with stored ones ----------------------------------------------------

STORED = ["trip_id", "status", "entry_ts", "exit_ts"]
UNRECONCILED = "Report"


def _stored_struct() -> Column:
    return F.struct(*STORED)


def match_stored(new: DataFrame, stored: DataFrame, days: int = 7) -> DataFrame:
    """The one stored visit a new visit is judged against, as struct column `s`.

    In turn: the same exit time, the same entry time, the latest stored visit
    that is still open on one side, the latest that ended. Each is one row per
    key, so no ticket is paired with all its past. `far` tells that the only
    candidate ended more than `days` from the new visit: too far to be judged
    against, too suspicious to pass as absent.
    """
    c = F.col
    recency = F.struct(F.coalesce("entry_ts", "exit_ts"), "trip_id")
    by_exit = stored.filter("exit_ts is not null").groupBy(*TICKET, "exit_ts").agg(F.max_by(_stored_struct(), recency).alias("s_exit"))
    by_entry = stored.filter("entry_ts is not null").groupBy(*TICKET, "entry_ts").agg(F.max_by(_stored_struct(), recency).alias("s_entry"))
    is_open = c("entry_ts").isNull() | c("exit_ts").isNull()
    last = stored.groupBy(*TICKET).agg(
        F.max_by(_stored_struct(), F.when(is_open, recency)).alias("s_open"),
        F.max_by(_stored_struct(), F.when(~is_open, recency)).alias("s_closed"),
    )
    joined = new.join(by_exit, [*TICKET, "exit_ts"], "left").join(by_entry, [*TICKET, "entry_ts"], "left").join(last, TICKET, "left")
    at = F.coalesce("entry_ts", "exit_ts")
    gap = F.abs(tp.datediff_minute(c("s_closed.exit_ts"), at))
    closer = F.coalesce("s_exit", "s_entry", "s_open")
    far = closer.isNull() & c("s_closed").isNotNull() & ~F.coalesce(gap <= days * 1440, F.lit(False))
    return joined.withColumns({"s": F.coalesce(closer, "s_closed"), "far": far}).drop("s_exit", "s_entry", "s_open", "s_closed")


def handler(status: Column, stored: Column, same_entry: Column, same_exit: Column) -> Column:
    """What to do with a new visit, by its status and the stored status (NULL when nothing is stored)."""
    none = stored.isNull()
    c, e, p, x = (stored == s for s in (st.COMPLETE, st.ENTRY_ONLY, st.ENTRY_ONLY_PERMIT, st.EXIT_ONLY))
    new_c, new_e, new_p, new_x = (status == s for s in (st.COMPLETE, st.ENTRY_ONLY, st.ENTRY_ONLY_PERMIT, st.EXIT_ONLY))
    rules = [
        (new_c & none, "Insert 2"), (new_e & none, "Insert 3"), (new_p & none, "Insert 4"), (new_x & none, "Insert 5"),
        (new_c & c, "Ignore 1"), (new_c & e, "Update 2"), (new_c & p, "Update 3"),
        (new_c & x & same_exit, "Ignore"), (new_c & x, "Insert 6"),
        (new_e & c & ~same_entry, "Insert 8"), (new_e & c, "Ignore"), (new_e & e, "Update 4"),
        (new_p & c & ~same_entry, "Insert 7"), (new_p & c, "Ignore"), (new_p & p, "Update 5"),
        (new_x & c & same_exit, "Ignore 2"), (new_x & c, "Update 1"), (new_x & e, "Update 6"), (new_x & p, "Update 7"),
        (new_x & x & same_exit, "Update 8"), (new_x & x, "Insert 1"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for rule, name in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise(UNRECONCILED)


def reconcile_visits(new: DataFrame, stored: DataFrame, days: int = 7) -> DataFrame:
    """Every new visit with its stored counterpart and handler; none is left without one."""
    c = F.col
    m = match_stored(new, stored, days)
    same_entry = F.coalesce(c("entry_ts") == c("s.entry_ts"), F.lit(False))
    same_exit = F.coalesce(c("exit_ts") == c("s.exit_ts"), F.lit(False))
    return m.select(
        *new.columns, c("s.trip_id").alias("stored_trip_id"), c("s.status").alias("stored_status"),
        c("s.entry_ts").alias("stored_entry_ts"), c("s.exit_ts").alias("stored_exit_ts"),
        F.when(c("far"), UNRECONCILED).otherwise(handler(c("status"), c("s.status"), same_entry, same_exit)).alias("handler"),
    )


EXIT_FIELDS = ["exit_txn_type", "exit_ticket_type", "exit_ticket_desc", "exit_parking", "amount", "t2_amount", "cashier", "shift",
               "exit_station", "attempt_station"]
CLOSING_UPDATES = ("Update 1", "Update 2", "Update 6", "Update 7")
IMPUTED_INSERTS = ("Insert 1", "Insert 5")


def _inserted_rows(reconciled: DataFrame, now: str, minutes: int) -> DataFrame:
    """New visits with an Insert handler as they are stored, a missing entry imputed."""
    c = F.col
    stamp = F.lit(now).cast(tp.NTZ)
    inserts = reconciled.filter(c("handler").startswith("Insert"))
    made_up = c("handler").isin(*IMPUTED_INSERTS)
    entry = F.when(made_up, tp.add_minutes(c("exit_ts"), -minutes)).otherwise(c("entry_ts"))
    return inserts.withColumns({
        "new_trip_id": c("trip_id"),
        "trip_id": F.when(made_up, st.trip_id(c("garage_id"), c("ticket"), entry)).otherwise(c("trip_id")),
        "length_of_stay": F.when(made_up, F.lit(float(minutes))).otherwise(c("length_of_stay")),
        "impute_duration": F.when(made_up, F.lit(float(minutes))).otherwise(c("impute_duration")),
        "entry_ts": entry, "load_ts": stamp, "update_ts": F.lit(None).cast(tp.NTZ),
    })


NO_RULE, TOO_FAR, ID_STORED, ID_REPEATED = "no rule", "stored visit too far away", "id already stored", "id repeated in the batch"


def unreconciled_visits(stored: DataFrame, reconciled: DataFrame, now: str, minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """New visits that are neither ignored, nor update a stored visit, nor are inserted, with the reason.

    Those without a rule, those whose only candidate is too far away, and
    inserts whose id is stored already or taken by another insert.
    """
    c = F.col
    why = F.when(c("stored_status") == st.COMPLETE, TOO_FAR).otherwise(NO_RULE)
    left = reconciled.filter(c("handler") == UNRECONCILED).select("trip_id", "status", "handler", why.alias("reason"))
    rows = _inserted_rows(reconciled, now, minutes)
    known = stored.select("trip_id", F.lit(True).alias("_stored")).distinct()
    first = rows.groupBy("trip_id").agg(F.max(F.struct("exit_ts", "status", "new_trip_id")).alias("_kept"))
    judged = rows.join(known, "trip_id", "left").join(first, "trip_id")
    reason = F.when(c("_stored"), ID_STORED).when(F.struct("exit_ts", "status", "new_trip_id") != c("_kept"), ID_REPEATED)
    clash = judged.select(c("new_trip_id").alias("trip_id"), "status", "handler", reason.alias("reason")).filter("reason is not null")
    return left.unionByName(clash)


def _closing(reconciled: DataFrame, detail: list[str]) -> DataFrame:
    """The exit that Updates 1, 2, 6 and 7 bring to a stored visit; the latest of several."""
    return (
        reconciled.filter(F.col("handler").isin(*CLOSING_UPDATES)).groupBy(F.col("stored_trip_id").alias("trip_id"))
        .agg(F.max_by(F.struct("exit_ts", *detail), F.struct("exit_ts", "trip_id")).alias("u"))
    )


def _with_exits(stored: DataFrame, reconciled: DataFrame, now: str, how: str) -> DataFrame:
    """Stored visits with the exits the batch brings: all of them (`left`), or only those that change (`inner`)."""
    c = F.col
    detail = [n for n in EXIT_FIELDS if n in reconciled.columns and n in stored.columns]
    hit = c("u").isNotNull()
    changed = {
        "status": F.when(hit, st.COMPLETE).otherwise(c("status")),
        "exit_ts": F.when(hit, c("u.exit_ts")).otherwise(c("exit_ts")),
        "length_of_stay": F.when(hit, _stay(c("entry_ts"), c("u.exit_ts"))).otherwise(c("length_of_stay")),
        "impute_duration": F.when(~hit, c("impute_duration")),
        "update_ts": F.when(hit, F.lit(now).cast(tp.NTZ)).otherwise(c("update_ts")),
        **{n: F.when(hit, c(f"u.{n}")).otherwise(c(n)) for n in detail},
    }
    if "exit_classification" in stored.columns:
        changed["exit_classification"] = F.when(~hit, c("exit_classification"))
    return stored.join(_closing(reconciled, detail), "trip_id", how).withColumns(changed).select(*stored.columns)


def _fresh_visits(stored: DataFrame, reconciled: DataFrame, now: str, minutes: int) -> DataFrame:
    inserts = _inserted_rows(reconciled, now, minutes).select(*stored.columns)
    once = inserts.groupBy("trip_id").agg(F.max_by(F.struct(*[n for n in stored.columns if n != "trip_id"]), F.struct("exit_ts", "status")).alias("r"))
    return once.join(stored.select("trip_id"), "trip_id", "left_anti").select("trip_id", "r.*").select(*stored.columns)


def apply_visit_updates(stored: DataFrame, reconciled: DataFrame, now: str, minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """The stored visits after the batch: exits filled in by Updates 1, 2, 6 and 7, and new visits inserted.

    Updates 3, 4, 5 and 8 change nothing. A stored visit hit by several new
    ones takes the latest exit. What is neither stored nor changed by this is
    in `unreconciled_visits`.
    """
    return _with_exits(stored, reconciled, now, "left").unionByName(_fresh_visits(stored, reconciled, now, minutes))


def visit_changes(stored: DataFrame, reconciled: DataFrame, now: str, minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """V12 for a stored table: only the visits that change or are new, for VersionedTable.upsert by trip_id."""
    return _with_exits(stored, reconciled, now, "inner").unionByName(_fresh_visits(stored, reconciled, now, minutes))


def close_stale_visits(stored: DataFrame, as_of: str, minutes: int = st.TYPICAL_STAY) -> DataFrame:
    """Visits that stayed open too long, with the missing side imputed; other rows unchanged.

    A transient Entry Only visit is closed two days after its entry; a
    transient Exit Only visit without an entry gets one after a day, and a new id.
    `closed_now` tells the rows that changed.
    """
    c = F.col
    transient = c("customer_type") == "transient"
    late_exit = transient & (c("status") == st.ENTRY_ONLY) & c("exit_ts").isNull() & (c("entry_ts") <= _shifted(as_of, -48))
    late_entry = transient & (c("status") == st.EXIT_ONLY) & c("entry_ts").isNull() & (c("exit_ts") <= _shifted(as_of, -24))
    new_exit, new_entry = tp.add_minutes(c("entry_ts"), minutes), tp.add_minutes(c("exit_ts"), -minutes)
    hit = F.coalesce(late_exit | late_entry, F.lit(False))
    return stored.withColumns({
        "trip_id": F.when(late_entry, st.trip_id(c("garage_id"), c("ticket"), new_entry)).otherwise(c("trip_id")),
        "entry_ts": F.when(late_entry, new_entry).otherwise(c("entry_ts")),
        "exit_ts": F.when(late_exit, new_exit).otherwise(c("exit_ts")),
        "length_of_stay": F.when(hit, F.lit(float(minutes))).otherwise(c("length_of_stay")),
        "impute_duration": F.when(hit, F.lit(float(minutes))).otherwise(c("impute_duration")),
        "update_ts": F.when(hit, _ntz(as_of)).otherwise(c("update_ts")),
        "closed_now": hit,
    })


def stale_changes(stored: DataFrame, as_of: str, minutes: int = st.TYPICAL_STAY) -> tuple[DataFrame, DataFrame]:
    """V13 for a stored table: the visits closed now, and the ids they had before, for VersionedTable.upsert by trip_id.

    A visit that gets an entry gets a new id, so its old one goes.
    """
    closed = close_stale_visits(stored.withColumn("_old_id", F.col("trip_id")), as_of, minutes).filter("closed_now")
    return closed.select(*stored.columns), closed.select(F.col("_old_id").alias("trip_id"))


def stale_minutes(closed: DataFrame) -> DataFrame:
    """+1 from the minute of entry through the minute of exit, as deltas for the minute summary.

    Both ends count, as in a range of whole-minute rows between the two times.
    """
    c = F.col
    rows = closed.filter("closed_now")
    first = tp.minute_index_up(c("entry_ts"))
    after = tp.minute_index(c("exit_ts")) + 1
    both = F.array(F.struct(first.alias("minute"), F.lit(1).alias("delta")), F.struct(after.alias("minute"), F.lit(-1).alias("delta")))
    return rows.select("garage_id", "customer_type", F.inline(both))
