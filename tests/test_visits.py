"""Every (stored, new) status pair, and the full outer join against plain SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import stays
from kerbline.operators import visits as vs

D = dt.datetime
C, E, P, X = "Complete", "Entry Only", "Entry Only - Permit Holder", "Exit Only"
A, B, B2 = D(2024, 1, 5, 8), D(2024, 1, 5, 10), D(2024, 1, 5, 11)

# (new status, stored status, same entry, same exit) -> handler
TABLE = {
    (C, C, 1, 1): "Ignore 1", (C, E, 1, 0): "Update 2", (C, P, 1, 0): "Update 3", (C, X, 0, 1): "Ignore", (C, X, 0, 0): "Insert 6", (C, None, 0, 0): "Insert 2",
    (E, C, 0, 0): "Insert 8", (E, C, 1, 0): "Ignore", (E, E, 1, 0): "Update 4", (E, P, 1, 0): "Report", (E, X, 0, 0): "Report", (E, None, 0, 0): "Insert 3",
    (P, C, 0, 0): "Insert 7", (P, C, 1, 0): "Ignore", (P, E, 1, 0): "Report", (P, P, 1, 0): "Update 5", (P, X, 0, 0): "Report", (P, None, 0, 0): "Insert 4",
    (X, C, 0, 1): "Ignore 2", (X, C, 0, 0): "Update 1", (X, E, 0, 0): "Update 6", (X, P, 0, 0): "Update 7", (X, X, 0, 1): "Update 8", (X, X, 0, 0): "Insert 1",
    (X, None, 0, 0): "Insert 5", ("Unknown", C, 0, 0): "Report", ("Unknown", None, 0, 0): "Report",
}
NEW = "trip_id string, garage_id int, ticket int, status string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, length_of_stay double, impute_duration double, customer_type string, cashier int, load_ts timestamp_ntz, update_ts timestamp_ntz"


def visit(tag, ticket, status, entry, left):
    entry = None if status == X else entry
    left = left if status in (C, X) else None
    return (f"{tag}{ticket}", 1, ticket, status, entry, left, None, None, "transient", 3 if tag == "n" else 1, None, None)


def frames(spark):
    new, stored, want = [], [], {}
    for ticket, ((status, held, same_entry, same_exit), name) in enumerate(TABLE.items(), 1000):
        new.append(visit("n", ticket, status, A, B))
        if held:
            stored.append(visit("s", ticket, held, A if same_entry else A - dt.timedelta(hours=3), B if same_exit else B2))
        want[ticket] = name
    return spark.createDataFrame(new, NEW), spark.createDataFrame(stored, NEW), want


def test_every_status_pair(spark):
    new, stored, want = frames(spark)
    got = {r.ticket: r.handler for r in vs.reconcile_visits(new, stored).collect()}
    assert got == want


def test_a_far_stored_visit_is_reported_not_passed_as_absent(spark):
    new = spark.createDataFrame([visit("n", 1, C, A, B)], NEW)
    old = spark.createDataFrame([visit("s", 1, C, A - dt.timedelta(days=40), B - dt.timedelta(days=40))], NEW)
    done = vs.reconcile_visits(new, old)
    assert done.first().handler == "Report"
    assert vs.unreconciled_visits(old, done, "2024-06-01 00:00:00").first().reason == vs.TOO_FAR


def test_updates_and_inserts(spark):
    new, stored, want = frames(spark)
    done = {r.trip_id: r for r in vs.apply_visit_updates(stored, vs.reconcile_visits(new, stored), "2024-02-01 00:00:00").collect()}
    before = {r.trip_id: r for r in stored.collect()}
    for ticket, name in want.items():
        key = f"s{ticket}"
        if name in ("Update 1", "Update 2", "Update 6", "Update 7"):
            row = done[key]
            assert (row.status, row.exit_ts, row.cashier) == (C, B, 3)
            assert row.length_of_stay == (B - row.entry_ts).total_seconds() / 60
        elif key in before:
            assert done[key] == before[key]
        inserted = [r for r in done.values() if r.ticket == ticket and r.trip_id not in before]
        assert len(inserted) == (1 if name.startswith("Insert") else 0)
        if name in ("Insert 1", "Insert 5"):
            assert inserted[0].entry_ts == B - dt.timedelta(minutes=204) and inserted[0].impute_duration == 204


@pytest.mark.parametrize("variant", ["v1", "v3"])
def test_full_outer_join(spark, variant):
    rng = random.Random(8)
    base = D(2024, 1, 10)
    gate, moves = [], []
    for i in range(300):
        ticket = 1 if i % 3 == 0 else rng.randint(2, 60)
        kind = rng.choice([20, 30, 31])
        gate.append((i, 1, ticket, kind, base + dt.timedelta(minutes=rng.randint(0, 40)), "S", 0, 0, 0, 0, 0, 0, base))
    for i in range(200):
        ticket = 1 if i % 3 == 0 else rng.randint(2, 80)
        moves.append((1, ticket, f"m{i}", base + dt.timedelta(minutes=rng.randint(0, 40)), rng.choice([None, base + dt.timedelta(minutes=rng.randint(0, 40))]), "h", "g", "c", 1, 3))
    g = spark.createDataFrame(gate, "event_id int, garage_id int, ticket int, txn_type int, ts timestamp_ntz, station string, ticket_type int, parking int, amount int, t2_amount int, cashier int, shift int, other_ts timestamp_ntz")
    m = spark.createDataFrame(moves, "garage_id int, ticket int, media string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, card_holder string, group_name string, customer_name string, customer_id int, state int")
    picks = vs.pick_events(g, "2024-01-09 00:00:00", "2024-01-12 00:00:00", variant)
    got = vs.visit_full_outer(picks, m, variant)
    picks.createOrReplaceTempView("p")
    m.createOrReplaceTempView("m")
    extra = "or p.f.ts = m.exit_ts" if variant == "v3" else ""
    want = spark.sql(f"""select coalesce(p.ticket, m.ticket) ticket, p.e.ts e, p.x.ts x, p.f.ts f, m.media media from p full outer join m
        on p.garage_id = m.garage_id and p.ticket = m.ticket and (p.e.ts = m.entry_ts or p.x.ts = m.exit_ts {extra})""")
    have = got.select("ticket", F.col("g.e.ts").alias("e"), F.col("g.x.ts").alias("x"), F.col("g.f.ts").alias("f"), F.col("m.media").alias("media"))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, have.collect())) == sorted(map(key, want.collect()))


def test_a_ticket_pairs_over_garages(spark):
    at = lambda h: D(2024, 1, 10, h)
    rows = [(1, 1, 5, 20, at(8), "E"), (2, 2, 5, 30, at(9), "X"), (3, 3, 6, 31, at(9), "F"), (4, 2, 7, 30, at(7), "X")]
    g = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, r[4]) for r in rows], "event_id int, garage_id int, ticket int, txn_type int, ts timestamp_ntz, station string, ticket_type int, parking int,"
                                                                         "amount int, t2_amount int, cashier int, shift int, other_ts timestamp_ntz")
    moves = [(4, 5, "m5", at(8), None, "h", "g", "c", 1, 3), (6, 9, "m9", at(8), at(9), "h", "g", "c", 1, 3)]
    m = spark.createDataFrame(moves, "garage_id int, ticket int, media string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, card_holder string, group_name string, customer_name string, customer_id int, state int")
    span = ("2024-01-09 00:00:00", "2024-01-12 00:00:00")
    got = {r.ticket: r for r in vs.assemble_visits(vs.pair_by_ticket(g, m, *span), employee_customer=99).collect()}
    assert {t: (r.garage_id, r.status, r.permit_number) for t, r in got.items()} == {
        5: (1, "Complete", "m5"), 6: (3, "Exit Only", None), 7: (2, "Exit Only", None), 9: (6, "Complete", "m9")}
    halves = vs.assemble_visits(vs.visit_full_outer(vs.pick_events(g, *span), m), employee_customer=99)
    assert halves.filter("ticket = 5").count() == 3


def test_picks_ignore_sentinels(spark):
    rows = [(1, 1, t, 20, D(2024, 1, 10), "E") for t in (*stays.SENTINEL_TICKETS, 5)]
    g = spark.createDataFrame(rows, "event_id int, garage_id int, ticket int, txn_type int, ts timestamp_ntz, station string")
    assert [r.ticket for r in vs.pick_events(g, "2024-01-09 00:00:00", "2024-01-12 00:00:00").collect()] == [5]
