"""Lookup and temporal joins: J1-J6, J10-J14, J19-J21.

No side is broadcast by hint: Spark broadcasts a side it measures below its
threshold and sort-merges it otherwise, splitting a hot key's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.timeparts import end_or_forever, in_interval


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Equi join of facts to a dimension."""
    return fact.join(dim, on, how)


def assignment_join(
    fact: DataFrame,
    assignments: DataFrame,
    ts: str,
    *,
    device: str = "device_id",
    how: str = "inner",
    carry: tuple[str, ...] = ("location_id",),
) -> DataFrame:
    """Each fact with the assignment that holds its device at `ts`.

    The interval is half-open: the start belongs to it, the end does not, and
    an open end means it still runs.
    """
    side = assignments.select(
        F.col("device_id").alias("_device"),
        F.col("assign_date").alias("_from"),
        F.col("end_date").alias("_to"),
        F.col("device_id").alias("assigned_device_id"),
        *carry,
    )
    held = (F.col(device) == F.col("_device")) & in_interval(F.col(ts), F.col("_from"), F.col("_to"))
    return fact.join(side, held, how).drop("_device", "_from", "_to")


def device_assignments(devices: DataFrame, assignments: DataFrame) -> DataFrame:
    """Devices with the list `_held` of their assignments, a handful by nature, so that facts meet both in one join."""
    spans = F.struct("location_id", F.col("assign_date").alias("_from"), F.col("end_date").alias("_to"))
    return devices.join(assignments.groupBy("device_id").agg(F.collect_list(spans).alias("_held")), "device_id", "left")


def held_at(fact: DataFrame, ts: str) -> DataFrame:
    """J2 for facts that carry `_held`: a row per assignment that holds their device at `ts`, one without if there is none."""
    now = F.explode_outer(F.filter("_held", lambda a: in_interval(F.col(ts), a["_from"], a["_to"])))
    found = fact.withColumn("_held", now)
    return found.withColumns({
        "assigned_device_id": F.when(F.col("_held").isNotNull(), F.col("device_id")), "location_id": F.col("_held.location_id"),
    }).drop("_held")


PAYMENT_KEYS = ["card_number", "authorization_code"]


def sales_payments_match(sales: DataFrame, payments: DataFrame) -> DataFrame:
    """Sales left-joined to payouts by card and authorization; match_count tells how far a sale fanned out."""
    # The payouts are counted where the join finds them: they are dealt by their key once.
    side = payments.withColumn("match_count", F.count(F.lit(1)).over(Window.partitionBy(*PAYMENT_KEYS)))
    return sales.join(side, PAYMENT_KEYS, "left").fillna(0, ["match_count"])


def latest_payment(payments: DataFrame) -> DataFrame:
    """One payout per card and authorization: the latest, then the highest id; with the number there were."""
    # One struct holds both the order and what is kept, so that a payout's date is shuffled once.
    newest = F.struct("payment_date", "payment_id", F.col("payment_amount").alias("paid_amount"))
    return payments.groupBy(*PAYMENT_KEYS).agg(F.count(F.lit(1)).alias("match_count"), F.max(newest).alias("_p")).select(
        *PAYMENT_KEYS, "match_count", "_p.payment_date", "_p.paid_amount"
    )


def packed(text: str) -> Column:
    """A text column in as few bytes as an equi join needs: digits and dashes in half a byte each, any other text after a
    byte that no packed one begins with. Equal texts, and only they, are equal."""
    c = F.col(text)
    digits = F.translate(c, "-", "a")
    # The last half byte of an odd number of them is filled with one that stands for neither digit nor dash.
    filled = F.when(F.length(c) % 2 == 1, F.concat(digits, F.lit("f"))).otherwise(digits)
    return F.when(c.rlike("^[0-9-]+\\z"), F.unhex(filled)).otherwise(F.concat(F.unhex(F.lit("ff")), c.cast("binary")))


def coalesced_key_join(fact: DataFrame, dim: DataFrame, first: str, second: str, dim_key: str, how: str = "inner") -> DataFrame:
    """Join on the first non-NULL of two fact columns."""
    return fact.join(dim, F.coalesce(F.col(first), F.col(second)) == F.col(dim_key), how)


def constant_key(dim: DataFrame, column: str, value: str, wanted: str) -> Column:
    """One id of a dimension row picked by a literal, as a scalar subquery (NULL when absent)."""
    return dim.filter(F.col(column) == value).agg(F.max(wanted)).scalar()


def anti_join_presence(tickets: DataFrame, *presence: DataFrame, keys: list[str]) -> DataFrame:
    """Drop tickets that are permit virtual tickets in any of the presence tables."""
    out = tickets
    for table in presence:
        out = out.join(table.filter(F.col("ticket") != 0).select(*keys).distinct(), keys, "left_anti")
    return out


def open_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("end_date").isNull())


def locations_full(locations: DataFrame, facilities: DataFrame, spaces: DataFrame) -> DataFrame:
    """Locations with facility and, where there is one, space."""
    space = spaces.select("space_id", "space_number")
    return locations.join(facilities, "facility_id", "left").join(space, "space_id", "left")


def current_assignment(devices: DataFrame, assignments: DataFrame, locations: DataFrame) -> DataFrame:
    """Every device with its open assignment and where that is, if any."""
    now = open_assignments(assignments).select("device_id", "assignment_id", "location_id")
    return devices.join(now, "device_id", "left").join(locations, "location_id", "left")


def assignment_history(assignments: DataFrame, devices: DataFrame, locations: DataFrame) -> DataFrame:
    """All assignments with device and location detail."""
    return assignments.join(devices, "device_id").join(locations, "location_id")


def overlap_detect(assignments: DataFrame) -> DataFrame:
    """Pairs of assignments of one device whose half-open intervals overlap, each pair once.

    A sweep by start marks clusters of touching intervals first; only the
    members of a cluster are paired, so a device with many clean assignments
    costs no self join.
    """
    spans = (
        assignments.select("device_id", "assignment_id", "assign_date", "end_date")
        .withColumn("_end", end_or_forever(F.col("end_date")))
        .filter(F.col("device_id").isNotNull() & (F.col("assign_date") < F.col("_end")))
    )
    # The assignments of one device are a handful by nature, so one plain window serves both steps.
    along = Window.partitionBy("device_id").orderBy("assign_date", "assignment_id")
    reach = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("_reach").isNull() | (F.col("assign_date") >= F.col("_reach")), 1).otherwise(0)
    numbered = spans.withColumn("_reach", reach).withColumn("_cluster", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("device_id", "_cluster"))
    members = numbered.withColumn("_size", size).filter("_size > 1")
    a = members.select("device_id", "_cluster", *[F.col(c).alias(f"a_{c}") for c in ("assignment_id", "assign_date", "_end")])
    b = members.select("device_id", "_cluster", *[F.col(c).alias(f"b_{c}") for c in ("assignment_id", "assign_date", "_end")])
    return (
        a.join(b, ["device_id", "_cluster"])
        .filter("a_assignment_id < b_assignment_id and a_assign_date < b__end and b_assign_date < a__end")
        .select("device_id", F.col("a_assignment_id").alias("first_id"), F.col("b_assignment_id").alias("second_id"))
    )


def station_to_garage(stations: DataFrame, garages: DataFrame) -> DataFrame:
    """Garage name of each station address, and how many garages claim it (one unless the data is wrong)."""
    named = stations.filter(F.col("station").isNotNull()).join(garages, "garage_id")
    return named.groupBy("station").agg(
        F.max("garage_name").alias("garage_name"),
        F.countDistinct("garage_name").alias("garages"),
    )


def org_code_lookup(readers: DataFrame, terminal_history: DataFrame) -> DataFrame:
    """Distinct union of reader terminals and card-terminal history, with open validity bounds filled in.

    Both inputs carry source, device_key, terminal_id, valid_from, valid_to, charge_code, facility.
    """
    columns = ["source", "device_key", "terminal_id", "valid_from", "valid_to", "charge_code", "facility"]
    bounded = [
        df.withColumn("valid_from", F.coalesce("valid_from", F.lit("1900-01-01").cast("timestamp_ntz")))
        .withColumn("valid_to", F.coalesce("valid_to", F.lit("2050-01-01").cast("timestamp_ntz")))
        .filter(F.col("charge_code").isNotNull())
        .select(*columns)
        for df in (readers, terminal_history)
    ]
    return bounded[0].union(bounded[1]).distinct()


def charge_code_at(facts: DataFrame, codes: DataFrame, ts: str, key: str = "terminal_id") -> DataFrame:
    """Charge code that held for a terminal at `ts`."""
    valid = (F.col(ts) >= F.col("valid_from")) & (F.col(ts) < F.col("valid_to"))
    side = codes.select(F.col("terminal_id").alias("_terminal"), "valid_from", "valid_to", "charge_code", "facility")
    return facts.join(side, (F.col(key) == F.col("_terminal")) & valid, "left").drop("_terminal", "valid_from", "valid_to")
