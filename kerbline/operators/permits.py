"""Permit rosters, access periods and visits within them: J9, P1-P6, P18, P19, E21.

The change log has log_id, card_id, ts, property_type, new_value, group_detail
and customer. Log scans run per card and month (see ordered_scan), so a card
with very many log rows is spread over its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import policies as pol
from kerbline.functions import timeparts as tp
from kerbline.operators.ordered import MONTH, chunk_of, islands, ordered_scan

# Property types of the change log and the group that has no access.
GROUP_ASSIGNMENT, START_DATE, BLOCKED = 2, 104, 110
LOST_CARDS = "LOST CARDS"


def permit_roster(cards: DataFrame, groups: DataFrame, customers: DataFrame, group_parkings: DataFrame, policies: DataFrame,
                  excluded_customers: tuple[int, ...] = ()) -> DataFrame:
    """Each card with its group, customer, garages and access policy, and its status word."""
    rows = (
        cards.join(groups, "group_id", "left").join(customers, "customer_id", "left")
        .join(group_parkings, "group_id", "left").join(policies, "policy_id", "left")
    )
    if excluded_customers:
        rows = rows.filter(~F.col("customer_id").isin(*excluded_customers))
    return rows.withColumn("status", pol.card_status(F.col("status_code")))


def access_policies(groups: DataFrame, group_parkings: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy of each group in each garage."""
    return groups.join(group_parkings, "group_id").join(policies, "policy_id")


def rename_groups(df: DataFrame, renames: DataFrame, column: str = "group_name") -> DataFrame:
    """The group name after its prefix, then the rename table (old_name, new_name)."""
    side = renames.select(F.col("old_name").alias("_old"), F.col("new_name").alias("_new"))
    short = df.withColumn(column, pol.short_group_name(F.col(column)))
    return short.join(side, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def relevant_events(log: DataFrame) -> DataFrame:
    """Log rows that decide access, with a group to connect them to a policy."""
    return log.filter(
        F.col("property_type").isin(GROUP_ASSIGNMENT, START_DATE, BLOCKED) & (F.coalesce("group_detail", F.lit("")) != "")
        & F.col("card_id").isNotNull()
    )


def parse_start_date(text: Column) -> Column:
    """A `dd mon yyyy` start date, with blanks or dashes."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.replace(F.trim(text), F.lit("-"), F.lit(" ")))), F.lit("d MMM yyyy")))


def card_start_dates(log: DataFrame, cards: DataFrame) -> DataFrame:
    """Effective start date per logged card: the latest start date set in the log, else the card's own."""
    changed = relevant_events(log).groupBy("card_id").agg(
        F.max(F.when(F.col("property_type") == START_DATE, parse_start_date(F.col("new_value")))).alias("_set")
    )
    return changed.join(cards.select("card_id", "permit", "start_date"), "card_id", "left").select(
        "card_id", "permit", F.coalesce("_set", F.to_date("start_date")).alias("effective_start_date")
    )


def access_states(log: DataFrame) -> DataFrame:
    """Block and group known at each event, whether that means access, and the time of the next event."""
    c = F.col
    events = relevant_events(log)
    kind = c("property_type")
    known = ordered_scan(
        events, ["card_id"], ["ts", "log_id"], chunk_of("ts", MONTH), row_number="rn",
        lasts={
            "_blocked": F.when(kind == BLOCKED, (c("new_value") == "True").cast("int")),
            "_group": F.when(kind == GROUP_ASSIGNMENT, c("group_detail")),
        },
        nexts={"period_end": c("ts")},
    )
    # A card without a group so far takes the first group its log names, whatever the entry was about.
    first = log.filter("card_id is not null").groupBy("card_id").agg(F.min_by("group_detail", F.struct("ts", "log_id")).alias("_first"))
    blocked = F.coalesce("_blocked", F.lit(0))
    access = F.when(blocked == 1, 0).when(c("_group").contains(LOST_CARDS), 0).otherwise(1)
    return known.join(first, "card_id").select(
        "card_id", "log_id", "ts", "customer", "rn", blocked.alias("is_blocked"), F.coalesce("_group", "_first").alias("current_group"),
        access.alias("has_access"), "period_end",
    )


def access_periods(log: DataFrame, cards: DataFrame, *, open_last: bool = False) -> DataFrame:
    """Maximal periods of equal access per card.

    A card's first period starts at midnight of its effective start date, or of
    its first event if that is later. A period ends with the latest known next
    event of its rows; a last period of one event has no end. `open_last`
    leaves every last period without an end.
    """
    c = F.col
    runs = islands(access_states(log), "card_id", "ts", "log_id", "has_access")
    last_open = F.max(c("period_end").isNull()).alias("_last")
    periods = runs.groupBy("card_id", "has_access", "island").agg(
        F.max("customer").alias("customer"), F.min("ts").alias("_start"), F.max("period_end").alias("period_end"),
        F.min("current_group").alias("group_at_start"), F.max("is_blocked").alias("was_manually_blocked"), last_open,
    )
    starts = card_start_dates(log, cards).filter("permit is not null")
    first = relevant_events(log).groupBy("card_id").agg(F.min("ts").alias("_first"))
    joined = periods.join(starts, "card_id").join(first, "card_id")
    midnight = F.greatest("effective_start_date", F.to_date("_start")).cast(tp.NTZ)
    end = F.when(~c("_last"), c("period_end")) if open_last else c("period_end")
    return joined.select(
        "permit", "card_id", "customer", F.when(c("_start") == c("_first"), midnight).otherwise(c("_start")).alias("period_start"),
        end.alias("period_end"), "has_access", "group_at_start", "was_manually_blocked", "effective_start_date",
    )


def add_unlogged_permits(periods: DataFrame, roster: DataFrame, as_of: str) -> DataFrame:
    """P5: cards that do not expire and have no log rows get one period from their start date to `as_of`."""
    silent = roster.filter("not with_expiry").join(periods.select("permit").distinct(), "permit", "left_anti")
    rows = silent.select(
        "permit", "card_id", "customer", F.to_date("start_date").cast(tp.NTZ).alias("period_start"),
        F.lit(as_of).cast(tp.NTZ).alias("period_end"), F.lit(1).alias("has_access"), F.col("group_name").alias("group_at_start"),
        F.lit(0).alias("was_manually_blocked"), F.to_date("start_date").alias("effective_start_date"),
    )
    return periods.unionByName(rows)


VISIT_KEY = ["permit", "entry_ts", "exit_ts"]


def visit_to_policy(visits: DataFrame, periods: DataFrame, as_of: str) -> DataFrame:
    """Each visit with the policy of the first access period that holds its entry, one row per visit.

    Periods are laid out by the months they cover and visits by the month of
    entry, so that a permit with very many visits or periods is joined month by
    month. An open period runs to `as_of`.
    """
    c = F.col
    end = F.coalesce("period_end", F.lit(as_of).cast(tp.NTZ))
    spans = periods.filter(c("has_access") == 1).withColumn("_end", end).filter(c("period_start") <= c("_end"))
    by_month = spans.select(
        c("permit").alias("_permit"), "period_start", "_end", "access_policy",
        F.explode(F.sequence(F.trunc("period_start", "month"), F.trunc("_end", "month"), F.expr("interval 1 month"))).alias("_month"),
    )
    at = (
        (c("permit") == c("_permit")) & (F.trunc("entry_ts", "month") == c("_month"))
        & (c("entry_ts") >= c("period_start")) & (c("entry_ts") <= c("_end"))
    )
    found = visits.join(by_month, at).drop("_permit", "_month", "_end")
    rest = [n for n in visits.columns if n not in VISIT_KEY]
    return found.groupBy(*VISIT_KEY).agg(
        F.min_by(F.struct(*rest, "access_policy"), F.struct("period_start", "access_policy", *rest)).alias("_v")
    ).select(*VISIT_KEY, "_v.*")


def unmatched_visits(visits: DataFrame, matched: DataFrame) -> DataFrame:
    """Visits whose permit, entry and exit matched no access period."""
    a, b = visits.alias("a"), matched.select(*VISIT_KEY).distinct().alias("b")
    same = (F.col("a.permit") == F.col("b.permit")) & (F.col("a.entry_ts") == F.col("b.entry_ts")) & F.col("a.exit_ts").eqNullSafe(F.col("b.exit_ts"))
    return a.join(b, same, "left_anti")


def merged_spans(spans: DataFrame) -> DataFrame:
    """Day spans (permit, _a, _b) of each permit with those that touch or overlap joined, so that no day is in two.

    `spans` has one row at most per permit and first day, or a handful, so one plain window holds.
    """
    along = Window.partitionBy("permit").orderBy("_a", "_b")
    reach = spans.withColumn("_reach", F.max("_b").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("_reach").isNull() | (F.col("_a") > F.date_add("_reach", 1)), 1).otherwise(0)
    runs = reach.withColumn("_span", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("permit", "_span").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_span")


def stay_spans(visits: DataFrame, as_of: str) -> DataFrame:
    """(permit, _a, _b): the days a permit was present, as spans apart from each other; a stay without an exit lasts to `as_of`."""
    end = F.coalesce("exit_ts", F.greatest(F.lit(as_of).cast(tp.NTZ), F.col("entry_ts")))
    stays = visits.filter(F.col("entry_ts") <= end).select("permit", F.to_date("entry_ts").alias("_a"), F.to_date(end).alias("_b"))
    # Of the stays that began on one day the longest holds the others' dates.
    return merged_spans(stays.groupBy("permit", "_a").agg(F.max("_b").alias("_b")))


def visit_dates(visits: DataFrame, as_of: str) -> DataFrame:
    """Every date a permit was present, once. Days are laid out last, and never shuffled."""
    return stay_spans(visits, as_of).select("permit", F.explode(F.sequence("_a", "_b")).alias("date"))


def policy_change_check(periods: DataFrame) -> DataFrame:
    """The most policies any card had, and how many periods have none."""
    per = periods.groupBy("card_id").agg(F.countDistinct("access_policy").alias("n"), F.count_if(F.col("access_policy").isNull()).alias("missing"))
    return per.agg(F.max("n").alias("max_policies"), F.sum("missing").alias("without_policy"))


def permits_present(visits: DataFrame, since: str) -> DataFrame:
    """Permits seen since a time, or still inside."""
    seen = F.col("exit_ts").isNull() | (F.col("exit_ts") >= F.lit(since).cast(tp.NTZ))
    return visits.filter((F.col("customer_type") == "permit") & seen).agg(F.countDistinct("permit").alias("permits"))
