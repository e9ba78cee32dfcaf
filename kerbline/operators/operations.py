"""Work orders, device and space history, lists and staff scheduling: J12, J13, J15-J18, J20, J22, J23, L13-L15, A16, A18-A20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import timeparts as tp
from kerbline.functions.filters import WEEKDAYS, weekday_rank
from kerbline.functions.policies import full_name, paid_hours
from kerbline.functions.timeparts import end_or_forever
from kerbline.operators.ordered import MONTH, chunk_of, ordered_scan
from kerbline.session import written

# Work order states and the parent descriptions that date a sign or hood job.
OPEN_STATES = ("OPEN", "HOLD")
DONE_STATES = ("CLOSED", "COMPLETE", "FINALREV", "FINANCE")
SIGN_CHECK = "No Parking Sign Check"
INSTALLS = ("Hood Install", "Hood/Sign Space")
REMOVALS = ("Hood Removal", "Hood/Sign Removal")
ORPHAN_NAMES = {"1586": "Portable CC Reader Move", "217": "No parent"}


def _ntz(value) -> Column:
    return F.lit(value).cast(tp.NTZ)


# --- work orders ---------------------------------------------------------------------------------

def parent_links(links: DataFrame) -> DataFrame:
    """Links from a parent work order to its child."""
    c = F.col
    return links.filter((c("dest_type") == "WorkOrder") & (c("source_type") == "WorkOrder") & (c("link_type") == "Parent")).select(
        c("dest_id").alias("wo_id"), c("source_id").alias("parent_id")
    )


def parent_work_order(orders: DataFrame, links: DataFrame, wanted: Column) -> DataFrame:
    """Work orders with the description and the dates their parent gives them."""
    c = F.col
    parents = orders.select(
        c("wo_id").alias("parent_id"), c("description").alias("p_description"), c("proj_start").alias("p_start"),
        c("proj_finish").alias("p_finish"), c("finish_ts").alias("p_actual"),
    )
    rows = orders.filter(wanted).join(parent_links(links), "wo_id", "left").join(parents, "parent_id", "left")
    name = c("p_description")
    orphan = F.when(c("template") == "1586", ORPHAN_NAMES["1586"]).when(c("template") == "217", ORPHAN_NAMES["217"])
    return rows.select(
        *[n for n in orders.columns],
        F.coalesce(name, orphan).alias("parent_template"),
        F.when(name == SIGN_CHECK, c("p_start")).when(name.isin(*INSTALLS), c("p_actual")).alias("parent_start"),
        F.when(name == SIGN_CHECK, c("p_finish")).when(name.isin(*REMOVALS), c("p_actual")).alias("parent_finish"),
    )


def parent_templates(orders: DataFrame, links: DataFrame, template: str) -> DataFrame:
    """Distinct descriptions of the parents of work orders of one template."""
    children = orders.filter(F.col("template") == template).select("wo_id")
    parents = parent_links(links).join(children, "wo_id", "left_semi").select(F.col("parent_id").alias("wo_id")).distinct()
    return orders.join(parents, "wo_id", "left_semi").select("description").distinct()


def work_order_stats(orders: DataFrame, as_of: str) -> DataFrame:
    """Open orders, orders started and finished in the last 7 days, mean days to finish over 90 days, finished but not closed."""
    c = F.col
    now = _ntz(as_of)
    week, quarter = tp.add_minutes(now, -7 * 1440), tp.add_minutes(now, -90 * 1440)
    done = c("status").isin(*DONE_STATES)
    took = F.when(done & c("initiate_ts").isNotNull() & (c("finish_ts") >= quarter), tp.datediff_day(c("initiate_ts"), c("finish_ts")))
    return orders.agg(
        F.count_if(c("status").isin(*OPEN_STATES)).alias("open_count"),
        F.count_if((c("initiate_ts") >= week) & (c("initiate_ts") < now)).alias("assigned_last_week"),
        F.count_if(done & (c("finish_ts") >= week) & (c("finish_ts") < now)).alias("closed_last_week"),
        F.round(F.sum(took) / F.count(took), 1).alias("avg_days_to_complete"),
        F.count_if((c("status") == "COMPLETE") & c("closed_ts").isNull()).alias("closed_not_completed"),
    )


# --- device and space history --------------------------------------------------------------------

def scd2_apply(dim: DataFrame, changes: DataFrame, keys: list[str], start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Each change opens a row and closes the key's open row at its own start; closed rows stay.

    Changes to one key that come together close each other in turn.
    """
    c = F.col
    still_open = dim.filter(c(end).isNull()).unionByName(changes.withColumn(end, F.lit(None).cast(tp.NTZ)).select(*dim.columns))
    order = [start, *[n for n in dim.columns if n not in (*keys, start, end)]]
    ended = ordered_scan(still_open, keys, order, chunk_of(start, MONTH), nexts={end: c(start)})
    return dim.filter(c(end).isNotNull()).unionByName(ended.select(*dim.columns))


def refuse_overlaps(assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """New device assignments, flagged `accepted` unless their interval overlaps another one of the device."""
    c = F.col
    columns = ["assignment_id", "device_id", "assign_date", "end_date"]
    spans = assignments.select(*columns).unionByName(changes.select(*columns)).withColumn("_end", end_or_forever(c("end_date")))
    # Sorted by start, an interval overlaps another when one before it reaches into it or the next one starts within it.
    along = Window.partitionBy("device_id").orderBy("assign_date", "assignment_id")
    reach, following = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lead("assign_date").over(along)
    clash = F.coalesce(reach > c("assign_date"), F.lit(False)) | F.coalesce(following < c("_end"), F.lit(False))
    clashing = spans.filter((c("assign_date") < c("_end")) & c("device_id").isNotNull()).withColumn("_clash", clash).filter("_clash").select("assignment_id", "_clash").distinct()
    return changes.join(clashing, "assignment_id", "left").withColumn("accepted", c("_clash").isNull()).drop("_clash")


def close_assignments(assignments: DataFrame, closures: DataFrame) -> DataFrame:
    """Open assignments ended at the given time, with the closing note appended; closed ones stay as they are."""
    c = F.col
    side = closures.select("assignment_id", c("end_date").alias("_end"), c("note").alias("_note"))
    hit = c("end_date").isNull() & c("_end").isNotNull()
    noted = F.concat(F.coalesce("notes", F.lit("")), F.lit(" | Closed: "), c("_note"))
    return assignments.join(side, "assignment_id", "left").withColumns({
        "end_date": F.when(hit, c("_end")).otherwise(c("end_date")),
        "notes": F.when(hit & c("_note").isNotNull(), noted).otherwise(c("notes")),
    }).select(*assignments.columns)


def stable_id(*parts: Column) -> Column:
    """A surrogate id that depends only on the parts: the first 15 hex digits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("bigint")


def missing_locations(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations that requests (facility_id, space_id) need and that do not exist yet."""
    r = requests.select("facility_id", "space_id").distinct().alias("r")
    have = locations.select(F.col("facility_id").alias("f"), F.col("space_id").alias("s"))
    return r.join(have, (F.col("facility_id") == F.col("f")) & F.col("space_id").eqNullSafe(F.col("s")), "left_anti").withColumn(
        "location_id", stable_id(F.col("facility_id"), F.col("space_id"))
    )


def fill_location_and_charge_code(requests: DataFrame, locations: DataFrame, charges: DataFrame) -> DataFrame:
    """Each requested (facility, space, program) with its location and charge code, made where missing.

    A new charge code copies the facility's, if the facility has exactly one
    for the program; otherwise `error` says so. `new_location` and `new_charge`
    mark what has to be inserted.
    """
    c = F.col
    made = missing_locations(requests, locations).select("location_id", "facility_id", "space_id", F.lit(True).alias("new_location"))
    places = locations.select("location_id", "facility_id", "space_id", F.lit(False).alias("new_location")).unionByName(made)
    side = places.select(c("facility_id").alias("f"), c("space_id").alias("s"), "location_id", "new_location")
    want = requests.select("facility_id", "space_id", "program_id").distinct()
    placed = want.join(side, (c("facility_id") == c("f")) & c("space_id").eqNullSafe(c("s"))).drop("f", "s")
    have = charges.select("location_id", c("program_type_id").alias("program_id"), "charge_code_id", c("charge_code").alias("_own"))
    usual = (
        charges.join(locations.select("location_id", "facility_id"), "location_id")
        .groupBy("facility_id", c("program_type_id").alias("program_id"))
        .agg(F.min("charge_code").alias("_lo"), F.max("charge_code").alias("_hi"))
    )
    rows = placed.join(have, ["location_id", "program_id"], "left").join(usual, ["facility_id", "program_id"], "left")
    new = c("charge_code_id").isNull()
    same = F.coalesce(c("_lo") == c("_hi"), F.lit(False))
    return rows.select(
        "facility_id", "space_id", "program_id", "location_id", "new_location",
        F.coalesce(c("charge_code_id").cast("bigint"), F.when(same, stable_id(c("location_id"), c("program_id"), F.lit("charge")))).alias("charge_code_id"),
        F.when(new, F.when(same, c("_lo"))).otherwise(c("_own")).alias("charge_code"), (new & same).alias("new_charge"),
        F.when(new & ~same, "Inconsistent or non-existent charge codes for facility/program").alias("error"),
    )


IN_SERVICE, OUT_OF_SERVICE = "In service", "Out of service"


def space_intervals(events: DataFrame) -> DataFrame:
    """Out-of-service intervals of a space from its event log (space, ts, kind, date_returned, event_id).

    kind is out, return, or out_and_return, which carries its own end. An out
    lasts to the space's next event when that is a return.
    """
    c = F.col
    nexts = {"_next_ts": c("ts"), "_next_kind": c("kind")}
    seen = ordered_scan(events, ["space"], ["ts", "event_id"], chunk_of("ts", MONTH), nexts=nexts)
    end = F.when(c("kind") == "out_and_return", c("date_returned")).when(c("_next_kind") == "return", c("_next_ts"))
    return seen.filter(c("kind") != "return").select("space", "event_id", c("ts").alias("date_out"), end.alias("date_returned"))


def space_service_state(events: DataFrame, as_of: str) -> DataFrame:
    """Latest status of each space; a sign whose end has passed is back in service."""
    last = events.groupBy("space").agg(F.max_by(F.struct("ts", "kind", "date_returned"), F.struct("ts", "event_id")).alias("l"))
    over = (F.col("l.kind") == "out_and_return") & (F.col("l.date_returned") < _ntz(as_of))
    status = F.when((F.col("l.kind") == "return") | F.coalesce(over, F.lit(False)), IN_SERVICE).otherwise(OUT_OF_SERVICE)
    return last.select("space", status.alias("status"), F.col("l.ts").alias("since"))


def coin_inspections(collections: DataFrame, cards: DataFrame) -> DataFrame:
    """On the latest collection day, the last collection of each terminal and who made it."""
    latest = collections.agg(F.max(F.to_date("date"))).scalar()
    rest = ["date", "card_number", "card_name", "id"]
    last = collections.filter(F.to_date("date") == latest).groupBy("terminal").agg(F.max_by(F.struct(*rest), F.struct("date", "id")).alias("l"))
    rows = last.select("terminal", "l.*").join(cards, "card_number", "left")
    return rows.select(
        "terminal", F.col("date").alias("inspected_date"), F.col("card_name").alias("inspected_by"), "card_number", "assigned_to"
    )


# --- lists ---------------------------------------------------------------------------------------

def person_names(employees: DataFrame, key: str, name: str) -> DataFrame:
    """Employee names under the given key and column name."""
    return employees.select(F.col("employee_id").alias(key), full_name(F.col("first_name"), F.col("last_name")).alias(name))


def special_event_list(events: DataFrame, locations: DataFrame, facilities: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Events with the name of their facility, by start."""
    rows = events if wanted is None else events.filter(wanted)
    place = locations.select("location_id", "facility_id")
    return (
        rows.join(place, "location_id", "left")
        .join(facilities.select("facility_id", F.col("facility_name").alias("location_name")), "facility_id", "left")
        .drop("facility_id").orderBy("event_start", "event_id")
    )


def time_off_list(requests: DataFrame, employees: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """Requests with the names of who asked, who sent it in and who changed it; newest first."""
    rows = requests if include_cancelled else requests.filter(~F.col("is_cancelled"))
    return (
        rows.join(person_names(employees, "employee_id", "employee_name"), "employee_id")
        .join(person_names(employees, "submit_by", "submit_by_name"), "submit_by", "left")
        .join(person_names(employees, "updated_by", "updated_by_name"), "updated_by", "left")
        .orderBy(F.col("request_date").desc(), F.col("submit_date").desc(), "request_id")
    )


def shift_list(shifts: DataFrame, assignments: DataFrame, employees: DataFrame, week: str | None = None) -> DataFrame:
    """Shifts with their assignment and employee, in weekday order."""
    rows = shifts if week is None else shifts.filter(F.col("week_start") == F.lit(week).cast("date"))
    return (
        rows.join(assignments, "shift_id", "left").join(person_names(employees, "employee_id", "employee_name"), "employee_id", "left")
        .orderBy("week_start", weekday_rank(F.col("day_of_week")), "location", "booth", "start_hour", "shift_id")
    )


def cash_bag_list(bags: DataFrame, facilities: DataFrame, devices: DataFrame, employees: DataFrame) -> DataFrame:
    """Cash bags with facility, device and who entered them; newest first."""
    return (
        bags.join(facilities.select(F.col("facility_id").alias("location_id"), F.col("facility_name").alias("location_name")), "location_id", "left")
        .join(devices.select("device_id", "device_terminal_id"), "device_id", "left")
        .join(person_names(employees, "created_by", "created_by_name"), "created_by", "left")
        .orderBy(F.col("date").desc(), F.col("id").desc())
    )


def location_directory(locations: DataFrame, facilities: DataFrame, spaces: DataFrame, garage_level: bool = False) -> DataFrame:
    """Locations with facility and space, sorted; only those without a space when garage_level."""
    rows = locations.filter(F.col("space_id").isNull()) if garage_level else locations
    return (
        rows.join(facilities, "facility_id").join(spaces.select("space_id", "space_number"), "space_id", "left")
        .orderBy("facility_name", F.col("space_number").asc_nulls_first())
    )


def space_directory(spaces: DataFrame, facilities: DataFrame) -> DataFrame:
    """Spaces with facility and whether they are active, newest version first."""
    rows = spaces.join(facilities.select("facility_id", "facility_name"), "facility_id")
    return rows.withColumn("is_active", F.col("end_date").isNull()).orderBy("facility_name", "space_number", F.col("start_date").desc())


def device_directory(devices: DataFrame, device_type: str | None = None, hidden: tuple[str, ...] = ("Virtual", "MK5")) -> DataFrame:
    """Devices of a type, or all but the hidden types (and, as in SQL, those without a type), sorted."""
    kind = F.col("device_type")
    rows = devices.filter(kind == device_type) if device_type else devices.filter(~kind.isin(*hidden))
    return rows.orderBy("device_type", "device_terminal_id")


def lookup_directory(dim: DataFrame, sort_by: str, wanted: Column | None = None) -> DataFrame:
    """Payment methods, settlement systems, facilities or employees, filtered and sorted."""
    return (dim if wanted is None else dim.filter(wanted)).orderBy(sort_by)


# --- staff scheduling ----------------------------------------------------------------------------

def shift_overlap(shifts: DataFrame) -> DataFrame:
    """Pairs of shifts of one week and day whose hours overlap, each pair once.

    Of two shifts that overlap the later one starts within the other. A shift
    is laid out over the two-hour slots it touches and meets there the shifts
    that start in the slot, so that pairs which do not overlap are hardly tried.
    """
    c = F.col
    slot = 2
    first, last = F.floor(c("start_hour") / slot).cast("int"), (F.ceil(c("end_hour") / slot) - 1).cast("int")
    spans = shifts.filter(c("start_hour") < c("end_hour")).select("week_start", "day_of_week", "shift_id", "start_hour", "end_hour", first.alias("_first"), last.alias("_last"))
    a = spans.select("week_start", "day_of_week", F.explode(F.sequence("_first", "_last")).alias("_slot"), *[c(n).alias(f"a_{n}") for n in ("shift_id", "start_hour", "end_hour")])
    b = spans.select("week_start", "day_of_week", c("_first").alias("_slot"), *[c(n).alias(f"b_{n}") for n in ("shift_id", "start_hour")])
    # Of shifts that start together the one with the lower id counts as the earlier.
    earlier = (c("a_start_hour") < c("b_start_hour")) | ((c("a_start_hour") == c("b_start_hour")) & (c("a_shift_id") < c("b_shift_id")))
    return a.join(b, ["week_start", "day_of_week", "_slot"]).filter(
        earlier & (c("b_start_hour") < c("a_end_hour")) & (c("a_shift_id") != c("b_shift_id"))
    ).select("week_start", "day_of_week", F.least("a_shift_id", "b_shift_id").alias("first_id"), F.greatest("a_shift_id", "b_shift_id").alias("second_id"))


def overlap_degree(shifts: DataFrame) -> DataFrame:
    """For each shift, how many others of its week and day overlap it; without pairs.

    The starts before a shift's end less the ends up to its start: two counts
    per hour of a day, added up along the day, and looked up once each.
    """
    c, day = F.col, ["week_start", "day_of_week"]
    spans = shifts.filter(c("start_hour") < c("end_hour"))
    marks = F.array(F.struct(c("start_hour").alias("hour"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
                    F.struct(c("end_hour").alias("hour"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    hours = spans.select(*day, F.inline(marks)).groupBy(*day, "hour").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    # The hours of one day are few, however many shifts begin in them.
    along = Window.partitionBy(*day).orderBy("hour")
    sums = hours.select(*day, "hour", F.coalesce(F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begun"),
                        F.sum("ends").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_over"))
    begun, over = sums.select(*day, c("hour").alias("end_hour"), "_begun"), sums.select(*day, c("hour").alias("start_hour"), "_over")
    return spans.join(begun, [*day, "end_hour"]).join(over, [*day, "start_hour"]).select("shift_id", *day, (c("_begun") - c("_over") - 1).alias("overlaps"))


def conflict_lists(shifts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per employee and day, the lists of shifts that run into each other; one row per list.

    A list is a chain of shifts without a free moment in between, with its
    first and last hour. Its length grows with the shifts of one person's day,
    not with their square.
    """
    c, person = F.col, ["employee_id", "week_start", "day_of_week"]
    held = assignments.select("employee_id", "shift_id").distinct().join(shifts.filter(c("start_hour") < c("end_hour")), "shift_id")
    along = Window.partitionBy(*person).orderBy("start_hour", "shift_id")
    reach = F.max("end_hour").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = held.select(*person, "shift_id", "start_hour", "end_hour", F.when(c("start_hour") < reach, 0).otherwise(1).alias("_new"))
    chained = marked.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = chained.groupBy(*person, "_chain").agg(F.array_sort(F.collect_list("shift_id")).alias("shift_ids"), F.min("start_hour").alias("from_hour"), F.max("end_hour").alias("to_hour"))
    return rows.filter(F.size("shift_ids") > 1).drop("_chain")


def blocked_days(shifts: DataFrame, staff: DataFrame, time_off: DataFrame) -> DataFrame:
    """Employee and date of time off on which there are shifts, with their number; stands for blocked_pairs."""
    off = time_off.filter(~F.col("is_cancelled")).select("employee_id", F.to_date("request_date").alias("date"))
    mine = off.join(staff.select("employee_id"), "employee_id", "left_semi").distinct()
    return mine.join(shift_date(shifts).groupBy("date").agg(F.count(F.lit(1)).alias("shifts")), "date")


def staff_days(staff: DataFrame, shifts: DataFrame, time_off: DataFrame) -> DataFrame:
    """Each employee's free dates in the weeks from the first to the last shift.

    An employee can take any shift on a free date, so these rows stand for the
    (employee, shift) pairs without listing them.
    """
    bounds = shifts.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b"))
    last = F.date_add(bounds.select("b").scalar(), 6)
    dates = F.sequence(bounds.select("a").scalar(), last)
    # A person's days off meet the calendar as one list; the free dates are laid out last, and never shuffled.
    off = time_off.filter(~F.col("is_cancelled")).groupBy("employee_id").agg(F.collect_set(F.to_date("request_date")).alias("_off"))
    free = F.array_except(dates, F.coalesce("_off", F.array().cast("array<date>")))
    return staff.select("employee_id").distinct().join(off, "employee_id", "left").select("employee_id", F.explode(free).alias("date"))


def shift_date(shifts: DataFrame) -> DataFrame:
    """Shifts with the date their week and weekday name."""
    offset = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_of_week")).cast("int") - 1
    return shifts.withColumn("date", F.date_add("week_start", offset))


# About: employees laid out together, employees a group gathers, pairs of one task.
BLOCK, GATHERED, PAIRS_PER_TASK = 256, 4_096, 50_000_000


def blocked_pairs(shifts: DataFrame, staff: DataFrame, time_off: DataFrame) -> DataFrame:
    """(employee, shift) pairs ruled out by a time-off request on the shift's date.

    The pairs grow with the square of a date's rows, so only the rows of both
    sides are shuffled: blocks of employees meet the shifts of their date and
    are laid out last, a block once for each shift. The pairs are written in
    runs of a shift and repeats of a block, which files hold in little space.
    A date of very many pairs is cut by its shifts.
    """
    c = F.col
    off = time_off.filter(~c("is_cancelled")).select("employee_id", F.to_date("request_date").alias("date"))
    dated = shift_date(shifts).select("shift_id", "date")
    count = F.count(F.lit(1))
    # One row per date. There are no more employees than requests.
    days = off.groupBy("date").agg(count.alias("_off")).join(dated.groupBy("date").agg(count.alias("_shifts")), "date")
    pairs = c("_off") * c("_shifts")
    days = written(days.select("date", F.ceil(c("_off") / GATHERED).alias("_groups"), F.ceil(pairs / PAIRS_PER_TASK).alias("_cuts"), pairs.alias("_pairs")), "blocked-dates")
    tasks = max(shifts.sparkSession.sparkContext.defaultParallelism, -(-(days.agg(F.sum("_pairs")).first()[0] or 0) // PAIRS_PER_TASK))
    days = F.broadcast(days.drop("_pairs"))
    mine = off.join(staff.select("employee_id").distinct(), "employee_id", "left_semi").join(days, "date")
    group = F.pmod(F.hash("employee_id"), "_groups").alias("_group")
    lists = mine.groupBy("date", "_cuts", group).agg(F.collect_set("employee_id").alias("_ids"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("_ids"), F.lit(BLOCK)), lambda k: F.slice("_ids", k, BLOCK))
    every_cut = lists.select("date", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_cuts") - 1)).alias("_cut"), blocks.alias("_blocks"))
    left = every_cut.repartition(tasks, "date", "_cut").select("date", "_cut", F.explode("_blocks").alias("_block"))
    right = dated.join(days, "date").select("shift_id", "date", F.pmod(F.hash("shift_id"), "_cuts").alias("_cut")).repartition(tasks, "date", "_cut")
    # The merge join takes the left side row by row, and goes over a date's shifts for each.
    return left.hint("merge").join(right, ["date", "_cut"]).select(F.explode("_block").alias("employee_id"), "shift_id")


def eligible_counts(shifts: DataFrame, staff: DataFrame, time_off: DataFrame) -> DataFrame:
    """Per shift, how many employees are free that day; 0 marks a shift nobody can take.

    Free staff are counted per date as all staff less those off, so that no
    (employee, shift) pair is formed.
    """
    off = (
        time_off.filter(~F.col("is_cancelled")).join(staff.select("employee_id").distinct(), "employee_id", "left_semi")
        .groupBy(F.to_date("request_date").alias("date")).agg(F.countDistinct("employee_id").alias("_off"))
    )
    everyone = staff.agg(F.countDistinct("employee_id")).scalar()
    free = everyone - F.coalesce("_off", F.lit(0))
    return shift_date(shifts).join(off, "date", "left").select(*shifts.columns, free.alias("eligible"))


def uncovered_shifts(shifts: DataFrame, staff: DataFrame, time_off: DataFrame) -> DataFrame:
    """Shifts no employee can take."""
    return eligible_counts(shifts, staff, time_off).filter("eligible = 0").drop("eligible")


SHIFT_KEY = ["location", "booth", "day_of_week", "start_hour", "end_hour"]


def kth_match(solver_rows: DataFrame, shifts: DataFrame, step: int = 100_000) -> DataFrame:
    """Solver rows and shifts with the same key, paired first to first, second to second; the surplus is left out.

    Rows of a key are numbered in stretches of `step` ids, so that a key with very many rows is not one task.
    """
    def numbered(df: DataFrame, by: str) -> DataFrame:
        return ordered_scan(df.select(*SHIFT_KEY, by), SHIFT_KEY, [by], F.floor(F.col(by) / step), row_number="_k")

    return numbered(solver_rows, "employee_id").join(numbered(shifts, "shift_id"), [*SHIFT_KEY, "_k"]).select("shift_id", "employee_id")


def employee_weeks(shifts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Weeks in which an employee has a shift."""
    return assignments.join(shifts.select("shift_id", "week_start"), "shift_id").select("employee_id", "week_start").distinct()


def week_overview(shifts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Shifts per week, and whether any is assigned."""
    done = assignments.select("shift_id").distinct().withColumn("_a", F.lit(1))
    return shifts.join(done, "shift_id", "left").groupBy("week_start").agg(
        F.count(F.lit(1)).alias("shift_count"), F.max(F.col("_a").isNotNull()).cast("int").alias("is_solved")
    )


def cashier_hours(shifts: DataFrame, assignments: DataFrame, limit: float = 40.0) -> DataFrame:
    """Paid hours and locations of each employee per week, flagged above the limit."""
    hours = F.sum(paid_hours(F.col("start_hour"), F.col("end_hour")))
    return assignments.join(shifts, "shift_id").groupBy("employee_id", "week_start").agg(
        hours.alias("paid_hours"), F.countDistinct("location").alias("locations"), (hours > limit).cast("int").alias("over_limit")
    )


def template_shifts(template: DataFrame, first_week: str, last_week: str) -> DataFrame:
    """The weekly template laid out over weeks (first and last given as Sundays)."""
    weeks = F.sequence(F.lit(first_week).cast("date"), F.lit(last_week).cast("date"), F.expr("interval 7 days"))
    return template.withColumn("week_start", F.explode(weeks)).withColumns({"special_event": F.lit(False), "rush": F.lit(0)})


def event_shift_demand(events: DataFrame, booths_by_word: dict[str, list[int]], other_booths: list[int]) -> DataFrame:
    """Shifts that events call for.

    Booths follow from a word in the facility's name (first word that fits).
    Hours are decimal, an end on a later day counts past 24, and rush is the
    minutes a shift falls short of five hours.
    """
    c = F.col
    low = F.lower(F.trim("facility_name"))
    booths = F.array(*[F.lit(b) for b in other_booths])
    for word, numbers in reversed(booths_by_word.items()):
        booths = F.when(low.contains(word), F.array(*[F.lit(b) for b in numbers])).otherwise(booths)

    def hour(ts: str) -> Column:
        return F.hour(ts) + F.minute(ts) / 60.0

    later = F.to_date("event_end") > F.to_date("event_start")
    rows = events.withColumns({"start_hour": hour("event_start"), "end_hour": hour("event_end") + F.when(later, 24.0).otherwise(0.0)})
    # Rounded before the fraction is cut, so that binary hours do not lose a minute.
    rush = F.round((5 - (c("end_hour") - c("start_hour"))) * 60, 6).cast("int")
    return rows.select(
        "event_id", F.trim("facility_name").alias("location"), F.explode(booths).alias("booth"), tp.day_name(c("event_start")).alias("day_of_week"),
        "start_hour", "end_hour", F.lit(True).alias("special_event"), rush.alias("rush"),
    )
