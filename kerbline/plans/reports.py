"""Revenue, settlement, file and enforcement reports: A1-A17, A21, A22, T1-T4.

The fact table is reduced to one row per combination of dimension ids before
any dimension is joined or any rollup expands it, so only that small result is
shuffled, however many facts one device or garage holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import timeparts as tp
from kerbline.functions.payments import program_label
from kerbline.functions.policies import full_name
from kerbline.operators.ordered import latest_per_key

GRAND_TOTAL, SUBTOTAL_2, SUBTOTAL_1, SUBTOTAL_0 = "*** GRAND TOTAL ***", "** Subtotal **", "* Subtotal *", "Subtotal"
FACT_IDS = ["charge_code_id", "location_id", "settlement_system_id", "payment_method_id", "device_id", "program_id"]

# Staging tables the settled-by-source pivot counts, in column order.
PIVOT_SOURCES = ("windcave_staging", "payments_insider_sales_staging", "ips_staging", "zms_cash_regular")


def _ntz(value) -> Column:
    return F.lit(value).cast(tp.NTZ)


def settled_between(fact: DataFrame, start: str, end: str) -> DataFrame:
    """Facts settled from the start of the first day to the end of the last day."""
    day_after = F.date_add(F.lit(end).cast("date"), 1).cast(tp.NTZ)
    return fact.filter((F.col("settle_date") >= _ntz(f"{start} 00:00:00")) & (F.col("settle_date") < day_after))


def _per_dimension(fact: DataFrame, *extra: Column) -> DataFrame:
    return fact.groupBy(*FACT_IDS, *extra).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("transaction_amount").alias("amount"),
        F.sum("settle_amount").alias("settled"),
        F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"),
    )


def _with_dimensions(reduced: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Join the reduced facts to charge_code, location, facility, settlement, method and device."""
    return (
        reduced.join(dims["charge_code"].select("charge_code_id", "charge_code"), "charge_code_id")
        .join(dims["location"].select("location_id", "facility_id"), "location_id")
        .join(dims["facility"].select("facility_id", "facility_name", "facility_type"), "facility_id")
        .join(dims["settlement"].select("settlement_system_id", "system_name"), "settlement_system_id")
        .join(dims["method"].select("payment_method_id", "payment_method_type"), "payment_method_id")
        .join(dims["device"].select("device_id", "device_terminal_id", "device_type"), "device_id")
    )


def _totals() -> list[Column]:
    return [
        F.sum("n").alias("transaction_count"),
        F.sum("amount").alias("total_transaction_amount"),
        F.sum("settled").alias("total_settle_amount"),
        F.min("first").alias("earliest_transaction_date"),
        F.max("last").alias("latest_transaction_date"),
    ]


def _rollup(rows: DataFrame, levels: list[tuple[str, str, str]]) -> DataFrame:
    """Rollup over (column, flag name, subtotal label) levels, labelled by grouping() so that a real NULL stays NULL."""
    names = [c for c, _, _ in levels]
    flags = [F.grouping(c).cast("int").alias(f) for c, f, _ in levels]
    rolled = rows.rollup(*names).agg(*_totals(), *flags, F.grouping_id(*names).cast("int").alias("grouping_level"))
    for c, flag, label in levels:
        rolled = rolled.withColumn(c, F.when(F.col(flag) == 1, label).otherwise(F.col(c)))
    return rolled


def settle_rollup_4(fact: DataFrame, dims: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """A1: settlement by charge code, facility, program and device, with subtotals and a grand total."""
    rows = _with_dimensions(_per_dimension(settled_between(fact, start, end)), dims)
    rows = rows.withColumn("charge_code", F.col("charge_code").cast("string"))
    rows = rows.withColumn("program_type", program_label(F.col("program_id")))
    return _rollup(rows, [
        ("charge_code", "is_charge_code_total", GRAND_TOTAL),
        ("facility_name", "is_facility_total", SUBTOTAL_2),
        ("program_type", "is_program_type_total", SUBTOTAL_1),
        ("device_terminal_id", "is_device_total", SUBTOTAL_0),
    ])


def settle_rollup_5(fact: DataFrame, dims: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """A2: settlement by charge code, facility, payment type, device type and device."""
    rows = _with_dimensions(_per_dimension(settled_between(fact, start, end)), dims)
    rows = rows.withColumn("charge_code", F.col("charge_code").cast("string"))
    return _rollup(rows, [
        ("charge_code", "is_charge_code_total", GRAND_TOTAL),
        ("facility_name", "is_facility_total", SUBTOTAL_2),
        ("payment_method_type", "is_payment_method_type_total", SUBTOTAL_1),
        ("device_type", "is_device_type_total", SUBTOTAL_0),
        ("device_terminal_id", "is_device_total", SUBTOTAL_0),
    ])


def rollup_order(rolled: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """A3: grand total first, then each subtotal ahead of its detail."""
    keys = []
    for column, flag in levels:
        keys += [F.col(flag).desc(), F.col(column).asc_nulls_first()]
    return rolled.orderBy(*keys)


def settle_totals(fact: DataFrame, start: str, end: str) -> DataFrame:
    """A4: number of facts and the settled amount, falling back to the transaction amount."""
    return settled_between(fact, start, end).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(F.coalesce("settle_amount", "transaction_amount")).alias("total_settled"),
    )


def calendar(spark, start: str, end: str, name: str = "day") -> DataFrame:
    """Every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name))


def source_pivot(fact: DataFrame, start: str, end: str, sources: tuple[str, ...] = PIVOT_SOURCES) -> DataFrame:
    """A5: facts per settlement day and staging source; every day appears, newest first."""
    counted = settled_between(fact, start, end).groupBy(F.to_date("settle_date").alias("day")).agg(
        *[F.count_if(F.col("staging_table") == s).alias(s) for s in sources]
    )
    days = calendar(fact.sparkSession, start, end)
    return days.join(counted, "day", "left").fillna(0, list(sources)).orderBy(F.col("day").desc())


REVENUE_FILTERS = ("system_name", "payment_method_type", "charge_code", "device_type", "facility_type", "facility_name")


def revenue_by_period(fact: DataFrame, dims: dict[str, DataFrame], start: str, end: str, period: str = "month",
                      filters: dict[str, object] | None = None) -> DataFrame:
    """Facts and settled amount per report period, with optional dimension filters."""
    key = tp.period_key(F.col("settle_date"), period).alias("period_key")
    label = tp.period_label(F.col("settle_date"), period).alias("period_label")
    rows = _with_dimensions(_per_dimension(settled_between(fact, start, end), key, label), dims)
    for name, value in (filters or {}).items():
        if name not in REVENUE_FILTERS:
            raise ValueError(f"unknown filter {name!r}")
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows.groupBy("period_key", "period_label").agg(F.sum("n").alias("transaction_count"), F.sum("settled").alias("amount"))


def revenue_summary(by_period: DataFrame) -> DataFrame:
    """Totals over the periods of a revenue report."""
    total, n = F.sum("amount"), F.sum("transaction_count")
    return by_period.agg(
        F.coalesce(total, F.lit(0)).alias("total_revenue"),
        F.coalesce(n, F.lit(0)).alias("transaction_count"),
        F.when(n > 0, total.cast("double") / n.cast("double")).otherwise(0.0).alias("avg_per_transaction"),
        F.count(F.lit(1)).alias("period_count"),
    )


def filter_options(dims: dict[str, DataFrame]) -> DataFrame:
    """Distinct non-NULL values of the six filter columns, in long form, sorted within each filter."""
    wanted = [
        ("settlement", "system_name"), ("method", "payment_method_type"), ("charge_code", "charge_code"),
        ("device", "device_type"), ("facility", "facility_type"), ("facility", "facility_name"),
    ]
    out = None
    for dim, column in wanted:
        values = dims[dim].filter(F.col(column).isNotNull()).select(
            F.lit(column).alias("filter"), F.col(column).cast("string").alias("value")
        ).distinct()
        out = values if out is None else out.unionByName(values)
    return out.orderBy("filter", "value")


def facility_wow(fact: DataFrame, dims: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Per facility, the seven days before `as_of` against the seven before those."""
    today = F.lit(as_of).cast("date")
    day = F.to_date("settle_date")
    recent = (day >= F.date_sub(today, 7)) & (day < today)
    prior = (day >= F.date_sub(today, 14)) & (day < F.date_sub(today, 7))
    per_place = fact.filter(recent | prior).groupBy("location_id").agg(
        F.count_if(recent).alias("n"),
        F.sum(F.when(recent, F.col("settle_amount"))).alias("now"),
        F.sum(F.when(prior, F.col("settle_amount"))).alias("was"),
    )
    rows = per_place.join(dims["location"].select("location_id", "facility_id"), "location_id").join(dims["facility"], "facility_id")
    both = rows.groupBy("facility_name", "facility_type").agg(
        F.sum("n").alias("transaction_count"), F.sum("now").alias("total_settled"), F.sum("was").alias("was")
    ).filter("transaction_count > 0")
    change = F.col("total_settled") - F.col("was")
    percent = F.when(F.col("was") != 0, F.round(change.cast("decimal(20,4)") * 100 / F.abs("was").cast("decimal(18,4)"), 1))
    return both.select("facility_name", "facility_type", "transaction_count", "total_settled",
                       change.alias("raw_change"), percent.alias("percent_change"))


def recent_summary(fact: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Facts, settled amount and last settlement date of the days before `as_of`."""
    today = F.lit(as_of).cast("date")
    day = F.to_date("settle_date")
    return fact.filter((day >= F.date_sub(today, days)) & (day < today)).agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("settle_amount").alias("total_settled"),
        F.max("settle_date").alias("last_settle_date"),
    )


def recent_uploads(files: DataFrame, employees: DataFrame, n: int = 10) -> DataFrame:
    """The newest files with who sent them. The limit is taken before the join."""
    newest = files.orderBy(F.col("upload_date").desc(), F.col("id").desc()).limit(n)
    who = employees.select(F.col("employee_id").alias("uploaded_by"), full_name(F.col("first_name"), F.col("last_name")).alias("uploaded_by_name"))
    return newest.join(who, "uploaded_by", "left")


def transaction_stats(transactions: DataFrame, approximate: bool = False) -> DataFrame:
    """Counts, distinct merchants, date range, sum and average of the settled amount."""
    merchants = F.approx_count_distinct("mid") if approximate else F.countDistinct("mid")
    return transactions.agg(
        F.count(F.lit(1)).alias("total_records"), merchants.alias("unique_merchants"),
        F.min("transaction_date").alias("earliest_transaction"), F.max("transaction_date").alias("latest_transaction"),
        F.sum("settle_amount").alias("total_settled_amount"),
        (F.sum("settle_amount").cast("double") / F.count("settle_amount")).alias("avg_settled_amount"),
    )


SKETCH_LG_K = 14  # a standard error of 0.8 %, 16 KB a day at most


def daily_sketches(transactions: DataFrame) -> DataFrame:
    """A11 for any range of days: one row per day with counts, sums and a mergeable sketch of the distinct merchants."""
    return transactions.groupBy(F.to_date("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.count("settle_amount").alias("settled"), F.sum("settle_amount").alias("settled_amount"),
        F.min("transaction_date").alias("earliest"), F.max("transaction_date").alias("latest"), F.hll_sketch_agg("mid", F.lit(SKETCH_LG_K)).alias("merchants"),
    )


def stats_from_sketches(sketches: DataFrame, start: str | None = None, end: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A11 from stored days, without reading transactions: unique_merchants is approximate, the rest is exact.

    `start` and `end` are days, both included; `by` groups by further columns.
    """
    day = F.col("day")
    rows = sketches if start is None else sketches.filter(day >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.filter(day <= F.lit(end).cast("date"))
    return rows.groupBy(*by).agg(
        F.sum("records").alias("total_records"), F.hll_sketch_estimate(F.hll_union_agg("merchants")).alias("unique_merchants"),
        F.min("earliest").alias("earliest_transaction"), F.max("latest").alias("latest_transaction"), F.sum("settled_amount").alias("total_settled_amount"),
        (F.sum("settled_amount").cast("double") / F.sum("settled")).alias("avg_settled_amount"),
    )


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Totals, and sums by payment type, location type and source; filter first with search_transactions.

    Rows are long: breakdown is total, payment_type, location_type or source.
    """
    by = ["payment_type", "location_type", "source"]
    reduced = transactions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("transaction_amount").alias("amount"), F.sum("settle_amount").alias("settled"),
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"),
    )
    sets = [[F.col(c)] for c in by] + [[]]
    gid = F.grouping_id(*by)
    rolled = reduced.groupingSets(sets, *[F.col(c) for c in by]).agg(
        gid.alias("_gid"), F.sum("n").alias("total_count"), F.sum("amount").alias("total_amount"),
        F.sum("settled").alias("total_settle_amount"), F.min("first").alias("start"), F.max("last").alias("end"),
    )
    breakdown = F.when(F.col("_gid") == 3, by[0]).when(F.col("_gid") == 5, by[1]).when(F.col("_gid") == 6, by[2]).otherwise("total")
    return rolled.select(breakdown.alias("breakdown"), F.coalesce(*by).alias("value"),
                         "total_count", "total_amount", "total_settle_amount", "start", "end")


def daily_summary(transactions: DataFrame) -> DataFrame:
    """Counts and amounts per day, source, location type and payment type."""
    return transactions.groupBy(F.to_date("transaction_date").alias("day"), "source", "location_type", "payment_type").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("transaction_amount").alias("total_amount"),
        F.sum("settle_amount").alias("total_settle_amount"),
        (F.sum("transaction_amount").cast("double") / F.count("transaction_amount")).alias("avg_transaction_amount"),
    )


def pending_by_source(staging_tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each staging table that have not been posted."""
    out = None
    for name, table in staging_tables.items():
        counted = table.agg(F.count_if(~F.col("processed_to_final")).alias("pending")).select(F.lit(name).alias("source"), "pending")
        out = counted if out is None else out.unionByName(counted)
    return out


DONE = ("complete", "completed")


def file_status(files: DataFrame, log: DataFrame, status: str | None = None) -> DataFrame:
    """Per file, status and progress over its runs. The log is summed per file before the join.

    `status` keeps complete, not_complete, failed or not_started files.
    """
    seen = log.filter(F.col("source_file_id").isNotNull()).groupBy(F.col("source_file_id").alias("id")).agg(
        F.max(F.col("status").isin(*DONE)).alias("_done"),
        F.max(F.col("status") == "running").alias("_running"),
        F.max(F.col("status") == "failed").alias("_failed"),
        F.sum("records_created").alias("records_created"),
        F.sum("records_failed").alias("records_failed"),
        F.sum("records_processed").alias("_processed"),
        F.max("error_message").alias("_error"),
    )
    c = F.col
    flag = {n: F.coalesce(c(n), F.lit(False)) for n in ("_done", "_running", "_failed")}
    rows = files.join(seen, "id", "left")
    out = rows.select(
        *[n for n in files.columns],
        F.when(c("is_processed") & (c("records_processed") == 0), "complete")
        .when(c("records_processed").isNull(), "not_started")
        .when(flag["_done"], "complete").when(flag["_running"], "in_progress").when(flag["_failed"], "failed")
        .otherwise("not_complete").alias("status"),
        "records_created", "records_failed",
        F.when(c("records_created") == c("_processed"), "").otherwise(c("_error")).alias("error_message"),
        F.when((c("records_processed") > 0) & (c("records_created") > 0),
               c("records_created").cast("double") / c("records_processed").cast("double") * 100.0).alias("percent_complete"),
        (~flag["_done"]).cast("int").alias("needs_etl"),
        F.when((c("records_processed") > 0) & ~flag["_running"], 1).otherwise(0).alias("can_process"),
        flag["_done"].alias("_done"), flag["_failed"].alias("_failed"),
    )
    keep = {
        None: F.lit(True),
        "complete": c("_done"),
        "failed": c("_failed"),
        "not_started": c("records_processed").isNull(),
        "not_complete": c("records_processed").isNotNull() & (F.coalesce("records_created", F.lit(0)) < c("records_processed")),
    }
    if status not in keep:
        raise ValueError(f"unknown status filter {status!r}")
    return out.filter(keep[status]).drop("_done", "_failed")


WARNING, VOID, TOW = "Warning", "Void Approved", "TOW FEE"


def first_citations(citations: DataFrame, day: str | None = None) -> DataFrame:
    """One row per ticket, the first issued; one day's, or all."""
    rows = citations if day is None else citations.filter(F.to_date("issue_ts") == F.lit(day).cast("date"))
    return latest_per_key(rows, ["ticketid"], [F.col("issue_ts"), F.col("status")], newest=False)


def citation_summary(citations: DataFrame, day: str | None = None) -> DataFrame:
    """Citations and amount without voids, and warnings, tows and voids, per day of issue."""
    void = F.coalesce(F.col("status") == VOID, F.lit(False))
    return first_citations(citations, day).groupBy(F.to_date("issue_ts").alias("report_date")).agg(
        F.count_if(~void).alias("citations"),
        F.sum(F.when(~void, F.coalesce("amount", F.lit(0))).otherwise(0)).alias("total_amount"),
        F.count_if(F.col("status") == WARNING).alias("warnings"),
        F.count_if((F.col("violation") == TOW) & ~void).alias("tows"),
        F.count_if(void).alias("voids"),
    )


def citation_breakdown(citations: DataFrame, day: str | None = None) -> DataFrame:
    """Tickets by hour (all 24 hours), violation, status and badge, in long form; voids stay in.

    One pass turns a ticket into its four labels.
    """
    def word(c: str) -> Column:
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))

    labels = F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("label"))
        for kind, value in (
            ("hour", F.hour("issue_ts").cast("string")), ("violation", word("violation")),
            ("status", word("status")), ("badge", word("badge")),
        )
    ])
    counted = first_citations(citations, day).select(F.inline(labels)).filter("label is not null").groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("count")
    )
    hours = citations.sparkSession.range(24).select(
        F.lit("hour").alias("kind"), F.col("id").cast("string").alias("label"), F.lit(0).cast("bigint").alias("count")
    )
    return counted.unionByName(hours).groupBy("kind", "label").agg(F.sum("count").alias("count"))


def visit_status_crosstab(pairs: DataFrame) -> DataFrame:
    """New status by stored status."""
    stored = ["Complete", "Entry Only", "Entry Only - Permit Holder", "Exit Only"]
    s = F.col("stored_status")
    return pairs.groupBy("status").agg(
        *[F.count_if(s == v).alias(v.lower().replace(" - ", "_").replace(" ", "_")) for v in stored],
        F.count_if(s.isNull()).alias("none"),
    )


def load_window(visits: DataFrame, since: str | None = None) -> DataFrame:
    """First and last entry and exit per garage and load time, since the last summary."""
    rows = visits if since is None else visits.filter(F.col("load_ts") >= _ntz(since))
    return rows.groupBy("garage_id", "load_ts").agg(
        F.min("entry_ts").alias("min_entry"), F.min("exit_ts").alias("min_exit"),
        F.max("entry_ts").alias("max_entry"), F.max("exit_ts").alias("max_exit"),
    )
