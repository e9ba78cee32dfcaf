"""Ordered scans that survive a hot key, and the window operators W1-W7 built on them.

A plain window per key puts all rows of one key in one task. Here a key's rows
are cut into time chunks: every chunk is scanned by itself, one small row per
(key, chunk) carries the state over from earlier chunks, and both meet again in
a join on (key, chunk), which the chunk window has already partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.session import cut_lineage

DAY, MONTH = "day", "month"


def chunk_of(ts: str | Column, unit: str = DAY) -> Column:
    """Chunk key of a timestamp."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    return d if unit == DAY else F.trunc(d, unit)


def null_safe(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Columns to partition and join by, in which a NULL of any of `columns` equals itself."""
    out = {}
    for n in columns:
        kind = df.schema[n].dataType
        stand_in = F.lit("").cast(kind) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit("1970-01-01").cast(kind) if isinstance(
            kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(0).cast(kind)
        out |= {f"_null_{n}": F.col(n).isNull(), f"_safe_{n}": F.coalesce(F.col(n), stand_in)}
    return out


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    *,
    row_number: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
) -> DataFrame:
    """Window results per key in `order`, computed chunk by chunk.

    row_number: name of a running row number.
    sums:  running total up to and including the row.
    lasts: last non-NULL value up to and including the row.
    nexts: value of the next row; NULL on a key's last row.
    prevs: value of the previous row; NULL on a key's first row.
    highs: greatest value of the rows before.
    Chunks must rise with `order`. No row is lost: a NULL key is a key of its
    own, and rows with a NULL chunk are the key's first chunk.
    """
    sums, lasts, nexts, prevs, highs = sums or {}, lasts or {}, nexts or {}, prevs or {}, highs or {}
    inputs = {f"_in_{n}": c for part in (sums, lasts, nexts, prevs, highs) for n, c in part.items()}
    cut = df.withColumns({**inputs, "_chunk": chunk})
    safe = null_safe(cut, [*keys, "_chunk"])
    cut = cut.withColumns(safe)
    of_key = [n for n in safe if not n.endswith("_chunk")]
    of_chunk = list(safe)
    at = F.struct(*[F.col(c) for c in order])

    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums]
    aggs += [F.max(F.when(F.col(f"_in_{n}").isNotNull(), F.struct(at.alias("at"), F.col(f"_in_{n}").alias("v")))).alias(f"_c_{n}") for n in lasts]
    aggs += [F.min(F.struct(at.alias("at"), F.col(f"_in_{n}").alias("v"))).alias(f"_c_{n}") for n in nexts]
    aggs += [F.max(F.struct(at.alias("at"), F.col(f"_in_{n}").alias("v"))).alias(f"_c_{n}") for n in prevs]
    aggs += [F.max(f"_in_{n}").alias(f"_c_{n}") for n in highs]
    per_chunk = cut.groupBy(*of_chunk).agg(*aggs)

    along = Window.partitionBy(*of_key).orderBy(F.desc("_null__chunk"), "_safe__chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_before_rows": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    carried |= {f"_k_{n}": F.sum(f"_c_{n}").over(before) for n in sums}
    carried |= {f"_k_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before)["v"] for n in lasts}
    carried |= {f"_k_{n}": F.lead(f"_c_{n}").over(along)["v"] for n in nexts}
    carried |= {f"_k_{n}": F.lag(f"_c_{n}").over(along)["v"] for n in prevs}
    carried |= {f"_k_{n}": F.max(f"_c_{n}").over(before) for n in highs}
    carry = per_chunk.select(*of_chunk, *[c.alias(n) for n, c in carried.items()])

    inside = Window.partitionBy(*of_chunk).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_w_{n}": F.sum(f"_in_{n}").over(upto) for n in sums}
    local |= {f"_w_{n}": F.last(f"_in_{n}", ignorenulls=True).over(upto) for n in lasts}
    local |= {f"_w_{n}": F.lead(F.struct(F.col(f"_in_{n}").alias("v"))).over(inside) for n in nexts}
    local |= {f"_w_{n}": F.lag(F.struct(F.col(f"_in_{n}").alias("v"))).over(inside) for n in prevs}
    local |= {f"_w_{n}": F.max(f"_in_{n}").over(earlier) for n in highs}
    if row_number:
        local["_w_row"] = F.row_number().over(inside)

    joined = cut.withColumns(local).join(carry, of_chunk)
    zero = F.lit(0)
    out = {n: F.coalesce(F.col(f"_w_{n}"), zero) + F.coalesce(F.col(f"_k_{n}"), zero) for n in sums}
    out |= {n: F.coalesce(f"_w_{n}", f"_k_{n}") for n in lasts}
    out |= {n: F.when(F.col(f"_w_{n}").isNotNull(), F.col(f"_w_{n}")["v"]).otherwise(F.col(f"_k_{n}")) for n in (*nexts, *prevs)}
    out |= {n: F.greatest(f"_w_{n}", f"_k_{n}") for n in highs}
    if row_number:
        out[row_number] = (F.col("_before_rows") + F.col("_w_row")).cast("bigint")
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])


def prefix_sums(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """`before_<n>` for each of `sums`: its total over all rows earlier in `order`, for a table without a key to split by.

    Rows are dealt by ranges of the order and summed within their range; the
    totals of the ranges before, one small row per range, are added.
    """
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: the only window over all rows of a table, and it is bounded by the number of ranges.
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums])
    carried = totals.select("_range", *[F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"_k_{n}") for n in sums])
    local = placed.withColumns({f"_w_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums})
    return local.join(carried, "_range").select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_k_{n}")).alias(f"before_{n}") for n in sums])


def order_statistics(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the quantile at its share, interpolated between the two rows around its rank.

    Rows are counted per distinct value first; NULLs do not count. No rows give NULLs.
    """
    c = F.col
    cells = df.filter(c(value).isNotNull()).groupBy(c(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(cells, ["_v"], ["_n"])
    last = cells.agg(F.sum("_n")).scalar() - 1
    sides, out = [], []
    for name, share in shares.items():
        rank = last * F.lit(float(share))
        low, high = F.floor(rank), F.ceil(rank)
        for side, at in (("low", low), ("high", high)):
            sides.append(F.max(F.when((c("before__n") <= at) & (at < c("before__n") + c("_n")), c("_v"))).alias(f"_{side}_{name}"))
        between = (high - rank) * c(f"_low_{name}") + (rank - low) * c(f"_high_{name}")
        out.append(F.when(low == high, c(f"_low_{name}")).otherwise(between).alias(name))
    return ranked.agg(*sides).select(*out)


def event_order(events: DataFrame, key: str, ts: str, tie: str, out: str = "rn", unit: str = MONTH) -> DataFrame:
    """Position of each event of a key in time order, ties by log id."""
    return ordered_scan(events, [key], [ts, tie], chunk_of(ts, unit), row_number=out)


def carry_forward(events: DataFrame, key: str, ts: str, tie: str, signals: dict[str, Column], unit: str = MONTH) -> DataFrame:
    """The last known value of each signal at every event."""
    return ordered_scan(events, [key], [ts, tie], chunk_of(ts, unit), lasts=signals)


def period_end(events: DataFrame, key: str, ts: str, tie: str, out: str = "period_end", unit: str = MONTH) -> DataFrame:
    """Time of the key's next event."""
    return ordered_scan(events, [key], [ts, tie], chunk_of(ts, unit), nexts={out: F.col(ts)})


def islands(events: DataFrame, key: str, ts: str, tie: str, state: str, out: str = "island", unit: str = MONTH) -> DataFrame:
    """Number of the run of equal `state` values that an event belongs to, counted from 1 per key.

    One scan: changes of state are counted within each chunk, and the changes
    of the chunks before, with those between one chunk and the next, are added.
    """
    cut = events.withColumn("_chunk", chunk_of(ts, unit))
    safe = null_safe(cut, [key, "_chunk"])
    of_chunk, of_key = list(safe), [n for n in safe if not n.endswith("_chunk")]
    inside = Window.partitionBy(*of_chunk).orderBy(ts, tie)
    before = F.lag(F.struct(F.col(state).alias("v"))).over(inside)
    turned = F.when(before.isNotNull() & ~before["v"].eqNullSafe(F.col(state)), 1).otherwise(0)
    scanned = cut.withColumns(safe).withColumn("_turn", turned).withColumn(
        "_turns", F.sum("_turn").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    at, held = F.struct(ts, tie), F.struct(F.col(state).alias("v"))
    per_chunk = scanned.groupBy(*of_chunk).agg(F.max("_turns").alias("_inner"), F.min_by(held, at).alias("_head"), F.max_by(held, at).alias("_tail"))
    along = Window.partitionBy(*of_key).orderBy(F.desc("_null__chunk"), "_safe__chunk")
    tail = F.lag("_tail").over(along)
    joint = F.when(tail.isNull() | ~tail["v"].eqNullSafe(F.col("_head.v")), 1).otherwise(0)
    earlier = F.coalesce(F.sum("_inner").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joints = F.sum("_joint").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = per_chunk.withColumn("_joint", joint).select(*of_chunk, (earlier + joints).alias("_before"))
    kept = [n for n in events.columns if n != out]
    return scanned.join(carry, of_chunk).select(*kept, (F.col("_before") + F.col("_turns")).alias(out))


def running_occupancy(deltas: DataFrame, keys: list[str], minute: str, values: list[str], day: Column) -> DataFrame:
    """Running total of the deltas of each key in minute order."""
    return ordered_scan(deltas, keys, [minute], day, sums={v: F.col(v) for v in values})


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], *, newest: bool = True) -> DataFrame:
    """One whole row per key, the greatest (or least) by `order`.

    A grouped max_by keeps at most one row per key and map task before the shuffle.
    """
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)
