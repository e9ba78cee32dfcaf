"""Load-time validation of card sales: S19."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns a card sales file must fill, and those that hold a currency code.
REQUIRED = (
    "business_name", "mid", "card_brand", "card_number", "transaction_type", "void_ind", "settled_amount",
    "settled_currency", "settled_date", "transaction_amount", "transaction_currency", "transaction_date",
    "transaction_time", "authorization_code", "gbok_batch_id", "terminal_id", "durbin_regulated",
    "card_swipe_indicator", "pos_entry",
)
CURRENCY = ("settled_currency", "transaction_currency")


def validate_pi(df: DataFrame, required: tuple[str, ...] = REQUIRED, currency: tuple[str, ...] = CURRENCY) -> DataFrame:
    """One row per problem (column, problem, rows); no row when the file is sound. One pass over the data."""
    missing = [c for c in required if c not in df.columns]
    held = [c for c in required if c in df.columns]
    coded = [c for c in currency if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in held],
        *[F.count_if(F.length(c) != 3).alias(f"code_{c}") for c in coded],
    )
    found = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit("missing column").alias("problem"), F.col("_rows").alias("rows")) for c in missing],
        *[F.struct(F.lit(c).alias("column"), F.lit("null values").alias("problem"), F.col(f"null_{c}").alias("rows")) for c in held],
        *[F.struct(F.lit(c).alias("column"), F.lit("bad currency code").alias("problem"), F.col(f"code_{c}").alias("rows")) for c in coded],
    )
    return counts.select(F.inline(found)).filter((F.col("rows") > 0) | (F.col("problem") == "missing column"))


def require_valid(df: DataFrame) -> DataFrame:
    """The same rows, or an error that names the problems of the file."""
    problems = validate_pi(df).collect()  # at most one row per column and check
    if problems:
        raise ValueError("; ".join(f"{r['column']}: {r['problem']} ({r['rows']})" for r in problems))
    return df
