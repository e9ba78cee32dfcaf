"""Which report a file is, its date, and whether it was seen before: S1-S4."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.operators.ordered import ordered_scan

# Filename rules, tried in order on the lower-cased name.
SOURCE_RULES = (
    ("starts", "payments", "payments_insider_payments"),
    ("contains", "sales", "payments_insider_sales"),
    ("starts", "transaction summary", "ips"),
    ("starts", "dailybankrecon", "ips_cc"),
    ("starts", "pbp", "ips_mobile"),
    ("starts", "collection report", "ips_cash"),
    ("contains", "coin collector card", "coin_collection"),
    ("starts", "windcave", "windcave"),
    ("starts", "wc", "windcave"),
)
OTHER = "other"

# Date spellings in filenames, with the format of each.
NAME_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{2}_\d{2}_\d{4})"


def file_name(path: Column) -> Column:
    """The part of a path after the last slash, with URL escapes decoded."""
    # A plus sign stands for itself in a path, not for a blank as in a form.
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def infer_source(name: Column) -> Column:
    """Report kind of a filename; the first rule that fits decides."""
    low = F.lower(name)
    out = F.when(name.isNull() | (name == ""), OTHER)
    for how, word, source in SOURCE_RULES:
        out = out.when(low.startswith(word) if how == "starts" else low.contains(word), source)
    return out.otherwise(OTHER)


def report_date_from_name(name: Column) -> Column:
    """The day before the first date in a filename; NULL when there is none or it is no date."""
    found = F.regexp_extract(name, NAME_DATE, 1)
    stamp = (
        F.when(found.contains("-"), F.try_to_timestamp(found, F.lit("yyyy-MM-dd")))
        .when(found.contains("_"), F.try_to_timestamp(found, F.lit("MM_dd_yyyy")))
        .when(found != "", F.try_to_timestamp(found, F.lit("yyyyMMdd")))
    )
    return F.date_sub(F.to_date(stamp), 1)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes, one row each, with name and content hash."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.col("modificationTime").alias("modified"),
        file_name(F.col("path")).alias("file_name"), F.sha2("content", 256).alias("file_hash"),
    )


def file_dedup(files: DataFrame, registry: DataFrame) -> DataFrame:
    """S3: files whose content hash is not registered, one per hash (the first by path)."""
    rest = [c for c in files.columns if c != "file_hash"]
    first = files.groupBy("file_hash").agg(F.min_by(F.struct(*rest), "path").alias("_f")).select("file_hash", "_f.*")
    known = registry.select("file_hash").distinct()
    return first.join(known, "file_hash", "left_anti").select(*files.columns)


def header_names(lines: list[str]) -> list[str]:
    """Column names of the CSV record that starts with the first line; quoted names may hold commas and line breaks."""
    return next(csv.reader([line.rstrip("\r\n") + "\n" for line in lines]))


def csv_records(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whole CSV records (keys, block, place, record) from physical lines (keys, block, place, value).

    A line begins inside a quoted field when the quotes before it are odd in
    number (a doubled quote counts twice). Their sum runs block by block, one
    small row carrying it from block to block, so that a report of any size is
    cut wherever its blocks are. Records of one line, nearly all, are done
    then; only lines of longer ones are put together. Blank lines between
    records are left out. `keys` name the file where there are several.
    """
    keys = keys or []
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2
    order = ["block", "place"]
    scanned = ordered_scan(lines.select(*keys, *order, "value"), keys, order, F.col("block"), sums={"_quotes": odd})
    inside = (F.col("_quotes") - odd) % 2 == 1
    marked = scanned.withColumns({"_inside": inside, "_odd": odd == 1})
    whole = marked.filter("not _inside and not _odd and trim(value) <> ''").select(*keys, *order, F.col("value").alias("record"))
    start = F.when(~F.col("_inside"), F.struct(*order))
    parts = ordered_scan(marked.filter("_inside or _odd"), keys, order, F.col("block"), lasts={"_start": start})
    pieces = F.array_sort(F.collect_list(F.struct(*order, "value")))
    joined = parts.groupBy(*keys, "_start").agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(joined.select(*keys, "_start.*", "record"))


def read_report(spark: SparkSession, path: str, *, skip_rows: int = 0, encoding: str = "UTF-8", multi_line: bool = False, header_lines: int = 20) -> DataFrame:
    """A CSV report with every column as text.

    With `skip_rows`, `path` names one file with that many lines above its
    header. They are left out by their place: the first lines of the file's
    first block; a data row of the same text stays, and quotes among them do
    not matter. With `multi_line` quoted fields and names may hold line breaks
    (a header record of at most `header_lines` lines). Either way the file may
    be split over many tasks; a folder of files with line breaks and without
    preamble is read a file at a time.
    """
    if skip_rows == 0 and not multi_line:
        return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, escape="\\")
    read = spark.read.option("encoding", encoding).text(path)
    # Ids rise by one within a block's partition, and a file's first block is the first of its partition.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    if skip_rows == 0 and read.select("_metadata.file_path").distinct().limit(2).count() != 1:
        return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, multiLine=True, escape='"')
    lines = read.select("value", F.col("_metadata.file_block_start").alias("block")).withColumn("place", place)
    head = [r.value for r in lines.filter("block = 0").limit(skip_rows + (header_lines if multi_line else 1)).collect()]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header_names(head[skip_rows:])])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
    if not multi_line:
        body = lines.filter(((F.col("block") > 0) | (F.col("place") > skip_rows)) & (F.trim("value") != ""))
        return body.select(F.from_csv("value", F.lit(ddl)).alias("row")).select("row.*")
    records = csv_records(lines.filter((F.col("block") > 0) | (F.col("place") >= skip_rows)))
    body = records.filter((F.col("block") > 0) | (F.col("place") > skip_rows))
    return body.select(F.from_csv("record", F.lit(ddl), {"escape": '"', "lineSep": "\u0000"}).alias("row")).select("row.*")
