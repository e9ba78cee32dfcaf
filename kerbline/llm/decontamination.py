"""Benchmark decontamination: Wu-Manber search for windows of benchmark items in document texts.

Patterns are windows of words; all patterns of one length form a set. For a set of length m the shift table holds, for
each block of two neighbouring words, how far the search may jump when that block ends at the current word: the distance
from the block's last place in any pattern to the pattern's end, or m - 1 for blocks in no pattern. Where the distance
is 0 the block is the end of some patterns; its bucket lists them, and a direct comparison of all words confirms.

Rows and memory. Documents never move: each Arrow batch is searched where it was read. The patterns are cut into blocks
of at most about `block_bytes` of item text, and each block is one broadcast and one more pass over the same rows, so a
benchmark of any size is searched whole and no broadcast grows with it.

Defined results. Null and empty texts have no words and no hits. An item without words, or with a null id, has no
window. Repeated item ids count once. Rows may repeat; each is searched by itself. Clashing extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import batches, text_bytes, words

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class PatternSet:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, owners: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = {}
        for pattern, items in owners.items():
            for stop in range(self.block, length + 1):
                key = pattern[stop - self.block:stop]
                self.shift[key] = min(self.shift.get(key, self.default), length - stop)
            self.bucket.setdefault(pattern[-self.block:], []).append((list(pattern), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        at, n, m, default, shift = self.length - 1, len(text), self.length, self.default, self.shift
        pair = self.block == 2
        while at < n:
            key = (text[at - 1], text[at]) if pair else (text[at],)
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for pattern, items in self.bucket[key]:
                if text[start:at + 1] == pattern:
                    yield start, items
            at += 1


def pattern_sets(items: list[tuple[str, bytes | None]], window: int) -> list[PatternSet]:
    """One set for each pattern length: `window`, and the lengths of shorter items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        found = words(text)
        m = min(window, len(found))
        for i in range(len(found) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(found[i:i + m]), set()).add(item)
    return [PatternSet(m, owners) for m, owners in sorted(by_length.items())]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4_000_000,
               text: str = "text", into: str = "found") -> DataFrame:
    """`docs` with a struct `into`: number of words, disjoint word spans hit by any window, ids of the items that occur."""
    spark = docs.sparkSession
    batches(spark)
    bench = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    n_blocks = max(1, -(-text_bytes(bench) // block_bytes))
    fields = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*fields, T.StructField(into, FOUND)])
    arrow_found = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
    out = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    for block in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        held = spark.sparkContext.broadcast([(r.item, bytes(r.text) if r.text is not None else None) for r in rows.toLocalIterator()])
        first = block == 0

        def search(parts: Iterator[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            sets = pattern_sets(held.value, window)
            for part in parts:
                results = []
                before = None if first else part.column(part.schema.get_field_index(into)).to_pylist()
                for i, value in enumerate(part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()):
                    found = words(value)
                    spans = [] if first else [(s["start"], s["stop"]) for s in before[i]["spans"]]
                    items: set[str] = set() if first else set(before[i]["items"])
                    for patterns in sets:
                        for start, owners in patterns.search(found):
                            spans.append((start, start + patterns.length))
                            items |= owners
                    results.append({"n_words": len(found), "spans": [{"start": a, "stop": b} for a, b in merge(spans)], "items": sorted(items)})
                own = [i for i, name in enumerate(part.schema.names) if name != into]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in own], pa.array(results, arrow_found)], names=[*[part.schema.names[i] for i in own], into])

        out = out.mapInArrow(search, schema)
    return out


def report(found: DataFrame) -> DataFrame:
    """One row per document with counts and a digest of the items."""
    f = F.col("found")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no window of any item, with their own columns."""
    return find_items(docs, benchmark, into="_kerbline_found").where(F.size("_kerbline_found.spans") == 0).drop("_kerbline_found")
