"""Document fingerprints by winnowing, and the likeness of each document to an edited form and to its successor.

Hashes of all k-grams of code points roll along the text; in every window of w neighbouring hashes the smallest is
chosen, the rightmost on ties, and kept with its position. Any passage of at least w + k - 1 code points that two texts
share leaves a common hash in both. The fingerprint is base64 of the chosen hashes, a colon, and base64 of their
positions (unsigned 32-bit, little-endian). Likeness is the Jaccard index of the sets of hashes.

Short texts have finer grids, or they would be one hash each (`grid`): k is a quarter of the text and w an eighth of its
k-grams, both rounded down to powers of two, k from 4 to 16 and w from 1 to 64. With one k the choice of a wide window
is part of the choice of a narrow one, so the guarantee for shared passages holds between texts of different w as well.
Two texts are compared on the grid of the longer one. A text of fewer than k code points is one gram.

The successor of a document is the next by (doc_id, text), nulls first, the first after the last. No row is compared
through one ordered task: documents are dealt by ranges of doc_id, ordered within a range, and each range also gets the
first document of the next one. Ranges hold about `range_bytes` of text and stream through a worker row by row; only a
run of one repeated doc_id stays in one range.

Defined results. Null is the empty text; the fingerprint of an empty text is ":" and two empty fingerprints are alike
(1.0). A single document is its own successor. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kerbline.llm.common import batches, text_bytes

GRAM, WINDOW, LEAST_GRAM = 16, 64, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint64(0xFFFFFFFF)


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    """Combine every run of `width` (a power of two) neighbours by doubling."""
    have = 1
    while have < width:
        values = join(values[:-have], values[have:], have)
        have *= 2
    return values


def grid(n: int, gram: int = GRAM, window: int = WINDOW) -> tuple[int, int]:
    """k and w for a text of n code points; `gram` and `window` are the widest."""
    power = lambda x: 1 << max(0, x.bit_length() - 1)
    k = min(gram, max(LEAST_GRAM, power(n // 4)))
    return k, min(window, power(max(0, n - k + 1) // 8))


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions; `gram` and `window` are powers of two."""
    n = len(codes)
    if n == 0:
        return np.empty(0, "<u4"), np.empty(0, "<u4")
    codes = codes.astype(np.uint64) + np.uint64(1)
    if n < gram:
        codes = np.concatenate([codes, np.zeros(gram - n, np.uint64)])
    with np.errstate(over="ignore"):
        power = {1: _BASE}
        while max(power) < gram:
            power[2 * max(power)] = power[max(power)] * power[max(power)]
        hashes = _doubled(codes, gram, lambda a, b, have: a * power[have] + b)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    # The high half orders by hash, the low half prefers the rightmost position.
    keys = (hashes & ~_MOST) | (_MOST - np.arange(len(hashes), dtype=np.uint64))
    if len(keys) <= window:
        keys = keys.min(keepdims=True)
    else:
        keys = _doubled(keys, window, lambda a, b, have: np.minimum(a, b))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint64(32)).astype("<u4"), (_MOST - (keys & _MOST)).astype("<u4")


def shown(hashes: np.ndarray, positions: np.ndarray) -> str:
    return base64.b64encode(hashes.tobytes()).decode() + ":" + base64.b64encode(positions.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter replaced by as many first code points of the next text."""
    quarter = len(codes) // 4
    return np.concatenate([codes[:len(codes) - quarter], following[:quarter]])


OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def in_ranges(docs: DataFrame, range_bytes: int = 8_000_000, most_ranges: int = 20_000) -> DataFrame:
    """Rows in order within ranges of doc_id; the first document of the next range comes last, marked `extra`.

    Columns range_no, extra, place (doc_id, nulls lowest), doc_id, text. Beyond `most_ranges` the ranges get longer,
    which the streaming reader does not mind.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = min(most_ranges, max(1, -(-text_bytes(docs) // range_bytes)))
    bounds = np.array(sorted(set(docs.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right").astype(np.int32))

    dealt = docs.withColumn("range_no", range_of("place")).withColumn("extra", F.lit(0))
    # First documents: at most one per range, found by id first so that no text is sorted.
    first_places = docs.select("place").withColumn("range_no", range_of("place")).groupBy("range_no").agg(F.min("place").alias("place"))
    heads = docs.join(F.broadcast(first_places.select("place")), "place", "left_semi").groupBy("place").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    by_range = W.orderBy("range_no")
    goes_to = first_places.select("place", F.lag("range_no").over(by_range).alias("before"), F.max("range_no").over(by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"))
    heads = heads.join(F.broadcast(goes_to), "place").select("doc_id", "text", "place", F.coalesce("before", "last").alias("range_no"), F.lit(1).alias("extra"))
    return dealt.unionByName(heads).repartition(n, "range_no").sortWithinPartitions("range_no", "extra", "place", "text")


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, range_bytes: int = 8_000_000) -> DataFrame:
    """Fingerprints of all documents and their edited forms, with both likenesses; `gram` and `window` are the widest."""
    batches(docs.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def alike(a: np.ndarray, its_a: tuple, b: np.ndarray, its_b: tuple) -> float:
        """Likeness of two texts with their fingerprints, on the grid of the longer one."""
        wide = grid(max(len(a), len(b)), gram, window)
        on_wide = [its if grid(len(codes), gram, window) == wide else winnow(codes, *wide) for codes, its in ((a, its_a), (b, its_b))]
        return likeness(on_wide[0][0], on_wide[1][0])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, code points, fingerprint) of the row before
        for batch in parts:
            rows = []
            for range_no, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
                own = winnow(codes, *grid(len(codes), gram, window))
                if last is not None and last[0] == range_no:
                    _, before, its_codes, its = last
                    changed = edited(its_codes, codes)
                    new = winnow(changed, *grid(len(changed), gram, window))
                    digest = hashlib.sha256(changed.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
                    rows.append((before, len(its_codes), digest, shown(*its), shown(*new), alike(its_codes, its, changed, new), alike(its_codes, its, codes, own)))
                last = (range_no, doc_id, codes, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=OUT.names)

    return in_ranges(docs, range_bytes).select("range_no", "doc_id", "text").mapInArrow(run, OUT)
