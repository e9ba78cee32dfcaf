"""Helpers the operators share: tables, words, scratch tables, size estimates."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.session import checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Bytes that belong to a word after A-Z were lowered: digits, a-z and all of non-ASCII UTF-8. The rest separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lowered, everything else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text after A-Z were lowered; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that a batch of very long texts still fits a Python worker.

    Also lets Python workers import this package from where the driver has it (on a cluster it is installed or shipped
    with --py-files, and the path is simply not there).
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder of spark.checkpoint.dir and read it back.

    What follows starts from files every executor can reach: a lost executor repeats nothing that came before.
    The folder has a fresh name, so that a job that runs again never reads the rows of another one.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/kerbline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SAMPLE_BITS = 62


def sample_bound(share: float) -> int:
    """Of all hashes of SAMPLE_BITS bits, those below this are a share; above 0 for any share a table can ask for."""
    return min(1 << SAMPLE_BITS, math.ceil(share * (1 << SAMPLE_BITS)))


def sampled(share: float, *columns: str) -> Column:
    """Whether a row is in a sample of about a share of all rows, by a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - SAMPLE_BITS) < F.lit(sample_bound(share))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column, one pass with a partial sum per task."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_UP = 0x9E3779B97F4A7C15
_DOWN = pow(_UP, -1, 1 << 64)
_CHUNK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _grown(name: str, base: int, n: int) -> np.ndarray:
    if len(_POWERS[name]) < n:
        factors = np.full(max(n, _CHUNK + 64), base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[name]


def hash_blank_separated(clean: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes between blanks, in order, without a Python loop over the runs.

    A prefix sum of byte times power gives each run's polynomial; dividing by the power at its start makes equal runs
    equal. Long inputs are cut at blanks, so that memory stays small.
    """
    if len(clean) > _CHUNK:
        out, at = [], 0
        while at < len(clean):
            stop = clean.find(b" ", at + _CHUNK)
            stop = len(clean) if stop < 0 else stop
            out.append(_hash_chunk(clean[at:stop]))
            at = stop
        return np.concatenate(out)
    return _hash_chunk(clean)


def _hash_chunk(clean: bytes) -> np.ndarray:
    values = np.frombuffer(clean, np.uint8)
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = values != 32
    edges = np.diff(inside)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * _grown("up", _UP, len(values))[:len(values)], out=sums[1:])
        return mixed((sums[stops] - sums[starts]) * _grown("down", _DOWN, len(values))[starts] + (stops - starts).astype(np.uint64))


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of `words(text)`."""
    return hash_blank_separated(text.translate(_WORD_BYTES)) if text else np.empty(0, np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours; of fewer than n, but not none, one run of all."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9FB21C651E98DF25) + hashes[i:i + len(out)]
    return mixed(out)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, then the label of its label. Rounds are written,
    so none is repeated; a hub's rows are reduced to one minimum per task before they are shuffled.
    """
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("onward"))
        lower = scratch(lower.join(jump, "new", "left").select("node", F.least("new", F.coalesce("onward", "new")).alias("label"), (F.least("new", F.coalesce("onward", "new")) != F.col("label")).alias("moved")), name)
        labels = lower.select("node", "label")
        if lower.where("moved").limit(1).count() == 0:
            return labels
