"""N-gram Jaccard join: MinHash banding finds candidate pairs, full n-gram sets confirm them.

A text's set holds its distinct runs of five words (fewer words: one run of all; no words: the raw text itself, so that
only equal texts agree). Texts with one and the same set are one node; copies are counted, never paired.

Signature: `bands * rows` minima of independent hashes over the set, 16 bits each. Two nodes are candidates when all
rows of some band agree. For a pair of similarity t the chance to be missed is (1 - t ** rows) ** bands; `plan_bands`
takes the fewest bands that keep it below 1 - recall at the threshold.

A bucket is the nodes that share a band. Buckets are cut into blocks of about `block` nodes by a hash; each pair of
blocks is one job, so a bucket that holds a third of all nodes is many jobs of bounded size. A pair is looked at only in
the job of its first common band, hence once. Jobs pass on nodes and counts, never pairs: first which nodes have a
candidate at all (by signatures alone), then, with the sets of just those nodes, how many documents each node links to
and which nodes are connected.

Defined results. Null is the empty text. Documents without words are linked only to equal texts. Repeated rows are
documents of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import batches, components, grams, scratch, word_hashes

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` rows that find a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    found = np.unique(grams(word_hashes(text), n))
    if len(found):
        return found
    return np.frombuffer(hashlib.blake2b(text or b"", digest_size=8).digest(), "<u8").astype(np.uint64)


class MinHash:
    def __init__(self, size: int):
        seeds = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, (2, size), dtype=np.uint64)
        self.factors, self.shifts = seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]

    def __call__(self, values: np.ndarray) -> bytes:
        best = np.full(len(self.factors), 0xFFFFFFFF, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(values), 1024):
                hashed = (self.factors[:, None] * values[None, at:at + 1024] + self.shifts[:, None]) >> np.uint64(32)
                np.minimum(best, hashed.min(axis=1), out=best)
        return (best & np.uint64(0xFFFF)).astype("<u2").tobytes()


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("signature", T.BinaryType()),
])


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """(doc_id, text_hash, node, signature), written: one row per input row."""
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(size)
        for part in parts:
            nodes, signed = [], []
            for text in part.column(2).to_pylist():
                values = shingles(text, n)
                nodes.append(digest(values))
                signed.append(minhash(values))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(signed, pa.binary())], names=SIGNED.names)

    return scratch(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary")).mapInArrow(run, SIGNED), "signatures")


def with_nodes(docs: DataFrame, name: str, n: int = WORDS) -> DataFrame:
    """All columns and the node of each row's text."""
    batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes = [digest(shingles(text, n)) for text in part.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.binary())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


JOB = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
    T.StructField("block", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType()),
])
LINKS = T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("links", T.LongType()),
])


def _jobs(parts: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one job after another; rows come sorted by job."""
    job, rows = None, []
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns)):
            if row[:4] != job:
                if len(rows) > 1:
                    yield rows
                job, rows = row[:4], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _pairs(rows: list[tuple], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a job's rows whose first common band is the job's band, across its two blocks."""
    _, band, low, high = rows[0][:4]
    signed = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), bands, -1)
    earlier = np.zeros((len(rows), len(rows)), bool)
    for b in range(band):
        same = signed[:, None, b, 0] == signed[None, :, b, 0]
        for r in range(1, signed.shape[2]):
            same &= signed[:, None, b, r] == signed[None, :, b, r]
        earlier |= same
    now = (signed[:, None, band] == signed[None, :, band]).all(axis=2)
    wanted = now & ~earlier
    if low != high:
        block = np.array([r[4] for r in rows])
        wanted &= block[:, None] != block[None, :]
    return np.nonzero(np.triu(wanted, 1))


def _likely(rows: list[tuple], i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose signatures agree in at least a share `least` of the hashes."""
    signed = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), -1)
    keep = np.concatenate([(signed[i[at:at + 20_000]] == signed[j[at:at + 20_000]]).mean(axis=1) >= least for at in range(0, len(i), 20_000)]) if len(i) else np.empty(0, bool)
    return i[keep], j[keep]


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    # Many pairs: products of 0/1 columns, some thousand n-grams at a time.
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    renumber = np.cumsum(times > 1) - 1
    column, owner = renumber[place[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    n_columns, width = int((times > 1).sum()), 8192
    for at in range(0, n_columns, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), min(width, n_columns - at)), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = 200) -> DataFrame:
    """doc_id, class_id (smallest doc_id of all documents connected by links), n_links (documents of similarity >= threshold)."""
    return classes(docs, n, threshold, recall, rows, block).select("doc_id", "class_id", "n_links")


def classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = 200) -> DataFrame:
    """The columns of `join`, node, and class_node: one node of the class, which tells classes apart whatever their ids."""
    spark = docs.sparkSession
    bands = plan_bands(threshold, recall, rows)
    # Agreement of bands * rows hashes is within 0.25 of the similarity but once in far more than 10**9 pairs.
    least = max(0.0, threshold - 0.25)
    signed = signatures(docs, n, bands * rows)
    # One row of each node, by id and text: ids alone may repeat or be missing.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = scratch(signed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.min(row).alias("first_row"), F.max("signature").alias("signature")), "nodes")
    width = 2 * rows
    band_rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "signature").select(
        "node", "band", F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})")).alias("key"))
    buckets = band_rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = band_rows.join(buckets, ["key", "band"]).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    jobs = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")

    def in_jobs(df: DataFrame) -> DataFrame:
        return df.repartition("key", "low", "high").sortWithinPartitions("key", "band", "low", "high", "node")

    def candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for found in _jobs(parts):
            i, j = _likely(found, *_pairs(found, bands), least)
            out += [found[k] for k in np.union1d(i, j)]
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=JOB.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=JOB.names)

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
    with_signature = jobs.join(nodes.select("node", "n", "signature"), "node").select(*JOB.names)
    takes_part = scratch(in_jobs(with_signature).mapInArrow(candidates, JOB), "candidates")

    # The sets of the nodes that take part, from the text of one of their documents.
    wanted = takes_part.select("node").distinct().join(nodes.select("node", "first_row.doc_id", "first_row.text_hash"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])).select("node", "text")

    def sets_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for node, text in zip(*(c.to_pylist() for c in part.columns)):
                values = shingles(text, n)
                if digest(values) == node:  # else another text with the same id and hash
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([values.astype("<u8").tobytes()], pa.binary())], names=["node", "grams"])

    sets = scratch(texts.mapInArrow(sets_of, "node binary, grams binary").dropDuplicates(["node"]), "gram-sets")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _jobs(parts):
            i, j = _likely(found, *_pairs(found, bands), least)
            values = [np.frombuffer(r[8], "<u8") for r in found]
            sizes = np.array([len(v) for v in values])
            both = _common(values, i, j)
            linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            n_docs = np.array([r[6] for r in found], np.int64)
            links = np.bincount(i, n_docs[j], len(found)) + np.bincount(j, n_docs[i], len(found))
            root = np.arange(len(found))
            while True:  # smallest row of each connected part
                lower = root.copy()
                np.minimum.at(lower, i, root[j])
                np.minimum.at(lower, j, root[i])
                lower = np.minimum(lower, lower[lower])
                if (lower == root).all():
                    break
                root = lower
            hit = np.union1d(i, j)
            yield pa.RecordBatch.from_arrays([
                pa.array([found[k][5] for k in hit], pa.binary()), pa.array([found[root[k]][5] for k in hit], pa.binary()),
                pa.array(links[hit].astype(np.int64), pa.int64())], names=LINKS.names)

    batches(spark, 200)
    links = scratch(in_jobs(takes_part.join(sets, "node").select(*JOB.names, "grams")).mapInArrow(verify, LINKS), "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    first = labels.join(nodes.select("node", "first_doc"), "node").groupBy("label").agg(F.min("first_doc").alias("class_id"))
    linked = labels.join(first, "label").join(counted, "node").select("node", "label", "class_id", "links")
    of_nodes = nodes.select("node", "n", "first_doc").join(linked, "node", "left").select(
        "node", F.coalesce("label", "node").alias("class_node"), F.coalesce("class_id", "first_doc").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "node").join(of_nodes, "node").select("doc_id", "node", "class_node", "class_id", "n_links")
