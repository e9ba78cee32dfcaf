"""Exact repeats of 50 bytes or more across documents, by a logarithmic family of sparse suffix arrays.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Texts are judged as UTF-8 bytes
on the input, each by itself.

Suffixes. Of each 50-byte window the 20-byte gram with the smallest hash is its anchor, the leftmost on ties. The choice
rests on the window alone, so equal windows have equal anchors at equal places, and it is enough to index the suffixes
that begin at anchors: about one byte in 16. An entry is such a suffix, as far as a window of its anchor reaches, with the
bytes before it; neighbouring windows of one anchor are one entry.

Pruning. The grams' hashes are counted first, packed, 4 bytes each, over buckets whose number grows with the input. An
anchor whose gram stands in one document alone cannot match and is not indexed. This drops five sixths of the suffixes of
ordinary text; a chance match of hashes only keeps a suffix too many.

Family. Documents come in batches by ascending doc_id. A batch gets its sorted array of distinct entries, split over
buckets by anchor, is merge-scanned with the array of each level, and joins the levels: levels of equal size merge, so
that n batches leave at most log2(n) + 1 arrays, and each entry is rewritten that often at most. All documents of the
levels have smaller ids than those of the batch; within the batch each window keeps its smallest doc_id. Entries are
compared byte by byte, in groups of one gram.

Skew. A chunk of texts sends each distinct entry once, with its smallest doc_id, so copies never meet in one task. A gram
with more than `HOT` occurrences is not one group: each window at it is an entry of its own and goes by its own bytes.

Texts are written once, compressed, in chunks of 4 MB; marks, occurrences and answers, a few bytes for an entry, are
written and joined to them.

Defined results. A null text is empty. Null doc_ids count as smaller than all others and equal to each other. Rows that
share a doc_id do not count as copies of each other. Texts of fewer than 50 bytes stay whole. An empty table gives no
rows. Extra columns stay out.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import batches, mixed, scratch, text_bytes

MATCH, GRAM = 50, 20
CHUNK_BYTES, SLICE_BYTES = 4_000_000, 64_000
HOT = 20_000
LOWEST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_CHUNK_ROWS = 4

CHUNKS = "chunk long, batch int, ids binary, nulls binary, lengths binary, size long, texts binary"
KEYS = "bucket int, chunk long, grams binary, multiple binary, often binary"
MARKS = "chunk long, bucket int, known binary, hot binary"
SENT = "batch int, bucket int, chunk long, n int, size long, entries binary, docs binary"
FOUND = "level_row boolean, bucket int, chunk long, n int, size long, entries binary, firsts binary, varied binary"
# The bucket of rows that hold a chunk's occurrences instead of entries.
PLACES = -1
OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("kept_sha256", T.StringType()),
])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _packed(data: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def chunked(docs: DataFrame, bounds: list[int], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The texts in written, compressed chunks of one batch each; a batch ends before each of `bounds`."""
    batches(docs.sparkSession, 200)
    schema = _arrow(CHUNKS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, itertools.count(), {}

        def row(batch: int) -> tuple:
            members = held.pop(batch)
            ids = np.array([LOWEST if i is None else i for i, _ in members], np.int64)
            nulls, lengths = np.array([i is None for i, _ in members]), np.array([len(t) for _, t in members], np.int64)
            texts = b"".join(t for _, t in members)
            return first + next(made), batch, ids.tobytes(), nulls.tobytes(), lengths.tobytes(), len(texts), _packed(texts, 6)

        sizes = dict.fromkeys(range(len(bounds) + 1), 0)
        for part in parts:
            ids = part.column(0).to_pylist()
            places = np.searchsorted(bounds, [LOWEST if i is None else i for i in ids], "right") if bounds else np.zeros(len(ids), int)
            for doc_id, text, batch in zip(ids, part.column(1).to_pylist(), places.tolist()):
                held.setdefault(batch, []).append((doc_id, text or b""))
                sizes[batch] += len(text or b"") + 16
                if sizes[batch] >= chunk_bytes:
                    sizes[batch] = 0
                    yield _batch(schema, [row(batch)])
        for batch in sorted(held):
            yield _batch(schema, [row(batch)])

    return scratch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, CHUNKS), "texts")


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    have = 1
    while have < width:
        values = join(values[:-have], values[have:], have)
        have *= 2
    return values


_POWER = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of the anchors of texts that follow each other in `data`."""
    none = np.empty(0, np.int64)
    if len(data) < MATCH:
        return none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        four = _doubled(data.astype(np.uint64) + np.uint64(1), 4, lambda a, b, have: a * _POWER[have] + b)
        sixteen = four[:-12] * (_POWER[4] * _POWER[8]) + four[4:-8] * _POWER[8] + four[8:-4] * _POWER[4] + four[12:]
        grams = mixed(sixteen[:-4] * _POWER[4] + four[16:])
    # The upper half of the hash orders, then the place: the leftmost on ties.
    keys = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    span = MATCH - GRAM + 1
    half = _doubled(keys, 16, lambda a, b, have: np.minimum(a, b))
    least = np.minimum(half[:len(half) - (span - 16)], half[span - 16:])
    ends = np.cumsum(lengths)
    # Windows that lie within one text.
    inside = np.ones(len(least) + MATCH, bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - MATCH + 1):end] = False
    windows = np.flatnonzero(inside[:len(least)])
    if not len(windows):
        return none, none, none, none.astype(np.uint64)
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], windows[first], windows[last], grams[at[first]]


class Chunk:
    """A chunk's texts and its anchors, found slice by slice so that only few bytes are hashed at once."""

    def __init__(self, row: dict, buckets: int, slice_bytes: int = SLICE_BYTES):
        self.ids, self.lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.texts = _unpacked(row["texts"], row["size"])
        self.ends = np.cumsum(self.lengths)
        data, found, begin = np.frombuffer(self.texts, np.uint8), [], 0
        while begin < len(self.lengths):
            left = self.ends[begin] - self.lengths[begin]
            stop = max(begin + 1, int(np.searchsorted(self.ends, left + slice_bytes, "right")))
            at, lo, hi, grams = anchors(data[left:self.ends[stop - 1]], self.lengths[begin:stop])
            found.append((at + left, lo + left, hi + left, grams))
            begin = stop
        self.at, self.lo, self.hi, grams = (np.concatenate(c) for c in zip(*found))
        # A gram's bucket and its 4 bytes there, as one number.
        self.gram = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32 | (grams & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.doc = self.ids[np.searchsorted(self.ends, self.at, "right")]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams in order, the number of each anchor's gram, whether several doc_ids have it, how often it stands."""
        distinct, number, times = np.unique(self.gram, return_inverse=True, return_counts=True)
        if not len(distinct):
            return distinct, number, np.empty(0, bool), times
        docs = self.doc[np.argsort(number, kind="stable")]
        begins = np.cumsum(times) - times
        return distinct, number, np.minimum.reduceat(docs, begins) != np.maximum.reduceat(docs, begins), times


def _chunks_of(parts: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[dict, Chunk]]:
    for part in parts:
        for row in part.to_pylist():
            yield row, Chunk(row, buckets)


def _by_bucket(distinct: np.ndarray) -> Iterator[tuple[int, slice]]:
    buckets = distinct >> 32
    begins = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else []
    for begin, stop in zip(begins, [*begins[1:], len(buckets)]):
        yield int(buckets[begin]), slice(int(begin), int(stop))


_OFTEN = 16


def gram_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's distinct grams by bucket: 4 bytes a gram, a bit for several doc_ids, counts of the frequent ones."""
    schema = _arrow(KEYS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks_of(parts, buckets):
            distinct, _, multiple, times = chunk.grams()
            rows = []
            for bucket, part in _by_bucket(distinct):
                own = times[part]
                often = np.flatnonzero(own >= _OFTEN)
                rows.append((bucket, row["chunk"], distinct[part].astype(np.uint32).tobytes(), np.packbits(multiple[part]).tobytes(), np.stack([often, own[often]]).astype(np.int64).tobytes()))
            if rows:
                yield _batch(schema, rows)

    return chunks.mapInArrow(run, KEYS)


def repeated_grams(counts: DataFrame, hot: int) -> DataFrame:
    """For each chunk and bucket: a bit per gram that stands in another document too, and the places of hot ones."""
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(b, np.uint32) for b in rows["grams"]]
        distinct, number, chunks = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        known, total = chunks > 1, chunks.copy()
        cuts = np.cumsum([0, *map(len, grams)])
        for i, (multiple, often) in enumerate(zip(rows["multiple"], rows["often"])):
            own = number[cuts[i]:cuts[i + 1]]
            known[own[np.unpackbits(np.frombuffer(multiple, np.uint8), count=len(own)).astype(bool)]] = True
            place, times = np.frombuffer(often, np.int64).reshape(2, -1)
            total[own[place]] += times - 1
        busy, out = known & (total > hot), []
        for i, (chunk, bucket) in enumerate(zip(rows["chunk"], rows["bucket"])):
            own = number[cuts[i]:cuts[i + 1]]
            if known[own].any():
                out.append((chunk, bucket, np.packbits(known[own]).tobytes(), np.flatnonzero(busy[own]).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "known", "hot"])

    return counts.groupBy("bucket").applyInPandas(find, MARKS)


def _occurrences(chunk: Chunk, marks: list, arrays: int) -> tuple[np.ndarray, ...]:
    """(array, first window, last window, suffix begin, doc_id) of every anchor of a chunk whose gram is marked.

    A hot gram's windows are occurrences of their own, which begin where the window does.
    """
    distinct, number, _, _ = chunk.grams()
    known, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    places = dict(_by_bucket(distinct))
    for mark in marks or ():
        part = places[mark["bucket"]]
        known[part] = np.unpackbits(np.frombuffer(mark["known"], np.uint8), count=part.stop - part.start).astype(bool)
        hot[np.frombuffer(mark["hot"], np.int64) + part.start] = True
    chosen, busy = np.flatnonzero((known & ~hot)[number]), np.flatnonzero(hot[number])
    width = chunk.hi[busy] - chunk.lo[busy] + 1
    window = np.repeat(chunk.lo[busy] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    to = np.array([zlib.crc32(chunk.texts[w:w + MATCH]) % arrays for w in window.tolist()], np.int64)
    parts = zip((chunk.gram[chosen] % 1_000_003 % arrays, chunk.lo[chosen], chunk.hi[chosen], chunk.at[chosen], chunk.doc[chosen]), (to, window, window, window, np.repeat(chunk.doc[busy], width)))
    return tuple(np.concatenate(p) for p in parts)


def _coded(texts: list[bytes], lefts: list[int]) -> tuple[int, bytes]:
    """Entries as one block: sizes, bytes before the suffix, texts."""
    data = bytes(map(len, texts)) + bytes(lefts) + b"".join(texts)
    return len(data), _packed(data)


def _decoded(n: int, size: int, data: bytes) -> list[tuple[bytes, bytes]]:
    """(suffix, bytes before it) of a block's entries, in its order."""
    data = _unpacked(data, size)
    ends = np.cumsum(np.frombuffer(data[:n], np.uint8).astype(np.int64)) + 2 * n
    return [(data[a + left:b], data[a:a + left]) for a, left, b in zip([2 * n, *ends.tolist()], data[n:2 * n], ends.tolist())]


def batch_arrays(chunks: DataFrame, buckets: int, arrays: int) -> DataFrame:
    """Distinct entries of each chunk with `marks`, by array, with their smallest doc_id; and, in one row of bucket
    `PLACES`, where they occur: array, number of the entry in its row, first and last window."""
    schema = _arrow(SENT)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks_of(parts, buckets):
            to, lo, hi, at, docs = _occurrences(chunk, row["marks"], arrays)
            # A text says by itself where its suffix begins, so it names the entry.
            known, least, lefts, numbers, texts = defaultdict(dict), defaultdict(list), defaultdict(list), [], chunk.texts
            for array, first, stop, left, doc in zip(to.tolist(), lo.tolist(), (hi + MATCH).tolist(), (at - lo).tolist(), docs.tolist()):
                text, own = texts[first:stop], known[array]
                number = own.get(text)
                if number is None:
                    own[text] = number = len(own)
                    least[array].append(doc)
                    lefts[array].append(left)
                elif least[array][number] > doc:
                    least[array][number] = doc
                numbers.append(number)
            rows = []
            for array, own in known.items():
                size, data = _coded(list(own), lefts[array])
                rows.append((row["batch"], array, row["chunk"], len(own), size, data, np.array(least[array], np.int64).tobytes()))
            if rows:
                places = np.stack([to, np.array(numbers, np.int64), lo, hi - lo]).astype(np.int32).tobytes()
                rows.append((row["batch"], PLACES, row["chunk"], len(numbers), len(places), _packed(places), b""))
                yield _batch(schema, rows)

    return chunks.mapInArrow(run, SENT)


def _windows(entry: tuple[bytes, bytes]) -> list[bytes]:
    text = entry[1] + entry[0]
    return [text[i:i + MATCH] for i in range(len(text) - MATCH + 1)]


def merge_scan(new: dict[tuple[bytes, bytes], int], levels: list[list[tuple[bytes, bytes]]]) -> tuple[list[tuple[bytes, bytes]], dict]:
    """The batch's sorted array, and for each of its entries the smallest doc_id of each window: one number where all
    windows have the same, else a list. LOWEST stands for a document of the levels."""
    array, firsts = sorted(new), {}
    # Runs in order, which the sort merges; suffixes of one gram are neighbours then.
    scan, old = [*array, *itertools.chain.from_iterable(levels)], set(itertools.chain.from_iterable(levels))
    if levels:
        scan.sort()
    begin, n = 0, len(scan)
    while begin < n:
        entry, stop = scan[begin], begin + 1
        gram = entry[0][:GRAM]
        while stop < n and scan[stop][0].startswith(gram):
            stop += 1
        if stop == begin + 1:
            if entry in new:
                firsts[entry] = new[entry]
        else:
            run = dict.fromkeys(scan[begin:stop])
            mine = [e for e in run if e in new]
            unknown = [e for e in mine if e not in old]
            least: dict[bytes, int] = {}
            if unknown:
                for e in mine:
                    doc = new[e]
                    for w in _windows(e):
                        if least.get(w, doc) >= doc:
                            least[w] = doc
                least.update((w, LOWEST) for e in run if e in old for w in _windows(e))
            for e in mine:
                own = [LOWEST] if e in old else [least[w] for w in _windows(e)]
                firsts[e] = own[0] if min(own) == max(own) else own
        begin = stop
    return array, firsts


def scan_group(rows: pd.DataFrame, merging: frozenset[int]) -> pd.DataFrame:
    """One array of a batch against the same array of all levels: answers for each chunk, and the new level's array."""
    new: dict[tuple[bytes, bytes], int] = {}
    sent, levels = [], {}
    for chunk, level, n, size, data, docs in rows[["chunk", "level", "n", "size", "entries", "docs"]].itertuples(index=False):
        entries = _decoded(int(n), int(size), data)
        if level >= 0:
            levels[int(level)] = entries
            continue
        sent.append((chunk, entries))
        for e, doc in zip(entries, np.frombuffer(docs, np.int64).tolist()):
            if new.get(e, doc) >= doc:
                new[e] = doc
    array, firsts = merge_scan(new, list(levels.values()))
    bucket, out = rows["bucket"].iloc[0], []
    for chunk, entries in sent:
        first, sizes, varied = [], [], []
        for e in entries:
            answer = firsts[e]
            if isinstance(answer, int):
                first.append(answer)
                sizes.append(0)
            else:
                first.append(0)
                sizes.append(len(answer))
                varied += answer
        one = np.array([first, sizes], np.int64)
        out.append((False, bucket, chunk, len(entries), 0, b"", _packed(one.tobytes()), _packed(np.array(varied, np.int64).tobytes())))
    merged = array
    if any(i in levels for i in merging):
        merged = [e for e, _ in itertools.groupby(sorted(itertools.chain(array, *(levels[i] for i in merging if i in levels))))]
    if merged:
        size, data = _coded([left + suffix for suffix, left in merged], [len(left) for _, left in merged])
        out.append((True, bucket, -1, len(merged), size, data, b"", b""))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


class Family:
    """Levels of written arrays, largest first; the sizes are numbers of batches and all different."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Scan a batch of arrays against all levels, take it in, and return the answers for its chunks."""
        size, merging = 1, set()
        for i in reversed(range(len(self.levels))):
            if self.levels[i][0] != size:
                break
            size, merging = 2 * size, merging | {i}
        rows = batch
        for i, (_, level) in enumerate(self.levels):
            rows = rows.unionByName(level.withColumn("level", F.lit(i)))
        chosen = frozenset(merging)
        found = scratch(rows.groupBy("bucket").applyInPandas(lambda rows: scan_group(rows, chosen), FOUND), "scan")
        level = found.where("level_row").select("bucket", "chunk", F.lit(0).alias("level"), "n", "size", "entries", F.lit(b"").alias("docs"))
        self.levels = [*(pair for i, pair in enumerate(self.levels) if i not in merging), (size, level)]
        return found.where("NOT level_row").select("chunk", "bucket", "n", "firsts", "varied")


def _gone(row: dict, n_bytes: int) -> np.ndarray:
    """Which bytes of a chunk's texts go, from its occurrences and the answers to its entries."""
    change = np.zeros(n_bytes + 1, np.int32)
    if row["places"]:
        to, number, lo, more = np.frombuffer(_unpacked(row["places"], row["places_size"]), np.int32).reshape(4, -1).astype(np.int64)
        doc = np.frombuffer(row["ids"], np.int64)[np.searchsorted(np.cumsum(np.frombuffer(row["lengths"], np.int64)), lo, "right")]
        order = np.argsort(to, kind="stable")
        cuts = dict(zip(*(a.tolist() for a in np.unique(to[order], return_index=True))))
        ends = dict(zip(cuts, [*list(cuts.values())[1:], len(to)]))
        for a in row["answers"]:
            own = order[cuts[a["bucket"]]:ends[a["bucket"]]]
            first, sizes = np.frombuffer(_unpacked(a["firsts"], 16 * a["n"]), np.int64).reshape(2, -1)
            lists, begin = np.frombuffer(_unpacked(a["varied"], 8 * int(sizes.sum())), np.int64), np.cumsum(sizes) - sizes
            which = number[own]
            whole = own[(sizes[which] == 0) & (first[which] < doc[own])]
            np.add.at(change, lo[whole], 1)
            np.add.at(change, lo[whole] + more[whole] + MATCH, -1)
            # Entries whose windows differ: one comparison for each window of each occurrence.
            part = own[sizes[which] > 0]
            width = sizes[number[part]]
            step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            hit = np.flatnonzero(lists[np.repeat(begin[number[part]], width) + step] < np.repeat(doc[part], width))
            at = (np.repeat(lo[part], width) + step)[hit]
            np.add.at(change, at, 1)
            np.add.at(change, at + MATCH, -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(row: dict) -> list[tuple]:
    texts, out, end = _unpacked(row["texts"], row["size"]), [], 0
    data, gone = np.frombuffer(texts, np.uint8), _gone(row, len(texts))
    for doc_id, null, n in zip(np.frombuffer(row["ids"], np.int64).tolist(), row["nulls"], np.frombuffer(row["lengths"], np.int64).tolist()):
        begin, end = end, end + n
        own = gone[begin:end]
        kept, spans, removed = texts[begin:end], [], 0
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
            kept, removed = data[begin:end][~own].tobytes(), int((edges[:, 1] - edges[:, 0]).sum())
            spans = [{"start": a, "stop": b} for a, b in edges.tolist()]
        out.append((None if null else doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest()))
    return out


def find(docs: DataFrame, n_batches: int = 4, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, least_buckets: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of every row; spans are byte ranges that go, start to stop."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n_batches for i in range(1, n_batches)], 10_000)).first()[0] if n_batches > 1 else None
    chunks = chunked(docs, sorted(set(cuts or [])), chunk_bytes)
    # A bucket of grams stands for 256 MB of text at most (16 M grams of 4 bytes), an array for 16 MB.
    buckets, arrays = max(least_buckets, total >> 28), max(least_buckets, total >> 24)
    batches(spark, _CHUNK_ROWS)
    marks = scratch(repeated_grams(gram_counts(chunks, buckets), hot), "marks")
    marks = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "known", "hot")).alias("marks"))
    # Each chunk's entries and occurrences, then the batches in order.
    sent, family, answers = scratch(batch_arrays(chunks.join(marks, "chunk", "left"), buckets, arrays), "entries"), Family(), None
    entries = sent.where(F.col("bucket") != PLACES)
    for batch in range(len(set(cuts or [])) + 1):
        found = family.add(entries.where(F.col("batch") == batch).select("bucket", "chunk", F.lit(-1).alias("level"), "n", "size", "entries", "docs"))
        answers = answers.unionByName(found) if answers else found
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "firsts", "varied")).alias("answers"))
    places = sent.where(F.col("bucket") == PLACES).select("chunk", F.col("entries").alias("places"), F.col("size").alias("places_size"))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept_sha256", pa.string())])

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                yield _batch(schema, _cleaned(row))

    out = scratch(chunks.join(places, "chunk", "left").join(grouped, "chunk", "left").mapInArrow(clean, OUT), "deduplicated")
    batches(spark)
    return out


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
