"""Packing: concatenate all documents' tokens, each with an end id, and cut the stream into fixed windows.

Two passes. The first turns texts into token ids and writes them with the number of their partition and their start
within it. The totals of the partitions, one small row each, are summed up in order: the sum before a partition plus the
start within it is a document's global offset. The second pass cuts each document at the multiples of the window; a
document that crosses a boundary has one record on either side. Only the last window can be short.

No row moves but the totals (one per partition); hot sources, equal texts and very long texts change nothing.

Defined results. Null and empty texts are one end id. Repeated rows are packed as often as they come. An empty table
gives no records. The order is that of the input's partitions, fixed by the written table, so a repeated task or a lost
executor cannot shift an offset.

Ids are those of the `tokenizers` file; they are made with `tiktoken` from the same vocabulary, which gives equal ids
several times faster. A text is cut before every space that follows a visible character. No token of this vocabulary
spans such a place, so each piece is encoded once per worker and remembered.
Added tokens of the file ("<|endoftext|>") that stand in a text are one id each and cut it, as the file's tokenizer does.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kerbline.llm.common import batches, scratch

END_ID = 0
_AFTER_WHITE = re.compile(r"\s ")
_SPLIT = re.compile(r"(?<=\S) ")


class PieceEncoder:
    """Token ids of a text as little-endian unsigned 16-bit numbers. Without `added` tokens all of it is plain text."""

    def __init__(self, vocabulary: str, remembered: int = 400_000, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = added or {}
        if max([*ranks.values(), *added.values()]) >= 1 << 16:
            raise ValueError("ids above 65535 do not fit")
        self._ids = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._most, self._memo = remembered, {}
        self._added = {t: np.array([i], "<u2").tobytes() for t, i in added.items()}
        self._cut = re.compile(f"({'|'.join(re.escape(t) for t in sorted(added, key=len, reverse=True))})")

    def _bytes(self, piece: str) -> bytes:
        return np.array(self._ids(piece), "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            # Every second part is an added token; the parts between are texts of their own.
            return b"".join(self._added[part] if i % 2 else self._plain(part) for i, part in enumerate(self._cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = _SPLIT.split(text) if _AFTER_WHITE.search(text) else text.split(" ")
        if text[0] == " " and pieces[0] == "":  # a leading space belongs to the first piece
            pieces[0:2] = [" " + pieces[1]] if len(pieces) > 1 else [" "]
        memo, out = self._memo, [self._bytes(pieces[0])]
        for piece in pieces[1:]:
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= self._most:
                    memo.clear()
                ids = self._bytes(" " + piece)
                if len(piece) <= 40:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)


TOKENS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
])
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """Added tokens of the default vocabulary's `tokenizers` file."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that are not plain texts")
    return {t["content"]: t["id"] for t in tokens}


def tokenise(docs: DataFrame, vocabulary: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Token ids with the end id, per document, in the written table that fixes the order.

    A vocabulary of one's own comes with its own added tokens.
    """
    batches(docs.sparkSession)
    added = default_added() if vocabulary is None and added is None else added
    vocabulary = vocabulary or default_vocabulary()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = PieceEncoder(vocabulary, added=added), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u2").tobytes()
        for batch in parts:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                rows.append((part, at, doc_id, len(ids) // 2, ids))
                at += len(ids) // 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=TOKENS.names)

    return scratch(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS), "tokens")


def concatenate_and_cut(tokens: DataFrame, window: int = 1024, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents in windows of `window` ids; `ids` (unsigned 16-bit, little-endian) only when kept."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # One row per input partition: the ordered sum and the broadcast are bounded by the number of partitions.
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("part_start")).alias("at"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in parts:
            rows = []
            for doc_id, n, ids, at in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    stop = min(n, start + window - offset)
                    rows.append((doc_id, start, stop - start, zlib.crc32(wide[start:stop].tobytes()), n, sequence, offset, ids[2 * start:2 * stop] if keep_ids else None))
                    start = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=PIECES.names)

    return placed.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, window: int = 1024, keep_ids: bool = True, vocabulary: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, concatenate and cut."""
    return concatenate_and_cut(tokenise(docs, vocabulary, added), window, keep_ids)
