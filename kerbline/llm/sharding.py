"""Sharding by a k-d tree over document metadata, with leaves of near equal bytes.

A node that stands for m shards is split into nodes for m // 2 and m - m // 2 shards. It is cut along its widest
dimension (range within the node over range in the whole table) at the weighted quantile m // 2 / m of bytes, until
every node is one shard; 40 shards take six levels. Ties along the dimension are ordered by the text's CRC, size and
doc_id, so equal texts fall on one side unless the cut must pass through their group, which a group of a third of all
bytes forces.

Quantiles are found by all tasks at once. A cut is a place in the order of the key (dimension, CRC, doc_id). Each pass
sums bytes by the next 12 bits of the key, in every unfinished node, and keeps the digit that holds the quantile; the
driver sees at most 4,096 sums per node and pass, whatever the input. A node is finished once the digit holds less than
`tolerance` of a shard, or copies of one text with less than `group_tolerance` of a shard; once few rows are left, they
are ordered on the driver. Passes read a written table of numbers, never texts.

Slots count from 0 within a shard by (part, doc_id, CRC, size), where a part is a hash of doc_id. Parts are ranked by
themselves and shifted by the sums of the parts before, so that no shard is ranked in one task.

Defined results. A null text has CRC 0 and 16 bytes. Null doc_ids count as the lowest. Repeated rows stay apart as rows
and may share a shard. Fewer rows than shards leave shards empty. An empty table gives no rows. Extra columns stay out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerbline.llm.common import scratch

BITS = 12
LOWEST = -(1 << 63)
# Bits of the key's parts, each a whole number of digits: dimension, CRC, doc_id.
PARTS = (24, 36, 72)
DIGITS = sum(PARTS) // BITS
DIMENSIONS = ("d_chars", "d_wide", "d_blanks")


@dataclass
class Node:
    """A region of the tree: `shards` leaves from `first` on."""

    number: int
    first: int
    shards: int
    dimension: str = ""
    total: int = 0
    digits: list[int] = field(default_factory=list)
    below: int = 0  # bytes before the digits found so far
    few: bool = False  # so few rows are left that they are ordered on the driver
    cut: tuple[int, int, int] | None = None  # the last key (dimension, CRC, doc_id) of the lower side


def metadata(docs: DataFrame) -> DataFrame:
    """One row of numbers per document: size, CRC, and the dimensions, each below 2**24."""
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text).cast("long"), F.length(text).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (size + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Length on a logarithmic scale.
        (F.log2(chars + 1) * 100_000).cast("long").alias("d_chars"),
        # Bytes beyond one per code point, per million bytes: tells scripts and languages apart.
        F.when(size > 0, ((size - chars) * 1_000_000 / size).cast("long")).otherwise(0).alias("d_wide"),
        # Blanks per million code points: the length of words.
        F.when(chars > 0, ((chars - F.length(F.translate(text, " ", ""))) * 1_000_000 / chars).cast("long")).otherwise(0).alias("d_blanks"),
    )


def _digit(dimension: str, k: int):
    """The k-th digit of the key, from the top."""
    place = k * BITS
    value, bits, start = F.col(dimension), PARTS[0], 0
    if place >= PARTS[0] + PARTS[1]:
        value, bits, start = F.col("doc_id_or_lowest").bitwiseXOR(F.lit(LOWEST)), PARTS[2], PARTS[0] + PARTS[1]
    elif place >= PARTS[0]:
        value, bits, start = F.col("text_crc32"), PARTS[1], PARTS[0]
    return F.shiftrightunsigned(value, bits - BITS - (place - start)).bitwiseAND(0xFFF)


def _by_node(nodes: list[Node], value):
    """A column that differs by node, null for nodes not listed."""
    out = F
    for n in nodes:
        out = out.when(F.col("node") == n.number, value(n))
    return out if nodes else F.lit(None)


def _same_digits(n: Node):
    out = F.lit(True)
    for k, d in enumerate(n.digits):
        out = out & (_digit(n.dimension, k) == d)
    return out


def _upper(n: Node):
    """True for rows beyond the cut."""
    if n.cut is None:
        return F.lit(False)
    (a, b, c), dim, crc, doc = n.cut, F.col(n.dimension), F.col("text_crc32"), F.col("doc_id_or_lowest")
    return (dim > a) | ((dim == a) & ((crc > b) | ((crc == b) & (doc > c))))


def _key_of(digits: list[int]) -> tuple[int, int, int]:
    """The last key that starts with these digits; the last digit may be -1."""
    value = 0
    for d in digits:
        value = (value << BITS) + d
    value = ((value + 1) << BITS * (DIGITS - len(digits))) - 1
    doc = min(value & ((1 << PARTS[2]) - 1), (1 << 64) - 1)
    return value >> (PARTS[1] + PARTS[2]), (value >> PARTS[2]) & ((1 << PARTS[1]) - 1), doc + LOWEST


def _cut_among(n: Node, rows: list[tuple[tuple[int, int, int], int]], wanted: float, group_bytes: float) -> None:
    """Cut within few rows (key, size): beside a small group of equal texts, else between two rows."""
    rows.sort()
    best, at = None, n.below
    ends: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], int] = {}
    for i, (key, size) in enumerate(rows):
        ends[key[:2]] = i
        sums[key[:2]] = sums.get(key[:2], 0) + size
    choices = [(abs(at - wanted), _key_of([*n.digits[:-1], n.digits[-1] - 1]))]
    for i, (key, size) in enumerate(rows):
        at += size
        if sums[key[:2]] > group_bytes or ends[key[:2]] == i:
            choices.append((abs(at - wanted), key))
    best = min(choices)
    n.cut = best[1]


def _find_cuts(data: DataFrame, nodes: list[Node], tolerance: float, group_tolerance: float, shard_bytes: float, few_rows: int = 1000) -> None:
    """Set each node's cut, one digit a pass for all nodes together; at most `few_rows` rows of a node reach the driver."""
    wanted = {n.number: n.total * (n.shards // 2) / n.shards for n in nodes}
    for k in range(DIGITS):
        going = [n for n in nodes if n.cut is None and not n.few and n.total]
        if not going:
            break
        digit = _by_node(going, lambda n, k=k: F.when(_same_digits(n), _digit(n.dimension, k)))
        sums: dict[int, list[tuple[int, int, int]]] = {}
        counted = data.select("node", "size", digit.alias("digit")).where(F.col("digit").isNotNull()).groupBy("node", "digit")
        for r in counted.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
            sums.setdefault(r.node, []).append((r.digit, r.bytes, r.n))
        for n in going:
            want, at, found = wanted[n.number], n.below, sorted(sums[n.number])
            for i, (d, held, count) in enumerate(found):
                if at + held >= want or i == len(found) - 1:
                    break
                at += held
            # Digits up to the CRC's last: after it only copies of one text are left.
            enough = max(tolerance, group_tolerance) if k == (PARTS[0] + PARTS[1]) // BITS - 1 else 0 if count <= few_rows else tolerance
            if held <= enough * shard_bytes or k == DIGITS - 1:
                n.cut = _key_of([*n.digits, d if at + held - want <= want - at else d - 1])
            else:
                n.digits.append(d)
                n.below, n.few = at, count <= few_rows
    few = [n for n in nodes if n.few]
    if few:
        here = _by_node(few, lambda n: F.when(_same_digits(n), F.col(n.dimension)))
        rows: dict[int, list] = {}
        for r in data.select("node", "size", here.alias("d"), "text_crc32", "doc_id_or_lowest").where(F.col("d").isNotNull()).collect():
            rows.setdefault(r.node, []).append(((r.d, r.text_crc32, r.doc_id_or_lowest), r.size))
        for n in few:
            _cut_among(n, rows[n.number], wanted[n.number], group_tolerance * shard_bytes)


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, tolerance: float = 0.002,
              group_tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32 and shard of every document; `target_bytes` sets the number of shards when `shards` is None."""
    data = scratch(metadata(docs), "metadata")
    spans = [f(d).alias(f"{d}_{name}") for d in DIMENSIONS for f, name in ((F.min, "low"), (F.max, "high"))]
    whole = data.agg(F.sum("size").alias("total"), *spans).first()
    if whole.total is None:
        return data.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    shards = shards or max(1, -(-whole.total // target_bytes))
    wide = {d: max(1, whole[f"{d}_high"] - whole[f"{d}_low"]) for d in DIMENSIONS}
    leaves: list[Node] = []
    nodes = [Node(0, 0, shards)]
    data = data.withColumn("doc_id_or_lowest", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("node", F.lit(0))
    while nodes:
        leaves += [n for n in nodes if n.shards == 1]
        nodes = [n for n in nodes if n.shards > 1]
        if not nodes:
            break
        seen = {r.node: r for r in data.groupBy("node").agg(F.sum("size").alias("total"), *spans).collect()}
        for n in nodes:
            r = seen.get(n.number)
            n.total = r.total if r else 0
            n.dimension = max(DIMENSIONS, key=lambda d, r=r: (r[f"{d}_high"] - r[f"{d}_low"]) / wide[d] if r else 0)
        _find_cuts(data, nodes, tolerance, group_tolerance, whole.total / shards)
        # Node i has the children 2 i + 2 and 2 i + 3.
        deeper = _by_node(nodes, lambda n: F.when(_upper(n), n.number * 2 + 3).otherwise(n.number * 2 + 2))
        data = scratch(data.withColumn("node", F.coalesce(deeper, F.col("node"))), "kd-level")
        nodes = [child for n in nodes for child in (
            Node(n.number * 2 + 2, n.first, n.shards // 2), Node(n.number * 2 + 3, n.first + n.shards // 2, n.shards - n.shards // 2))]
    shard = _by_node(leaves, lambda n: F.lit(n.first))
    return data.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))


def with_slots(placed: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """A gapless number from 0 on within each shard."""
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    parts = max(1, -(-most // rows_per_part))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).drop("part", "rank", "before")
