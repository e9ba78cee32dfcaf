"""Merkle manifest of a dataset: stored levels of parent-linked nodes, and a recursive query that climbs them per leaf.

Every row is a leaf; the leaves of one source, in order of doc_id, form a tree in which each run of three neighbours has
one parent, and the trees' roots, in order of source, form the top tree. H is SHA-256 in lowercase hex over its inputs
put together, digests as hex text.

Building. Texts are read once and leave as two digests. Leaves are numbered by a range shuffle and prefix sums over
(partition, source), so that no source is ordered in one task. Then storeys are built: one storey is `STOREY` levels,
so at most 3 ** STOREY neighbours and all their ancestors up to one node are hashed in one group. A node row holds its
digest, the siblings it meets on the way through its storey, and the link to its parent in the next storey; the way of a
source's last storey goes on through the first storey of the top tree. Leaves lie in the rows of their runs: the up to
three leaves under one parent, which share the way from there. Each storey is a written table.

Climbing. A Spark recursive query starts with every leaf, folds its tampered digest along its row's way and follows one
parent link a step, appending siblings and folding each leaf on, until a row has no parent: 2 to 4 steps where single
levels would need 20. A node under which many leaves lie has one copy for each `LOT` of them, and a row asks for the copy
its hash names, so that no join key gathers more than about LOT leaves.

Defined results. Null doc_ids come first within a source; ties in doc_id go by leaf digest (equal leaves may change
places, which changes no value). The null source is a source of its own, the first. Rows without a doc_id are not
tampered with. Repeated rows are leaves of their own. An empty table has no root and gives no rows. Extra columns stay out.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kerbline.llm.common import batches, scratch

STOREY = 6
RUN = 3
LOT = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = 0

_PATH = T.ArrayType(T.StructType([T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())]))
_MEMBERS = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("tampered", T.BinaryType())]))
NODES = T.StructType([
    T.StructField("tree", T.LongType()), T.StructField("storey", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
    # The leaves of a run, in order; null above them.
    T.StructField("members", _MEMBERS),
    # The siblings met on the way up through the storey, level by level; empty at levels where a node has none.
    T.StructField("path", _PATH),
    # The digest the way ends with, and how many leaves lie beneath that node.
    T.StructField("up", T.BinaryType()), T.StructField("up_weight", T.LongType()),
])


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*parts))


def tampers(doc_id: Column) -> Column:
    """Whether a row's text loses its line feeds in the tampered copy: crc32 of the decimal doc_id is even."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(id, tree_key, digest, tampered) of every row; `tampered` is null where the tampered copy equals the original."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    broken = tampers(fields["doc_id"]) & F.contains(fields["text"], F.lit("\n"))
    changed = leaf_digest([fields[c] if c != "text" else F.translate(fields[c], "\n", "") for c in FIELDS])
    return docs.select(fields["doc_id"].cast("long").alias("id"), fields["source"].cast("string").alias("tree_key"),
                       leaf_digest(list(fields.values())).alias("digest"), F.when(broken, changed).alias("tampered"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with `pos`, their number from 0 within their source; and (tree_key, place, n) of the sources, by rank.

    Leaves are dealt by ranges of (source, doc_id, digest) and counted within partitions; the counts before a partition
    are added. The count tables have one row per source and partition that meet, and the one ordered sum over all of a
    table is over partitions.
    """
    order = ["tree_key", "id", "digest", "_row"]
    spread = scratch(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-digests")
    at = scratch(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    extents = at.groupBy("tree_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("tree_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = extents.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = at.alias("a").join(starts.alias("s"), (F.col("a._part") == F.col("s._part")) & F.col("a.tree_key").eqNullSafe(F.col("s.tree_key")))
    placed = placed.select(*[f"a.{c}" for c in rows.columns], (F.col("_at") - F.col("_first") + F.col("_base")).alias("pos"))
    # Sources that begin in a partition are ranked there; the sources of earlier partitions come before them.
    sources = extents.groupBy("tree_key").agg(F.min("_part").alias("_part"), F.sum("_n").alias("n")).withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy("tree_key")))
    begun = sources.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed, sources.join(begun, "_part").select("tree_key", (F.col("_base") + F.col("_rank") - 1).alias("place"), "n")


def hexed(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def climb_block(block: list[bytes], levels: int) -> tuple[list[list[tuple[bytes, bytes]]], bytes]:
    """The path of every digest of a block through `levels` levels, and the one digest above them all."""
    rows, paths, places = block, [[] for _ in block], list(range(len(block)))
    for _ in range(levels):
        for i, at in enumerate(places):
            first = at - at % RUN
            paths[i].append((b"".join(rows[first:at]), b"".join(rows[at + 1:first + RUN])))
            places[i] = at // RUN
        rows = [hexed(rows[i:i + RUN]) for i in range(0, len(rows), RUN)]
    if len(rows) != 1:
        raise ValueError("the block is wider than its levels")
    return paths, rows[0]


def _levels(n: int, storey: int, height: int) -> int:
    """How many levels a tree of n leaves has in a storey."""
    levels = 0
    while levels < height and RUN ** (storey * height + levels) < n:
        levels += 1
    return levels


def leaf_storey(leaf_rows: DataFrame, height: int) -> DataFrame:
    """The lowest storey, one row for each run of leaves, from (tree, n, pos, id, digest, tampered)."""
    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        levels, digests = _levels(n, 0, height), list(block["digest"])
        members = [{"id": None if pd.isna(i) else int(i), "digest": d, "tampered": t} for i, d, t in zip(block["id"], digests, block["tampered"])]
        runs = [members[i:i + RUN] for i in range(0, len(members), RUN)]
        paths, up = climb_block([hexed(digests[i:i + RUN]) for i in range(0, len(digests), RUN)] if levels else digests, max(0, levels - 1))
        return pd.DataFrame({
            "tree": block["tree"].iloc[0], "storey": 0, "pos": [int(p) // RUN for p in block["pos"].iloc[::RUN]], "n": n, "members": runs,
            "path": [[{"before": a, "after": b} for a, b in path] for path in paths], "up": up, "up_weight": len(members),
        })

    # Strings keep large ids exact beside nulls.
    return leaf_rows.withColumn("id", F.col("id").cast("string")).withColumn("_block", F.floor(F.col("pos") / RUN ** height)).groupBy("tree", "_block").applyInPandas(build, NODES)


def storey_of(nodes: DataFrame, storey: int, height: int) -> DataFrame:
    """Node rows of a storey above the leaves, from (tree, n, pos, digest, weight); `n` is the tree's number of leaves.

    A group is one block of RUN ** height neighbours at most.
    """
    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        paths, up = climb_block(list(block["digest"]), _levels(n, storey, height))
        return pd.DataFrame({
            "tree": block["tree"], "storey": storey, "pos": block["pos"], "n": n, "members": None,
            "path": [[{"before": a, "after": b} for a, b in path] for path in paths], "up": [up] * len(block), "up_weight": int(block["weight"].sum()),
        })

    return nodes.withColumn("_block", F.floor(F.col("pos") / RUN ** height)).groupBy("tree", "_block").applyInPandas(build, NODES)


def _above(storey: DataFrame, i: int, height: int, of_runs: bool) -> DataFrame:
    """The nodes a storey ends with: (tree, n, pos, digest, weight)."""
    width = RUN ** (height - 1 if of_runs else height)
    return storey.groupBy("tree", F.floor(F.col("pos") / width).alias("pos")).agg(F.first("n").alias("n"), F.first("up").alias("digest"), F.first("up_weight").alias("weight"))


def _grown(storeys: list[DataFrame], most: int, height: int, of_runs: bool, name: str) -> list[DataFrame]:
    """Storeys upon the first one until the largest tree, of `most` leaves, has its root."""
    while most > RUN ** (height * len(storeys)):
        i = len(storeys)
        nodes = _above(storeys[-1], i - 1, height, of_runs and i == 1).where(F.col("n") > RUN ** (height * i))
        storeys.append(scratch(storey_of(nodes, i, height), name))
    return storeys


def manifest(docs: DataFrame, height: int = STOREY, lot: int = LOT) -> tuple[DataFrame, DataFrame] | None:
    """The rows of leaf runs and all other node rows, both with parent links, or None for an empty table.

    A link is (to_tree, to_storey, to_pos, to_lots); to_tree is null where the way ends at the root. `subroot` is set
    in the last storey of a source's tree, `lot` tells the copies of a node apart.
    """
    batches(docs.sparkSession, 10_000)
    placed, sources = numbered(leaves(docs))
    sources = scratch(sources, "merkle-sources")
    largest, trees = sources.agg(F.max("n"), F.count(F.lit(1))).first()
    if not trees:
        return None
    # One row per source: Spark broadcasts the sources where they are few and splits a hot one where they are not.
    known = placed.alias("l").join(sources.alias("s"), F.col("l.tree_key").eqNullSafe(F.col("s.tree_key")))
    known = known.select((F.col("place") + 1).alias("tree"), "n", "pos", "id", "digest", "tampered")
    low = _grown([scratch(leaf_storey(known, height), "merkle-storey")], int(largest), height, True, "merkle-storey")

    # The one node above a tree's last storey is its root.
    tops = [s.where((F.col("pos") == 0) & (F.col("n") <= RUN ** (height * (i + 1)))).select("tree", F.col("up").alias("digest"), F.col("n").alias("weight")) for i, s in enumerate(low)]
    roots = reduce(DataFrame.unionByName, tops).select(F.lit(TOP).cast("long").alias("tree"), F.lit(int(trees)).cast("long").alias("n"), (F.col("tree") - 1).alias("pos"), "digest", "weight")
    high = _grown([scratch(storey_of(roots, 0, height), "merkle-top")], int(trees), height, False, "merkle-top")

    def on(i: int, last: bool, of_runs: bool) -> list[Column]:
        """The link from a row of storey i to the next one of its tree, none from the last."""
        width = RUN ** (height - 1 if of_runs else height)
        to = [F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")] if last else [F.col("tree"), F.lit(i + 1), F.floor(F.col("pos") / width)]
        return [c.alias(name) for c, name in zip([*to, F.ceil(F.col("up_weight") / lot).cast("long")], ("to_tree", "to_storey", "to_pos", "to_lots"))]

    first_top = high[0].select((F.col("pos") + 1).alias("_of"), F.col("path").alias("_on"), F.col("up").alias("_root"), *on(0, len(high) == 1, False))
    shown = ["tree", "storey", "pos", "n", "members", "path", "up", "subroot", "to_tree", "to_storey", "to_pos", "to_lots"]

    def linked(s: DataFrame, i: int) -> DataFrame:
        ends = F.col("n") <= RUN ** (height * (i + 1))
        inner = s.where(~ends).select("*", F.lit(None).cast("binary").alias("subroot"), *on(i, False, i == 0)).select(shown)
        # Trees that end here have at most one block of rows each, so no key of this join is hot.
        last = s.where(ends).withColumn("subroot", F.col("up")).join(first_top, F.col("tree") == F.col("_of")).withColumn("path", F.concat("path", "_on")).withColumn("up", F.col("_root")).select(shown)
        return inner.unionByName(last)

    above = [linked(s, i) for i, s in enumerate(low) if i]
    above += [s.select("*", F.lit(None).cast("binary").alias("subroot"), *on(i, i == len(high) - 1, False)).select(shown) for i, s in enumerate(high) if i]
    if not above:
        return linked(low[0], 0), linked(low[0], 0).where(F.lit(False)).withColumn("lot", F.lit(0).cast("long"))
    # As many copies of a node as links to it may name: it has the weight that the ways into it end with.
    weights = [_above(s, i, height, group is low and i == 0).select("tree", F.lit(i + 1).alias("storey"), "pos", "weight") for group in (low, high) for i, s in enumerate(group[:-1])]
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("weight") / lot).cast("long") - 1))
    nodes = reduce(DataFrame.unionByName, above).join(reduce(DataFrame.unionByName, weights), ["tree", "storey", "pos"]).withColumn("lot", copies).drop("weight")
    return linked(low[0], 0), scratch(nodes, "merkle-nodes")


# One member's start: its run's digest with the tampered leaf in its place, or the lone leaf of a tree without levels.
_OTHERS = "aggregate(filter(transform(members, (o, j) -> IF({keep}, o.digest, NULL)), x -> x IS NOT NULL), CAST('' AS BINARY), (p, x) -> concat(p, x))"
_START = f"""IF(n = 1, coalesce(m.tampered, m.digest),
    unhex(sha2(lower(hex(concat({_OTHERS.format(keep='j < i')}, coalesce(m.tampered, m.digest), {_OTHERS.format(keep='j > i')}))), 256)))"""
_FOLD = "aggregate({path}, {start}, (h, s) -> unhex(sha2(lower(hex(concat(s.before, h, s.after))), 256)))"
_BYTES = "aggregate({path}, CAST('' AS BINARY), (p, s) -> concat(p, s.before, s.after))"
CLIMB = f"""
    WITH RECURSIVE climb(tree, pos, lot_hash, members, proof, up, subroot, to_tree, to_storey, to_pos, to_lots) AS (
        SELECT tree, pos, pmod(xxhash64(tree, pos), 1000003),
               transform(members, (m, i) -> named_struct('id', m.id, 'digest', m.digest, 'folded', {_FOLD.format(path='path', start=_START)})),
               {_BYTES.format(path='path')}, up, subroot, to_tree, to_storey, to_pos, to_lots
        FROM {{leaves}}
        UNION ALL
        SELECT c.tree, c.pos, c.lot_hash,
               transform(c.members, m -> named_struct('id', m.id, 'digest', m.digest, 'folded', {_FOLD.format(path='n.path', start='m.folded')})),
               concat(c.proof, {_BYTES.format(path='n.path')}), n.up, coalesce(c.subroot, n.subroot), n.to_tree, n.to_storey, n.to_pos, n.to_lots
        FROM climb c JOIN {{nodes}} n ON n.tree = c.to_tree AND n.storey = c.to_storey AND n.pos = c.to_pos AND n.lot = c.lot_hash % c.to_lots
    )
    SELECT member.id, member.digest AS leaf, subroot, up AS root, concat(near, proof) AS proof, member.folded
    FROM (SELECT subroot, up, proof, inline(transform(members, (m, i) -> struct(m AS member,
              concat({_OTHERS.format(keep='j < i')}, {_OTHERS.format(keep='j > i')}) AS near))) FROM climb WHERE to_tree IS NULL)
"""


def climb(leaf_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of every leaf, digests in binary: the recursive query."""
    spark = leaf_rows.sparkSession
    # Every row of the table is a row of the recursion; the default bounds are meant for interactive use.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    names = {"leaves": "kerbline_merkle_leaves", "nodes": "kerbline_merkle_nodes"}
    leaf_rows.createOrReplaceTempView(names["leaves"])
    node_rows.createOrReplaceTempView(names["nodes"])
    return spark.sql(CLIMB.format(**names))


EMPTY = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def prove(docs: DataFrame, height: int = STOREY, lot: int = LOT) -> DataFrame:
    """Every leaf with its roots, its proof (the siblings' hex digests in order, put together) and the tampered fold."""
    stored = manifest(docs, height, lot)
    if stored is None:
        return docs.sparkSession.createDataFrame([], EMPTY)

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return climb(*stored).select(F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                                 text("proof").alias("proof"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def report(proved: DataFrame) -> DataFrame:
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
