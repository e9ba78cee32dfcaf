"""The Merkle manifest against trees built by hand, with storeys and lots small enough to need several of each."""

import hashlib
import zlib

import pytest

from kerbline.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return sha("".join(map(field, row)))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def expected(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, levels_of([leaf(r) for r in members])))
    top, out = levels_of([levels[-1][0] for _, levels in trees]), []
    for k, (members, levels) in enumerate(trees):
        for i, row in enumerate(members):
            folded, proof = leaf(row), ""
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf((*row[:4], row[4].replace("\n", "")))
            for tree, at in ((levels, i), (top, k)):
                for level in tree[:-1]:
                    first = at - at % 3
                    before, after = "".join(level[first:at]), "".join(level[at + 1:first + 3])
                    proof, folded, at = proof + before + after, sha(before + folded + after), at // 3
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def found(docs, **how):
    return sorted((tuple(r) for r in merkle.report(merkle.prove(docs, **how)).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"height": 1, "lot": 7}, {"height": 2, "lot": 20}])
def test_proofs_equal_trees_built_by_hand(spark, small, how):
    got = found(small, **how)
    assert got == expected(rows_of(small)) and 0 < sum(r[-1] for r in got) < len(got)


def test_odd_rows_and_many_sources(spark, odd, none):
    assert found(odd) == expected(rows_of(odd))
    assert found(none) == []
    # Every row a source of its own, and repeated rows without ids.
    lone = spark.range(40).selectExpr("id AS doc_id", "concat('s', id) AS source", "'x' AS lang", "1L AS n_chars", "concat('a\n', id) AS text", "1 AS pos", "2 AS tree", "3 AS lot")
    assert found(lone, height=1, lot=3) == expected(rows_of(lone))
    same = spark.range(50).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS source", "'x' AS lang", "1L AS n_chars", "'same' AS text")
    assert found(same, height=2, lot=5) == expected(rows_of(same))


def test_a_node_has_as_many_copies_as_links_name(spark, small):
    leaf_rows, node_rows = merkle.manifest(small, height=1, lot=10)
    key = ["tree", "storey", "pos"]
    copies = {tuple(r[k] for k in key): r["n"] for r in node_rows.groupBy(*key).count().withColumnRenamed("count", "n").collect()}
    links = leaf_rows.select("to_tree", "to_storey", "to_pos", "to_lots").unionByName(node_rows.select("to_tree", "to_storey", "to_pos", "to_lots")).where("to_tree IS NOT NULL").distinct().collect()
    assert {(r.to_tree, r.to_storey, r.to_pos): r.to_lots for r in links} == copies and max(copies.values()) > 1


def test_a_block_wider_than_its_levels_is_refused():
    with pytest.raises(ValueError):
        merkle.climb_block([b"a" * 32] * 4, 1)
