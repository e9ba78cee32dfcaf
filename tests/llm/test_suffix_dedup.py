"""Repeats across documents against a table of all 50-byte windows, with many batches, small chunks and hot grams."""

import hashlib

import numpy as np
import pytest

from kerbline.llm import suffix_dedup


def order(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def expected(rows, size=50):
    texts, first = [(i, (t or "").encode()) for i, t in rows], {}
    for i, b in texts:
        for k in range(len(b) - size + 1):
            w = b[k:k + size]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if first[b[k:k + size]] < order(i):
                gone[k:k + size] = True
        n_spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **how):
    return sorted((tuple(r) for r in suffix_dedup.report(suffix_dedup.find(docs, **how)).collect()), key=str)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("how", [{"least_buckets": 4}, {"n_batches": 7, "hot": 2, "chunk_bytes": 30_000, "least_buckets": 3}, {"n_batches": 1, "least_buckets": 2}])
def test_repeats_equal_a_table_of_all_windows(spark, small, how):
    got = found(small, **how)
    assert got == expected(rows_of(small)) and sum(r[2] for r in got) > 0


def test_edges_of_matches_and_odd_rows(spark, odd, none):
    line = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(5, line[:50]), (6, "x" + line[:50] + "y"), (7, line[:49]), (8, line), (9, line[1:51] + line[1:51]), (10, "é" * 25), (11, "é" * 26), (10, "é" * 25),
            (None, "z" * 50), (None, "z" * 50), (12, "z" * 130), (13, line[30:] + "-" + line[:31]), (14, "z" * 49), (15, line + "\0" * 60), (16, "\0" * 55), (17, line[::-1] + "é" * 40)]
    edges = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n_batches in (1, 2, 5):
        assert found(edges, n_batches=n_batches, least_buckets=2, hot=3) == expected(rows)
    # The long row repeats itself only, which is no match.
    assert found(odd, least_buckets=2) == expected(rows_of(odd))
    assert found(none, least_buckets=2) == []


def test_spans_say_what_goes(spark, small):
    texts = {r.doc_id: r.text.encode() for r in small.collect()}
    for r in suffix_dedup.find(small, least_buckets=3).where("n_removed > 0").limit(40).collect():
        kept, at = b"", 0
        for a, b in r.spans:
            assert b - a >= 50
            kept, at = kept + texts[r.doc_id][at:a], b
        assert hashlib.sha256(kept + texts[r.doc_id][at:]).hexdigest() == r.kept_sha256


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 101, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 101, k).astype(np.uint8), shared, rng.integers(97, 101, k).astype(np.uint8)]) for k in (0, 3, 40, 77)]
    chosen = []
    for text, k in zip(texts, (0, 3, 40, 77)):
        at, lo, hi, _ = suffix_dedup.anchors(text, np.array([len(text)]))
        of_window = {w: a for a, x, y in zip(at, lo, hi) for w in range(x, y + 1)}
        assert sorted(of_window) == list(range(len(text) - 49)) and all(w <= a <= w + 30 for w, a in of_window.items())
        chosen.append([of_window[k + w] - k for w in range(351)])
    assert all(c == chosen[0] for c in chosen)


def test_levels_merge_when_they_are_equal(spark, monkeypatch):
    sizes = []
    add = suffix_dedup.Family.add
    monkeypatch.setattr(suffix_dedup.Family, "add", lambda self, batch: (add(self, batch), sizes.append([s for s, _ in self.levels]))[0])
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('a passage that every document of this table repeats, and then a number: ', id) AS text")
    got = found(docs, n_batches=6, least_buckets=2)
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    assert got == expected(rows_of(docs)) and sum(r[2] > 0 for r in got) == 59
