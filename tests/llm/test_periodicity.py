"""Periodic runs against a scan of every period, and the grammar's answers against letter-by-letter comparison."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from kerbline.llm import periodicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(s):
    """All (start, length, period): for every period the longest stretches of equal neighbours, the smallest period first."""
    n, out = len(s), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and s[j] == s[j + q]:
                j += 1
            if j > k and j - k + q >= max(6, 4 * q):
                out.setdefault((k, j - k + q), q)
            k = j + 1
    return sorted((a, length, q) for (a, length), q in out.items())


def expected(doc_id, text):
    w = WORD.findall((text or "").encode())
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    dropped = {i for a, length, q in found for i in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{a},{length},{q}\n" for a, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


@pytest.mark.parametrize("batch_words", [periodicity.BATCH_WORDS, 300])
def test_runs_equal_a_scan_of_every_period(spark, small, batch_words):
    docs = small.where("length(text) < 8000").unionByName(spark.createDataFrame(
        [(-1, "a b a b a b a b a b c c c c c c c d", "x", "y", 1), (-2, "a a a a a", "x", "y", 1), (-3, "a a a a a a", "x", "y", 1), (-4, "a b c a b c a b c a b", "x", "y", 1)], small.schema))
    got = periodicity.report(periodicity.find(docs, plant=True, batch_words=batch_words)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert any(r.n_runs for r in got if r.doc_id >= 0)


def test_odd_and_empty_tables(odd, none):
    got = periodicity.report(periodicity.find(odd, plant=True)).where("doc_id <> 8 OR doc_id IS NULL").collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(r.doc_id, r.text) for r in odd.where("doc_id <> 8 OR doc_id IS NULL").collect()), key=str)
    long = periodicity.find(odd).where("doc_id = 8").first()
    assert [tuple(r) for r in long.runs] == [(0, 60_000, 5)] and bytes(long.collapsed) == b"lorem ipsum dolor sit amet"
    assert periodicity.find(none).count() == 0


def test_random_sequences_with_nested_periods():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(0, 150))
        s = rng.integers(0, int(rng.choice([1, 2, 3, 30])), n)
        for _ in range(int(rng.integers(0, 3)) if n > 30 else 0):
            a, p = int(rng.integers(0, n - 20)), int(rng.integers(1, 9))
            for i in range(a + p, min(n, a + int(rng.integers(4, 7)) * p)):
                s[i] = s[i - p]
        assert [tuple(r) for r in periodicity.runs(s.astype(np.int64), n).tolist()] == plain_runs(s.tolist())


def test_the_grammar_answers_every_pair_of_places():
    rng = np.random.default_rng(3)
    for kind in range(4):
        s = np.concatenate([np.repeat(rng.integers(0, 3, 40), rng.integers(1, 6, 40)), np.tile([0, 1, 1], 20 * (kind % 2)), np.zeros(30 * (kind // 2), int), [9]])
        a, b = (v.ravel() for v in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
        a, b = a[a < b], b[a < b]
        grammar = periodicity.Grammar(s)
        assert len(grammar.letters) > 4 and np.array_equal(np.array([grammar.size]), [len(s)])
        ahead, behind = grammar.agree(a, b), grammar.agree(a, b, backward=True)
        for x, y, f, r in zip(a, b, ahead, behind):
            assert not np.any(s[x:x + f] != s[y:y + f]) and (y + f == len(s) or s[x + f] != s[y + f])
            assert not np.any(s[x - r:x] != s[y - r:y]) and (x == r or s[x - r - 1] != s[y - r - 1])


def test_a_long_text_of_one_word_stays_small_and_quick():
    assert periodicity.runs(np.zeros(300_000, np.int64), 300_000).tolist() == [[0, 300_000, 1]]
