"""Periodic runs of words, found by recompression: a run-length grammar answers how far two places of a text agree.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends.

Grammar. The words of a batch of texts are one sequence of numbers, with a mark of its own after each text. Rounds of two
steps shorten it: block compression turns each longest repeat of one letter into one letter (base, count), pair
compression splits the alphabet in two by a hash and turns each left letter followed by a right one into one letter. Equal
stretches are cut alike but for their ends, so the levels are a locally consistent grammar of logarithmic height, and a
block's count is its run length. Recompression ends where no letter stands twice: then different places differ.

Extension. Where two places agree, a walk goes up while both stand at a cut of the next level, takes equal letters whole
(of two blocks of one base the shorter count) and comes down where letters differ; backwards alike. All questions of a
batch walk together in numpy, in a number of steps that grows with the height.

Candidates. A run of period q has at least 4 q words, so it holds three neighbours on the grid of multiples of q whose
words equal those one period on; n/1 + n/2 + ... grid places are looked at, and only those with such a triple are asked
for their extensions in both directions. Of the periods of one stretch the smallest is kept: two periods of a stretch at
least four times either have their greatest common divisor as a period.

No row moves: texts are dealt as they are read, and one text is work for one task. Its memory is a few numbers per word.

Defined results. Words are what stands between bytes 0x20 and 0x09 to 0x0D. Null and empty texts have no words and no
runs; the collapsed text is then empty. Repeated rows have results of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import batches, mixed

LEAST, TIMES = 6, 4
BATCH_WORDS = 150_000
_ASKED = 1 << 19  # extensions answered at once


class Grammar:
    """Levels of a sequence: letters, where each begins in the sequence, and whether the step up made blocks or pairs."""

    def __init__(self, sequence: np.ndarray, rounds: int = 200):
        self.size = len(sequence)
        self.letters, self.starts = [sequence.astype(np.int64)], [np.arange(len(sequence) + 1)]
        self.blocks: list[bool] = []
        # Of every letter: its base letter and count, itself and 1 where it is no block.
        self.base, self.count = np.arange(int(sequence.max(initial=-1)) + 1), np.ones(int(sequence.max(initial=-1)) + 1, np.int64)
        for step in range(rounds):
            now = self.letters[-1]
            if len(now) < 2 or np.bincount(now, minlength=1).max() < 2:
                break
            if step % 2 == 0:
                self._add_blocks(now)
            else:
                self._add_pairs(now, step)

    def _named(self, first: np.ndarray, second: np.ndarray, are_blocks: bool) -> np.ndarray:
        """New letters for pairs of numbers, equal for equal pairs."""
        known = len(self.base)
        pairs, names = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
        width = int(second.max(initial=0)) + 1
        self.base = np.concatenate([self.base, pairs // width if are_blocks else known + np.arange(len(pairs))])
        self.count = np.concatenate([self.count, pairs % width if are_blocks else np.ones(len(pairs), np.int64)])
        return known + names

    def _add_blocks(self, now: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        counts = np.diff(np.append(first, len(now)))
        out, many = now[first].copy(), counts > 1
        if many.any():
            out[many] = self._named(out[many], counts[many], True)
        self._push(out, first, True)

    def _add_pairs(self, now: np.ndarray, step: int) -> None:
        left = (mixed(now.astype(np.uint64) * np.uint64(2 * step + 1) + np.uint64(step)) & np.uint64(1)).astype(bool)
        head = np.flatnonzero(left[:-1] & ~left[1:])
        keep = np.ones(len(now), bool)
        keep[head + 1] = False
        out = now.copy()
        if len(head):
            out[head] = self._named(now[head], now[head + 1], False)
        first = np.flatnonzero(keep)
        self._push(out[first], first, False)

    def _push(self, letters: np.ndarray, first: np.ndarray, are_blocks: bool) -> None:
        self.letters.append(letters)
        self.starts.append(np.append(self.starts[-1][first], self.size))
        self.blocks.append(are_blocks)

    def agree(self, a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many numbers agree from the places a and b on, or before them where `backward`."""
        a, b, top = a.astype(np.int64), b.astype(np.int64), len(self.letters) - 1
        begin = a.copy()
        a, b, going = a.copy(), b.copy(), np.arange(len(a))
        for level in range(top + 1):
            # Up: at each level as far as a cut of the next level, which both sides reach together or not at all.
            going = self._walk(level, a, b, going, backward, climbing=level < top)
        for level in range(top - 1, -1, -1):
            self._walk(level, a, b, np.arange(len(a)), backward, climbing=False)
        return np.abs(a - begin)

    def _walk(self, level: int, a: np.ndarray, b: np.ndarray, going: np.ndarray, backward: bool, climbing: bool) -> np.ndarray:
        """Move the walks `going` over equal letters of a level; return those that stand at a cut of the next level."""
        letters, starts, back = self.letters[level], self.starts[level], 1 if backward else 0
        up = []
        # Walks whose places are no cut of this level (they came down from beside it) wait for a lower one.
        at_a, at_b = np.searchsorted(starts, a[going]), np.searchsorted(starts, b[going])
        good = (starts[at_a] == a[going]) & (starts[at_b] == b[going])
        going, at_a, at_b = going[good], at_a[good], at_b[good]
        while len(going):
            if climbing:
                above = self.starts[level + 1]
                both = self._cut(above, a[going]) & self._cut(above, b[going])
                up.append(going[both])
                going, at_a, at_b = going[~both], at_a[~both], at_b[~both]
            inside = (at_a - back >= 0) & (at_b - back >= 0) & (at_a - back < len(letters)) & (at_b - back < len(letters))
            going, at_a, at_b = going[inside], at_a[inside], at_b[inside]
            one, two = letters[at_a - back], letters[at_b - back]
            same = one == two
            # Two blocks of one base agree in the shorter count, and then differ where the longer one goes on.
            part = ~same & (self.base[one] == self.base[two])
            if part.any():
                self._take_shorter(level, a, b, going[part], one[part], two[part], backward)
            going, at_a, at_b = going[same], at_a[same], at_b[same]
            if not len(going):
                break
            step = np.ones(len(going), np.int64)
            if climbing and level < len(self.blocks) and self.blocks[level]:
                step = np.minimum(self._left_in_block(level, at_a, backward), self._left_in_block(level, at_b, backward))
            at_a, at_b = (at_a - step, at_b - step) if backward else (at_a + step, at_b + step)
            a[going], b[going] = starts[at_a], starts[at_b]
        return np.concatenate(up) if up else np.empty(0, np.int64)

    def _cut(self, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return starts[np.searchsorted(starts, at)] == at

    def _left_in_block(self, level: int, at: np.ndarray, backward: bool) -> np.ndarray:
        """Letters of this level from `at` to the end of the block of the next level that holds it (or to its start)."""
        above = self.starts[level + 1]
        place = self.starts[level][at]
        if backward:
            edge = above[np.searchsorted(above, place) - 1]
            return at - np.searchsorted(self.starts[level], edge)
        edge = above[np.searchsorted(above, place, "right")]
        return np.searchsorted(self.starts[level], edge) - at

    def _take_shorter(self, level, a, b, walks, one, two, backward) -> None:
        """Blocks of one base letter: both sides move by the shorter count of it, then wait for a lower level."""
        count = np.minimum(self.count[one], self.count[two])
        # All letters of a base have one length; the block with the shorter count measures it.
        starts = self.starts[level]
        at = np.searchsorted(starts, a[walks])
        length = np.abs(starts[at] - starts[at - 1]) if backward else starts[at + 1] - starts[at]
        length = length // self.count[one] * count
        move = -length if backward else length
        a[walks] += move
        b[walks] += move


def _asked(grammar: Grammar, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ahead, behind = grammar.agree(at, at + q), grammar.agree(at, at + q, backward=True)
    return at - behind, at + q + ahead


def runs(sequence: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then length; `longest` bounds the length of a text in it."""
    n = len(sequence)
    if n < LEAST:
        return np.empty((0, 3), np.int64)
    grammar, found, waiting, held = Grammar(sequence), [], [], 0

    def ask() -> None:
        at, q = (np.concatenate(c) for c in zip(*waiting))
        start, stop = _asked(grammar, at, q)
        good = stop - start >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack([start[good], stop[good] - start[good], q[good]], 1), axis=0))

    for q in range(1, longest // TIMES + 1):
        grid = sequence[::q]
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hits):
            waiting.append((hits * q, np.full(len(hits), q)))
            held += len(hits)
            if held >= _ASKED:
                ask()
                waiting, held = [], 0
    if waiting:
        ask()
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    again = (rows[1:, :2] == rows[:-1, :2]).all(1)
    return np.delete(rows, np.flatnonzero(again) + 1, axis=0)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one text in ten become periodic from some word on, as told by crc32 of the decimal doc_id."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def kept_words(n: int, own: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, own[:, 0] + own[:, 2], 1)
    np.add.at(edges, own[:, 0] + own[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)),
    T.StructField("collapsed", T.BinaryType()), T.StructField("collapsed_sha256", T.StringType()),
])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _solve(members: list[tuple[int | None, list[bytes]]], keep_text: bool) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for _, w in members], np.int64)
    # A mark after each text, used nowhere else, keeps runs within their text.
    offsets = np.cumsum(sizes + 1) - sizes - 1
    sequence = np.empty(int(sizes.sum()) + len(members), np.int64)
    for (_, words), at in zip(members, offsets):
        sequence[at:at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    sequence[offsets + sizes] = len(numbers) + np.arange(len(members))
    rows = runs(sequence, int(sizes.max(initial=0)))
    owner = np.searchsorted(offsets, rows[:, 0], "right") - 1
    rows[:, 0] -= offsets[owner]
    cuts = np.searchsorted(owner, np.arange(len(members) + 1))
    out = []
    for i, (doc_id, words) in enumerate(members):
        own = rows[cuts[i]:cuts[i + 1]]
        own = own[np.lexsort((own[:, 2], own[:, 0]))]
        kept = b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), own))] if len(own) else words)
        out.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in own.tolist()], kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(_RUN), pa.binary(), pa.string()))], names=OUT.names)


def find(docs: DataFrame, plant: bool = False, keep_text: bool = True, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256) of every row; `plant` makes one text in ten periodic first."""
    batches(docs.sparkSession, 200)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for batch in parts:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                members.append((doc_id, planted(words, doc_id) if plant else words))
                held += len(words) + 1
                if held >= batch_words:
                    yield _solve(members, keep_text)
                    members, held = [], 0
        if members:
            yield _solve(members, keep_text)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def report(found: DataFrame) -> DataFrame:
    """Digest columns: number of runs, the longest (then first, then of smallest period), and digests of runs and kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
