"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, less exception phrases, normalised by length.

Folding lowers the text, maps look-alike letters of other scripts and digit substitutions (1 for i, 3 for e ...) to
plain letters, and turns what separates words into blanks. Lexicon entries are folded words (" idiot ") and beginnings
of words (" idio"), so that one pass of the automaton finds both.

The lexicon is learned from labelled training documents: each word and each beginning of a word is counted once per
document and label, by all tasks; entries whose log-odds are surely above `least_sure` are candidates. A beginning is
kept only where it stands for several words, and words it covers as well are left out. Exceptions are pairs of a
candidate's match and the word before or after it that training documents of label 0 hold at least as often as those of
label 1, smoothed; matches within an exception count nothing. Candidates whose other matches have log-odds of at least
`least_odds` make the lexicon, and the log-odds is the weight.

Score: a logistic function of the summed weights, their density per word, and whether anything matched, fitted on the
same documents. Only `sample_rows` labelled rows (a hash of doc_id picks them) train; all documents are scored whole.

Defined results. Null and empty texts get the score of a text without matches. Without training labels of both kinds
every score is the share of label 1 (0 without any). Labels that are null do not train; repeated rows train once.
Extra columns stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import batches, sampled, scratch

# Letters that look like Latin ones, and digits and signs used for letters.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): SUBSTITUTES.get(str(i), str(i)) for i in range(10)}
_BLANK = {chr(c): " " for c in [*range(0, 48), *range(58, 64), *range(91, 97), *range(123, 192), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026]}
_NONE = {"​": None, "‌": None, "‍": None, "­": None}
FOLD = str.maketrans(_BLANK | _WIDE | LOOK_ALIKE | SUBSTITUTES | _NONE)
STEMS = (4, 5, 6)


def fold(text: str | None) -> str:
    """Folded text between blanks."""
    return f" {text.lower().translate(FOLD)} " if text else "  "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)

    def automaton(self):
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (entry, weight))
        out.make_automaton()
        return out


def around(text: str, start: int, entry: str) -> tuple[str, str, str]:
    """The whole word a match begins, and its neighbours."""
    stop = text.find(" ", start + 1)
    word = text[start + 1:stop]
    # Blanks may stand in a row; the neighbours are whole words, however long and far.
    end, begin = start, stop
    while end > 0 and text[end - 1] == " ":
        end -= 1
    while begin < len(text) and text[begin] == " ":
        begin += 1
    return word, text[text.rfind(" ", 0, end) + 1:end], text[begin:text.find(" ", begin)] if begin < len(text) else ""


def matched(text: str, automaton, exceptions: set[str]) -> tuple[float, list[tuple[str, str, str, str]]]:
    """Summed weight of a folded text, one per word start (the heaviest entry), and the (entry, word, left, right) that counted."""
    best: dict[int, tuple[float, str]] = {}
    for last, (entry, weight) in automaton.iter(text):
        start = last - len(entry) + 1
        if start not in best or weight > best[start][0]:
            best[start] = (weight, entry)
    total, found = 0.0, []
    for start, (weight, entry) in best.items():
        word, left, right = around(text, start, entry)
        if exceptions and (f"{left} {word}" in exceptions or f"{word} {right}" in exceptions):
            continue
        total += weight
        found.append((entry, word, left, right))
    return total, found


def features(total: float, n_matches: int, n_words: int) -> tuple[float, ...]:
    """Bounded, so that one long rant is no outlier of the fit."""
    return (1.0, math.log1p(total), min(1.0, 10 * total / (10 + n_words)), float(n_matches > 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_entries: int = 4_000, least_odds: float = 3.0, least_sure: float = 1.0, least_docs: int = 4) -> Model:
    """Learn lexicon, exceptions and logistic coefficients; only aggregates and at most `sample_rows` pairs of numbers reach the driver."""
    spark = docs.sparkSession
    batches(spark)
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).distinct()
    share = min(1.0, sample_rows / max(1, usable.count()))
    usable = usable.where(sampled(share, "_id"))
    # About `sample_rows` pairs of numbers, so a broadcast is bounded and only the sample's texts are ever moved.
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), F.col("doc_id") == F.col("_id")).select("_id", "text", "_toxic")
    rows = scratch(sample.dropDuplicates(), "toxicity-sample").select("text", "_toxic")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = set(fold(text).split())
                entries = {f" {w} " for w in found} | {f" {w[:k]}" for w in found for k in STEMS if len(w) > k}
                seen[toxic].update(entries)
                seen[toxic][""] += 1
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield from flushed(seen)
        yield from flushed(seen)

    def flushed(seen):
        for toxic in (0, 1):
            if seen[toxic]:
                keys = list(seen[toxic])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([seen[toxic][k] if not toxic else 0 for k in keys], pa.int64()), pa.array([seen[toxic][k] if toxic else 0 for k in keys], pa.int64())], names=["entry", "n0", "n1"])
                seen[toxic].clear()

    counts = rows.mapInArrow(count, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = counts.where("entry = ''").first()
    if totals is None or not totals.n1 or not totals.n0:
        return Model(coefficients=(20.0 if totals is not None and totals.n1 else -20.0, 0.0, 0.0, 0.0))
    odds = F.log((F.col("n1") + 0.5) / (totals.n1 + 1)) - F.log((F.col("n0") + 0.5) / (totals.n0 + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    strong = counts.where(f"entry <> '' and n1 >= {least_docs}").withColumn("odds", odds).where(sure >= least_sure)
    # A beginning of one word only says what the word says: both are counted, the word is the more exact.
    top = strong.orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "entry").limit(most_entries).collect()
    known = {r.entry: (r.odds, r.n1) for r in top}
    weights = {}
    for entry, (value, n1) in known.items():
        word = entry.strip()
        if entry.endswith(" "):
            covered = any(known.get(f" {word[:k]}", (0, 0))[1] > 1.5 * n1 and known[f" {word[:k]}"][0] >= value - 1 for k in STEMS if len(word) > k)
        else:
            whole = [n for e, (_, n) in known.items() if e.startswith(entry) and e.endswith(" ")]
            covered = bool(whole) and max(whole) > 0.9 * n1
            covered |= any(known.get(f" {word[:k]}", (0, 0))[1] >= n1 and known[f" {word[:k]}"][0] >= value for k in STEMS if len(word) > k)
        if not covered:
            weights[entry] = float(value)
    held = spark.sparkContext.broadcast(weights)  # at most `most_entries` short strings

    def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Model(held.value).automaton(), (Counter(), Counter())
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[toxic].update({p for _, w, a, b in matched(fold(text), automaton, set())[1] for p in (f"{a} {w}", f"{w} {b}")})
        yield from flushed(seen)

    phrases = rows.mapInArrow(contexts, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    harmless = phrases.where("n0 >= 3").withColumn("odds", odds).where("odds <= 0").orderBy(F.desc("n0"), "entry").limit(most_entries)
    exceptions = {r.entry for r in harmless.collect()}

    def others(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Model(held.value).automaton(), (Counter(), Counter())
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[toxic].update({e for e, *_ in matched(fold(text), automaton, exceptions)[1]})
        yield from flushed(seen)

    final = rows.mapInArrow(others, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = Model({r.entry: r.odds for r in final.where(f"n1 >= {least_docs}").withColumn("odds", odds).where(F.col("odds") >= least_odds).collect()}, exceptions)
    held_model = spark.sparkContext.broadcast(model)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held_model.value.automaton()
        for part in parts:
            out = [measured(text, automaton, held_model.value.exceptions) for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), (pa.float64(), pa.int64(), pa.int64()))), part.column(1)], names=["total", "matches", "words", "toxic"])

    seen = rows.mapInArrow(measure, "total double, matches long, words long, toxic int").collect()
    x = np.array([features(r.total, r.matches, r.words) for r in seen])
    model.coefficients = tuple(fit_logistic(x, np.array([r.toxic for r in seen], float)))
    return model


def measured(text: str | None, automaton, exceptions: set[str]) -> tuple[float, int, int]:
    folded = fold(text)
    total, found = matched(folded, automaton, exceptions) if len(automaton) else (0.0, [])
    return total, len(found), len(folded.split())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with _kerbline_score (0 to 1) and _kerbline_predicted (1 from 0.5 on)."""
    spark = docs.sparkSession
    batches(spark)
    held = spark.sparkContext.broadcast(model)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in ("_kerbline_score", "_kerbline_predicted")], T.StructField("_kerbline_score", T.DoubleType()), T.StructField("_kerbline_predicted", T.IntegerType())])
    own = [F.col(f"`{f.name}`") for f in schema.fields[:-2]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, w = held.value.automaton(), np.array(held.value.coefficients)
        for part in parts:
            x = np.array([features(*measured(t, automaton, held.value.exceptions)) for t in part.column(part.schema.get_field_index("text")).to_pylist()]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*own).mapInArrow(run, schema)
