"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for what they miss.

Patterns (e-mail, IP address, card number with a Luhn check, phone number) are found leftmost and non-overlapping, each
in time linear in the text. The field labels whitespace-separated tokens with B/I/O of each kind. Its features are the
token's shape, affixes, counts of digits and their check digit, and the shapes of its neighbours; it is trained by AdaGrad on the exact
likelihood of a small labelled table of token runs and decoded by Viterbi for many runs at once in numpy. Only runs
around tokens with a digit or "@" are decoded: no token without either begins or continues a labelled span in training,
so the others are O. A decoded span joins the result when it touches no pattern span.

The labelled table is made here from `sample_runs` runs of about `sample_docs` documents (the smallest hashes) labelled by the
patterns, and such runs again with phone numbers without their country code; `train` takes any such table. All documents are scanned whole, where they are read.

Defined results. Null and empty texts have no spans. Repeated rows are scanned alike. Without any labelled run the field
finds nothing. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import batches, sampled

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TELLING = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of each chain of dotted numbers in turn; a part above 255 drops its four."""
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            stop = at + sum(map(len, parts[i:i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i:i + 4]):
                yield at, stop
            at = stop + 1


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, stop), sorted by start and then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text and _DOTTED.search(text):
        out += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            number = re.sub(r"[ -]", "", m.group())
            if 12 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def runs(text: str, around: int = 2) -> list[list[tuple[str, int]]]:
    """Token runs (token, start) with at least one telling token, each with its neighbours."""
    if not _TELLING.search(text):
        return []
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
    marked = [i for i, (t, _) in enumerate(tokens) if _TELLING.search(t)]
    out, start, stop = [], -1, -1
    for i in marked:
        if start < 0 or i - around > stop:
            if start >= 0:
                out.append(tokens[start:stop + 1])
            start = max(0, i - around)
        stop = min(len(tokens) - 1, i + around)
    if start >= 0:
        out.append(tokens[start:stop + 1])
    return out


_REPEATS = re.compile(r"(.)\1+", re.DOTALL)


def shape(token: str) -> str:
    """X for upper-case, x for lower-case, d for digits, other signs as they are; repeats once."""
    signs = ["d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in token]
    return _REPEATS.sub(r"\1", "".join(signs))


def token_features(tokens: list[str]) -> list[list[str]]:
    shapes = ["<", *(shape(t) for t in tokens), ">"]
    out = []
    for i, t in enumerate(tokens, 1):
        digits = sum("0" <= c <= "9" for c in t)
        checked = digits >= 12 and luhn("".join(c for c in t if "0" <= c <= "9"))
        out.append([f"c={checked}/{shapes[i]}", "", f"s={shapes[i]}", f"d={min(digits, 20)}", f"l={min(len(t), 20)}", f"p={shapes[i - 1]}", f"n={shapes[i + 1]}",
                    f"at={t.count('@')}", f"dot={min(t.count('.'), 4)}", f"a={shape(t[:1])}{shape(t[-1:])}", f"sd={shapes[i]}/{min(digits, 20)}"])
    return out


def labels_of(run: list[tuple[str, int]], spans: list[tuple[int, str, int]]) -> list[str]:
    """B/I/O of the tokens that a span covers in part."""
    out, last = [], None
    for token, start in run:
        span = next((s for s in spans if s[0] < start + len(token) and start < s[2]), None)
        out.append("O" if span is None else f"{'I' if span is last else 'B'}-{span[1]}")
        last = span
    return out


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS) + 1, len(LABELS))))  # last row: from the start

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Feature numbers per token; 0 is any unknown feature and weighs nothing."""
        return np.array([[self.index.get(f, 0) for f in fs] for fs in token_features(tokens)], np.int64)

    def decode(self, many: list[list[str]]) -> list[np.ndarray]:
        """Best labels of many token runs at once (Viterbi over a padded batch)."""
        out: list[np.ndarray] = [None] * len(many)  # type: ignore[list-item]
        order = sorted(range(len(many)), key=lambda i: len(many[i]))
        at = 0
        while at < len(order):
            # Batches of like lengths, with a bounded number of cells.
            size = max(1, min(256, 20_000 // len(many[order[min(len(order) - 1, at + 255)]])))
            batch = order[at:at + size]
            at += size
            lengths = np.array([len(many[i]) for i in batch])
            scores = np.zeros((len(batch), lengths.max(), len(LABELS)))
            for k, i in enumerate(batch):
                scores[k, :lengths[k]] = self.emit[self.rows(many[i])].sum(axis=1)
            best = scores[:, 0] + self.move[-1]
            back = np.zeros(scores.shape, np.int8)
            for t in range(1, scores.shape[1]):
                reach = best[:, :, None] + self.move[None, :-1]
                back[:, t] = reach.argmax(axis=1)
                step = reach.max(axis=1) + scores[:, t]
                best = np.where((t < lengths)[:, None], step, best)
            last = best.argmax(axis=1)
            for k, i in enumerate(batch):
                path = np.zeros(lengths[k], np.int64)
                path[-1] = last[k]
                for t in range(lengths[k] - 1, 0, -1):
                    path[t - 1] = back[k, t, path[t]]
                out[i] = path
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], rounds: int = 8, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Fit to (tokens, labels) runs by AdaGrad on the gradient of the exact log-likelihood."""
    out = Field()
    if not table:
        return out
    for tokens, _ in table:
        for fs in token_features(tokens):
            for f in fs:
                out.index.setdefault(f, len(out.index) + 1)
    n = len(LABELS)
    out.emit = np.zeros((len(out.index) + 1, n))
    seen_emit, seen_move = np.full(out.emit.shape, 1e-8), np.full(out.move.shape, 1e-8)
    runs_ = [(out.rows(tokens), np.array([LABELS.index(x) for x in labels])) for tokens, labels in table]
    random = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for k in random.permutation(len(runs_)):
            rows, gold = runs_[k]
            scores, move = out.emit[rows].sum(axis=1), out.move
            forward, backward = np.zeros_like(scores), np.zeros_like(scores)
            forward[0] = scores[0] + move[-1]
            for t in range(1, len(rows)):
                forward[t] = _log_sum(forward[t - 1][:, None] + move[:-1], 0) + scores[t]
            for t in range(len(rows) - 2, -1, -1):
                backward[t] = _log_sum(move[:-1] + (scores[t + 1] + backward[t + 1])[None], 1)
            whole = _log_sum(forward[-1], 0)
            d_scores = -np.exp(forward + backward - whole)
            d_move = np.zeros_like(move)
            d_move[-1] += d_scores[0]
            d_move[-1, gold[0]] += 1
            for t in range(1, len(rows)):
                d_move[:-1] -= np.exp(forward[t - 1][:, None] + move[:-1] + (scores[t] + backward[t])[None] - whole)
                d_move[gold[t - 1], gold[t]] += 1
            d_scores[np.arange(len(gold)), gold] += 1
            touched, inverse = np.unique(rows, return_inverse=True)
            d_emit = np.zeros((len(touched), n))
            np.add.at(d_emit, inverse.reshape(rows.shape), d_scores[:, None, :])
            d_emit -= ridge * out.emit[touched]
            seen_emit[touched] += d_emit ** 2
            out.emit[touched] += rate * d_emit / np.sqrt(seen_emit[touched])
            d_move -= ridge * move
            seen_move += d_move ** 2
            out.move = move + rate * d_move / np.sqrt(seen_move)
    out.emit[0] = 0
    return out


def without_country(tokens: list[str], labels: list[str]) -> tuple[list[str], list[str]] | None:
    """The run with phone numbers as people write them at home, which no pattern finds: without the country code."""
    out = []
    for i, (token, label) in enumerate(zip(tokens, labels)):
        if label == "B-phone" and re.fullmatch(r"\+[0-9]{1,3}", token) and labels[i + 1:i + 2] == ["I-phone"]:
            continue
        home = label == "I-phone" and i and labels[i - 1] == "B-phone" and (not out or out[-1][0] != tokens[i - 1])
        out.append((token, "B-phone" if home else label))
    return None if len(out) == len(tokens) else ([t for t, _ in out], [x for _, x in out])


def labelled_table(docs: DataFrame, sample_runs: int = 1500, sample_docs: int = 60_000, longest: int = 40) -> list[tuple[list[str], list[str]]]:
    """A bounded table of token runs labelled by the patterns; half of it at least holds a pattern where there are enough."""
    batches(docs.sparkSession)

    def label(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for order, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = runs(text)
                spans = base_spans(text) if found else []
                for k, run in enumerate(found[:20]):
                    labels = labels_of(run, spans)[:longest]
                    tokens = [t for t, _ in run][:longest]
                    out.append((order, k, any(x != "O" for x in labels), tokens, labels))
                    local = without_country(tokens, labels)
                    if local:
                        out.append((order, k, True, *local))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())))], names=["place", "k", "hit", "tokens", "labels"])

    # Training sample only: about `sample_docs` documents by a hash, at most 20 runs of each, so the driver sees a bounded table.
    share = min(1.0, sample_docs / max(1, docs.count()))
    picked = docs.where(sampled(share, "doc_id"))
    telling = picked.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("place"), "text")
    labelled = telling.mapInArrow(label, "place long, k int, hit boolean, tokens array<string>, labels array<string>")
    halves = [labelled.where(F.col("hit") == hit).orderBy("place", "k").limit(sample_runs // 2).collect() for hit in (True, False)]
    return [(r.tokens, r.labels) for half in halves for r in half]


def decoded_spans(text: str, run: list[tuple[str, int]], path: np.ndarray) -> Iterator[tuple[int, str, int]]:
    """Spans of a decoded run, without signs that only end a sentence."""
    i = 0
    while i < len(run):
        label = LABELS[path[i]]
        if label == "O":
            i += 1
            continue
        kind, first = label[2:], i
        i += 1
        while i < len(run) and LABELS[path[i]] == f"I-{kind}":
            i += 1
        start, stop = run[first][1], run[i - 1][1] + len(run[i - 1][0])
        while stop > start + 1 and not text[stop - 1].isalnum():
            stop -= 1
        while start < stop - 1 and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        yield start, f"crf-{kind}", stop


def find(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, spans (kind, start, stop), sorted by start, patterns before decoded spans."""
    batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled table
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            found = [(i, run) for i, t in enumerate(texts) for run in runs(t)] if held.value.index else []
            for (i, run), path in zip(found, held.value.decode([[t for t, _ in run] for _, run in found])):
                base = [s for s in spans[i] if not s[1].startswith("crf")]
                spans[i] += [s for s in decoded_spans(texts[i], run, path) if not any(a < s[2] and s[0] < b for a, _, b in base)]
            rank = {k: n for n, k in enumerate((*KINDS, *(f"crf-{k}" for k in KINDS)))}
            rows = [[{"kind": k, "start": a, "stop": b} for a, k, b in sorted(s, key=lambda x: (x[0], rank[x[1]], x[2]))] for s in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run_all, "doc_id long, spans array<struct<kind: string, start: long, stop: long>>")


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the pattern spans, and all spans as text."""
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: ~s["kind"].startswith("crf-"))
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
