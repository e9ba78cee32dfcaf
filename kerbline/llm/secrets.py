"""Secret scan with DataFrame functions alone: exact patterns, and a battery of randomness tests for other tokens.

Candidates are runs of at least `LEAST` letters, digits and + / _ -. The smallest alphabet that holds a candidate is its
inferred encoding. Three tests ask whether it could be uniform over that alphabet: chi-squared of the symbol counts
(Wilson-Hilferty), runs above and below the alphabet's middle (Wald-Wolfowitz), and lag-1 serial correlation. A candidate
is kept when the smallest p-value, times three, stays above `ALPHA`.

The tests alone say little about short tokens. Length enters through the evidence against ordinary text: the sum over
symbols of log(uniform / share of the symbol in all texts), which bounds the chance of such a token in ordinary text by
exp(-evidence) (Markov). Shares are counted over all documents. Benjamini-Hochberg at rate `RATE` within each class of
length (doubling) and encoding turns the evidence of all candidates into a threshold per class; the driver sees only the
counts per class and whole evidence.

Positions. Spark finds matches but not where; a text is split at the matches and the lengths are summed. Texts never
move; two passes read them (shares and thresholds, then spans).

Defined results. Null and empty texts have no spans. Repeated rows are scanned alike. A class without candidates has no
threshold and no spans. Extra columns stay out of `report` and in `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import lower_ascii

KINDS = ("assign", "access", "hex", "random")
# The patterns. The letters of the name alone match in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is one match however long it must be
HEX = r"[0-9a-f]{24,}"
LEAST, RATE, ALPHA = 20, 0.01, 0.001
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets from small to large: the first that holds a token is its encoding.
ENCODINGS = (
    ("decimal", "[0-9]", _DIGITS), ("hex", "[0-9a-f]", _DIGITS + _LOW[:6]), ("hex-upper", "[0-9A-F]", _DIGITS + _UP[:6]),
    ("base32", "[A-Z2-7]", _UP + "234567"), ("upper", "[0-9A-Z]", _DIGITS + _UP), ("lower", "[0-9a-z]", _DIGITS + _LOW),
    ("alnum", "[0-9A-Za-z]", _DIGITS + _UP + _LOW), ("base64", "[0-9A-Za-z+/]", _UP + _LOW + _DIGITS + "+/"), ("base64-url", "[0-9A-Za-z+/_-]", _UP + _LOW + _DIGITS + "-_+/"),
)
SPAN = "array<struct<start: long, rank: int, stop: long, token: string>>"


def _let(value: Column, body):
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(text: Column, pattern: str, rank: int, shown: int = 0) -> Column:
    """Matches of a pattern in order: start and stop in code points, and the text of group `shown`."""
    def spans(parts):
        hits, pieces, groups = parts["hits"], parts["pieces"], parts["groups"]
        step = lambda a, i: F.struct(
            (a["at"] + F.length(F.get(pieces, i)) + F.length(F.get(hits, i))).cast("long").alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(F.get(pieces, i))).cast("long").alias("start"), F.lit(rank).alias("rank"),
                (a["at"] + F.length(F.get(pieces, i)) + F.length(F.get(hits, i))).cast("long").alias("stop"), F.get(groups, i).alias("token")))).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(shown)).alias("groups"))
    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The patterns' spans, by start and then kind."""
    assigned = F.filter(placed(text, ASSIGN, 0, 2), lambda s: F.length(s["token"]) >= 6)
    return F.concat(assigned, placed(text, ACCESS, 1), placed(text, HEX, 2))


def _tail(z: Column) -> Column:
    """Two-sided normal p-value (a rational approximation, good to 1e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def encoded(token: Column) -> Column:
    """Struct with the encoding's number, its alphabet, and the token's symbols as numbers."""
    number, alphabet = F.lit(len(ENCODINGS) - 1), F.lit(ENCODINGS[-1][2])
    for i, (_, symbols, letters) in reversed(list(enumerate(ENCODINGS[:-1]))):
        holds = token.rlike(f"^{symbols}+$")
        number, alphabet = F.when(holds, F.lit(i)).otherwise(number), F.when(holds, F.lit(letters)).otherwise(alphabet)
    return F.struct(number.alias("encoding"), alphabet.alias("alphabet"), F.regexp_extract_all(token, F.lit("."), F.lit(0)).alias("chars"))


def battery(indexes: Column, size: Column) -> Column:
    """Smallest p-value of the three tests, times three."""
    n = F.size(indexes).cast("double")
    squares = F.aggregate(F.array_distinct(indexes), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(indexes, lambda x: x == v)).cast("double"), 2.0))
    free = size - 1
    chi = size / n * squares - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    rest = F.slice(indexes, F.lit(2), F.size(indexes) - 1)
    first = F.slice(indexes, F.lit(1), F.size(indexes) - 1)
    high = F.aggregate(indexes, F.lit(0.0), lambda a, v: a + (v >= size / 2).cast("double"))
    low = n - high
    n_runs = 1 + F.aggregate(F.zip_with(first, rest, lambda a, b: ((a >= size / 2) != (b >= size / 2)).cast("double")), F.lit(0.0), lambda a, v: a + v)
    mean_runs = 2 * high * low / n + 1
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
    p_runs = F.when((high > 0) & (low > 0), _tail((n_runs - mean_runs) / F.sqrt(var_runs))).otherwise(F.pow(F.lit(2.0), 1 - n))
    total = F.aggregate(indexes, F.lit(0.0), lambda a, v: a + v)
    spread = F.aggregate(indexes, F.lit(0.0), lambda a, v: a + v * v) - total * total / n
    products = F.aggregate(F.zip_with(first, rest, lambda a, b: (a - total / n) * (b - total / n)), F.lit(0.0), lambda a, v: a + v)
    p_serial = F.when(spread > 0, _tail((products / spread + 1 / n) * F.sqrt(n))).otherwise(0.0)
    # Too even counts are no sign against a secret; only an excess counts.
    p_chi = F.when(z_chi > 0, _tail(z_chi)).otherwise(1.0)
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def symbol_shares(docs: DataFrame) -> dict[str, float]:
    """Share of each letter (cases together), digit and sign among all of them in all texts, add-one smoothed."""
    symbols = _LOW + _DIGITS + "+/_-"
    low = lower_ascii(F.col("text"))
    sums = docs.agg(*[F.sum(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).alias(f"s{i}") for i, c in enumerate(symbols)]).first()
    counts = {c: (sums[f"s{i}"] or 0) + 1 for i, c in enumerate(symbols)}
    total = sum(counts.values())
    return {c: n / total for c, n in counts.items()}


def tested(text: Column, shares: dict[str, float]) -> Column:
    """Candidates with start, stop, class of length and encoding, evidence and the battery's p-value."""
    # log(uniform / share) per symbol; where both cases occur a letter's share is halved, so case is no evidence.
    single = F.create_map(*[F.lit(x) for c, p in shares.items() for u in {c, c.upper()} for x in (u, math.log(p))])

    def with_numbers(s):
        def of(e):
            size = F.length(e["alphabet"]).cast("double")
            both_cases = e["encoding"] >= 6
            evidence = F.aggregate(e["chars"], F.lit(0.0), lambda a, c: a - F.log(size) - F.try_element_at(single, c) + F.when(both_cases & c.rlike("[A-Za-z]"), math.log(2)).otherwise(0.0))
            indexes = F.transform(e["chars"], lambda c: (F.position(c, e["alphabet"]) - 1).cast("double"))
            return F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"), (F.floor(F.log2(F.length(s["token"]).cast("double"))) * 16 + e["encoding"]).cast("int").alias("group"),
                evidence.alias("evidence"), _let(indexes, lambda x: battery(x, size)).alias("p"))
        return _let(encoded(s["token"]), of)

    return F.transform(placed(text, CANDIDATE, 3), with_numbers)


def thresholds(docs: DataFrame, shares: dict[str, float], rate: float = RATE, most: int = 400) -> dict[int, int]:
    """Least whole evidence per class by Benjamini-Hochberg over all candidates."""
    rows = docs.select(F.explode(tested(F.col("text"), shares)).alias("c")).select("c.group", F.least(F.greatest(F.floor("c.evidence"), F.lit(-1)), F.lit(most)).cast("int").alias("evidence"))
    by_group: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("group", "evidence").count().collect():
        by_group.setdefault(r.group, []).append((r.evidence, r["count"]))
    out = {}
    for group, counts in by_group.items():
        m, above = sum(n for _, n in counts), 0
        for evidence, n in sorted(counts, reverse=True):
            above += n
            # The k-th smallest bound may be at most k * rate / m.
            if evidence >= 0 and math.exp(-evidence) <= above * rate / m:
                out[group] = evidence
    return out


def find_spans(docs: DataFrame, into: str = "_kerbline_spans") -> DataFrame:
    """`docs` with an array of spans (start, rank of the kind, stop), by start and then kind."""
    texts = docs.select("text")
    shares = symbol_shares(texts)
    least = thresholds(texts, shares)
    text = F.coalesce("text", F.lit(""))
    chosen = lambda c: _passes(c, least) & (c["p"] >= ALPHA)
    kind = "array<struct<start: long, rank: int, stop: long>>"
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"], s["rank"], s["stop"]))
    out = docs.withColumn("_kerbline_base", base.cast(kind)).withColumn("_kerbline_tested", F.filter(tested(text, shares), chosen))
    fresh = F.filter("_kerbline_tested", lambda c: ~F.exists("_kerbline_base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    added = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["stop"].alias("stop"))).cast(kind)
    return out.withColumn(into, F.array_sort(F.concat("_kerbline_base", added))).drop("_kerbline_base", "_kerbline_tested")


def _passes(c: Column, least: dict[int, int]) -> Column:
    out = F.lit(False)
    for group, evidence in sorted(least.items()):
        out = out | ((c["group"] == group) & (c["evidence"] >= evidence))
    return out


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the pattern spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))))
    n = lambda rank: F.size(F.filter("_kerbline_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(shown(F.filter("_kerbline_spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), shown(F.col("_kerbline_spans")).alias("spans"))


def redact(found: DataFrame, marker: str = "[secret]") -> DataFrame:
    """Texts with every span replaced by a marker; overlapping spans share one."""
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, s: F.when(s["stop"] <= a["at"], a).when(
        s["start"] < a["at"], F.struct(a["out"].alias("out"), s["stop"].alias("at"))).otherwise(F.struct(
            F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(marker)).alias("out"), s["stop"].alias("at")))
    new = F.aggregate("_kerbline_spans", start, cut, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn("text", F.when(F.size("_kerbline_spans") > 0, new).otherwise(text)).drop("_kerbline_spans")
