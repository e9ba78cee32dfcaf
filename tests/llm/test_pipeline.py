"""The corpus pipeline's stages against what brute force keeps."""

import re

import numpy as np

import corpus_pipeline
from kerbline.llm import queries
from tests.llm.test_scans import SECRET, low, secrets_expected

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    w = WORD.findall(low(text))
    n = min(5, len(w))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else frozenset([text or ""])


def test_order_and_columns():
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_one_document_of_each_group_stays(spark, small, odd):
    for docs in (small, odd):
        got = STAGES["near_duplicates"](spark, docs, SF)
        assert got.columns == docs.columns
        rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
        group = list(range(len(rows)))
        for _ in range(3):
            for a in range(len(rows)):
                for b in range(a):
                    both = len(rows[a][1] & rows[b][1])
                    if both >= 0.8 * len(rows[a][1] | rows[b][1]) - 1e-9:
                        group[a] = group[b] = min(group[a], group[b])
        first = {}
        for (i, _), g in zip(rows, group):
            first[g] = min(first.get(g, i) if first.get(g, i) is not None else i, i) if i is not None and first.get(g, i) is not None else first.get(g, i)
        assert sorted(map(str, first.values())) == sorted(str(r.doc_id) for r in got.collect())


def test_rows_that_share_an_id_stay_or_go_by_their_own_texts(spark):
    random = np.random.default_rng(6)
    a, b, c, d = ([f"w{k}" for k in random.integers(0, 5000, 60)] for _ in range(4))
    near = lambda t: " ".join([*t[:-1], "other"])
    a, b, c, d, near_a, near_b = *(" ".join(t) for t in (a, b, c, d)), near(a), near(b)
    rows = [(1, a), (None, near_a), (None, d),  # a near copy without an id goes, another row without an id stays
            (2, b), (7, near_b), (7, c),  # one text of id 7 goes, the other stays
            (8, "some words, that differ in punctuation only here"), (8, "Some words that differ in punctuation only: here!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, docs, SF).collect()]
    assert len(got) == 5 and {t for i, t in got if i != 8} == {a, b, c, d}
    assert sorted(str(i) for i, _ in got) == ["1", "2", "7", "8", "None"]


def test_filters_keep_clean_documents(spark, small, odd):
    bench = [WORD.findall(low(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(b[k:k + 10]) for b in bench for k in range(len(b) - 9)}
    want = sorted(str(r.doc_id) for r in small.collect() for w in [WORD.findall(low(r.text))] if not any(tuple(w[k:k + 10]) in grams for k in range(len(w) - 9)))
    assert sorted(str(r.doc_id) for r in STAGES["decontamination"](spark, small, SF).collect()) == want
    kept = STAGES["decontamination"](spark, odd, SF)
    clean = [r.doc_id for r in odd.collect() for w in [WORD.findall(low(r.text))] if not any(tuple(w[k:k + 10]) in grams for k in range(len(w) - 9))]
    assert kept.columns == odd.columns and sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect())
    kept = STAGES["toxicity"](spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_secrets_are_blotted_and_nothing_else(spark, small, odd):
    for docs in (small, odd):
        got = STAGES["secrets"](spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        after = sorted(((str(r.doc_id), r.text, r.n_chars) for r in got.collect()), key=str)
        for (i, text, n), r in zip(after, sorted(docs.collect(), key=lambda r: str((str(r.doc_id), r.text)))):
            if text is not None:
                assert not secrets_expected(text)
            if not secrets_expected(r.text or "") and "[secret]" not in (text or ""):
                assert (text, n) == (r.text, r.n_chars)
    assert SECRET.search("token = abcdef")


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in rows:
        assert len(np.frombuffer(r.ids, "<u2")) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = [sum(n for _, n in by[s]) for s in range(len(by))]
    assert all(n == 1024 for n in sizes[:-1]) and 0 < len({r.doc_id for r in rows}) < 200


def test_stages_take_empty_tables(spark, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
