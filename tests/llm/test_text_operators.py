"""LM scoring, fingerprints, packing, sharding and the Jaccard join against brute force, and on odd tables."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import fingerprints, jaccard, lm_scoring, packing, sharding
from kerbline.llm.common import hash_blank_separated, word_hashes, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def test_words_are_those_of_the_pattern():
    text = "Ab-9 \x7fÉté_x {y} 雪~z\x00q"
    assert [w.decode() for w in words(text.encode())] == WORD.findall(low(text))
    hashes = word_hashes(b"one two one " * 60_000)
    assert len(hashes) == 180_000 and len(set(hashes[::3])) == 1 and hashes[0] == hashes[2] and len(set(hashes)) == 2
    assert hash_blank_separated(b"ab ba")[0] != hash_blank_separated(b"ab ba")[1]


def lm_expected(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return sorted((str(i), held(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 4)) for i, t in rows)


@pytest.mark.parametrize("head_words", [300_000, 5])
def test_lm_base_scores_equal_brute_force(small, odd, head_words):
    for docs in (small.select("doc_id", "text"), odd):
        model = lm_scoring.train(docs.where(~lm_scoring.held_out()))
        got = lm_scoring.score(docs, model, head_words=head_words).collect()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_expected(rows)
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_lm_base_scores_hold_when_no_head_fits(spark):
    docs = spark.createDataFrame([(1, "often " * 100_500 + "once"), (2, "often once never")], "doc_id long, text string")
    model = lm_scoring.train(docs.where("doc_id = 1"))
    train = {"often": 100_500, "once": 1, None: 1}
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in lm_scoring.score(docs, model, head_words=0).collect()}[2]
    want = sum(math.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in ("often", "once", "never", None))
    assert got.n_known == 3 and math.isclose(got.base_score, want, abs_tol=1e-6)


def test_lm_filter_read_back_and_both_ways_alike(small):
    docs = small.select("doc_id", "text")
    model = lm_scoring.train(docs.where(~lm_scoring.held_out()))
    whole = {r.doc_id: r.score for r in lm_scoring.score(docs, model).collect()}
    sharded = {r.doc_id: r.score for r in lm_scoring.score(docs, model, most_bytes=0).collect()}
    assert whole.keys() == sharded.keys() and all(math.isclose(whole[k], sharded[k], rel_tol=1e-9) for k in whole)
    held = [r for r in lm_scoring.score(docs, model).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    random = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    levels = np.arange(10_000) % 9 + 1
    flags = np.zeros(lm_scoring.SEGMENT_BYTES * 8, np.uint8)
    lm_scoring.set_flags(flags, random[:10_000], levels)
    bits = np.packbits(flags, bitorder="little")
    assert (lm_scoring.read_levels(bits, 1, random[:10_000]) >= levels).all()
    assert (lm_scoring.read_levels(bits, 1, random[10_000:]) > 0).mean() < 0.01
    assert abs(lm_scoring.distinct_pairs(sorted(map(int, random * np.uint64(2)))[:lm_scoring.SKETCH]) / 20_000 - 1) < 0.15


@pytest.mark.parametrize("copies", [1, 20])
def test_lm_filter_is_sized_by_the_levels_of_the_corpus(spark, copies):
    random = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{k}" for k in random.integers(0, 3000, 600))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").crossJoin(spark.range(copies).select()).repartition(4)
    model = lm_scoring.train(docs)
    bits = np.concatenate([np.frombuffer(r.bits, np.uint8) for r in model.table.collect()])
    assert len(bits) == model.segments * lm_scoring.SEGMENT_BYTES
    # 1 - exp(-6 / 12) = 0.39 of all bits when every entry has its 12.
    assert np.unpackbits(bits).mean() < 0.43
    unseen = random.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    stored = np.zeros(model.segments * lm_scoring.SEGMENT_BYTES, np.uint8)
    for r in model.table.collect():
        stored[r.segment * lm_scoring.SEGMENT_BYTES:(r.segment + 1) * lm_scoring.SEGMENT_BYTES] = np.frombuffer(r.bits, np.uint8)
    assert (lm_scoring.read_levels(stored, model.segments, unseen) > 0).mean() < 0.01
    # The sketch holds whole counts: its pairs have those of all pairs counted.
    counted = lambda of_pairs, kind: {r.hash: r.c for r in lm_scoring.ngram_counts(docs, of_pairs, stretch=50_000).where(f"kind = {kind}").groupBy("hash").agg(F.sum("c").alias("c")).collect()}
    every, sketch = counted(True, 1), counted(False, 2)
    smallest = sorted(sketch, key=lambda h: h % (1 << 64))[:lm_scoring.SKETCH]
    assert smallest == sorted(every, key=lambda h: h % (1 << 64))[:lm_scoring.SKETCH] and all(sketch[h] == every[h] for h in smallest)


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = WORD.findall(low(t))
        n = min(5, len(w))
        out.append((i, frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else frozenset([t or ""])))
    return out


def jaccard_expected(rows):
    sets = shingle_sets(rows)
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both >= 0.8 * len(sets[a][1] | sets[b][1]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    first = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted((str(i), str(first[find(k)]), links[k]) for k, (i, _) in enumerate(sets))


def test_jaccard_join_equals_all_pairs(spark, small, odd):
    near = [(f"w{k} " * 1).strip() for k in range(60)]
    copies = [(1000 + k, " ".join(near[:k % 12 + 40] + [f"x{k % 5}"])) for k in range(60)]  # one dense group over several blocks
    for docs, block in ((small.select("doc_id", "text"), 200), (odd, 200), (spark.createDataFrame(copies, "doc_id long, text string"), 8)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.join(docs, block=block).collect()) == jaccard_expected(rows)


def test_band_plan_reaches_the_recall():
    for rows in (3, 4, 5, 8):
        b = jaccard.plan_bands(rows=rows)
        assert (1 - 0.8 ** rows) ** b <= 1e-4 < (1 - 0.8 ** rows) ** (b - 1)


def widths(n):
    """The grid of a text of n code points by its table: k from the length, w from the number of k-grams."""
    k = 4 if n < 32 else 8 if n < 64 else 16
    g = max(0, n - k + 1)
    return k, max([w for w in (1, 2, 4, 8, 16, 32, 64) if 8 * w <= g], default=1)


@functools.cache
def winnowed(text, gram, window):
    """Windows one by one; the hash of a gram is taken from a text of just that gram."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(codes) <= gram:
        return fingerprints.winnow(codes, gram, window)
    hashes = [int(fingerprints.winnow(codes[i:i + gram], gram, 1)[0][0]) for i in range(len(codes) - gram + 1)]
    chosen = {}
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i:i + window]
        least = min(part)
        k = max(j for j, h in enumerate(part) if h == least)
        chosen[i + k] = hashes[i + k]
    return np.array([chosen[k] for k in sorted(chosen)], "<u4"), np.array(sorted(chosen), "<u4")


def likeness_of(a, b):
    """On the grid of the longer text."""
    a, b = (set(winnowed(t, *widths(max(len(a), len(b))))[0].tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_bytes", [8_000_000, 2_000])
def test_fingerprints_equal_windows_one_by_one(spark, small, odd, range_bytes):
    for docs in (small.where("n_chars < 1500").select("doc_id", "text"), odd.where("n_chars < 1000")):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for k, (i, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            quarter = len(text) // 4
            changed = text[:len(text) - quarter] + after[:quarter]
            a, b = (winnowed(t, *widths(len(t))) for t in (text, changed))
            want.append((str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.shown(*a), fingerprints.shown(*b), likeness_of(text, changed), likeness_of(text, after)))
        got = fingerprints.fingerprint(docs, range_bytes=range_bytes).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_a_long_shared_passage_leaves_a_common_fingerprint():
    random = np.random.default_rng(3)
    passage = random.integers(97, 123, fingerprints.GRAM + fingerprints.WINDOW - 1, dtype=np.uint32)
    for _ in range(20):
        a, b = (np.concatenate([random.integers(97, 123, 200, dtype=np.uint32), passage, random.integers(97, 123, 90, dtype=np.uint32)]) for _ in "ab")
        assert set(fingerprints.winnow(a)[0]) & set(fingerprints.winnow(b)[0])


def test_short_texts_have_graded_likeness(spark):
    random = np.random.default_rng(11)
    texts = ["".join(map(chr, random.integers(97, 123, n))) for n in (*range(12, 700, 8), 5000)]
    got = sorted(fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for text, r in zip(texts, got[:-1]):  # three quarters are shared, but for what spans the seam
        assert (0.3 if len(text) >= 40 else 0.1) < r.near_edited < 1 and r.near_next < 0.1, (len(text), r.near_edited, r.near_next)


def test_a_passage_is_found_between_texts_of_different_length():
    random = np.random.default_rng(4)
    passage = random.integers(97, 123, fingerprints.GRAM + fingerprints.WINDOW - 1, dtype=np.uint32)
    for short in (0, 1, 30, 200, 400):
        a, b = (np.concatenate([passage, random.integers(97, 123, n, dtype=np.uint32)]) for n in (short, 3000))
        assert set(fingerprints.winnow(a, *fingerprints.grid(len(a)))[0]) & set(fingerprints.winnow(b, *fingerprints.grid(len(b)))[0])


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_the_tokenizer():
    hard = ["", " ", "  a", " a b", "a  b   c    d", "x\n y", "x \n\n  y\t z ", "don't we'll  I'm", "a  b 　c", "é   ü", "<|endoftext|> 12 345", "tab\t\tx  \n", "\x1c a\x85 b", "a " * 50]
    encode = packing.PieceEncoder(packing.default_vocabulary())
    for text, ids in zip(hard, encoded(hard)):
        assert np.frombuffer(encode(text), "<u2").tolist() == ids, repr(text)


def test_added_tokens_in_a_text_are_those_of_the_tokenizer_at_its_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f" {end}  x", f"a{end}b", f"{end} a  {end}\n c ", f"<|endoftext| {end}|>", f"a {end[:-1]} b", "a  b", "", f"é {end} 雪 don't"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {p.doc_id: np.frombuffer(p.ids, "<u2").tolist() for p in pieces} == {i: ids + [packing.END_ID] for i, ids in enumerate(want)}
    assert all(p.ids_crc32 == zlib.crc32(np.array([*want[p.doc_id], packing.END_ID], "<u4").tobytes()) for p in pieces)


def test_packing_is_an_exact_round_trip(small, odd, none):
    for docs in (small.select("doc_id", "text"), odd):
        pieces = packing.pack(docs).collect()
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        streams = collections.defaultdict(dict)
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u2")
            assert len(ids) == p.length > 0 and p.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and p.offset + p.length <= 1024
            streams[p.sequence_id][p.offset] = p
        sizes = []
        for s in range(len(streams)):
            at = 0
            for offset in sorted(streams[s]):
                assert offset == at
                at += streams[s][offset].length
            sizes.append(at)
        assert all(n == 1024 for n in sizes[:-1])
        rebuilt, ids = [], []
        for s in range(len(streams)):
            for offset in sorted(streams[s]):
                p = streams[s][offset]
                assert p.start == len(ids)
                ids += np.frombuffer(p.ids, "<u2").tolist()
                if len(ids) == p.doc_tokens:
                    rebuilt.append((str(p.doc_id), ids))
                    ids = []
        assert not ids and sorted(rebuilt) == sorted((str(i), e + [0]) for (i, _), e in zip(rows, encoded([t for _, t in rows])))
    assert packing.pack(none).count() == 0


def test_shards_are_near_equal_gapless_and_keep_copies_together(spark, small, odd, none):
    docs = small.select("doc_id", "text")
    hot = spark.range(3000).selectExpr("10000 + id as doc_id", "'the same text in a third of all rows' as text")
    for table in (docs.unionByName(hot), odd):
        placed = sharding.with_slots(sharding.kd_shards(table, 40), rows_per_part=7).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in placed) == want
        by = collections.defaultdict(list)
        for r in placed:
            by[r.shard].append(r.slot)
        assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    placed = sharding.kd_shards(docs.unionByName(hot), 8).collect()
    sizes, where = collections.Counter(), collections.defaultdict(set)
    for r in placed:
        sizes[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.2 * mean
    copies = [len(w) for crc, w in where.items() if crc != zlib.crc32(b"the same text in a third of all rows")]
    assert sum(n > 1 for n in copies) <= 7  # only a cut through a group parts copies
    assert sharding.with_slots(sharding.kd_shards(none)).count() == 0


def test_empty_tables(none):
    model = lm_scoring.train(none)
    assert lm_scoring.score(none, model).count() == 0
    assert jaccard.join(none).count() == 0 and fingerprints.fingerprint(none).count() == 0


def test_rows_without_ids_link_by_their_texts(spark):
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for i in range(150):
        own = words[i * 25:i * 25 + 60]
        texts += [" ".join(own), " ".join([*own[:-1], "other"])]
    far = [t.replace("w", f"v{i // 2}x") for i, t in enumerate(texts)]
    with_ids = spark.createDataFrame([(i, t) for i, t in enumerate(far)], "doc_id long, text string").repartition(4)
    without = with_ids.withColumn("doc_id", F.lit(None).cast("long"))
    links = [sorted(r.n_links for r in jaccard.join(df).collect()) for df in (with_ids, without, with_ids.withColumn("doc_id", F.lit(7).cast("long")))]
    assert links[0] == links[1] == links[2] == [1] * 300
    assert jaccard.classes(without).select("class_node").distinct().count() == 150
