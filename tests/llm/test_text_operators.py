"""Deduplication, packing, mixing and classifiers against brute force, and on odd inputs."""

from __future__ import annotations

import array
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.llm import graphs, mixing, neardup, packing, quality, repeats, toxicity

from .conftest import prose

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ------------------------------------------------------------------------------------------------ near duplicates


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return [(d, len(s), best.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.choice((4, 40, 150, 300))).split()
        for _ in range(rng.choice((1, 2, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = rng.choice(("X", "y", "Zz"))
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows = list({d: (d, t) for d, t in rows}.values())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_a_large_family_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(neardup, "KEY_LIMIT", 8)
    rng = random.Random(6)
    base = prose(rng, 100).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_components_of_long_chains(spark):
    rng = random.Random(12)
    names = [rng.randrange(-(2**62), 2**62) for _ in range(2600)]
    edges = [(names[i], names[i + 1]) for i in range(1199)] + [(names[i], names[i + k]) for i in range(1200, 2297) for k in (1, 2, 3)]
    edges += [(i, i + 1) for i in range(1500)] + [(names[2300], names[i]) for i in range(2301, 2600)] + [(7, 7), (names[0], names[0])] + [(names[1], names[0])]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = [names[:1200], names[1200:2300], list(range(1501)), names[2300:]]
    assert got == {x: min(g) for g in groups for x in g}
    assert graphs.connected_components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graphs.connected_components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)


def test_a_long_drift_chain_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 96)
    rng = random.Random(13)
    words = [f"{w}{i}" for i, w in enumerate(rng.choices(("a", "b", "c"), k=1100 * 2 + 120))]
    rows = [(i, " ".join(words[2 * i : 2 * i + 120])) for i in range(1100)]
    # texts i and i + 4 share 108 of 124 shingles
    assert len(shingles(rows[0][1]) & shingles(rows[4][1])) * 100 >= 85 * len(shingles(rows[0][1]) | shingles(rows[4][1]))
    rng.shuffle(rows)
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == 1100 and {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_near_duplicates_on_odd_rows(spark, odd_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[2] == {(1, False)} and by[1] == {(1, True)} and by[8] == {(7, False)} and by[4] == {(4, True)} and by[5] == {(5, True)} and by[6] == {(6, True)}
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_rows_are_kept_by_row_not_by_id(spark):
    rng = random.Random(14)
    texts = [prose(rng, 150) for _ in range(9)]
    near = [t + " tail" for t in texts]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (6, near[4]), (7, near[0])]
    rows += [(None, texts[5]), (None, near[5]), (8, texts[6]), (8, near[6]), (9, texts[7]), (3, near[7]), (9, texts[8]), (None, None), (None, ""), (None, " "), (4, None), (4, None), (4, "")]
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(table(spark, rows)).collect())
    either = [{(None, texts[5]), (None, near[5])}, {(8, texts[6]), (8, near[6])}]  # the key decides
    assert all(sum(got.pop(x, 0) for x in pair) == 1 for pair in either)
    want = [(7, near[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (3, near[7]), (9, texts[8])]
    assert got == Counter(want + rows[-6:])
    found = neardup.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in found if r.n_shingles))) == sorted(str(x) for x in brute_components(rows) if x[1])


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    s = rng.integers(1, 2**63, 1200, dtype=np.uint64)
    a, b = s[:1100], s[100:]  # similarity 1000 / 1200
    x, y = (np.frombuffer(neardup.odd_sketch(neardup.min_hashes(np.sort(v))), np.uint64) for v in (a, b))
    xor = int(np.bitwise_count(x ^ y).sum())
    assert neardup.largest_xor(0.95) < xor < neardup.largest_xor(0.70)


# --------------------------------------------------------------------------------------------------- repeated bytes


def brute_kept(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield b, gone, bytes(c for c, g in zip(b, gone, strict=True) if not g)


def brute_repeats(texts, length):
    return [(len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()) for b, gone, kept in brute_kept(texts, length)]


def repeat_texts():
    rng = random.Random(8)
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [prose(rng, 50) for _ in range(6)]
    for i in range(30):
        a, b = rng.choice(shared), rng.choice(shared)
        cut = rng.randrange(40)
        texts.append(prose(rng, 20) + " " + a[cut:] + f" {i} " + b + prose(rng, 10))
    return [*texts, "ab" * 400, "q" * 700, "short", "", None, texts[0], texts[0], "ü" * 230]


@pytest.mark.parametrize("limit", (1, 2, 16, 1024))
def test_repeats_match_brute_force(spark, limit):
    texts = repeat_texts()
    rows = list(enumerate(texts))
    got = repeats.drop_repeats(table(spark, rows), shard_strings=limit).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts, 200)


def test_parts_of_long_texts_join(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    texts = repeat_texts()
    parts = repeats.parts_of([(t or "").encode() for t in texts], 200)
    assert sum(len(p) - 199 for p in parts[2]) == sum(max(0, len((t or "").encode()) - 199) for t in texts)


def test_run_length_index_has_the_matching_statistics():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(20)] + [b"abab" * 6, b"abab" * 6]
    index = repeats.RunLengthIndex(strings, 64)
    assert len(index.run_symbol) < len(index.symbols) and index.run_length.sum() == len(index.symbols)
    got = index.matching_statistics()
    every = [s[i:] for s in strings for i in range(len(s))]
    at = 0
    for k, s in enumerate(strings):
        for i in range(len(s)):
            others = [t[j:] for q, t in enumerate(strings) for j in range(len(t)) if (q, j) != (k, i)]
            want = max((next((n for n, (x, y) in enumerate(zip(s[i:], o)) if x != y), min(len(s) - i, len(o))) for o in others), default=0)
            assert got[index.starts[k] + i] == want
            at += 1
    assert at == len(every)


def test_repeats_on_odd_rows(spark, odd_docs):
    got = repeats.drop_repeats(odd_docs)
    assert got.count() == odd_docs.count() and got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    texts = [r.text for r in odd_docs.collect()]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(brute_repeats(texts, 200))
    kept = repeats.keep_unrepeated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    r = {x.doc_id: x for x in kept.collect()}
    assert r[4].text is None and r[7].text == "one two" and r[1].text == "" and r[1].n_chars == 0 and r[1].kept == 7
    assert repeats.drop_repeats(odd_docs.limit(0)).count() == 0


# ----------------------------------------------------------------------------------------------------------- packing


def encoder():
    return packing.encoder(packing._vocabulary(None))


def test_cached_encoding_equals_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = encoder()
    alphabet = st.sampled_from(list("abcXYZ019 .,!?'\n\t-_éÜßñçÖ’“—İıſΣσ中文😀\u00a0\u0085\u0301\u200b\x1c<|>")) | st.characters(codec="utf-8")

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=60))
    def same(text):
        assert e.encode(text) == e.whole(text)

    same()
    for text in ("it's <|endoftext|> we'll", "naïve CAFÉ", " a  b ", "\x00"):
        assert e.encode(text) == e.whole(text)


def check_packing(rows, docs, capacity):
    e, ids = encoder(), {}
    for d, t in docs:
        ids.setdefault(d, []).append(e.encode(t or "") + array.array("I", [0]).tobytes())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d, texts in ids.items():
        want = Counter((i, i * capacity, min(capacity, len(b) // 4 - i * capacity), zlib.crc32(b[4 * i * capacity : 4 * (i + 1) * capacity])) for b in texts for i in range(-(-len(b) // (4 * capacity))))
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d]) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_places_every_piece(spark, odd_docs):
    for capacity in (64, 2048):
        rows = packing.pack(odd_docs, capacity=capacity).collect()
        used, least = check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], capacity)
        assert used <= least + 1
    assert packing.pack(odd_docs.limit(0)).count() == 0
    rows = packing.pack(odd_docs, with_ids=True).where("doc_id = 7").collect()
    assert array.array("I", rows[0].ids).tobytes() == encoder().encode("one two") + bytes(4)


def test_plans_of_few_pieces_are_optimal():
    rng = random.Random(15)

    def least(pieces, capacity):
        best = [len(pieces)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(pieces):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + pieces[i] <= capacity:
                    go(i + 1, bins[:j] + [bins[j] + pieces[i]] + bins[j + 1 :])
            go(i + 1, [*bins, pieces[i]])

        go(0, [])
        return best[0]

    for _ in range(150):
        pieces = sorted((rng.randrange(5, 60) for _ in range(rng.randrange(1, 10))), reverse=True)
        counts = np.zeros(101, np.int64)
        for x in pieces:
            counts[x] += 1
        assert sum(t for _, t in packing.plan_packing(counts, 100)) == least(pieces, 100)


def test_dominance_matches_exhaustive_dealing():
    rng = random.Random(8)

    def fits(rooms, pieces):
        if not pieces:
            return True
        return any(r >= pieces[0] and fits(rooms[:i] + [r - pieces[0]] + rooms[i + 1 :], pieces[1:]) for i, r in enumerate(rooms))

    for _ in range(2000):
        a = tuple(rng.randrange(1, 20) for _ in range(rng.randrange(0, 4)))
        b = tuple(rng.randrange(1, 12) for _ in range(rng.randrange(0, 6)))
        got, right = packing.dominates(a, b), fits(list(a), list(b))
        assert got == right if len(a) <= 2 else not got or right, (a, b)


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(4)
    for _ in range(15):
        counts = np.zeros(101, np.int64)
        for x in rng.integers(1, 101, 300):
            counts[x] += 1
        plan = packing.plan_packing(counts, 100)
        used = np.zeros(101, np.int64)
        for filling, times in plan:
            assert sum(n * k for n, k in filling) <= 100
            for n, k in filling:
                used[n] += k * times
        bins, first = sum(t for _, t in plan), sum(t for _, t in packing.best_fit(counts, 100))
        assert (used == counts).all() and packing.lower_bound(counts, 100) <= bins <= first
    exact = np.zeros(101, np.int64)
    exact[[60, 40, 35, 65, 30, 33, 37]] = 7
    assert sum(t for _, t in packing.plan_packing(exact, 100)) == packing.lower_bound(exact, 100) == 21


# ------------------------------------------------------------------------------------------------------------ mixing


def test_mix_meets_its_targets(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    total, taken, by = sum(r.size for r in rows), sum(r.taken for r in rows), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[(r.source_size, r.target)] = by.get((r.source_size, r.target), 0) + r.taken
    for (size, target), got in by.items():
        assert abs(got - target) <= 0.5 and target <= 3 * size
    assert abs(taken - total) <= 4
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd_docs.repartition(3)).collect()), key=str)  # reruns agree
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_null_ids_of_equal_size_are_ordered_by_text(spark):
    rows = [(None, f"w{i} x y", "a") for i in range(40)] + [(i, "one two three four", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.apply_mix(d, weights=(1.0, 9.0)).collect())) for d in (df, df.repartition(7).orderBy(F.desc("text"))))
    assert a == b


def test_applied_mix_has_the_words_taken(spark, odd_docs):
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    words = out.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    taken = mixing.mix(odd_docs, carry=True).groupBy(F.col("__row.source").alias("source")).agg(F.sum("taken").alias("n")).collect()
    assert {r.source: r.n for r in words} == {r.source: r.n for r in taken if r.n}


# ------------------------------------------------------------------------------------------------------- classifiers


def labelled(spark, n=600):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.15
        w = prose(rng, rng.randrange(30, 150)).split()
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(("vilething", "vileword", "nastyone")) for _ in range(3)]
        text = " ".join(w)
        docs.append((i, text if good else (text + "!! ") .upper() * 2))
        labels.append((i, int(good), int(toxic)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("column,low", (("quality", 0.95), ("toxic", 0.95)))
def test_classifiers_on_held_out_rows(spark, column, low):
    docs, labels = labelled(spark)
    if column == "quality":
        scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    else:
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 150 and sum(r.predicted == r[column] for r in out) / len(out) > low


def test_classifiers_on_odd_rows(spark, odd_docs):
    docs, labels = labelled(spark, 300)
    for scored in (quality.score_quality(odd_docs, quality.fit_quality(docs, labels)), toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(docs, labels), carry=True)):
        rows = scored.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert quality.score_quality(odd_docs, quality.fit_quality(docs, none)).count() == odd_docs.count()
    kept = toxicity.drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality.score_quality(odd_docs.limit(0), quality.fit_quality(docs, labels)).count() == 0


def brute_segments(scores):
    """The recursive definition: the best segment, then the same on both sides."""
    before = np.concatenate([[0.0], np.cumsum(scores)])

    def best(lo, hi):
        if lo >= hi:
            return []
        total, a, b = max((before[b + 1] - before[a], a, b) for a in range(lo, hi) for b in range(a, hi))
        return [*best(lo, a), (a, b, total), *best(b + 1, hi)] if total > 0 else []

    return best(0, len(scores))


def test_maximal_segments_match_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        scores = [-1.0 if rng.random() < 0.6 else rng.uniform(0.1, 3.0) for _ in range(14)]
        where = np.array([i for i, s in enumerate(scores) if s > 0], int)
        got = toxicity.maximal_segments(where, np.array([scores[i] for i in where]), -1.0)
        want = brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity_scores_match_brute_force(spark):
    docs, labels = labelled(spark, 400)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    rows = docs.where("doc_id < 60").collect()
    for r, (_, _, h) in zip(rows, toxicity.tokens([r.text for r in rows]), strict=True):
        dense = np.full(h.shape[1], model.drift)
        where, score = model.hits(h)
        dense[where] = score
        chance = np.log(max(model.k * len(dense), 1e-9))
        evidence = sum(x for x in (model.rate * s - chance for *_, s in brute_segments(dense)) if x >= -np.log(toxicity.SIGNIFICANT))
        want = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * np.log1p(evidence), -30, 30)))
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == int(want >= 0.7)


def test_classifiers_learn_from_every_labelled_row(spark):
    # a sign of 1 in 30 bad or toxic rows, in more rows than samples of a class had
    n = 14_000
    rows = spark.range(n).withColumn("bad", F.col("id") % 2 == 0).withColumn("rare", F.col("bad") & (F.col("id") % 60 == 0))
    text = F.concat(F.lit("some words of plain text that say little about "), F.col("id").cast("string"), F.when(F.col("rare"), " vileword").otherwise(""))
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = rows.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), 0).otherwise(1).alias("quality"), F.when(F.col("rare"), 1).otherwise(0).alias("toxic"))
    seen = []
    fit = quality.BradleyTerry.fit
    try:
        quality.BradleyTerry.fit = lambda self, rows: seen.append(dict(rows.groupBy("y").count().collect())) or fit(self, rows)
        quality.fit_quality(docs, labels)
        curve = toxicity.ToxicSegments.fit_curve
        toxicity.ToxicSegments.fit_curve = lambda self, x, y, weight: seen.append({c: int(weight[y == c].sum()) for c in (0, 1)}) or curve(self, x, y, weight)
        toxicity.fit_toxicity(docs, labels)
    finally:
        quality.BradleyTerry.fit, toxicity.ToxicSegments.fit_curve = fit, curve
    mine = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0] == {0: sum(i % 2 == 0 for i in mine), 1: sum(i % 2 for i in mine)} and min(seen[0].values()) > 4000
    assert seen[1] == {0: sum(i % 60 > 0 for i in mine), 1: sum(i % 60 == 0 for i in mine)} and seen[1][0] > 8000


def test_token_texts_have_the_hashes_of_the_whole():
    texts = [None, "", " 12 !", "One one ONE; two-two é éé É\n3x x", "a " * 500, "inflected inflection Inflect"]
    short = toxicity.token_texts(texts)
    for (_, _, whole), (_, _, cut) in zip(toxicity.tokens(texts), toxicity.tokens(short), strict=True):
        assert set(whole[whole > 0]) == set(cut[cut > 0]) and cut.shape[1] == len(set(whole[0]))
    assert short[3:] == ["One two é éé É x", "a", "inflected inflection Inflect"]


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("fit,most", ((quality.fit_quality, 0.15), (toxicity.fit_toxicity, 0.25)))
def test_classifiers_do_not_shuffle_whole_texts(spark, fit, most):
    # labels too many to broadcast, texts that repeat their words
    rng = random.Random(12)
    docs = table(spark, [(i, prose(rng, 6000) + " vileword" * (i % 7 == 0)) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        fit(docs, labels)
        assert shuffled(spark) - before < most * docs.agg(F.sum(F.length("text"))).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_sums_by_level_stand_for_all_pairs(spark):
    docs, labels = labelled(spark, 300)
    model = quality.fit_quality(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y = quality.features([r.text for r in rows]), np.array([r.quality for r in rows])
    d, places = model.design(x), model.places(x)
    diff = (d[y == 1][:, None] - d[y == 0][None]).reshape(-1, d.shape[1])
    share = quality.PAIRS / len(diff)
    p = 1 / (1 + np.exp(diff @ model.weights))
    table = spark.createDataFrame([([int(v) for v in a], int(b)) for a, b in zip(places, y, strict=True)], "p array<int>, y int")
    gradient, hessian = model._derivatives(table, share)
    assert np.allclose(gradient, share * diff.T @ p, rtol=2e-2, atol=0.02)
    assert np.allclose(hessian, share * (diff * (p * (1 - p))[:, None]).T @ diff, rtol=5e-2, atol=0.05)
    assert np.abs(share * diff.T @ p - model.penalty * model.weights).max() < 0.05  # the least loss of all pairs


def test_quality_strengths_minimise_the_loss_of_pairs(spark):
    docs, labels = labelled(spark, 300)
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y = quality.features([r.text for r in rows]), np.array([r.quality for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (y[i], x[i].tolist()))
    x, y = x[order], y[order]
    d = model.design(x)
    for f, e in enumerate(model.edges):  # a feature's bins, one by one
        at = sum(len(other) + 1 for other in model.edges[:f])
        assert all(d[i, at + sum(v >= edge for edge in e)] == 1 for i, v in enumerate(x[:, f]))
    rng = np.random.default_rng(model.seed)
    diff = d[rng.choice(np.flatnonzero(y == 1), quality.PAIRS)] - d[rng.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    loss = lambda w: np.logaddexp(0, -diff @ w).sum() + model.penalty / 2 * w @ w
    least = loss(model.weights)
    for _ in range(40):
        step = rng.normal(size=len(model.weights))
        assert least <= loss(model.weights + 0.05 * step / np.linalg.norm(step)) + 1e-6
    strength = {r.doc_id: quality_strength for r, quality_strength in zip(docs.orderBy("doc_id").collect(), model.design(quality.features([r.text for r in docs.orderBy("doc_id").collect()])) @ model.weights, strict=True)}
    for d_id, s in strength.items():
        assert got[d_id] == pytest.approx(1 / (1 + np.exp(-np.clip((s - model.middle) / model.scale, -30, 30))))


# ---------------------------------------------------------------------------------------------------------- pipeline


def brute_mix(rows):
    """Copies of (id, text, source) rows that the mixture takes, a source's last one cut."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(len(w) for w, r in zip(words, rows, strict=True) if r[2] == s) for s in names}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        target |= {s: 3.0 * size[s] if over else weight[s] * level for s in (over or free)}
        left -= sum(target[s] for s in over)
        free -= over or free
    out = []
    for s in names:
        epochs, rest = divmod(int(target[s] + 0.5), size[s]) if size[s] else (0, 0)
        key = lambda i: hashlib.md5(("mix:" + (str(rows[i][0]) if rows[i][0] is not None else "null:" + hashlib.md5((rows[i][1] or "").encode()).hexdigest())).encode()).hexdigest()
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s and words[i]), key=key):
            out += [rows[i][:2]] * epochs
            head = min(rest, len(words[i]))
            rest -= head
            if head:
                out.append((rows[i][0], rows[i][1] if head == len(words[i]) else " ".join(words[i][:head])))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = [], []
    shared = [prose(rng, 70) for _ in range(2)]
    for i in range(360):
        w, toxic = prose(rng, rng.randrange(100, 160)).split(), rng.random() < 0.15
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(("vilething", "vileword", "nastyone")) for _ in range(4)]
        elif i % 9 == 0 and rows and rows[-1][1]:  # a near copy of the one before
            w = rows[-1][1].split()
            w[len(w) // 2] = "changed"
            toxic = "vile" in rows[-1][1] or "nastyone" in rows[-1][1]
        elif i % 20 == 7:
            w.insert(30, shared[i % 2])
        rows.append((i, " ".join(w), "en", ("a", "b", "c", None)[min(3, int(rng.expovariate(0.9)))]))
        labels.append((i, 1, int(toxic)))
    toxic_ids = {d for d, _, y in labels if y}
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (None, prose(rng, 60), "en", "b"), (1002, prose(rng, 3000), "de", "b"), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = [(d, t, s) for d, t, _, s in rows if d not in toxic_ids]
    kept, seen = [], set()
    for r, (d, n, c) in zip(docs, brute_components([r[:2] for r in docs]), strict=True):
        if not n or c is None or d == c and d not in seen:
            kept.append(r)
            seen.add(d)
    assert len(kept) < len(docs) - 10
    cut = [(d, t if t is None else k.decode("utf-8", "ignore"), s) for (d, t, s), (_, _, k) in zip(kept, brute_kept([t for _, t, _ in kept], 200), strict=True)]
    assert sum(a != b for a, b in zip(kept, cut, strict=True)) > 8
    mixed = brute_mix(cut)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in mixed}
    used, _ = check_packing(packed, mixed, 2048)
    counts = np.bincount([r.length for r in packed], minlength=2049)
    assert packing.lower_bound(counts, 2048) <= used <= sum(t for _, t in packing.best_fit(counts, 2048))


def test_pipeline_of_an_empty_table_and_clashing_columns(spark, tmp_path, odd_docs):
    import corpus_pipeline

    _, labels = labelled(spark, 30)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd_docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
