"""The filter audit and whitening against brute force, and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.llm import audit, whitening

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------------------------------------------------- audit


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(j is not None and i is not None and j < i and (other or "") == text for j, other, _ in docs)
        flags = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": smaller}
        parts.setdefault(lang or "", []).append((flags, i is not None and i in good, i is not None and i in bad))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = rows
            for k, letter in enumerate(order):
                gone = [r for r in alive if r[0][letter]]
                alive = [r for r in alive if not r[0][letter]]
                failing = [r for r in rows if r[0][letter]]
                out[part, order, k + 1] = [len(alive), len(gone), len(failing) - len(gone) - sum(r[0][letter] for r in alive), sum(sum(r[0].values()) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "bad_lost", "shapley"]
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_replays_every_order_as_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(audit, "_LONG", 3000)
    vocabulary = ["alpha", "Beta", "GAMMA", "b$", "c", "été", "\x1cx", "naïve one"] + [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary[: rng.choice([4, 8, 308])]) for _ in range(rng.choice([0, 1, 30, 199, 200, 220, 900]))]
        docs.append((rng.randrange(120) if i % 25 else None, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b\x0c "]).join(words), rng.choice(["en", "de", "", None])))
    docs += [(200, None, "en"), (201, "", "en"), (202, None, "fr"), (10**12, docs[5][1], None), docs[7], docs[7], (None, docs[7][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 210)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("mask", "step", "kept", "id", "part", "digest", "first", "good")})
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("id", "good", "bad", "part")})
    assert collected(audit.audit(d, t)) == brute_audit(docs, labels)
    assert audit.audit(d.limit(0), t).count() == 0
    assert set(collected(audit.audit(d, t.limit(0)))) == set(brute_audit(docs, []))


def test_limits_of_the_text_filters():
    text = lambda n, m: " ".join(f"w{i % m}" for i in range(n)).encode()
    assert [audit.text_flags(t) for t in (b"", text(199, 199), text(200, 200), text(200, 100), text(200, 99), text(201, 101), text(201, 100))] == [1, 1, 0, 0, 2, 0, 2]
    lower = text(200, 200)
    n = len(lower) + 1
    assert audit.text_flags(lower + b" ") & 4 == 0
    assert audit.text_flags(lower + b" " + b"A" * 40) & 4 == (4 if 100 * 40 > 3 * (n + 40) else 0)
    assert audit.text_flags(("é" * 97 + "AAA").encode()) & 4 == 0 and audit.text_flags(("é" * 96 + "AAA").encode()) & 4 == 4
    assert [bool(audit.text_flags(lower + bytes([c])) & 8) for c in b"#$%&*|@^\\"] == [True] * 6 + [False] * 3


def test_audit_of_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert collected(audit.audit(odd_docs, labels)) == brute_audit(rows, [(1, 1, 0), (4, 0, 1)])


# --------------------------------------------------------------------------------------------------------- whitening


def brute_whiten(vectors):
    """n, exact deviations, variances and trace of the fixed-point vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return n, deviations, centred, e[::-1], u[:, ::-1], np.trace(cov)


def same_up_to_sign(got, centred, e, u):
    for k in range(got.shape[1]):
        want = centred @ u[:, k] / np.sqrt(e[k])
        sign = np.sign(got[:, k] @ want)
        assert np.abs(got[:, k] - sign * want).max() < 1e-6


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 40)) @ np.diag(np.linspace(3, 0.3, 40)) + 5).tolist()
    rows = list(enumerate(v)) + [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (1004, []), (1005, [1.0]), (1006, [0.0] * 40), (None, v[3]), (3, v[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "n", "w", "component", "d", "v", "whitened", "i")})
    out = sorted(whitening.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    kept = v + [[0.0] * 40, v[3], v[3]]
    n, deviations, centred, e, u, trace = brute_whiten(kept)
    assert len(out) == n * 32 and {r.n for r in out} == {n} and all(r.identity_error <= 1e-8 for r in out)
    by_id = dict(zip([*range(300), 1006, "null", "again"], deviations, strict=True))
    assert all(r.deviation == by_id["null" if r.vec_id is None else r.vec_id] for r in out)
    assert np.allclose([r.explained for r in out[:32]], e[:32] / trace, rtol=1e-9)
    places = {(r.vec_id, r.component): r.whitened for r in out}
    got = np.array([[places[i, k + 1] for k in range(32)] for i in range(300)])
    same_up_to_sign(got, centred[:300], e, u)


def test_whitening_of_few_equal_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    frame = lambda vs: spark.createDataFrame(list(enumerate(vs)), schema)
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame([[1.0, 2.0]])).count() == whitening.whiten(frame([[1.0, 2.0]] * 5)).count() == 0
    line = whitening.whiten(frame([[0.0, 1.0, 0.0], [1.0, 1.0, 2.0], [2.0, 1.0, 4.0], [3.0, 1.0, 6.0]])).collect()
    assert len(line) == 4 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in line)
    one = whitening.whiten(frame([[1.0], [2.0], [4.0]])).orderBy("vec_id").collect()
    x = np.array([64.0, 128, 256])
    assert np.allclose(np.abs([r.whitened for r in one]), np.abs(x - x.mean()) / x.std()) and [r.deviation for r in one] == [(3 * int(v) - 448) ** 2 for v in x]


def test_whitening_holds_or_refuses_large_numbers(spark):
    rows = [(1, [2.0**45, 1.0]), (2, [-(2.0**45), 2.0]), (3, [0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, deviations, *_ = brute_whiten([v for _, v in rows])
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == deviations and max(deviations) > 2**63
    with pytest.raises(Exception, match="exceeds"):
        whitening.whiten(spark.createDataFrame([(1, [1e18]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_the_whitening_query_on_driver_data(spark):
    rows = whitening.op13_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviations, centred, e, u, trace = brute_whiten([r.embedding for r in table])
    assert len(rows) == n * 32 and all(r.identity_error <= 1e-4 for r in rows)
    by_id = {r.vec_id: i for i, r in enumerate(table)}
    got = np.empty((n, 32))
    for r in rows:
        got[by_id[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[by_id[r.vec_id]] and abs(r.explained * trace / e[r.component - 1] - 1) < 1e-9
    same_up_to_sign(got, centred, e, u)
