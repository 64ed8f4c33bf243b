"""Chats, vector search, URL filters and the pipeline against brute force, and on odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.llm import chat, neighbours, queries, topk, urls

SF = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------------------------------------------- sql


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    from tests.test_oracle import TABLES, rows

    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns) and rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


# ------------------------------------------------------------------------------------------------------------- chats


def brute_chats(rows):
    chats = {}
    for conv, turn, role, text in set(rows):
        chats.setdefault(conv, []).append((turn, role or "", text or ""))
    full = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))] for c, ts in chats.items()}
    keep = []
    for c, ts in full.items():
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts for o in full.values())
        same = [k for k, o in full.items() if o == ts and k is not None]
        if not longer and c == (min(same) if same else None):
            keep.append((c, len(ts), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)))
    return sorted(keep, key=str)


def test_chats_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for turn in range(rng.randrange(1, 5)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{turn}-{rng.randrange(2)}"))
    rows += [rows[0], (50, None, None, None), (50, 1, "user", ""), (None, 0, "user", "alone"), (51, 0, "user", "x" * 50_000), (52, 3, "user", "gap"), (52, 9, "user", "gap")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = sorted(((r.conv_id, r.n_turns, r.text) for r in chat.format_chats(df).collect()), key=str)
    assert got == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_tied_turns_are_ordered_by_text(spark):
    rows = [(i, 0, "user", f"{w}{i}") for i in range(6) for w in ("z", "b", "é", "A", "")] + [(9, 1, "user", "x"), (9, 1, "user", "a"), (9, None, None, None), (9, 1, "a", "zz")]
    got = {r.conv_id: r.text for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()) for r in rows if r[0] == c))
        assert got[c] == "".join(f"<|im_start|>{r}\n{t.decode()}<|im_end|>\n" for _, _, r, t in mine)
    # the second conversation is the first one's head only in the order of texts
    heads = spark.createDataFrame([(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "u", "b")], "conv_id long, turn int, role string, text string")
    assert sorted(r.conv_id for r in chat.format_chats(heads).collect()) == [1, 3]


# ----------------------------------------------------------------------------------------------------------- vectors


def vectors(spark, n=700, dim=16, copies=120):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(8, dim))
    x = centre[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(10_000 + i, rows[3][1]) for i in range(copies)]  # one very common vector
    return rows


ODD = [(20_000, None), (20_001, [0.0] * 16), (20_100, [None] * 16), (20_200, [float("nan")] + [0.0] * 15), (20_300, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (20_400, [1.0, 2.0]), (20_500, [])]
SCHEMA = "vec_id long, embedding array<float>"


def test_search_finds_neighbours(spark):
    rows = vectors(spark)
    df = spark.createDataFrame(rows + ODD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1))
    got = neighbours.search_nearest(df).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[ids == r.vec_id][0]) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[order].tolist()))
        total += 10
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(ids[ids % 100 == 0].tolist())


def nearest_by_force(ids, x, every=100, k=10):
    out = []
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out += [(int(ids[q]), r, int(ids[i]), float(d[i])) for r, i in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("kind", ["offset", "isotropic"])
def test_search_misses_nothing_where_the_graph_is_poor(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 48))
    if kind == "offset":  # far from zero, beside one vector of another scale
        x = 1000 + x
        x[7] = 1e6
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search_nearest(df).collect())
    assert [g[:3] for g in got] == [w[:3] for w in nearest_by_force(ids, x)]


def test_search_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search_nearest(df).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search_nearest(df.limit(0)).count() == 0
    assert neighbours.search_nearest(df.where("vec_id = 0")).count() == 0


def test_top_k_is_exact(spark):
    rows = vectors(spark, 500) + [(20_001, [0.0] * 16)]
    df = spark.createDataFrame(rows + [r for r in ODD if r[0] != 20_001], SCHEMA).withColumn("rank", F.lit("clash"))
    got = {}
    for r in topk.exact_top_k(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([r[0] for r in rows])
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert sorted(got[q]) == [(k + 1, ids[i], s[i]) for k, i in enumerate(order)]
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_sorted_lists_stop_early_and_keep_ties():
    rng = np.random.default_rng(3)
    rows = rng.integers(-30, 30, (3000, 12))
    rows[::7] = rows[0]
    index = topk.SortedLists(np.arange(3000), rows)
    every = rng.integers(-30, 30, (300, 12)) * (rng.random((300, 12)) < 0.7)
    q_ids = np.where(np.arange(300) % 3 == 0, np.arange(300), -1)  # some are rows themselves
    for floor in (np.full(300, -np.inf), np.where(np.arange(300) % 2, 900.0, -np.inf), np.full(300, 1e9)):
        number, at, score = index.top(q_ids, every, 25, floor)
        for i, q in enumerate(every):
            s = (rows @ q).astype(float)
            want = [int(x) for x in np.lexsort((np.arange(3000), -s)) if x != q_ids[i]][:25]
            mine = at[number == i].tolist()
            assert mine == want[: len(mine)] and (score[number == i] == s[mine]).all()
            assert len(mine) == len(want) or s[want[len(mine)]] < floor[i]
    huge = topk.SortedLists(np.arange(3000), rows * 2**20)
    number, at, score = huge.top(np.full(2, -1), every[:2] * 2**10, 5, np.full(2, -np.inf))
    assert (score[number == 0] == (rows[at[number == 0]] @ every[0]) * 2.0**30).all()


def test_top_k_refuses_scores_that_are_not_exact(spark):
    rows = [(i, [float(2**25 + i), 1.0]) for i in range(30)]
    for data in (rows, [(0, [1e18]), (1, [2.0])]):
        with pytest.raises(ValueError, match="exactly"):
            topk.exact_top_k(spark.createDataFrame(data, SCHEMA))
    fine = [(i, [float(2**20 + i), 1.0]) for i in range(30)]
    got = [r.score for r in topk.exact_top_k(spark.createDataFrame(fine, SCHEMA), k=1).orderBy("query_id").collect()]
    assert got == [(64 * 2**20) * 64 * (2**20 + 29) + 64 * 64, 64 * (2**20 + 20) * 64 * (2**20 + 29) + 64 * 64]


def test_top_k_of_few_rows_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [-1.0, 0.0]), (4, [100.0, 3.0]), (0, [1.0, 0.5])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), k=3).collect()]
    want = []
    for q in (0, 20):
        pool = [(-sum(int(64 * a) * int(64 * b) for a, b in zip(x, y, strict=True)), j) for i, x in rows if i == q for j, y in rows if j != q]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(sorted(pool)[:3])]
    assert sorted(got) == sorted(want)


# -------------------------------------------------------------------------------------------------------------- urls


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = ["http://Example.NET/en/1", "https://a.example.net/EN/", "http://net/", "http://x.net", "ftp://example.com/de/#x", "http://org/fr/?q", "http://a.b.org/fr/x", "http://notorg/fr/", "http://example.com.org/de/", "nothing", "", None, "://", "http://?a/b", "http://a.net/" + "p" * 50_000, "http://" + "a." * 3000 + "net/x", "http://ÄB.net/", "x://example.com/de/", "http://example.com:80/de/"]


def test_url_filter_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id int, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})
    got = urls.filter_urls(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute_url(u, urls.RULES) for u in URLS + URLS[:3]]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_cascade_is_exact_with_small_filters(spark):
    rng = random.Random(1)
    keys = [f"host{rng.randrange(10**6)}.net/" for _ in range(3000)]
    listed = keys[:150]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    cascade = urls.Cascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), universe, bits_per_key=2, hashes=1)
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(listed)
    assert not universe.where(urls.Cascade.build(universe.limit(0), universe).contains(F.col("key"))).count()


# ---------------------------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs
    for name, stage in p.STAGES[:4]:
        out = stage(spark, last, SF)
        assert out.columns == columns, name
        from titerframe.llm.common import materialize

        last = materialize(out, name)
        assert last.count() > 0
    packed = p.STAGES[4][1](spark, last, SF)
    assert packed.select(F.sum("length")).first()[0] >= last.count() and packed.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()
    assert p.ORACLE_SQL is None
