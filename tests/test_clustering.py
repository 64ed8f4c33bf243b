"""Clusterers and the fitted gating chain against NumPy versions, saved and loaded, and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerframe.operators import clustering as C
from titerframe.operators import gates, gating, models, readouts


def groups(seed, sizes, spread=0.5, d=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), d)) * 6
    return np.concatenate([rng.normal(centres[i], spread, (n, d)) for i, n in enumerate(sizes)])


def as_rows(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


# ----------------------------------------------------------------------------------------------------------------- map


def numpy_map(x, som):
    mean = x.mean(0)
    nodes = som.start(mean, (x - mean).T @ (x - mean) / len(x))
    grid = np.array([(i // som.width, i % som.width) for i in range(len(nodes))], float)
    between = ((grid[:, None] - grid[None]) ** 2).sum(2)
    for epoch in range(som.epochs):
        nearest = ((x[:, None] - nodes[None]) ** 2).sum(2).argmin(1)
        h = np.exp(-between / (2 * som.radius(epoch) ** 2))[:, nearest]
        nodes = (h @ x) / h.sum(1, keepdims=True)
    return nodes


def test_map_equals_numpy_and_groups_its_nodes(spark):
    x = groups(1, [200, 150, 100], 0.8)
    som = C.clusterer("som", width=4, height=3, epochs=6, n_clusters=3)
    fitted = som.fit(as_rows(spark, x), "id", "vec")
    nodes = np.stack(fitted.tables["nodes"]["weights"].to_list())
    assert np.allclose(nodes, numpy_map(x, som), atol=1e-8)
    table = fitted.tables["nodes"]["cluster"].to_numpy()
    assert set(table) == {0, 1, 2}
    got = [r.cluster for r in fitted.predict(as_rows(spark, x), "vec").orderBy("id").collect()]
    assert got == table[((x[:, None] - nodes[None]) ** 2).sum(2).argmin(1)].tolist()
    assert same_partition(got, np.repeat([0, 1, 2], [200, 150, 100]).tolist())
    by_node = C.clusterer("som", width=2, height=2, epochs=2, label_kind="cluster").fit(as_rows(spark, x), "id", "vec")
    assert by_node.tables["nodes"]["cluster"].tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="label_kind"):
        C.clusterer("som", label_kind="x").fit(as_rows(spark, x), "id", "vec")


def test_average_linkage_matches_brute_force():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(17, 2))
    parts = [[i] for i in range(17)]
    while len(parts) > 5:
        d = {(i, j): np.mean([np.linalg.norm(x[a] - x[b]) for a in parts[i] for b in parts[j]]) for i in range(len(parts)) for j in range(i)}
        i, j = min(d, key=d.get)
        parts[j] += parts.pop(i)
    want = np.empty(17, int)
    for k, p in enumerate(parts):
        want[p] = k
    assert same_partition(C.linkage_groups(x, 5).tolist(), want.tolist())
    assert C.linkage_groups(x, 17).tolist() == list(range(17))


# ------------------------------------------------------------------------------------------------------------- density


def brute_tree(x, k):
    """Spanning tree weights by Prim over the whole matrix of mutual reachability."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, k]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    seen, best, weights = np.zeros(len(x), bool), np.full(len(x), np.inf), []
    at = 0
    for _ in range(len(x) - 1):
        seen[at] = True
        best = np.minimum(best, np.where(seen, np.inf, m[at]))
        best[seen] = np.inf
        at = int(best.argmin())
        weights.append(best[at])
    return d, core, m, sorted(weights)


def brute_labels(m, least):
    """Leaf clusters by definition: as the distance falls over all its values, parts of ``least`` rows at least."""
    n = len(m)

    def parts(rows, cut):
        left, out = set(rows), []
        while left:
            todo = [left.pop()]
            part = list(todo)
            while todo:
                i = todo.pop()
                near = [j for j in left if m[i, j] < cut]
                left -= set(near)
                part += near
                todo += near
            out.append(sorted(part))
        return out

    labels = np.full(n, -1)

    def walk(rows, cuts, root):
        """Rows of a cluster from its birth on; it is a leaf unless it splits into two large parts."""
        current = rows
        for k, cut in enumerate(cuts):
            large = [p for p in parts(current, cut) if len(p) >= least]
            if len(large) > 1:
                for p in large:
                    walk(p, cuts[k + 1 :], False)
                return
            if not large:
                break
            current = large[0]
        if not root:
            labels[rows] = labels.max() + 1

    walk(list(range(n)), sorted(np.unique(m[np.triu_indices(n, 1)]), reverse=True), True)
    return labels


@pytest.mark.parametrize("seed", [1, 2])
def test_density_clusters_match_the_definition(spark, seed):
    x = np.concatenate([groups(seed, [40, 30, 25], 0.6, 2), np.random.default_rng(seed).uniform(-12, 12, (15, 2))])
    d, core, m, weights = brute_tree(x, 4)
    got_core = C.core_distances(spark, x, 4)
    assert np.allclose(got_core, core)
    edges = C.spanning_tree(spark, x, got_core)
    assert np.allclose(edges[:, 0], weights)
    tree = C.condensed(edges, len(x), 8)
    labels = tree.owner(tree.selected("leaf"))[tree.cluster]
    want = brute_labels(m, 8)
    assert ((labels < 0) == (want < 0)).all() and same_partition(labels[labels >= 0].tolist(), want[want >= 0].tolist())


def test_density_fit_refits_predicts_and_scores_outliers(spark):
    x = np.concatenate([groups(5, [90, 70, 60], 0.4, 2), [[40.0, 40.0]]])
    rows = as_rows(spark, x)
    fitted = C.clusterer("density", min_cluster_size=20, min_samples=5).fit(rows, "id", "vec")
    labels = fitted.labels["cluster"].to_numpy()
    assert labels[-1] == -1 and fitted.info["frac_noise"] <= 0.15 and fitted.info["noise_target_met"]
    assert len(set(labels) - {-1}) >= 3 and all(len(set(labels[a:b]) - {-1}) >= 1 for a, b in ((0, 90), (90, 160), (160, 220)))
    assert fitted.labels["outlier"].between(0, 1).all() and fitted.labels["outlier"].iloc[-1] == fitted.labels["outlier"].max()
    again = fitted.predict(rows, "vec").orderBy("id").collect()
    agree = np.mean([r.cluster == v for r, v in zip(again, labels, strict=True)])
    assert agree > 0.95 and all(0 <= r.prob <= 1 and 0 <= r.outlier <= 1 for r in again)
    far = fitted.predict(as_rows(spark, np.array([[500.0, -500.0]])), "vec").first()
    assert far.cluster == -1 and far.outlier > 0.9
    # a target that can't be met: all refits are tried, each 1.5 times smaller, the one of least noise is kept
    strict = C.clusterer("density", min_cluster_size=30, min_samples=5, max_noise=0.0).fit(rows, "id", "vec")
    sizes = [h["min_cluster_size"] for h in strict.info["history"]]
    assert sizes == [30, 20, 13, 8, 5] and strict.info["frac_noise"] == min(h["frac_noise"] for h in strict.info["history"]) and not strict.info["noise_target_met"]
    for bad in ({"min_cluster_size": 1}, {"min_cluster_size": 10_000}, {"max_noise": 2.0}):
        with pytest.raises(ValueError):
            C.clusterer("density", **bad).fit(rows, "id", "vec")


def test_excess_of_mass_prefers_the_parent_of_weak_children():
    tree = C.Tree(np.array([1] * 10 + [3] * 5 + [4] * 5), np.array([9.0] * 10 + [1.2] * 10), np.array([0, 0, 0, 2, 2]), np.array([0.0, 0.5, 0.5, 1.1, 1.1]), np.array([20, 10, 10, 5, 5]))
    assert tree.selected("leaf").tolist() == [False, True, False, True, True]
    assert tree.selected("eom").tolist() == [False, True, True, False, False]
    assert tree.owner(tree.selected("eom")).tolist() == [-1, 1, 2, 2, 2]


# --------------------------------------------------------------------------------------------------------- communities


def local_modularity(edges, labels):
    m = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if labels[a] == labels[b])
    ends = {}
    for a, b, w in edges:
        for v in (a, b):
            ends[labels[v]] = ends.get(labels[v], 0) + w
    return inside / m - sum(v * v for v in ends.values()) / (2 * m) ** 2


def local_moves(edges, n):
    """Sequential moves of single nodes, then of whole communities, until nothing gains."""
    labels = list(range(n))
    while True:
        before = local_modularity(edges, labels)
        for members in [[v] for v in range(n)] + [[v for v in range(n) if labels[v] == c] for c in set(labels)]:
            best, to = local_modularity(edges, labels), labels[members[0]]
            for c in {labels[b] for a, b, _ in edges if a in members} | {labels[a] for a, b, _ in edges if b in members}:
                q = local_modularity(edges, [c if v in members else k for v, k in enumerate(labels)])
                if q > best + 1e-12:
                    best, to = q, c
            for v in members:
                labels[v] = to
        if local_modularity(edges, labels) <= before + 1e-12:
            return before, labels


def test_communities_reach_the_modularity_of_local_moves(spark):
    rng = np.random.default_rng(6)
    part = np.repeat(np.arange(4), 9)
    edges = [(a, b, float(rng.uniform(0.5, 1))) for a in range(36) for b in range(a) if rng.random() < (0.6 if part[a] == part[b] else 0.05)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    runs = [{r.node: r.c for r in C.communities(df).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    q = local_modularity(edges, runs[0])
    assert q >= local_moves(edges, 36)[0] - 1e-9
    labels = spark.createDataFrame(list(runs[0].items()), "node long, c long")
    assert C.modularity(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"), labels) == pytest.approx(q)


def test_community_clusters_votes_and_small_groups(spark):
    x = np.concatenate([groups(8, [80, 60, 50], 0.5), [[60.0, 60, 60], [60.1, 60, 60], [60, 60.1, 60]]])
    fitted = C.clusterer("communities", knn=10, small_pop=5).fit(as_rows(spark, x), "id", "vec")
    labels = fitted.labels["cluster"].to_numpy()
    names, counts = np.unique(labels, return_counts=True)
    assert counts.min() >= 5 and (np.diff(counts) <= 0).all()
    for a, b in ((0, 80), (80, 140), (140, 190)):
        assert not set(labels[a:b]) & set(labels[:a]) and not set(labels[a:b]) & set(labels[b:190])
    rng = np.random.default_rng(1)
    fresh = x[:190:7] + rng.normal(0, 0.05, x[:190:7].shape)
    got = fitted.predict(as_rows(spark, fresh), "vec").orderBy("id").collect()
    for r, v in zip(got, fresh, strict=True):
        near = labels[np.argsort(np.sqrt(((x - v) ** 2).sum(1)), kind="stable")[:10]]
        votes = np.bincount(near)
        assert (r.cluster, r.prob, r.outlier) == (votes.argmax(), pytest.approx(votes.max() / 10), pytest.approx(1 - votes.max() / 10))


@pytest.mark.parametrize(("name", "options"), [("som", {"width": 3, "height": 2, "n_clusters": 3}), ("kmeans", {"k": 3}), ("communities", {"knn": 8}), ("density", {"min_cluster_size": 10})])
def test_clusterers_save_load_and_pass_over_odd_vectors(spark, tmp_path, name, options):
    x = groups(9, [40, 40, 30], 0.4)
    rows = as_rows(spark, x)
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [None, 1.0, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [])], rows.schema)
    fitted = C.clusterer(name, **options).fit(rows.union(odd), "id", "vec")
    fitted.save(spark, str(tmp_path / "model"))
    other = C.Fitted.load(spark, str(tmp_path / "model"))
    table = rows.union(odd).withColumn("clash", F.lit("x"))
    one, two = (sorted(map(str, f.predict(table, "vec").collect())) for f in (fitted, other))
    assert one == two and sum("id=90" in r and "cluster=None" in r for r in one) == 5
    assert fitted.predict(rows.limit(0), "vec").count() == 0
    if name in ("communities", "density"):
        with pytest.raises(ValueError, match="training rows"):
            C.clusterer(name, **options, max_training=20).fit(rows, "id", "vec")


def test_clusterers_are_registered_by_name(spark):
    class One:
        def fit(self, rows, id_col, vec_col):
            import pandas as pd

            return C.Fitted("one", {}, {}, pd.DataFrame({"id": [], "cluster": []}))

    C.register("one", One, lambda fitted: (3, lambda q: (np.zeros(len(q)), np.ones(len(q)), np.zeros(len(q)))))
    assert C.clusterer("one").fit(None, "id", "vec").predict(as_rows(spark, groups(1, [5])), "vec").where("cluster = 0 AND prob = 1").count() == 5
    with pytest.raises(KeyError, match="no clusterer"):
        C.clusterer("none")


# --------------------------------------------------------------------------------------------------------------- chain


@pytest.fixture(scope="module")
def measured(spark):
    """Files with lymphocytes of two lineages, debris and controls."""
    rng = np.random.default_rng(12)
    rows = []
    for file, role in ((1, "NC"), (2, "PC"), (3, "SAMPLE"), (4, "SAMPLE")):
        for i in range(1500):
            lymph, lineage = rng.random() < 0.75, rng.random() < 0.6
            a = rng.lognormal(10.6 if lymph else 9.0, 0.15)
            h = a * (0.6 if rng.random() < 0.05 else 1.0) * rng.lognormal(0, 0.02)
            bright = lambda on: float(rng.lognormal(8.0, 0.3) if on else rng.lognormal(4.0, 0.5))
            igg = rng.lognormal(5.0, 0.4) * (8.0 if role == "PC" else 3.0 if role == "SAMPLE" and lineage else 1.0)
            rows.append((file, i, role, file % 2, float(a), float(h), float(rng.lognormal(9.0 if lymph else 9.6, 0.2)), float(igg), bright(lymph and lineage), bright(lymph and not lineage)))
    rows.append((4, 5000, "SAMPLE", 0, None, float("nan"), 1.0, 1.0, 1.0, None))
    return spark.createDataFrame(rows, "file_id long, event long, role string, sample long, fsc_a double, fsc_h double, ssc_a double, igg double, cd3 double, cd19 double")


def chain(**more):
    options = {"min_guide": 100, "min_nc": 500, "min_pc": 500} | more.pop("options", {})
    return gating.EventGater(rowCols=["event"], markers=["cd3", "cd19"], limit=262144.0, options=options, **more)


@pytest.fixture(scope="module")
def fitted(measured):
    said = []
    model = chain(clusterer="som", clustererOptions={"width": 4, "height": 4, "n_clusters": 6}, tell=said.append).fit(measured)
    return model, said


def test_the_chain_finds_populations(fitted, measured):
    model, said = fitted
    assert tuple(said) == gating.EventGater.STAGES
    assert {"cd3", "cd19"} <= set(model.types["population"])
    out = model.transform(measured)
    assert out.count() == measured.count() and out.where("event = 5000 AND (qc OR lymph OR accepted)").count() == 0
    r = {(x.file_id, x.gate): x for x in model.readouts(measured).collect()}
    assert r[3, "cd3"].n_events > 300 and r[3, "cd19"].n_events > 200
    assert r[3, "cd3"].pos_fraction > 0.6 > 0.2 > r[3, "cd19"].pos_fraction  # the reporter rises on one lineage only
    assert r[2, "Lymphocytes"].fluorescence_index == pytest.approx(100, abs=5)
    assert {x.gate for x in model.readouts(measured, ["sample"]).collect()} == {"All Cells", "Singlets", "Lymphocytes", "cd3", "cd19"}


def test_rows_gated_by_the_fit_are_those_of_transform(fitted, measured):
    model, _ = fitted
    again, gated = chain(clusterer="som", clustererOptions={"width": 4, "height": 4, "n_clusters": 6}).fit_gated(measured)
    columns = ["file_id", "event", "edge", "qc", "lymph", "cluster", "population", "accepted", "t"]
    rows = lambda df: sorted(df.select(*columns).collect(), key=str)
    assert str(rows(gated)) == str(rows(model.transform(measured)))
    assert sorted(again.readouts_of(gated).collect(), key=str) == sorted(model.readouts(measured).collect(), key=str)


def test_the_chain_is_its_parts_called_by_hand(spark, fitted, measured):
    model, _ = fitted
    rows = gates.singlets_mad(measured.withColumn("edge", gates.edge_gate(["fsc_a", "ssc_a", "fsc_h"], 262144.0)), "file_id", "fsc_a", "fsc_h").withColumn("qc", F.col("edge") & F.col("singlet"))
    for m in model.marker_table.itertuples():
        values = [r[0] for r in rows.where("qc").select(m.marker).where(F.col(m.marker).isNotNull()).collect()]
        c, t = models.calibrate_marker(np.array(sorted(values)))
        assert (m.cofactor, m.threshold) == (pytest.approx(c, rel=1e-6), pytest.approx(t, rel=1e-6))
    train = model._lymphocytes(rows, model.marker_table).where("lymph")
    x = np.array([[*map(float, r)] for r in train.select(*[c.alias(n) for n, c in model._features(model.marker_table).items()]).collect()])
    med = np.median(x, 0)
    mad = np.median(np.abs(x - med), 0)
    assert np.allclose(model.scaler["med"], med) and np.allclose(model.scaler["mad"], mad)
    nodes = np.stack(model.fitted.tables["nodes"]["weights"].to_list())
    som = C.clusterer("som", width=4, height=4, n_clusters=6)
    assert np.allclose(nodes, numpy_map(np.clip((x - med) / np.maximum(mad, 1e-6), -8, 8), som), atol=1e-6)
    gated = model.transform(measured)
    controls = readouts.control_stats(gates.explode_gates(gated, model.gates()), "gate", "role", "igg", "t", min_nc=500, min_pc=500)
    by_hand = readouts.readouts(gates.explode_gates(gated, model.gates()), ["file_id"], "gate", "igg", "t", controls)
    key = lambda df: {(r.file_id, r.gate): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in df.collect()}
    assert key(by_hand) == key(model.readouts(measured))


def test_the_chain_is_saved_and_loaded(fitted, measured, tmp_path):
    model, _ = fitted
    model.write().overwrite().save(str(tmp_path / "model"))
    other = gating.EventGaterModel.load(str(tmp_path / "model"))
    assert other.uid == model.uid and other.extractParamMap().keys() == model.extractParamMap().keys()
    assert sorted(map(str, other.transform(measured).collect())) == sorted(map(str, model.transform(measured).collect()))
    assert sorted(map(str, other.readouts(measured).collect())) == sorted(map(str, model.readouts(measured).collect()))
    est = chain(clusterer="density", options={"least_prob": 0.3})
    est.save(str(tmp_path / "estimator"))
    same = gating.EventGater.load(str(tmp_path / "estimator"))
    assert same._option("least_prob") == 0.3 and same._option("min_guide") == 100 and same.getOrDefault("clusterer") == "density"


@pytest.mark.parametrize(("name", "options"), [("density", {"min_cluster_size": 60})])
def test_the_chain_takes_any_clusterer(measured, name, options):
    model = chain(clusterer=name, clustererOptions=options, options={"subsample_per_file": 400, "tail_per_marker": 30, "min_training": 1000}).fit(measured)
    assert {"cd3", "cd19"} <= set(model.types["population"])
    r = {(x.file_id, x.gate): x.n_events for x in model.readouts(measured).collect()}
    assert r[3, "cd3"] > 200 and r[3, "cd19"] > 100
    assert 0 < model.outlier_limit < 1  # of the training rows' scores, which density alone has


def test_the_chain_refuses_too_few_events_and_unknown_options(measured):
    with pytest.raises(ValueError, match="too few"):
        chain(clusterer="kmeans").fit(measured.where("event < 400"))
    with pytest.raises(KeyError):
        gating.EventGater(options={"nothing": 1})


@pytest.mark.parametrize("kind", ["continuous", "tied"])
def test_nearest_rows_are_those_of_a_stable_sort_without_measuring_all(kind, monkeypatch):
    rng = np.random.default_rng(3)
    draw = (lambda n: rng.normal(size=(n, 3))) if kind == "continuous" else (lambda n: rng.integers(0, 4, (n, 3)).astype(float))
    x, q = draw(1500), draw(3000)
    measured, plain = [], C._distances
    monkeypatch.setattr(C, "_distances", lambda a, b: measured.append(len(a) * len(b)) or plain(a, b))
    at, d = C.NearestRows(x).nearest(q, 9)
    want = plain(q, x)
    near = np.argsort(want, axis=1, kind="stable")[:, :9]
    assert (at == near).all() and (d == np.take_along_axis(want, near, 1)).all() and sum(measured) < len(q) * len(x) / 2
