import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytofleet.operators import linear as L
from cytofleet.operators import phenotype as H
from cytofleet.operators import priors as G
from cytofleet.operators import spatial as X


def brute_knn(pdf, k):
    out = set()
    for f, g in pdf.groupby("field_id"):
        ids, x, y = g["cell_id"].to_numpy(), g["x"].to_numpy(), g["y"].to_numpy()
        for i in range(len(ids)):
            d = (x - x[i]) ** 2 + (y - y[i]) ** 2
            o = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out |= {(f, ids[i], ids[j], r + 1) for r, j in enumerate(o)}
    return out


def test_knn_with_clumps_duplicates_and_outliers(spark):
    rng = np.random.default_rng(1)
    clump = rng.normal(0, 0.01, (150, 2))
    same = np.full((60, 2), 3.0)
    wide = rng.uniform(-500, 500, (80, 2))
    far = np.array([[9000.0, 9000.0]])
    xy = np.vstack([clump, same, wide, far])
    pdf = pd.DataFrame({"field_id": 1, "cell_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    small = pd.DataFrame({"field_id": [2] * 4 + [3], "cell_id": [1, 2, 3, 4, 9], "x": [0.0, 1, 2, 2, 5], "y": [0.0, 0, 0, 0, 5]})
    pdf = pd.concat([pdf, small])
    got = {(r["field_id"], r["src"], r["dst"], r["rank"]) for r in X.knn_edges(spark.createDataFrame(pdf), 6).collect()}
    assert got == brute_knn(pdf, 6)


def brute_delaunay(xy, cutoff):
    """Edges with an empty circle through both ends: the two one-sided bounds must not cross."""
    out, n = set(), len(xy)
    for i in range(n):
        for j in range(i + 1, n):
            v = xy[j] - xy[i]
            d = np.hypot(*v)
            if d > cutoff:
                continue
            m, nrm = (xy[i] + xy[j]) / 2, np.array([-v[1], v[0]]) / d
            w = np.delete(xy, [i, j], 0) - m
            a = w @ nrm
            t = ((w * w).sum(1) - d * d / 4) / (2 * a)
            if np.max(t[a < 0], initial=-np.inf) < np.min(t[a > 0], initial=np.inf):
                out.add((i, j))
    return out


@pytest.mark.parametrize("per_tile", [1500, 25])
def test_delaunay_is_exact_whole_and_in_tiles(spark, per_tile):
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.uniform(0, 600, (90, 2)), rng.normal(300, 20, (60, 2))])
    p = spark.createDataFrame(pd.DataFrame({"field_id": 1, "cell_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    f = spark.createDataFrame([(1, 0.5)], "field_id long, pixel_size_um double")
    e = X.delaunay_edges(p, f, 40.0, per_tile=per_tile)
    got = {(r["src"], r["dst"]) for r in e.filter("src < dst").collect()}
    assert got == brute_delaunay(xy, 80.0)
    assert e.count() == 2 * len(got) and e.agg(F.max("dist_um")).first()[0] <= 40.0


def test_delaunay_square_and_cutoff(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1000.0, 0.0), (1, 3, 0.0, 1000.0), (1, 4, 1000.0, 1000.0), (2, 5, 0.0, 0.0)], "field_id long, cell_id long, x double, y double")
    f = spark.createDataFrame([(1, 0.325), (2, 0.325)], "field_id long, pixel_size_um double")
    assert X.delaunay_edges(p, f, 100.0).isEmpty()
    assert X.delaunay_edges(p, f, 400.0).count() == 8  # the diagonal is longer than 400 um


def test_spatial_folds(spark):
    def grid(n, f):
        s = int(math.ceil(math.sqrt(n)))
        return [(f, i, (i % s) * 40.0, (i // s) * 40.0) for i in range(n)]

    df = spark.createDataFrame(grid(100, 1) + grid(40, 2) + grid(6, 3), "field_id long, cell_id long, centroid_x double, centroid_y double")
    r = X.spatial_folds(df, ["cell_id"]).toPandas()
    assert r[r.field_id == 1]["fold"].nunique() == 5 and r[r.field_id == 2]["fold"].nunique() == 4
    assert r[(r.field_id == 1) | (r.field_id == 2)]["spatial"].all() and not r[r.field_id == 3]["spatial"].any()
    assert set(r[r.field_id == 3]["fold"]) == {0, -1} and len(r) == 146


def test_context_regression_sees_a_gradient(spark):
    rng = np.random.default_rng(0)
    n = 100
    x, y = (np.arange(n) % 10) * 40.0, (np.arange(n) // 10) * 40.0
    pdf = pd.DataFrame({"field_id": 1, "cell_id": np.arange(n), "centroid_x": x, "centroid_y": y, "mechano_score": x / x.max() + rng.normal(0, 0.05, n),
                        "u": x + rng.normal(0, 20, n), "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    e = X.delaunay_edges(df.select("field_id", "cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")), spark.createDataFrame([(1, 0.325)], "field_id long, pixel_size_um double"))
    p, r2 = X.context_regression(df, e, ["u", "v"], "mechano_score", ["cell_id"])
    r = r2.first()
    assert r["n_folds"] == 5 and p.count() == n
    assert np.corrcoef(*p.toPandas()[["actual", "predicted"]].to_numpy().T)[0, 1] > 0.7


def test_fold_models_match_lstsq(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    pdf["y"], pdf["z"] = 3 + 2 * pdf.a - pdf.b + rng.normal(0, 0.1, 200), pdf.c + rng.normal(0, 0.1, 200)
    pdf["fold"], pdf["k"] = np.arange(200) % 4, 1
    m = L.fold_models(spark.createDataFrame(pdf), ["a", "b", "c"], ["y", "z"], ["k"], "fold").toPandas().set_index("fold")["coef"]
    for f in range(4):
        t = pdf[pdf.fold != f]
        w, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[["a", "b", "c"]]]), t[["y", "z"]].to_numpy(), rcond=None)
        assert np.allclose(np.array(m[f]).reshape(2, 4), w.T)


def test_cross_block(spark):
    rng = np.random.default_rng(6)
    n = 300
    a = rng.normal(size=(n, 3))
    pdf = pd.DataFrame({"row": np.arange(n), "a1": a[:, 0], "a2": a[:, 1], "a3": a[:, 2], "b1": 5 + a[:, 0] + rng.normal(0, 0.1, n), "b2": rng.normal(size=n)})
    out = H.cross_block(spark.createDataFrame(pdf), ["row"], ["a1", "a2", "a3"], ["b1", "b2"])
    r2 = {r["target"]: r["r2"] for r in out["r2"].collect()}
    assert r2["b1"] > 0.97 and r2["b2"] < 0.1
    imp = {r["feature"]: r["importance"] for r in out["importance"].collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and max(imp, key=imp.get) == "a1"
    p = out["predicted"].toPandas()
    assert len(p) == 2 * n and abs(p[p.target == "b1"]["predicted"].mean() - 5) < 0.1 and sorted(p["fold"].unique()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        H.cross_block(spark.createDataFrame(pdf), ["row"], ["a1"], ["b1"])


def test_hash_folds_cut_the_order_without_sorting_it(spark):
    """Borders from hash ranges equal those of the full order, ties by key, the remainder in the last fold; no row moves."""
    rng = np.random.default_rng(12)
    for n in (3, 23, 500):
        pdf = pd.DataFrame({"row": np.arange(n), "h": rng.integers(0, 2**31 - 1, n) // 2**28 * 2**28})
        d, count = H.hash_folds(spark.createDataFrame(pdf), 5, "h", ["row"])
        assert count == n and "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
        want = pdf.sort_values(["h", "row"])["row"].to_numpy()
        fold = {r: min(4, i // max(1, n // 5)) for i, r in enumerate(want)}
        assert {r["row"]: r["fold"] for r in d.collect()} == fold


def test_cosine_knn_is_exact_with_pruning_and_small_blocks(spark):
    rng = np.random.default_rng(9)
    v = np.vstack([rng.normal(c, 0.05, (60, 8)) for c in rng.normal(size=(6, 8))])
    v[5] = v[4]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["similarity"]) for r in H.cosine_knn(df, 5, pivots=8, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i in range(len(v)):
        top = np.sort(s[i])[::-1][:5]
        assert np.allclose([got[i, r + 1][1] for r in range(5)], top)
    tiny = H.cosine_knn(df.limit(3), 15).toPandas()
    assert (tiny.groupby("src").size() == 2).all()


def test_cosine_knn_in_groups_without_clusters(spark):
    """Many groups on both sides and blocks that hold few neighbours: every rank is exact, equal vectors tie by id."""
    rng = np.random.default_rng(10)
    v = rng.normal(size=(300, 6))
    v[200:240] = v[7]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["similarity"]) for r in H.cosine_knn(df, 5, block=16, group=70).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    assert len(got) == 1500
    for i in range(300):
        want = np.lexsort((np.arange(300), -s[i]))[:5]
        assert [got[i, r + 1][0] for r in range(5)] == want.tolist()
        assert np.allclose([got[i, r + 1][1] for r in range(5)], s[i][want])


def test_communities_separate_cliques(spark):
    rows = []
    for c in range(3):
        ids = range(c * 10, c * 10 + 8)
        rows += [(a, b, 1.0) for a in ids for b in ids if a != b]
    rows += [(7, 10, 0.1), (10, 7, 0.1)]
    g = spark.createDataFrame(rows, "src long, dst long, weight double")
    lab = H.communities(g)
    got = lab.toPandas().set_index("node")["community"]
    assert got.groupby(got.index // 10).nunique().eq(1).all() and got.nunique() == 3
    assert H.modularity(g, lab).first()["modularity"] > 0.6


def test_communities_in_one_task_and_in_sweeps(spark):
    """Planted blocks: both ways find them, every community is connected, and no single move raises the modularity."""
    rng = np.random.default_rng(8)
    rows = {}
    for a in range(60):
        for b in range(a):
            if rng.random() < (0.6 if a // 15 == b // 15 else 0.03):
                rows[a, b] = rows[b, a] = round(float(rng.uniform(0.5, 1)), 3)
    g = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src long, dst long, weight double")
    total = sum(rows.values())
    deg = {u: sum(w for (a, _), w in rows.items() if a == u) for u in range(60)}

    def score(lab):
        names = set(lab.values())
        inner = sum(w for (a, b), w in rows.items() if lab[a] == lab[b])
        return inner / total - sum((sum(deg[u] for u in lab if lab[u] == c) / total) ** 2 for c in names)

    for small in (0, 10**6):
        lab = {r["node"]: r["community"] for r in H.communities(g, small=small).collect()}
        assert len(lab) == 60 and all(lab[u] == lab[u - u % 15] for u in lab) and len(set(lab.values())) == 4
        assert all(c == min(u for u in lab if lab[u] == c) for c in lab.values())
        for u in lab:
            for c in set(lab.values()):
                assert score({**lab, u: c}) <= score(lab) + 1e-9


def test_communities_in_blocks_are_as_good_as_in_one_task(spark, monkeypatch):
    """Neighbours of noise: blocks of a tenth of the graph end after few rounds and lose next to nothing."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 12))
    v[:200] += 0.6
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T - 2 * np.eye(400)
    rows = {(min(a, b), max(a, b)): float(s[a, b]) for a in range(400) for b in np.argsort(-s[a])[:8].tolist() if s[a, b] > 0}
    g = spark.createDataFrame([(*p, w) for (a, b), w in rows.items() for p in ((a, b), (b, a))], "src long, dst long, weight double").cache()
    rounds, measure = [], H.modularity
    monkeypatch.setattr(H, "modularity", lambda *a: rounds.append(1) or measure(*a))
    score = lambda lab: measure(g, lab).first()["modularity"]
    one, blocks = (H.communities(g, small=n) for n in (10**6, len(rows) // 5))
    assert not g.join(blocks, g.src == blocks.node, "left_anti").count() and blocks.count() == 400
    assert score(blocks) > 0.95 * score(one) and len(rounds) <= 25
    calm = {r["node"]: r["community"] for r in blocks.collect()}
    assert all(c == min(u for u in calm if calm[u] == c) for c in set(calm.values()))


def test_communities_without_an_edge_inside_are_cut(spark, monkeypatch):
    g = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)], "src long, dst long, weight double")
    monkeypatch.setattr(H, "_communities", lambda *a: spark.createDataFrame([(k, 1) for k in range(1, 5)], "node long, community long"))
    assert {r["node"]: r["community"] for r in H.communities(g).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_embedding_rules(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=60)]) for i in range(70)] + [(70, [float("nan")] * 60), (71, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    red = H.reduce_embedding(df)
    assert red.count() == 70 and red.select(F.size("components")).first()[0] == 50
    small = H.reduce_embedding(df.limit(20))
    assert small.select(F.size("components")).first()[0] == 60
    k = H.with_unclustered(df, H.kmeans_clusters(red), "vec_id")
    assert k.filter("cluster = -1").count() == 2 and k.filter("cluster >= 0").select("cluster").distinct().count() <= 3


def edges(spark, rows):
    return spark.createDataFrame([(a, b, math.exp(-w)) for a, b, w in rows], "src string, dst string, confidence double")


def test_shortest_paths_by_hand(spark):
    g = G.build_graph(edges(spark, [("SDC1", "ITGB1", 1), ("ITGB1", "PTK2", 1), ("PTK2", "YAP1", 1), ("ITGB1", "RHOA", 1), ("A", "B", 1)]))
    src = spark.createDataFrame([("SDC1",), ("NONE",), ("YAP1",)], "source string")
    p = {(r["source"], r["node"]): r for r in G.shortest_paths(g, src).collect()}
    assert abs(p["SDC1", "YAP1"]["distance"] - 3) < 1e-9 and abs(p["SDC1", "RHOA"]["distance"] - 2) < 1e-9
    assert p["SDC1", "YAP1"]["path"] == ["SDC1", "ITGB1", "PTK2", "YAP1"]
    assert ("SDC1", "A") not in p and not any(s == "NONE" for s, _ in p)
    t = spark.createDataFrame([("YAP1",), ("RHOA",)], "target string")
    m = {r["source"]: r for r in G.median_inverse(G.shortest_paths(g, src), src, t).collect()}
    assert abs(m["SDC1"]["score"] - (1 / 4 + 1 / 3) / 2) < 1e-9 and m["NONE"]["score"] == 0 and m["NONE"]["reachable"] == 0
    none = {r["source"]: r["score"] for r in G.median_inverse(G.shortest_paths(g, src), src, t.filter("false")).collect()}
    assert none["SDC1"] == 0
    self_only = G.median_inverse(G.shortest_paths(g, src), src, t.filter("target = 'YAP1'")).filter("source = 'YAP1'").first()
    assert self_only["score"] == 1.0


def test_graph_build_and_overlay(spark):
    e = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.9), ("a", "c", 0.0), ("c", "d", 0.4)], "src string, dst string, confidence double")
    g = G.build_graph(e)
    assert {(r["src"], r["dst"], r["confidence"]) for r in g.collect()} == {("a", "b", 0.9), ("c", "d", 0.4)}
    cur = spark.createDataFrame([("d", "c", 0.4), ("b", "a", 0.95), ("x", "y", 0.5)], "src string, dst string, confidence double")
    o = {(r["src"], r["dst"]): (r["change"], r["confidence"]) for r in G.overlay_curated(g, cur).collect()}
    assert o == {("a", "b"): ("upgraded", 0.95), ("c", "d"): ("kept", 0.4), ("x", "y"): ("added", 0.5)}


def test_weighted_median(spark):
    cases = {"odd": ([.1, .4, .3, .8, .2], [1 / 5] * 5, .3), "heavy": ([.1, .2, .9], [.1, .1, .8], .9), "null": ([None, .5, .7], [.4, .4, .2], .5),
             "even": ([1.0, 2, 3, 4], [.25] * 4, 2.0), "twelve": ([float(i) for i in range(12)], [1 / 12] * 12, 5.0), "none": ([None, None], [.5, .5], None)}
    rows = [(k, float(v) if v is not None else None, float(w)) for k, (vs, ws, _) in cases.items() for v, w in zip(vs, ws)]
    got = {r["k"]: r["score"] for r in G.weighted_median(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w").collect()}
    assert got == {k: c[2] for k, c in cases.items()}


def test_target_weights(spark):
    panel = spark.createDataFrame([(t,) for ts, _, _ in G.FEATURE_TARGETS.values() for t in ts], "target string").distinct()
    ft, co = G.feature_targets(spark), G.fallback_cohort(spark)
    assert panel.count() == 15

    def weights(rows):
        z = G.feature_z(spark.createDataFrame(rows, "field_id int, yap_nc_ratio double"), co, ["field_id"])
        return z, {r["target"]: r["weight"] for r in G.target_weights(z, ft, panel, ["field_id"]).collect()}

    _, flat = weights([(1, 1.0), (1, 1.0)])
    assert all(abs(w - 1 / 15) < 1e-12 for w in flat.values())
    z, w = weights([(1, v) for v in (2.5, 2.8, 3.0, 2.7)])
    assert w["YAP1"] > 0.15 and w["WWTR1"] > 0.15 and w["RHOA"] < 0.02 and abs(sum(w.values()) - 1) < 1e-12 and min(w.values()) > 0
    s = {r["target"]: r["z"] for r in G.signed_target_z(z, ft, panel, ["field_id"]).collect()}
    assert s["YAP1"] > 5 and s["PIEZO1"] == 0


def test_uniform_weights_reproduce_the_static_ranking(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i:02d}", f"t{j:02d}", float(rng.random())) for i in range(22) for j in range(15)]
    p = spark.createDataFrame(rows, "gene string, target string, inverse double")
    r = G.rank_genes(p.groupBy("gene").agg(F.median("inverse").alias("score")))
    prior = p.join(r, "gene").withColumn("source", F.lit("s"))
    w = p.select("target").distinct().withColumn("weight", F.lit(1 / 15))
    d = G.rerank(prior, w)
    assert d.filter("delta <> 0").count() == 0 and d.count() == 22


def _reranked(prior, weights, z):
    """field, source, gene -> score, signed score, static and dynamic rank, by plain loops."""

    def median(pairs):
        pairs = sorted((v, w) for v, w in pairs if v is not None and not np.isnan(v) and w > 0)
        half, run = sum(w for _, w in pairs) / 2 * (1 - 1e-12), 0.0
        for v, w in pairs:
            run += w
            if run >= half:
                return v
        return None

    out = {}
    for f in weights:
        rows = []
        for s, g in sorted({(s, g) for s, g, _, _, _ in prior}):
            mine = [(t, v) for s2, g2, _, t, v in prior if (s2, g2) == (s, g) and t in weights[f]]
            static = max(r for s2, g2, r, _, _ in prior if (s2, g2) == (s, g))
            signed = [(np.sign(z[f][t]) * v if v is not None else None, weights[f][t]) for t, v in mine if t in z[f]]
            rows.append((s, g, static, median([(v, weights[f][t]) for t, v in mine]), median(signed)))
        for s in {r[0] for r in rows}:
            ordered = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3] is None, -(r[3] or 0), r[2], r[1]))
            out |= {(f, s, r[1]): (r[3], r[4], r[2], i) for i, r in enumerate(ordered, 1)}
    return out


def test_rerank_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    targets = [f"t{j}" for j in range(7)]
    prior = [(s, f"g{i:02d}", i + 1, t, [None, float("nan"), 0.5, float(rng.random())][min(3, int(rng.integers(0, 9)))])
             for s in ("a", "b") for i in range(14) for t in targets if rng.random() < 0.8]
    prior += [("a", "g99", 99, "elsewhere", 1.0), ("b", "g98", 98, "t0", 0.25), ("b", "g98", 98, "t0", 0.75)]  # no shared target; a repeated one
    weights = {f: {t: float(w) for t, w in zip(targets[:6], rng.choice([0.0, 0.1, 0.2, 0.4], 6), strict=True)} for f in (1, 2, 3)}
    z = {f: {t: float(v) for t, v in zip(targets[1:], rng.choice([-1.5, 0.0, 2.0], 6), strict=True)} for f in (1, 2)} | {3: {}}
    p = spark.createDataFrame(prior, "source string, gene string, rank int, target string, inverse double").withColumn("score", F.lit(0.0))
    w = spark.createDataFrame([(f, t, v) for f, r in weights.items() for t, v in r.items()], "field_id int, target string, weight double")
    s = spark.createDataFrame([(f, t, v) for f, r in z.items() for t, v in r.items()], "field_id int, target string, z double")
    d = G.rerank(p, w, ["field_id"], s)
    got = {(r["field_id"], r["source"], r["gene"]): (r["score"], r["signed_score"], r["static_rank"], r["dynamic_rank"]) for r in d.collect()}
    assert got == _reranked(prior, weights, z)
    one = G.rerank(p, w.filter("field_id = 1").drop("field_id"), (), s.filter("field_id = 1").drop("field_id")).collect()
    assert {(1, r["source"], r["gene"]): (r["score"], r["signed_score"], r["static_rank"], r["dynamic_rank"]) for r in one} == {k: v for k, v in got.items() if k[0] == 1}
    assert G.rerank(p, w.limit(0), ["field_id"], s).isEmpty() and G.rerank(p.limit(0), w, ["field_id"], s).isEmpty()


def test_rerank_shuffles_no_target_rows(spark):
    p = spark.createDataFrame([("a", "g", 1, "t", 1.0)], "source string, gene string, rank int, target string, inverse double")
    w = spark.createDataFrame([(1, "t", 1.0)], "field_id int, target string, weight double")
    plan = G.rerank(p, w, ["field_id"], w.withColumnRenamed("weight", "z"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Generate explode" not in plan and "Generate inline" not in plan


def test_prior_table_and_status(spark):
    a = spark.createDataFrame([("SDC1", 1, .92), ("SDC4", 2, .88), ("EXT1", 3, .71)], "gene string, rank int, score double")
    b = spark.createDataFrame([("SDC1", 3, .71), ("SDC4", 2, .83), ("EXT1", 1, .95)], "gene string, rank int, score double")
    assert {r["gene"]: r["divergence"] for r in G.rank_divergence(a, b).collect()} == {"SDC1": 2, "SDC4": 0, "EXT1": 2}
    assert G.rank_divergence(a, b.limit(0)).isEmpty()
    meta = {"ok": {"generated_utc": "2025-06-01T00:00:00+00:00"}, "old": {"generated_utc": "2024-01-01T00:00:00Z"}, "undated": {}, "odd": {"generated_utc": "yesterday"},
            "err": {"error": "boom"}, "few": {}, "nan": {}, "zero": {}, "empty": {}}
    m = spark.createDataFrame([(k, True, v) for k, v in meta.items()] + [("gone", False, {})], "source string, available boolean, metadata map<string,string>")
    genes = [(k, f"GENE{i:02d}", i + 1, .5 + .01 * i) for k in meta if k != "empty" for i in range(16 if k == "few" else 20)]
    genes = [(k, g, 0 if k == "zero" and r == 3 else r, float("nan") if k == "nan" and r == 3 else s) for k, g, r, s in genes]
    got = {r["source"]: r["status"] for r in G.prior_status(m, spark.createDataFrame(genes, "source string, gene string, rank int, score double"), F.to_timestamp(F.lit("2025-06-30T00:00:00Z"))).collect()}
    assert got == {"ok": "ready", "old": "stale", "undated": "ready", "odd": "ready", "err": "invalid", "few": "invalid", "nan": "invalid", "zero": "invalid", "empty": "invalid", "gone": "missing"}


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Labels, degrees and blocks of a graph in blocks meet its edges by merging, though all of them are small here."""
    ring = [(u, v, 1.0) for g in range(120) for u in range(g * 5, g * 5 + 5) for v in range(g * 5, g * 5 + 5) if u != v]
    spark.createDataFrame(ring, "src long, dst long, weight double").write.parquet(str(tmp_path / "g"))
    graph = spark.read.parquet(str(tmp_path / "g"))
    plans = []
    real = H.pin
    monkeypatch.setattr(H, "pin", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    c = H.communities(graph, small=600)
    assert c.select("community").distinct().count() == 120
    plans += [H.modularity(graph, c)._jdf.queryExecution().executedPlan().toString()]
    node = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "lead" not in line and "_k" not in line]
    assert not node and sum(p.count("SortMergeJoin") for p in plans) > 8
