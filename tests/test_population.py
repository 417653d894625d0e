import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytofleet.functions.scalar import mix31
from cytofleet.operators import population as P
from cytofleet.operators import rules as B
from cytofleet.operators import screen as Q


def frame(spark, **cols):
    pdf = pd.DataFrame(cols)
    df = spark.createDataFrame(pdf)
    from cytofleet.schema import nan_to_null
    return nan_to_null(df)


def test_residualisation_recovers_slope_and_gates(spark):
    rng = np.random.default_rng(7)
    n = 200
    area = rng.uniform(500, 5000, n)
    y = 2 + 0.001 * area + rng.normal(0, 0.05, n)
    noise = rng.normal(0, 1, n)
    df = frame(spark, field_id=[1] * n + [2] * n + [3] * 3, cell_id=list(range(2 * n + 3)),
               cell_area=list(area) + list(area) + [100.0, 500.0, 1000.0], yap_nc_ratio=list(y) + list(noise) + [1.0, 1.5, 2.0])
    r = P.residualise(df).toPandas()
    a, b, c = (r[r.field_id == i] for i in (1, 2, 3))
    assert abs(a["slope"].iloc[0] / 0.001 - 1) < 0.15 and a["r2"].iloc[0] > 0.95 and a["applied"].all()
    assert abs(np.corrcoef(a["yap_nc_ratio_size_corrected"], a["cell_area"])[0, 1]) < 0.05
    assert not b["applied"].any() and (b["yap_nc_ratio_size_corrected"] == b["yap_nc_ratio"]).all()
    assert c["slope"].isna().all() and not c["applied"].any()
    assert P.residualise(df.drop("cell_area")).filter("yap_nc_ratio_size_corrected is not null").count() == 0
    ci = P.bootstrap_slope_ci(df.filter("field_id < 3"), "yap_nc_ratio", "cell_area", ["cell_id"], resamples=100).toPandas().set_index("field_id")
    s = a["slope"].iloc[0]
    assert ci.loc[1, "slope_ci_lo"] < s < ci.loc[1, "slope_ci_hi"] and ci.loc[1, "slope_ci_hi"] - ci.loc[1, "slope_ci_lo"] < 2e-4


def score_frame(spark, sizes):
    rng = np.random.default_rng(42)
    out = []
    for f, n in sizes.items():
        lat = rng.normal(size=n)
        d = {"field_id": f, "cell_id": np.arange(n)}
        for c in P.SCORE_PANEL[:7]:
            d[c] = lat + rng.normal(0, 0.3, n)
        d["actin_cortical_ratio"] = rng.normal(1, 0.3, n)
        d["nuclear_aspect_ratio"] = rng.normal(1.5, 0.3, n)
        d["nuclear_solidity"] = rng.normal(0.95, 0.05, n)
        d["nuclear_to_cell_area_ratio"] = rng.normal(0.15, 0.05, n)
        out.append(pd.DataFrame(d))
    return pd.concat(out)


def test_composite_score_against_numpy(spark):
    pdf = score_frame(spark, {1: 200, 2: 10})
    df = spark.createDataFrame(pdf)
    s = P.composite_score(df).toPandas()
    one = s[s.field_id == 1].sort_values("cell_id")
    names = [c.lstrip("-") for c in P.SCORE_PANEL]
    sign = np.array([-1 if c.startswith("-") else 1 for c in P.SCORE_PANEL])
    x = pdf[pdf.field_id == 1][names].to_numpy() * sign
    z = (x - x.mean(0)) / x.std(0)
    val, vec = np.linalg.eigh(np.cov(z, rowvar=False))
    v = vec[:, -1] * np.sign(vec[0, -1])
    assert np.allclose(one["mechano_score"], z @ v, atol=1e-8)
    assert abs(one["explained"].iloc[0] - val[-1] / val.sum()) < 1e-10 and one["explained"].iloc[0] > 0.3
    two = s[s.field_id == 2].sort_values("cell_id")
    x2 = pdf[pdf.field_id == 2][names].to_numpy() * sign
    assert np.allclose(two["mechano_score"], ((x2 - x2.mean(0)) / x2.std(0)).mean(1)) and set(two["score_mode"]) == {"weighted_sum"}
    m = {r["field_id"]: r for r in P.score_summary(P.composite_score(df)).collect()}
    assert m[1]["mode"] == "pca" and m[1]["n_used"] == 200 and m[1]["p_used"] == 11 and m[2]["n_used"] == 10
    assert m[1]["loadings"]["yap_nc_ratio_size_corrected"] > 0 and "cell_spread_area" not in m[1]["loadings"]


def test_two_fields_together_equal_each_alone(spark):
    pdf = score_frame(spark, {1: 80, 2: 90})
    both = P.composite_score(spark.createDataFrame(pdf)).toPandas().sort_values(["field_id", "cell_id"])
    alone = pd.concat([P.composite_score(spark.createDataFrame(pdf[pdf.field_id == f])).toPandas() for f in (1, 2)]).sort_values(["field_id", "cell_id"])
    assert np.allclose(both["mechano_score"], alone["mechano_score"])


def test_combat_converges_and_needs_three_batches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b, sh, sc in (("p", 0, 1), ("q", 1.5, 1.2), ("r", -0.8, 0.7)):
        bio = rng.normal(size=50)
        rows.append(pd.DataFrame({"batch": b, "biology": bio, "feature_a": 5 + bio + sh + rng.normal(0, 0.3, 50), "feature_b": (10 + bio) * sc + rng.normal(0, 0.3, 50)}))
    pdf = pd.concat(rows)
    df = spark.createDataFrame(pdf)
    c = P.combat(df, ["feature_a", "feature_b"]).toPandas()
    spread = lambda d: np.ptp(d.groupby("batch")["feature_a"].mean())
    assert spread(c) < spread(pdf) / 3 and np.corrcoef(c["feature_a"], c["biology"])[0, 1] > 0.5
    two = df.filter("batch <> 'r'")
    assert P.combat(two, ["feature_a"]).exceptAll(two.select(P.combat(two, ["feature_a"]).columns)).count() == 0
    s = P.batch_effect_summary(df, ["feature_a", "feature_b"]).first()
    assert s["applicable"] and s["max_ratio"] > 1
    assert not P.batch_effect_summary(df.filter("batch = 'p'"), ["feature_a"]).first()["applicable"]


def test_combat_leaves_small_batches_alone(spark):
    rng = np.random.default_rng(4)
    pdf = pd.concat([pd.DataFrame({"batch": b, "v": rng.normal(i, 1, n)}) for i, (b, n) in enumerate((("a", 30), ("b", 30), ("c", 30), ("d", 3)))])
    c = P.combat(spark.createDataFrame(pdf), ["v"]).toPandas()
    assert np.allclose(sorted(c[c.batch == "d"]["v"]), sorted(pdf[pdf.batch == "d"]["v"]))
    assert not np.allclose(sorted(c[c.batch == "c"]["v"]), sorted(pdf[pdf.batch == "c"]["v"]))


def screen_frame(spark, n=200):
    rng = np.random.default_rng(11)
    lat = rng.normal(size=n)
    d = {c: rng.normal(size=n) for c in Q.BLOCK_A + Q.BLOCK_B}
    d["glycocalyx_haralick_contrast"] = 0.5 + 0.4 * lat + rng.normal(0, 0.05, n)
    d["fa_mature_fraction"] = 0.5 + 0.4 * lat + rng.normal(0, 0.05, n)
    d["glycocalyx_moran_i"] = np.ones(n)
    return frame(spark, field_id=[1] * n, cell_id=list(range(n)), **d)


def test_screen_finds_the_engineered_pair(spark):
    s = Q.benjamini_hochberg(Q.with_parametric_p(Q.correlation_screen(screen_frame(spark))))
    pdf = s.toPandas()
    assert len(pdf) == 144
    flat = pdf[pdf.a == "glycocalyx_moran_i"]
    assert flat[["r", "p", "q"]].isna().all().all()
    ok = pdf.dropna().sort_values("p")
    assert (ok["q"] >= ok["p"] - 1e-15).all() and ok["q"].between(0, 1).all() and ok["q"].is_monotonic_increasing
    h = Q.screen_headline(s).first()
    assert (h["a"], h["b"]) == ("glycocalyx_haralick_contrast", "fa_mature_fraction") and abs(h["r"]) > 0.85 and h["n_tested"] == 132 and h["n_significant"] >= 1


def test_screen_counts_values_once_and_equals_brute_force(spark, monkeypatch):
    """Different NULL patterns, ties and NaN: looked-up ranks, joined ranks and pandas agree; rows are fanned out once per feature."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({f: np.round(rng.normal(size=150), 1) for f in ("a1", "a2", "b1", "b2", "b3")})
    pdf.loc[::7, "a2"], pdf.loc[::5, "b2"], pdf["b3"] = None, None, 2.0
    d = frame(spark, cell_id=np.arange(150), field_id=np.zeros(150, int), **{c: pdf[c] for c in pdf})
    fanned = []
    real = Q.prefix_sums
    monkeypatch.setattr(Q, "prefix_sums", lambda df, *a, **k: fanned.append(df.agg(F.sum("n")).first()[0]) or real(df, *a, **k))
    seen = []
    for bound in (300_000, 0):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", bound)
        got = {(r["a"], r["b"]): r for r in Q.correlation_screen(d, ["a1", "a2"], ["b1", "b2", "b3"]).collect()}
        assert len(got) == 6
        for (a, b), r in got.items():
            x = pdf[[a, b]].dropna()
            assert r["n"] == len(x)
            assert r["r"] is None if b == "b3" else abs(r["r"] - x[a].rank().corr(x[b].rank())) < 1e-12
        seen.append(got)
    assert len(fanned) == 2 and all(abs((seen[0][p]["r"] or 0) - (seen[1][p]["r"] or 0)) < 1e-12 for p in seen[0])


def test_permutation_p_floor_and_null(spark):
    d = screen_frame(spark, 60)
    a = Q.permutation_p(d, "glycocalyx_haralick_contrast", "fa_mature_fraction", 99, ["cell_id"]).first()
    assert a["p"] == 0.01
    b = Q.permutation_p(d, "glycocalyx_coverage", "nuclear_solidity", 99, ["cell_id"]).first()
    assert 0.01 < b["p"] <= 1.0
    assert Q.permutation_p(d, "glycocalyx_moran_i", "nuclear_solidity", 9, ["cell_id"]).first()["p"] is None


def test_permuted_positions_are_even_bijections(spark):
    """Every size gets a permutation per number; each place is hit about equally often; the plan repeats no round."""
    sizes = [1, 2, 3, 5, 7, 12, 37, 91, 545, 4097]
    d = frame(spark, n=sizes).select(F.col("n").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    d = Q.permuted_position(d.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(40)))), "pos", "n", "perm", "at")
    g = d.groupBy("n", "perm").agg(F.countDistinct("at").alias("k"), F.min("at").alias("lo"), F.max("at").alias("hi")).toPandas()
    assert len(g) == 40 * len(sizes) and (g.k == g.n).all() and (g.lo == 0).all() and (g.hi == g.n - 1).all()
    e = spark.range(7).select(F.col("id").alias("pos"), F.lit(7).cast("bigint").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(7000))).alias("perm"))
    seen = Q.permuted_position(e, "pos", "n", "perm", "at").groupBy("pos", "at").count().toPandas()
    assert len(seen) == 49 and seen["count"].between(850, 1150).all()


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_permutation_p_equals_brute_force(spark, monkeypatch, bound):
    """With positions broadcast and joined: p of two groups against ranks and permutations put together in numpy, rows of equal keys and ties included."""
    monkeypatch.setattr(Q, "POSITION_ROWS", bound)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": [0] * 23 + [1] * 40, "k": [0] * 5 + list(range(58)), "x": rng.integers(0, 9, 63) * 1.0, "y": rng.integers(0, 15, 63) * 1.0})
    got = {r["g"]: r for r in Q.permutation_p(spark.createDataFrame(pdf), "x", "y", 200, ["k"], ["g"]).collect()}
    moved = Q.permuted_position(spark.createDataFrame([(n,) for n in (23, 40)], "n bigint").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
                                .withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(200)))), "pos", "n", "perm", "at").toPandas()
    order = spark.createDataFrame(pdf).select("g", "k", "x", "y", mix31(42, "k").alias("h")).toPandas().sort_values(["g", "h", "k", "x", "y"])
    for g, part in order.groupby("g"):
        rx, ry = part.x.rank().to_numpy() * 2, part.y.rank().to_numpy() * 2
        n, c = len(part), lambda s: abs(len(part) * s - rx.sum() * ry.sum())
        maps = moved[moved.n == n].sort_values(["perm", "pos"])["at"].to_numpy().reshape(200, n)
        extreme = int((np.array([c((rx * ry[m]).sum()) for m in maps]) >= c((rx * ry).sum())).sum())
        assert (got[g]["n"], got[g]["extreme"], got[g]["p"]) == (n, extreme, (extreme + 1) / 201)


def test_all_null_screen_is_safe(spark):
    d = screen_frame(spark, 20).withColumns({c: F.lit(None).cast("double") for c in Q.BLOCK_A})
    s = Q.benjamini_hochberg(Q.with_parametric_p(Q.correlation_screen(d)))
    assert s.filter("r is not null or q is not null").count() == 0 and s.count() == 144
    assert Q.screen_headline(s).isEmpty() or Q.screen_headline(s).first()["n_tested"] == 0


def test_power_grows_with_the_effect(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, row=list(range(2000)), v=list(rng.normal(10, 3, 2000)))
    g = Q.power_scan(df, ["v"], ["row"], cells_per_arm=40, replicates=12).toPandas().set_index("effect")["power"]
    assert set(g.index) == set(Q.EFFECTS) and g[1.0] == 0 and g[2.0] == 1.0 and g[0.5] == 1.0 and g[1.1] < 0.9
    m = Q.min_detectable(spark.createDataFrame([("v", 0.9, 0.85), ("v", 1.1, 0.9), ("v", 1.5, 1.0), ("w", 1.1, 0.2)], "feature string, effect double, power double")).toPandas().set_index("feature")
    assert m.loc["v", "min_detectable_effect"] == 0.9 and math.isnan(m.loc["w", "min_detectable_effect"])


@pytest.mark.parametrize("margin", [6.0, -4.0, -1e9])
def test_hash_draws_are_the_smallest_hashes(spark, margin):
    # negative margins come out short at first and are drawn again
    df = frame(spark, row=list(range(700)) + [3, 3]).withColumn("row", F.col("row").cast("long"))
    got = sorted((r["replicate"], r["_i"], r["row"]) for r in Q.hash_draws(df, ["row"], 40, 5, 42, margin).collect())
    tagged = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("r", mix31(42, "r", "row").alias("h"), "row").collect()
    want = []
    for k in range(1, 6):
        mine = sorted((t["h"], t["row"]) for t in tagged if t["r"] == k)[:40]
        want += [(k, i, row) for i, (_, row) in enumerate(mine, 1)]
    assert got == want
    few = Q.hash_draws(df.limit(7), ["row"], 40, 5, 42, margin)
    assert few.count() == 35 and Q.hash_draws(df.limit(0), ["row"], 40, 5, 42, margin).isEmpty()


def test_qc_rules(spark):
    n = 60
    df = frame(spark, field_id=[1] * n, cell_id=list(range(n)), cell_area=[1000.0] * (n - 2) + [30.0, 1000.0], nuclear_area=[200.0] * (n - 2) + [10.0, 200.0],
               cell_solidity=[0.9] * (n - 1) + [0.6], bbox_x0=[5] * n, bbox_y0=[5] * n, bbox_x1=[20] * n, bbox_y1=[20] * (n - 1) + [99], height=[100] * n, width=[100] * n)
    r = {x["cell_id"]: x for x in B.qc_flags(df).collect()}
    assert r[0]["analysis_ready"] and r[0]["flags"] == []
    assert "high debris probability" in r[n - 2]["blocking_flags"] and "low nuclear signal" in r[n - 2]["flags"]
    assert r[n - 1]["flags"] == ["edge-truncated cell", "segmentation confidence low", "overlapping/touching cells"]
    assert r[n - 1]["blocking_flags"] == ["edge-truncated cell", "segmentation confidence low"]
    q = P.field_qc(B.qc_flags(df), spark.createDataFrame([(1, n + 5)], "field_id long, raw_masks long")).first()
    assert q["measured"] == n and q["ready"] == n - 2 and q["flagged"] == 2 + 5 and q["excluded"] == 7


def test_interpretation_ladder(spark):
    yes = {m: True for m in B.CORE_MARKERS}
    meta = {m: True for m in B.REQUIRED_METADATA + B.ANY_METADATA[:1]}
    rows = [("v", "assay", True, yes, meta, {"a": "validated"}), ("c", "assay", True, yes, meta, {"a": "validated", "b": "provided"}),
            ("m", "assay", True, {**yes, "yap": False}, meta, {"a": "validated"}), ("d", "technical_demo", True, yes, meta, {"a": "validated"}), ("n", "assay", None, yes, meta, {})]
    df = spark.createDataFrame(rows, "id string, dataset_type string, allowed boolean, markers map<string,boolean>, metadata map<string,boolean>, controls map<string,string>")
    got = {r["id"]: r["interpretation_level"] for r in B.interpretation_level(df).collect()}
    assert got == {"v": "validated_biological_inference", "c": "phenotype_comparison", "m": "marker_quantification", "d": "technical_demo", "n": "technical_demo"}


def test_records_keep_nulls(spark):
    from cytofleet.sources import tables as A
    df = frame(spark, field_id=[1, 2], a=[1.5, float("nan")], deep_0=[0.0, 1.0])
    back = A.from_records(A.to_records(df), df.drop("deep_0").schema)
    assert sorted(map(tuple, back.collect()), key=str) == [(1, 1.5), (2, None)]
    assert json.loads(A.summary_records(df.drop("deep_0")).first()["value"])["seed"] == 42


def test_z_projection_and_channels(spark):
    from cytofleet.sources import tables as A
    rows = [(1, "c", 0, z, 0, 0, {3: 1.0, 5: 0.5}.get(z, 0.0)) for z in range(7)] + [(2, "c", t, z, 0, 0, {(0, 1): 0.7, (1, 2): 0.9}.get((t, z), 0.0)) for t in range(3) for z in range(4)] + [(3, "c", 0, 0, 0, 0, 0.3)]
    r = {x["field_id"]: x for x in A.z_project(spark.createDataFrame(rows, "field_id int, channel string, t int, z int, y int, x int, value double")).collect()}
    assert (r[1]["value"], r[1]["planes"]) == (1.0, 7) and (r[2]["value"], r[2]["planes"]) == (0.7, 4) and (r[3]["value"], r[3]["planes"]) == (0.3, None)
    with pytest.raises(ValueError):
        A.validated_panel(spark.createDataFrame([("p", "a")], "panel string, gene string"), spark.createDataFrame([("p", 2)], "panel string, size int"))


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_permutations_of_small_groups_shuffle_rows_only(spark, monkeypatch, bound):
    """A group that fits a task is permuted there, without a join; large groups in blocks have the same rows."""
    rng = np.random.default_rng(6)
    d = frame(spark, g=[0] * 3 + [1] * 30 + [2] * 70 + [3] * 9, k=rng.permutation(112) // 2 * 1, x=rng.integers(0, 9, 112) * 1.0, y=[*rng.integers(0, 15, 103) * 1.0, *[2.0] * 9])
    whole = Q.permutation_p(d, "x", "y", 150, ["k"], ["g"])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan and plan.count("Exchange hashpartitioning") == 1
    once = sorted(whole.collect())
    assert [(r["g"], r["n"], r["p"] is None) for r in once] == [(0, 3, True), (1, 30, False), (2, 70, False), (3, 9, True)]
    for name, value in (("PERMUTED_ROWS", 20), ("PERMUTED_BLOCK", 16), ("POSITION_ROWS", bound)):
        monkeypatch.setattr(Q, name, value)
    assert sorted(Q.permutation_p(d, "x", "y", 150, ["k"], ["g"]).collect()) == once


def test_correlation_matrix_sums_pairs_inside_tasks(spark):
    """Different NULL patterns, constant sides and an empty column: the rows of one group by the fanned-out path, without fanning out."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({f: rng.normal(size=90) * 3 + 50 for f in ("a", "b", "c")})
    pdf.loc[::4, "a"], pdf.loc[::3, "b"] = None, None
    pdf["d"], pdf["e"] = 2.0, np.where(pdf["a"].isna(), rng.normal(size=90), 1.0)  # e is constant where a is there
    d = spark.createDataFrame([(1, *(None if pd.isna(v) else float(v) for v in r), None) for r in pdf.itertuples(index=False)], "field_id int, a double, b double, c double, d double, e double, f double")
    names = list("abcdef")
    got = Q.correlation_matrix(d, names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate explode") <= 1  # the mirror
    want = {(r["a"], r["b"]): (r["n"], r["r"]) for r in Q.correlation_matrix(d, names, ["field_id"]).collect()}
    rows = {(r["a"], r["b"]): (r["n"], r["r"]) for r in got.collect()}
    assert len(rows) == 36 and rows.keys() == want.keys()
    for p, (n, r) in rows.items():
        assert n == want[p][0] and ((r is None) == (want[p][1] is None)) and abs((r or 0) - (want[p][1] or 0)) < 1e-12
    assert rows["a", "e"][1] is None and rows["c", "e"][1] is not None and rows["a", "f"][0] == 0
