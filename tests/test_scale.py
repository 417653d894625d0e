"""The distributed paths must agree with plain computation when groups are forced to be cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytofleet.operators import population as P
from cytofleet.operators import scale as C
from cytofleet.operators import screen as Q


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 20, n))
    # a third of one group shares a single value
    v = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.gamma(1.0, 10.0, n), 2))
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "v": v, "w": rng.normal(size=n).round(1)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("limit", [10, None])
def test_ranks_and_quantiles(skewed, limit):
    pdf, df = skewed
    got = C.value_ranks(df, ["k"], "v", limit).toPandas().set_index(["k", "v"])["rank"]
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first()
    assert np.allclose(got.sort_index(), want.sort_index())
    q = C.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.995}, limit=limit).toPandas().set_index("k").sort_index()
    ref = pdf.groupby("k")["v"].quantile([0.1, 0.5, 0.995]).unstack()
    assert np.allclose(q[["a", "b", "c"]], ref)


@pytest.mark.parametrize("limit", [10, None])
def test_spearman_and_rank_sum(skewed, limit):
    pdf, df = skewed
    d = df.withColumn("u", F.when(F.col("id") % 5 > 0, F.col("w") + F.col("v") / 10))
    s = Q.correlation_screen(d.withColumnRenamed("id", "cell_id").withColumn("field_id", F.lit(1)), ["v", "u"], ["w"], limit=limit).toPandas().set_index("a")
    pu = pdf.assign(u=np.where(pdf.id % 5 > 0, pdf.w + pdf.v / 10, np.nan))
    for a in ("v", "u"):
        ok = pu[a].notna()
        assert abs(s.loc[a, "r"] - pu.loc[ok, a].rank().corr(pu.loc[ok, "w"].rank())) < 1e-9
        assert s.loc[a, "n"] == ok.sum()
    u = Q.rank_sum(df.withColumn("arm", F.when(F.col("k") == 0, "a").otherwise("b")).withColumnRenamed("v", "value"), "arm", "a", [], limit=limit).first()
    r = pdf["v"].rank()
    na = (pdf.k == 0).sum()
    assert u["u"] == r[pdf.k == 0].sum() - na * (na + 1) / 2


def test_adjacent_cells_across_cut_groups(skewed):
    pdf, df = skewed
    d = df.select(F.col("k").alias("field_id"), F.col("id").alias("cell_id"))
    a = P.adjacent_cells(d).toPandas().sort_values("cell_id").reset_index(drop=True)
    b = P.adjacent_cells(d, limit=10).toPandas().sort_values("cell_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_hash_order_is_a_permutation(skewed):
    from cytofleet.functions.scalar import mix31

    _, df = skewed
    for buckets in (None, 1, 64):
        o = Q.hash_order(df.withColumn("h", mix31(1, "id")), ["k"], "h", ["id"], "pos", buckets).toPandas()
        for _, g in o.groupby("k"):
            assert sorted(g["pos"]) == list(range(len(g)))
            assert list(g.sort_values("pos")["h"]) == sorted(g["h"])


def test_attach_stats_has_no_group_window(skewed):
    _, df = skewed
    plan = C.attach_stats(df, ["k"], F.avg("v").alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_one_large_batch_is_written_by_several_tasks(spark):
    from cytofleet.sources import tables as A
    c = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("cell_id"), F.lit("N").alias("batch"), F.xxhash64("id").alias("v"))
    path, key = A.shared_path(spark, "test-features"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "200KB")
    try:
        A.write_features(c, path, partition=["batch"])
    finally:
        spark.conf.unset(key)
    back = spark.read.parquet(path)
    assert back.select(F.input_file_name()).distinct().count() > 1
    assert back.count() == 200_000 and back.select("cell_id", "v").exceptAll(c.select("cell_id", "v")).isEmpty()


def test_batch_correction_does_not_gather_a_batch(spark):
    from cytofleet.operators import population as P
    c = spark.range(0, 300, 1, 4).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("batch"), (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        out = P.combat(c, ["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 300
    finally:
        spark.conf.unset(key)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(batch" not in plan and "SortMergeJoin" not in plan


def test_views_are_counted_in_one_pass(spark):
    from cytofleet.operators import rules as B
    flags = [[], ["edge-truncated cell"], ["saturated WGA channel"], ["overlapping/touching cells"], []]
    rows = [(i % 3, i, flags[i % 5], i % 5 in (0, 3) and i % 7 != 1) for i in range(60)] + [(9, 99, ["edge-truncated cell"], False)]
    f = spark.createDataFrame(rows, "field_id long, cell_id long, flags array<string>, analysis_ready boolean")
    views = {"all": {"mode": "all"}, "ready": {}, "failed": {"mode": "qc_failed"}, "unsaturated": {"exclude_edge": True, "exclude_saturated": True}}
    want = {(name, r["field_id"], r["count"]) for name, v in views.items() for r in B.visible_cells(f, **v).groupBy("field_id").count().collect()}
    got = B.count_visible(f, views)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["mode", "field_id", "n"]
    assert plan.count("Exchange hashpartitioning") == 1


def test_bootstrap_draws_in_pieces_as_the_hash_says(spark):
    """A field that is cut into pieces gets the slopes of plain weighted sums; the array hash equals the column hash."""
    from cytofleet.functions.scalar import mix31, mix31_numpy
    from cytofleet.operators import population as P
    rng = np.random.default_rng(2)
    n = 240
    pdf = pd.DataFrame({"field_id": [None if i % 3 == 0 else float(i % 3) for i in range(n)], "a": rng.integers(0, 2**40, n), "b": rng.integers(0, 9, n), "x": 1e4 + rng.normal(size=n)})
    pdf["y"] = 2 * pdf["x"] + rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("field_id", F.when(~F.isnan("field_id"), F.col("field_id").cast("long")))
    hashed = df.select("a", "b", mix31(42, F.lit(7), "a", "b").alias("h")).toPandas()
    assert (mix31_numpy(42, np.full(n, 7), hashed["a"].to_numpy(), hashed["b"].to_numpy()) == hashed["h"].to_numpy()).all()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "16")
    try:
        got = {r["field_id"]: r for r in P.bootstrap_slope_ci(df, "y", "x", ["a", "b"], resamples=40).collect()}
    finally:
        spark.conf.unset(key)
    assert set(got) == {None, 1, 2}
    for f, g in pdf.groupby(pdf["field_id"].fillna(-1)):
        slopes = []
        for r in range(40):
            u = mix31_numpy(42, np.full(len(g), r), g["a"].to_numpy(), g["b"].to_numpy()) / 2147483647.0
            w = np.searchsorted(P.POISSON1_CDF, u, side="right")
            x, y = g["x"] - g["x"].mean(), g["y"] - g["y"].mean()
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            slopes.append((w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum())
        row = got[None if f < 0 else int(f)]
        assert np.allclose([row["slope_ci_lo"], row["slope_ci_hi"]], np.percentile(slopes, [2.5, 97.5]), atol=1e-7) and row["n_resamples"] == 40
