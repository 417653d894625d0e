import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import DISKS
from cytofleet.operators import cells as D
from cytofleet.operators import raster as R


def image(spark, arr, field=1, channel="actin"):
    y, x = np.indices(arr.shape)
    pdf = pd.DataFrame({"field_id": field, "channel": channel, "y": y.ravel(), "x": x.ravel(), "value": arr.ravel().astype(float)})
    return spark.createDataFrame(pdf.astype({"y": "int32", "x": "int32"}))


def test_tophat_removes_ramp_and_keeps_punctum(spark):
    img = np.tile(0.6 * np.arange(64) / 63, (64, 1))
    img[30:34, 30:34] = 1.0
    px = image(spark, img).unionByName(image(spark, img, channel="dapi"))
    out = R.white_tophat(px, spark.createDataFrame([(1, 10)], "field_id int, radius_px int")).toPandas()
    a = out[out.channel == "actin"].set_index(["y", "x"])["value"]
    assert a[(63, 63)] < img[63, 63] / 3 and a[(32, 32)] > 0.5
    b = out[out.channel == "dapi"].set_index(["y", "x"])["value"]
    assert abs(b[(63, 63)] - img[63, 63]) < 1e-12
    same = R.white_tophat(px, spark.createDataFrame([(1, 0)], "field_id int, radius_px int")).toPandas()
    assert np.allclose(same.sort_values(["channel", "y", "x"])["value"], px.toPandas().sort_values(["channel", "y", "x"])["value"])


def test_tophat_matches_square_filter_with_two_radii(spark):
    rng = np.random.default_rng(1)
    want = {}
    frames = []
    for f, r in ((1, 2), (2, 5)):
        img = rng.integers(0, 100, (17, 20)) / 10
        pad = np.pad(img, r, mode="symmetric")
        win = lambda a, fn: np.array([[fn(a[i:i + 2 * r + 1, j:j + 2 * r + 1]) for j in range(img.shape[1])] for i in range(img.shape[0])])  # noqa: E731, B023
        er = win(pad, np.min)
        want[f] = img - win(np.pad(er, r, mode="symmetric"), np.max)
        frames.append(image(spark, img, f))
    out = R.white_tophat(frames[0].unionByName(frames[1]), spark.createDataFrame([(1, 2), (2, 5)], "field_id int, radius_px int")).toPandas()
    for f, w in want.items():
        got = out[out.field_id == f].sort_values(["y", "x"])["value"].to_numpy().reshape(w.shape)
        assert np.allclose(got, w)


def test_components_touch_diagonally_only_inside_a_region(spark):
    rng = np.random.default_rng(3)
    m = rng.random((40, 150)) < 0.45
    y, x = np.nonzero(m)
    mask = spark.createDataFrame(pd.DataFrame({"field_id": 1, "cell_id": 1, "y": y, "x": x}))
    got = R.components(mask).toPandas()
    lab = {}
    for s in zip(y, x):  # flood fill
        if s in lab:
            continue
        todo = [s]
        lab[s] = s
        while todo:
            a, b = todo.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    t = (a + i, b + j)
                    if 0 <= t[0] < 40 and 0 <= t[1] < 150 and m[t] and t not in lab:
                        lab[t] = s
                        todo.append(t)
    want = [lab[(r.y, r.x)] for r in got.itertuples()]
    assert len(got) == len(y)
    assert got.groupby("component").ngroups == len(set(want)) == len(set(zip(got["component"], want)))


def test_star_contraction_on_a_long_path_and_a_hub(spark):
    path = [(0, i, i + 1) for i in range(1, 300)] + [(1, 500, i) for i in range(1000, 1400)]
    r = R.star_components(spark.createDataFrame(path, "k int, u long, v long"), ["k"]).toPandas()
    assert set(r[r.k == 0]["root"]) == {1} and set(r[r.k == 1]["root"]) == {500}
    assert len(r) == 300 + 401


def test_flooding_meets_halfway_and_crosses_tiles(spark):
    img = np.full((5, 40), 0.5)
    img[2, 20] = 0.0
    seeds = spark.createDataFrame([(1, 2, 0, 7), (1, 2, 39, 9)], "field_id long, y int, x int, label int")
    px = image(spark, img).drop("channel").withColumn("field_id", F.col("field_id").cast("long"))
    whole = R.seeded_growth(px, seeds, 4, tile=64).toPandas().sort_values(["y", "x"]).reset_index(drop=True)
    cut = R.seeded_growth(px, seeds, 4, tile=8).toPandas().sort_values(["y", "x"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut)
    assert len(whole) == 199  # the dark pixel stays unlabelled
    assert set(whole[whole.x < 19]["label"]) == {7} and set(whole[whole.x > 21]["label"]) == {9}


def test_structure_tensor_matches_direct_convolution(spark):
    rng = np.random.default_rng(5)
    img, s = rng.random((21, 26)), 1.3
    pad = np.pad(img, 1, mode="symmetric")
    k = np.array([1, 2, 1])
    dc = pad[:, 2:] - pad[:, :-2]
    gc = sum(k[i] * dc[i:i + 21] for i in range(3))
    dr = pad[2:] - pad[:-2]
    gr = sum(k[i] * dr[:, i:i + 26] for i in range(3))
    rad = int(4 * s + 0.5)
    w = np.exp(-np.arange(-rad, rad + 1) ** 2 / (2 * s * s))
    w /= w.sum()

    def smooth(a):
        p = np.pad(a, rad, mode="symmetric")
        p = sum(w[i] * p[i:i + 21] for i in range(2 * rad + 1))
        return sum(w[i] * p[:, i:i + 26] for i in range(2 * rad + 1))

    want = [smooth(gr * gr), smooth(gr * gc), smooth(gc * gc)]
    t = R.structure_tensor(image(spark, img), spark.createDataFrame([(1, s)], "field_id int, sigma_px double"), 2.0).toPandas().sort_values(["y", "x"])
    for name, ref in zip(("arr", "arc", "acc"), want):
        assert np.allclose(t[name].to_numpy().reshape(21, 26), ref)


def test_stripes_have_a_fibre_direction(spark):
    y, x = np.indices((40, 40))
    mask = spark.createDataFrame(pd.DataFrame({"field_id": 1, "cell_id": 1, "y": y.ravel(), "x": x.ravel()}))
    sig = spark.createDataFrame([(1, 2.0)], "field_id int, sigma_px double")
    # varies along x only: fibres run along y, which is angle 0 (angles start at the row axis)
    f = R.fibre_features(R.structure_tensor(image(spark, np.sin(x / 2.0)), sig, 2.0), mask).first()
    assert f["coherence"] > 0.99 and abs(f["orientation_deg"]) < 1e-6


def test_moran_signs(spark):
    y, x = np.indices((10, 10))
    base = pd.DataFrame({"field_id": 1, "cell_id": 1, "y": y.ravel(), "x": x.ravel()})
    check = spark.createDataFrame(base.assign(value=((y + x) % 2).ravel().astype(float)))
    assert abs(R.moran_on_mask(check).first()["moran_i"] + 1) < 1e-12
    assert R.moran_on_mask(spark.createDataFrame(base.assign(value=y.ravel().astype(float)))).first()["moran_i"] > 0.8
    assert R.moran_on_mask(spark.createDataFrame(base.assign(value=1.0))).first()["moran_i"] is None
    assert R.moran_on_mask(check, min_pixels=101).first()["moran_i"] is None


def test_otsu_splits_two_levels_and_flat_groups_have_none(spark):
    rows = [("a", 0.1)] * 50 + [("a", 0.9)] * 30 + [("b", 0.5)] * 5
    t = {r["k"]: r for r in R.otsu_threshold(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert 0.1 <= t["a"]["threshold"] < 0.9 and not t["a"]["flat"]
    assert t["b"]["threshold"] is None and t["b"]["flat"]


def test_disk_morphology(disk_field):
    _, lab, _ = disk_field
    m = D.cell_morphology(lab).toPandas().set_index("cell_id")
    n = D.nuclear_morphology(lab).toPandas().set_index("cell_id")
    for i, (cy, cx, r, rn) in DISKS.items():
        assert abs(m.loc[i, "cell_area"] / (math.pi * r * r) - 1) < 0.03
        assert abs(m.loc[i, "cell_circularity"] - 1) < 0.12 and abs(m.loc[i, "cell_aspect_ratio"] - 1) < 0.01
        assert 0.95 < m.loc[i, "cell_solidity"] <= 1.0
        assert abs(m.loc[i, "centroid_x"] - cx) < 0.1 and abs(m.loc[i, "centroid_y"] - cy) < 0.1
        assert abs(n.loc[i, "nuclear_to_cell_area_ratio"] / (rn / r) ** 2 - 1) < 0.08


def test_convex_hull_pixels_of_square_and_cross(spark):
    sq = [(1, 1, y, x) for y in range(4) for x in range(6)]
    cross = [(1, 2, 5, x) for x in range(0, 11)] + [(1, 2, y, 5) for y in range(0, 11) if y != 5]
    h = {r["cell_id"]: r for r in D.convex_hull(spark.createDataFrame(sq + cross, "field_id int, cell_id int, y int, x int")).collect()}
    assert h[1]["convex_area"] == 24 and h[1]["solidity"] == 1.0
    # |dy| + |dx| <= 5 has 61 pixels; widening the arms by half a pixel lets none but these in
    assert 61 <= h[2]["convex_area"] <= 65 and abs(h[2]["solidity"] - 21 / h[2]["convex_area"]) < 1e-12


def test_yap_ratio_and_ring_on_disks(disk_field):
    px, lab, f = disk_field
    y = D.nuclear_partition(D.over(D.channel(px, "yap"), lab)).toPandas()
    assert np.allclose(y["yap_nc_ratio"], 2.0)
    reg = D.build_regions(lab, f)
    v = D.over(D.channel(px, "glycocalyx"), reg.ring)
    i = D.over(D.channel(px, "glycocalyx"), reg.interior)
    assert D.intensity(v).agg(F.min("mean_intensity")).first()[0] > 0.6
    assert D.pericellular_ratio(v, i).filter("pericellular_ratio is not null").count() == 0  # dark interior
    roi = v.unionByName(D.over(D.channel(px, "glycocalyx"), lab.select("field_id", "cell_id", "y", "x")))
    top = R.radial_bins(roi, reg.centroids).groupBy("cell_id").agg(F.max_by("bin", "mean").alias("b")).toPandas()
    assert (top["b"] >= 15).all()


def test_adhesions_on_disks(spark, disk_field):
    px, lab, f = disk_field
    p = D.AdhesionParams(threshold="fixed", min_area_um2=3 * 0.325**2, max_area_um2=50 * 0.325**2, peripheral_um=15 * 0.325)
    v = D.over(D.channel(px, "paxillin"), lab)
    a = D.adhesion_features(D.adhesion_pixels(v, f, p), lab, f, p).toPandas()
    assert a["fa_count"].between(6, 9).all() and (a["fa_peripheral_fraction"] >= 0.8).all()
    dark = D.adhesion_features(D.adhesion_pixels(v.withColumn("value", F.lit(0.0)), f, p), lab, f, p).toPandas()
    assert (dark["fa_count"] == 0).all() and (dark["fa_total_area"] == 0).all() and dark["fa_mean_area"].isna().all()
    otsu_flat = D.adhesion_pixels(v.withColumn("value", F.lit(0.5)), f)
    assert otsu_flat.isEmpty()


def test_points_in_polygons(spark):
    poly = spark.createDataFrame([(1, 10, 1, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]), (1, 11, 0, [(50.0, 50.0), (80.0, 50.0), (65.0, 90.0)])],
                                 "field_id int, cell_id int, ord int, vertices array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 65.0, 60.0), (1, 3, 150.0, 5.0), (2, 4, 5.0, 5.0)], "field_id int, point_id int, px double, py double")
    got = {r["point_id"]: r["cell_id"] for r in R.points_in_polygons(pts, poly).collect()}
    assert got == {1: 10, 2: 11, 3: None, 4: None}


def test_mismatched_channels_are_an_error(spark):
    px = image(spark, np.ones((4, 4))).unionByName(image(spark, np.ones((4, 5)), channel="yap"))
    with pytest.raises(ValueError):
        D.check_channels(px)


def test_texture_against_plain_loops_with_missing_pixels(spark):
    rng = np.random.default_rng(12)
    img = rng.integers(0, 40, (26, 31)).astype(float)
    labels = np.zeros(img.shape, int)
    labels[2:16, 3:17], labels[1:25, 18:30], labels[17:26, 0:12] = 7, 8, 9
    gone = rng.random(img.shape) < 0.06
    gone[5], gone[8, 10:18] = True, True  # a whole row, and the end of one
    y, x = np.nonzero(labels)
    ring = spark.createDataFrame([(1, int(labels[a, b]), int(a), int(b)) for a, b in zip(y, x)], "field_id int, cell_id int, y int, x int")
    px = image(spark, img).join(spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(gone)], "y int, x int"), ["y", "x"], "left_anti")
    px = px.unionByName(px.limit(40)).drop("channel")  # repeated pixels
    # and one more without a value
    px = px.unionByName(spark.createDataFrame([(1, 5, 5, None)], "field_id int, y int, x int, value double"))
    px = px.withColumn("other", F.lit(1))
    got = {r["cell_id"]: r for r in R.glcm_texture(px, ring, levels=8, min_pixels=100).collect()}
    assert set(got) == {7, 8} | ({9} if ((labels == 9) & ~gone).sum() >= 100 else set())
    for c in got:
        inside = (labels == c) & ~gone
        lo, hi = img[inside].min(), img[inside].max()
        ys, xs = np.nonzero(inside)
        grey = {(a, b): int(np.clip(np.rint((img[a, b] - lo) / (hi - lo) * 7), 0, 7))
                for a in range(ys.min(), ys.max() + 1) for b in range(xs.min(), xs.max() + 1) if not gone[a, b]}
        want, total = np.zeros(4), 0
        for dy, dx, m in R.GLCM_OFFSETS:
            p = np.zeros((8, 8))
            for (a, b), g in grey.items():
                if (a + dy, b + dx) in grey:
                    p[g, grey[a + dy, b + dx]] += 1
                    p[grey[a + dy, b + dx], g] += 1
            p /= p.sum()
            i, j = np.indices(p.shape)
            mu = (p * i).sum()
            var = (p * (i - mu) ** 2).sum()
            want += m * np.array([(p * (i - j) ** 2).sum(), (p / (1 + (i - j) ** 2)).sum(), (p * (i - mu) * (j - mu)).sum() / var, np.sqrt((p * p).sum())])
            total += m
        assert np.allclose([got[c][k] for k in ("contrast", "homogeneity", "correlation", "energy")], want / total, atol=1e-9)
    assert R.glcm_texture(px.limit(0), ring).isEmpty()


def test_erosion_wears_one_stretch_per_line(spark):
    """Against brute force on ragged regions; a shell pixel is one row per line it reaches, not one per position."""
    rng = np.random.default_rng(11)
    cells = {(c, y, x) for c in (1, 2) for y in range(14) for x in range(14) if (y - 7) ** 2 + (x - 6) ** 2 < 45 and rng.random() < 0.97}
    mask = spark.createDataFrame([(1, *c) for c in cells], "field_id int, cell_id int, y int, x int")
    depth = spark.createDataFrame([(1, 1, 1), (1, 2, 3)], "field_id int, cell_id int, depth_px int")
    got = {(r["cell_id"], r["y"], r["x"]) for r in R.eroded(mask, depth).collect()}
    far = {1: 1, 2: 3}
    steps = lambda k: [(dy, dx) for dy in range(-k, k + 1) for dx in range(abs(dy) - k, k - abs(dy) + 1)]
    near = lambda c, y, x: any((c, y + a, x + b) in cells for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    worn = lambda c, y, x: any((c, y + a, x + b) not in cells and near(c, y + a, x + b) for a, b in steps(far[c]))
    assert got == {p for p in cells if not worn(*p)} and got
    plan = R.eroded(mask, depth)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan


def test_components_in_one_group_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    mask = spark.createDataFrame([(1, c, y, x) for c in (1, 2) for y in range(18) for x in range(18) if rng.random() < (0.4 if c == 1 else 0.1)],
                                 "field_id int, cell_id int, y int, x int")
    rows = lambda: sorted(tuple(r) for r in R.components(mask).collect())
    grouped = rows()
    monkeypatch.setattr(R, "GROUP_RUNS", 60)
    assert rows() == grouped
    monkeypatch.setattr(R, "GROUP_RUNS", 0)
    assert rows() == grouped


def test_a_channel_is_computed_without_the_others(spark):
    from functools import reduce

    from fixtures import SF
    from pyspark.sql import DataFrame
    from cytofleet.operators.cells import channel
    from cytofleet.plans.adapters import pixels
    both = reduce(DataFrame.unionByName, [pixels(spark, SF, [c]) for c in ("dapi", "yap")])
    assert "Union" not in channel(both, "yap")._jdf.queryExecution().optimizedPlan().toString()
    want, got = (p.agg({"value": "sum", "*": "count"}).first() for p in (channel(pixels(spark, SF, ["dapi", "yap"]), "yap"), channel(both, "yap")))
    assert tuple(want) == tuple(got)


def test_pixel_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Joins of pixels merge though the table is small, interiors wait until they are read, and a radial profile deals its pixels once."""
    from cytofleet.plans import adapters as A

    vectors = np.random.default_rng(2).normal(size=(64, 64))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    made = []
    real = R.interior
    monkeypatch.setattr(R, "interior", lambda *a: made.append(1) or real(*a))
    reg = D.build_regions(A.labels(spark, str(tmp_path)), A.fields(spark, str(tmp_path)), cut=False)
    assert not made and reg.interior is reg.interior and made == [1]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    v = D.over(A.pixels(spark, str(tmp_path), ["glycocalyx"]), reg.ring)
    assert plan(v).count("SortMergeJoin") == 3  # outline and width, ring and mask, ring and values
    bins = R.radial_bins(v, reg.centroids)
    assert bins.collect() and "ReusedExchange" in plan(bins)
