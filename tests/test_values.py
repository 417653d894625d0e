"""Fixed tables against values written out by hand, and rules that rest on them."""

import pytest
from pyspark.sql import functions as F

from cytofleet.operators import phenotype as H
from cytofleet.operators import population as P
from cytofleet.operators import priors as G
from cytofleet.operators import rules as B
from cytofleet.sources import tables as A


def test_panel_sizes_and_members(spark):
    counts = {r["panel"]: r["n"] for r in B.fixed_panels(spark).groupBy("panel").agg(F.countDistinct("gene").alias("n")).collect()}
    assert counts == {"perturbation": 22, "signature": 15, "inhibitors": 5}
    assert B.SIGNATURE == ["YAP1", "WWTR1", "CTGF", "CYR61", "ANKRD1", "RHOA", "ROCK1", "ROCK2", "MYL9", "ITGB1", "PTK2", "VCL", "PXN", "TLN1", "PIEZO1"]
    assert sorted(g for genes in B.CLASSES.values() for g in genes) == sorted(B.PERTURBATION_PANEL)


def test_a_panel_of_the_wrong_size_raises(spark):
    sizes = spark.createDataFrame([(f"p{i}", 2) for i in range(150)], "panel string, size int")
    rows = [(f"p{i}", g) for i in range(150) for g in ("a", "b")]
    assert A.validated_panel(spark.createDataFrame(rows, "panel string, gene string"), sizes).count() == 300
    with pytest.raises(ValueError, match="p149 has 1"):
        A.validated_panel(spark.createDataFrame(rows[:-1], "panel string, gene string"), sizes)
    with pytest.raises(ValueError, match="p149 has 0"):
        A.validated_panel(spark.createDataFrame(rows[:-2], "panel string, gene string"), sizes)


def test_labels_aliases_and_presets(spark):
    row = spark.range(1).select(
        B.lookup(F.lit("GPC6"), B.CLASSES, "Other").alias("core"), B.lookup(F.lit("NDST1"), B.CLASSES, "Other").alias("hs"),
        B.lookup(F.lit("OGT"), B.CLASSES, "Other").alias("glyco"), B.lookup(F.lit("TP53"), B.CLASSES, "Other").alias("none"),
        B.rename_nodes(F.array(F.lit("GFPT1"), F.lit("TAZ"), F.lit("FAK")), B.TARGET_ALIASES).alias("path"),
        B.relabel(F.lit("ion_channel"), B.LAYER_LABELS).alias("layer"),
        *[B.pixel_preset(F.lit(v)).alias(f"p{i}") for i, v in enumerate((0.063, 0.0634, 0.163, 0.2))]).first()
    assert row["core"] == "HSPG core proteins" and row["hs"] == "HS biosynthesis/remodeling"
    assert row["glyco"] == "N/O-glycosylation and HBP/O-GlcNAc" and row["none"] == "Other"
    assert row["path"] == ["GFPT1", "WWTR1/TAZ", "PTK2/FAK"] and row["layer"] == "Mechanosensitive ion channel"
    assert [row[f"p{i}"] for i in range(4)] == ["leica-100x", "leica-100x", "zeiss-40x", "custom"]


def test_batch_effect_reasons(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "batch string, f double")
    reason = lambda df: P.batch_effect_summary(df, ["f"]).first()["reason"]
    assert reason(one) == "single batch — no inter-batch shift to measure"
    assert reason(one.drop("batch")) == "batch column 'batch' missing"
    assert reason(spark.createDataFrame([("a", None), ("b", None)], "batch string, f double")) == "no feature with finite values across multiple batches"


def test_curated_edges_carry_their_source(spark):
    graph = G.build_graph(spark.createDataFrame([("OGT", "YAP1", 0.9), ("GFPT1", "OGT", 0.2)], "src string, dst string, confidence double"))
    rows = {(r["src"], r["dst"]): r for r in G.overlay_curated(graph, G.curated_edges(spark)).collect()}
    assert rows["OGT", "YAP1"]["change"] == "kept" and rows["OGT", "YAP1"]["pubmed_doi"] is None
    assert rows["GFPT1", "OGT"]["change"] == "upgraded" and rows["GFPT1", "OGT"]["pubmed_doi"] == "10.1172/JCI94844"
    assert rows["ITGB1", "MGAT5"]["change"] == "added" and rows["ITGB1", "MGAT5"]["reason"].startswith("MGAT5-mediated")


def test_communities_follow_structure_and_resolution(spark):
    edges = [(a, b, 1.0) for g in range(4) for a in range(g * 5, g * 5 + 5) for b in range(g * 5, a)] + [(g * 5, (g * 5 + 5) % 20, 0.3) for g in range(4)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, weight double")
    parts = H.communities(both)
    assert {r["node"]: r["community"] for r in parts.collect()} == {n: n // 5 * 5 for n in range(20)}
    assert H.modularity(both, parts).first()["modularity"] > 0.65
    assert len({r["community"] for r in H.communities(both, resolution=0.01).collect()}) < 4
