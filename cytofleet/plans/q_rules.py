"""Queries B1..B18 and H1..H4."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofleet.functions import scalar as S
from cytofleet.operators import cells as D
from cytofleet.operators import population as P
from cytofleet.operators import rules as B
from cytofleet.plans.adapters import cells, cells_sql, nation_edges, NATION_SQL, pixels, pixels_sql, table
from cytofleet.plans.q_population import QC_IN, QC_SQL, qc_input, rnd
from cytofleet.plans.q_raster import r6
from cytofleet.plans.registry import query

KEY = ["field_id", "cell_id"]


@query("B1_px_resolution", """WITH p AS (SELECT p_partkey, (p_size + p_partkey % 7) / 100e0 AS px FROM part)
SELECT p_partkey, CAST(greatest(1, round_even(7.5e0 / px, 0)) AS INT) AS background, CAST(greatest(1, round_even(0.5e0 / (px * px), 0)) AS INT) AS min_area,
  CAST(greatest(greatest(1, round_even(0.5e0 / (px * px), 0)) + 1, round_even(50e0 / (px * px), 0)) AS INT) AS max_area, round(greatest(1e0, 6.5e0 / px), 6) AS peripheral,
  CAST(greatest(2, round_even(1e0 / px, 0)) AS INT) AS ring_floor, round(greatest(0.5e0, 0.65e0 / px), 6) AS sigma, CAST(greatest(1, round_even(3.25e0 / px, 0)) AS INT) AS cortical FROM p""")
def b1(spark, d):
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_size") + F.col("p_partkey") % 7) / 100).alias("px"))
    return p.select("p_partkey", S.background_radius_px(7.5, "px").alias("background"), S.min_area_px(0.5, "px").alias("min_area"), S.max_area_px(0.5, 50.0, "px").alias("max_area"),
                    r6(S.distance_px(6.5, "px")).alias("peripheral"), S.ring_floor_px("px").alias("ring_floor"), r6(S.sigma_px(0.65, "px")).alias("sigma"), S.width_px(3.25, "px").alias("cortical"))


@query("B2_guarded_ratio", """SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_discount > 0 AND l_linenumber <> 7 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem""")
def b2(spark, d):
    t = table(spark, d, "lineitem")
    # line 7 carries NaN, as an upstream extractor would emit it
    num = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return t.select("l_orderkey", "l_partkey", "l_linenumber", r6(S.guarded_ratio(num, F.col("l_discount"))).alias("ratio"))


# The expected selection, two allowed names and then the first 18 matching names, sorted.
_SELECTED = ["yap_nc_ratio", "fa_count", "actin_cortical_ratio", "actin_stress_fiber_coherence", "cell_area", "fa_density_per_um2", "fa_mean_area",
             "fa_total_area", "fa_total_area_um2", "glycocalyx_coverage", "glycocalyx_moran_i", "glycocalyx_pericellular_ratio",
             "glycocalyx_shannon_entropy", "mechano_score", "nuclear_area", "nuclear_aspect_ratio", "nuclear_solidity", "nuclear_to_cell_area_ratio", "solidity"]


@query("B3_feature_selection", "WITH " + cells_sql() + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS n, {i + 1} AS position FROM cells" for i, f in enumerate(_SELECTED)))
def b3(spark, d):
    c = cells(spark, d)
    use = B.select_features(c, ["yap_nc_ratio", "fa_count"])
    s = P.summarise(c.select("field_id", *use), [], use, {"n": F.count})
    return s.withColumn("position", F.array_position(F.array(*[F.lit(u) for u in use]), F.col("feature")).cast("int"))


@query("B4_prefix_rename", "WITH " + cells_sql(["glycocalyx_coverage", "glycocalyx_moran_i", "cell_area"]) + " SELECT field_id, cell_id, glycocalyx_coverage AS hs_coverage, glycocalyx_moran_i AS hs_moran_i, cell_area FROM cells")
def b4(spark, d):
    return D.rename_prefix(cells(spark, d, ["glycocalyx_coverage", "glycocalyx_moran_i", "cell_area"]).drop("batch", "condition"), "glycocalyx_", "hs_")


@query("B5_substitute_exclusion", f"WITH {pixels_sql(['dapi', 'yap', 'actin'])} SELECT field_id, channel, count(*) AS n, round(avg(value), 6) AS mean FROM pixels WHERE NOT (channel = 'yap' AND field_id % 2 = 0) GROUP BY ALL")
def b5(spark, d):
    p = pixels(spark, d, ["dapi", "yap", "actin"])
    sub = table(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("field_id"), F.lit("yap").alias("channel")).filter("field_id % 2 = 0")
    return rnd(B.drop_substitutes(p, sub).groupBy("field_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("B6_profile_expansion", "SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS embedding_{i:02d}" for i in range(20)) + " FROM embeddings")
def b6(spark, d):
    e = D.expand_profile(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return e.select("vec_id", *[r6(F.col(c).cast("double")).alias(c) for c in e.columns if c != "vec_id"])


@query("B7_complete_rows", "WITH " + cells_sql(["fa_mean_orientation_alignment", "glycocalyx_moran_i"]) + " SELECT field_id, cell_id, fa_mean_orientation_alignment, glycocalyx_moran_i FROM cells WHERE fa_mean_orientation_alignment IS NOT NULL AND glycocalyx_moran_i IS NOT NULL")
def b7(spark, d):
    c = cells(spark, d, ["fa_mean_orientation_alignment", "glycocalyx_moran_i"]).drop("batch", "condition")
    return B.complete_rows(c, ["fa_mean_orientation_alignment", "glycocalyx_moran_i"], 10)


@query("B8_qc_flags", "WITH " + cells_sql(QC_IN) + "," + QC_SQL + " SELECT field_id, cell_id, array_to_string(flags, '; ') AS flags, analysis_ready FROM qr")
def b8(spark, d):
    f = B.qc_flags(qc_input(cells(spark, d, QC_IN)))
    return f.select(*KEY, F.array_join("flags", "; ").alias("flags"), "analysis_ready")


@query("B9_visible_cells", "WITH " + cells_sql(QC_IN) + "," + QC_SQL + """
SELECT 'all' AS mode, field_id, count(*) AS n FROM qr GROUP BY ALL UNION ALL SELECT 'ready', field_id, count(*) FROM qr WHERE analysis_ready GROUP BY ALL
UNION ALL SELECT 'failed', field_id, count(*) FROM qr WHERE NOT analysis_ready OR len(flags) > 0 GROUP BY ALL
UNION ALL SELECT 'unsaturated', field_id, count(*) FROM qr WHERE analysis_ready AND array_to_string(flags, ';') NOT LIKE '%saturated%' GROUP BY ALL""")
def b9(spark, d):
    f = B.qc_flags(qc_input(cells(spark, d, QC_IN)))
    return B.count_visible(f, {"all": {"mode": "all"}, "ready": {}, "failed": {"mode": "qc_failed"}, "unsaturated": {"exclude_edge": True, "exclude_saturated": True}})


_TAG = ["glycocalyx_pericellular_ratio", "mechano_score", "yap_nc_ratio", "fa_mature_fraction", "actin_stress_fiber_coherence"]


@query("B10_phenotype_tags", "WITH " + cells_sql(_TAG) + """,
z AS (SELECT *, (glycocalyx_pericellular_ratio - avg(glycocalyx_pericellular_ratio) OVER f) / stddev_pop(glycocalyx_pericellular_ratio) OVER f AS gz FROM cells WINDOW f AS (PARTITION BY field_id)),
t AS (SELECT *, CASE WHEN glycocalyx_pericellular_ratio > 0.8e0 THEN 'WGA proxy high' WHEN glycocalyx_pericellular_ratio < 0.4e0 THEN 'WGA proxy low' END AS a,
  CASE WHEN mechano_score > 1 THEN 'prototype high' WHEN mechano_score < -1 THEN 'prototype low' END AS b FROM z)
SELECT field_id, cell_id, concat_ws(' / ', a, b) AS tag, concat_ws(' / ', CASE WHEN gz > 1 THEN 'WGA proxy high' WHEN gz < -1 THEN 'WGA proxy low' END,
  CASE WHEN yap_nc_ratio > 1.3e0 THEN 'YAP nuclear-enriched' WHEN yap_nc_ratio < 0.8e0 THEN 'YAP cytoplasmic-enriched' END, 'FA placeholder output',
  CASE WHEN actin_stress_fiber_coherence > 0.6e0 THEN 'aligned stress fibers' END) AS narrative FROM t""")
def b10(spark, d):
    c = P.relative_z(cells(spark, d, _TAG), ["glycocalyx_pericellular_ratio"])
    return c.select(*KEY, B.phenotype_tag(F.col("glycocalyx_pericellular_ratio"), F.col("mechano_score")).alias("tag"),
                    B.narrative_tag(F.col("z_glycocalyx_pericellular_ratio"), F.col("yap_nc_ratio"), F.col("fa_mature_fraction"), F.col("actin_stress_fiber_coherence"), True, False).alias("narrative"))


@query("B11_edge_cost", "WITH " + NATION_SQL + " SELECT src, dst, round(-ln(least(1e0, greatest(1e-6, confidence))) + 0e0, 9) AS cost FROM edges")
def b11(spark, d):
    return nation_edges(spark, d).select("src", "dst", r6(S.edge_cost("confidence"), 9).alias("cost"))


@query("B12_lookup", """SELECT c_custkey, c_mktsegment AS segment, CASE WHEN r_name IS NULL OR n_regionkey = 4 THEN 'Other' ELSE r_name END AS class,
  CASE (c_custkey % 5) WHEN 0 THEN 'effectors' WHEN 1 THEN 'response' WHEN 2 THEN 'actomyosin' WHEN 3 THEN 'adhesion' END AS layer,
  CASE (c_custkey % 5) WHEN 0 THEN 'Mechanosensitive transcriptional effectors' WHEN 1 THEN 'YAP/TAZ-response genes' WHEN 2 THEN 'Actomyosin tension' WHEN 3 THEN 'Adhesion clutch' END AS layer_label,
  CASE (c_custkey % 6) WHEN 0 THEN 'HA/CD44 axis' WHEN 1 THEN 'HSPG core proteins' WHEN 2 THEN 'HS biosynthesis/remodeling' WHEN 3 THEN 'N/O-glycosylation and HBP/O-GlcNAc' ELSE 'Other' END AS gene_class,
  CASE (c_custkey % 6) WHEN 0 THEN 'CD44' WHEN 1 THEN 'GPC3' WHEN 2 THEN 'HPSE' WHEN 3 THEN 'OGT' WHEN 4 THEN 'YAP1' ELSE 'none' END || '>' ||
  CASE (c_custkey % 7) WHEN 0 THEN 'WWTR1/TAZ' WHEN 1 THEN 'WWTR1/TAZ' WHEN 2 THEN 'CCN2/CTGF' WHEN 3 THEN 'CYR61/CCN1' WHEN 4 THEN 'PTK2/FAK' WHEN 5 THEN 'PIEZO1' ELSE 'SRC' END AS path
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def b12(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("class"))
    c = B.lookup_join(table(spark, d, "customer"), n, "c_nationkey")
    gene = F.get(F.array(*[F.lit(g) for g in ("YAP1", "CTGF", "RHOA", "VCL", "none")]), F.col("c_custkey") % 5)
    pick = lambda names: F.get(F.array(*[F.lit(g) for g in names]), F.col("c_custkey") % len(names))
    member = pick(("CD44", "GPC3", "HPSE", "OGT", "YAP1", "none"))
    end = pick(("WWTR1", "TAZ", "CTGF", "CCN1", "FAK", "PIEZO1", "SRC"))
    return c.select("c_custkey", F.col("c_mktsegment").alias("segment"), "class", B.lookup(gene, B.LAYERS).alias("layer"),
                    B.relabel(B.lookup(gene, B.LAYERS), B.LAYER_LABELS).alias("layer_label"), B.lookup(member, B.CLASSES, "Other").alias("gene_class"),
                    F.array_join(B.rename_nodes(F.array(member, end), B.TARGET_ALIASES), ">").alias("path"))


def _config(spark, d):
    """One assay description per supplier; every declared fact follows from its key."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("field_id"))
    k = F.col("field_id")
    flag = lambda m, names: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[k % (m + i) != 0 for i, _ in enumerate(names)]))
    return s.select("field_id", F.when(k % 7 == 0, "technical_demo").otherwise("assay").alias("dataset_type"), (k % 11 != 0).alias("allowed"),
                    flag(13, B.CORE_MARKERS).alias("markers"), flag(19, B.REQUIRED_METADATA + B.ANY_METADATA[:1]).alias("metadata"),
                    F.create_map(F.lit("a"), F.when(k % 2 == 0, "validated").otherwise("provided"), F.lit("b"), F.lit("validated")).alias("controls"))


_MARK = " AND ".join(f"field_id % {13 + i} <> 0" for i in range(5))
_META = " AND ".join(f"field_id % {19 + i} <> 0" for i in range(4))


@query("B13_interpretation_level", f"""WITH c AS (SELECT s_suppkey AS field_id FROM supplier)
SELECT field_id, CASE WHEN field_id % 7 = 0 OR field_id % 11 = 0 THEN 'technical_demo' WHEN NOT ({_MARK}) THEN 'marker_quantification' WHEN NOT ({_META}) THEN 'marker_quantification'
  WHEN field_id % 2 = 0 THEN 'validated_biological_inference' ELSE 'phenotype_comparison' END AS interpretation_level FROM c""")
def b13(spark, d):
    return B.interpretation_level(_config(spark, d)).select("field_id", "interpretation_level")


@query("B14_control_label", """SELECT s_suppkey, CASE WHEN s_suppkey % 30 <= 2 OR s_suppkey % 30 >= 23 THEN 'DMSO control' ELSE 'Compound-treated' END AS label FROM supplier""")
def b14(spark, d):
    well = F.concat(F.lit("H"), F.lpad((F.col("s_suppkey") % 30).cast("string"), 2, "0"))
    return table(spark, d, "supplier").select("s_suppkey", B.control_label(well).alias("label"))


@query("B15_stars", """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN q < 0.001e0 THEN '***' WHEN q < 0.01e0 THEN '**' WHEN q < 0.05e0 THEN '*' END AS stars
FROM (SELECT *, l_discount * l_tax AS q FROM lineitem)""")
def b15(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", B.stars(F.col("l_discount") * F.col("l_tax")).alias("stars"))


@query("B16_score_groups", """SELECT s_suppkey AS field_id, g AS "group", w AS weight, i IS NULL OR s_suppkey % (13 + i) <> 0 AS active FROM supplier,
  (VALUES ('Morphology', NULL, 0.25e0), ('Actin coherence', 2, 0.2e0), ('WGA proxy', 1, 0.2e0), ('YAP N/C', 3, 0.2e0), ('FA maturity', 4, 0.15e0)) t(g, i, w)""")
def b16(spark, d):
    return B.score_groups(_config(spark, d)).select("field_id", "group", "weight", "active")


@query("B17_overlay_values", "WITH " + cells_sql(["mechano_score"]) + """,
m AS (SELECT *, greatest(abs(min(mechano_score) OVER f), abs(max(mechano_score) OVER f)) AS r, min(mechano_score) OVER f AS lo, max(mechano_score) OVER f AS hi FROM cells WINDOW f AS (PARTITION BY field_id)),
p AS (SELECT field_id, cell_id, greatest(0, least(1, (mechano_score + r) / (2 * r))) AS d, greatest(0, least(1, (mechano_score - lo) / (hi - lo))) AS s FROM m)
SELECT field_id, cell_id, round(d, 6) AS diverging, CAST(least(floor(d * 4), 3) AS INT) AS diverging_stop, round(s, 6) AS sequential, CAST(least(floor(s * 4), 3) AS INT) AS sequential_stop FROM p""")
def b17(spark, d):
    c = cells(spark, d, ["mechano_score"])
    a = B.overlay_values(c, "mechano_score", True).select(*KEY, "mechano_score", r6("position").alias("diverging"), F.col("stop").alias("diverging_stop"))
    s = B.overlay_values(a, "mechano_score")
    return s.select(*KEY, "diverging", "diverging_stop", r6("position").alias("sequential"), F.col("stop").alias("sequential_stop"))


@query("B18_pixel_preset", """SELECT p_partkey, coalesce(first_hit, 'custom') AS preset FROM (SELECT p_partkey, (SELECT arg_min(id, o) FROM (VALUES
    (0, 'leica-100x', 0.063e0), (1, 'zeiss-63x-airy', 0.084e0), (2, 'leica-63x', 0.103e0), (3, 'zeiss-63x', 0.137e0), (4, 'zeiss-40x', 0.163e0),
    (5, 'zeiss-20x', 0.227e0), (6, 'leica-20x', 0.325e0), (7, 'leica-20x-2x', 0.163e0), (8, 'bbbc022', 0.656e0)) t(o, id, um) WHERE abs(um - v) / um < 0.01e0) AS first_hit
  FROM (SELECT p_partkey, (p_partkey % 700) / 1000e0 AS v FROM part))""")
def b18(spark, d):
    return table(spark, d, "part").select("p_partkey", B.pixel_preset((F.col("p_partkey") % 700) / 1000).alias("preset"))


# --- H ----------------------------------------------------------------------


@query("H1_panel_algebra", """WITH a AS (SELECT p_brand AS g FROM part WHERE p_size < 3), b AS (SELECT p_brand AS g FROM part WHERE p_type = 'SMALL' AND p_size = 4)
SELECT 'union' AS op, g FROM (SELECT g FROM a UNION SELECT g FROM b) UNION ALL SELECT 'uncovered', g FROM (SELECT g FROM a EXCEPT SELECT g FROM b)
UNION ALL SELECT 'first', p_brand || ':' || arg_min(p_name, p_partkey) FROM part GROUP BY p_brand""")
def h1(spark, d):
    p = table(spark, d, "part")
    a, b = p.filter("p_size < 3").select(F.col("p_brand").alias("g")), p.filter("p_type = 'SMALL' and p_size = 4").select(F.col("p_brand").alias("g"))
    first = B.first_occurrence(p.select("p_brand", "p_name", "p_partkey"), ["p_brand"], "p_partkey").select(F.lit("first").alias("op"), F.concat_ws(":", "p_brand", "p_name").alias("g"))
    return B.panel_union(a, b).select(F.lit("union").alias("op"), "g").unionByName(B.uncovered(a.distinct(), b.distinct()).select(F.lit("uncovered").alias("op"), "g")).unionByName(first)


@query("H2_catalogue_replace", """WITH c AS (SELECT p_name AS name, p_type AS condition FROM part WHERE p_name NOT LIKE 'red%' UNION ALL SELECT 'red ' || p_brand, 'fresh' FROM part WHERE p_size < 5)
SELECT condition, count(*) AS n, count(*) FILTER (name LIKE 'red%') AS replaced FROM c GROUP BY ALL""")
def h2(spark, d):
    p = table(spark, d, "part")
    fresh = p.filter("p_size < 5").select(F.concat(F.lit("red "), "p_brand").alias("name"), F.lit("fresh").alias("condition"))
    cat = p.select(F.col("p_name").alias("name"), F.col("p_type").alias("condition"))
    once = B.replace_entries(cat, fresh, "red")
    twice = B.replace_entries(once, fresh, "red")  # running it again changes nothing
    return twice.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").startswith("red")).alias("replaced"))


def _catalogue(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("note"), F.col("p_type").alias("cell_line"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 100).alias("pixel_size_um"),
        F.array_compact(F.array(F.lit("bundled"), F.when(F.col("p_size") % 2 == 0, "real"), F.when(F.col("p_size") % 5 == 0, "substitute"))).alias("sources"),
        F.array_compact(F.array(F.lit("dapi"), F.when(F.col("p_size") % 3 == 0, "yap"), F.when(F.col("p_size") % 4 == 0, "other stain"), F.lit("dapi"))).alias("channels"))


@query("H3_catalogue_search", """WITH c AS (SELECT concat_ws(' ', p_name, p_partkey) AS name, p_brand AS source, p_type AS note, CASE WHEN p_size % 3 > 0 THEN p_size / 100e0 END AS px, p_size FROM part),
k AS (SELECT * FROM c WHERE contains(lower(concat_ws(' ', name, source, note)), 'brand#1') AND p_size % 2 = 0 AND p_size % 4 = 0)
SELECT name, source, px AS pixel_size_um FROM k ORDER BY px NULLS LAST, name""")
def h3(spark, d):
    hit = B.search_catalogue(_catalogue(spark, d), " Brand#1 ", "real", "other stain")
    return B.sort_catalogue(hit, "pixel_size").select("name", "source", "pixel_size_um")


@query("H4_facet_counts", """WITH c AS (SELECT p_size AS s FROM part)
SELECT 'sources' AS facet_group, 'all' AS facet, count(*) AS n, 0 AS position FROM c UNION ALL SELECT 'sources', 'bundled', count(*), 1 FROM c
UNION ALL SELECT 'sources', 'real', count(*), 3 FROM c WHERE s % 2 = 0 UNION ALL SELECT 'sources', 'substitute', count(*), 4 FROM c WHERE s % 5 = 0
UNION ALL SELECT 'channels', 'all', count(*), 0 FROM c UNION ALL SELECT 'channels', 'dapi', count(*), 5 FROM c UNION ALL SELECT 'channels', 'yap', count(*), 8 FROM c WHERE s % 3 = 0
UNION ALL SELECT 'channels', 'other stain', count(*), 1000 FROM c WHERE s % 4 = 0""")
def h4(spark, d):
    c = _catalogue(spark, d)
    return B.facet_counts(c, "sources").withColumn("facet_group", F.lit("sources")).unionByName(B.facet_counts(c, "channels").withColumn("facet_group", F.lit("channels")))
