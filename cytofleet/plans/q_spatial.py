"""Queries F1..F16."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofleet.operators import linear as L
from cytofleet.operators import phenotype as H
from cytofleet.operators import rules as B
from cytofleet.operators import spatial as G
from cytofleet.operators.screen import BLOCK_A, BLOCK_B
from cytofleet.plans.adapters import cells, cells_sql, table
from cytofleet.plans.q_population import _HASH_KEYS, QC_IN, QC_SQL, _keyed_cells, qc_input, rnd
from cytofleet.plans.q_raster import r6
from cytofleet.plans.registry import query
from cytofleet.session import pin

KEY = ["field_id", "cell_id"]
_XY = ["centroid_x", "centroid_y"]


def points(c):
    return c.select(*KEY, F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))


KNN_SQL = """
knn AS (SELECT * FROM (
  SELECT a.field_id, a.cell_id AS src, b.cell_id AS dst, (b.centroid_x - a.centroid_x) * (b.centroid_x - a.centroid_x) + (b.centroid_y - a.centroid_y) * (b.centroid_y - a.centroid_y) AS d2,
         row_number() OVER (PARTITION BY a.field_id, a.cell_id ORDER BY (b.centroid_x - a.centroid_x) * (b.centroid_x - a.centroid_x) + (b.centroid_y - a.centroid_y) * (b.centroid_y - a.centroid_y), b.cell_id) AS rank
  FROM cells a JOIN cells b ON a.field_id = b.field_id AND a.cell_id <> b.cell_id) WHERE rank <= 6)"""


@query("F1_spatial_knn", "WITH " + cells_sql(_XY) + "," + KNN_SQL + " SELECT field_id, src, dst, d2, CAST(rank AS INT) AS rank FROM knn")
def f1(spark, d):
    return G.knn_edges(points(cells(spark, d, _XY)))


_F2 = sorted({"cell_area", "yap_nuclear_fraction", "fa_count", *(f for f in [*G.NODE_FEATURES, *BLOCK_A, *BLOCK_B] if f != "yap_nc_ratio_size_corrected")})
_C2 = sorted(set(_XY + _F2 + QC_IN))


@query("F2_graph_moran", "WITH " + cells_sql(_C2) + "," + KNN_SQL + "," + QC_SQL + ", mo AS (" + " UNION ALL ".join(f"""
SELECT s.field_id, '{f}' AS feature, (n * 1e0 / count(*)) * (sum((a.{f} - mean) * (b.{f} - mean)) / max(ss)) AS moran, n, mean, sd
FROM (SELECT field_id, count({f}) AS n, avg({f}) AS mean, stddev_samp({f}) AS sd, var_samp({f}) * (count({f}) - 1) AS ss FROM qr WHERE analysis_ready GROUP BY ALL) s
  JOIN knn USING (field_id) JOIN qr a ON a.field_id = knn.field_id AND a.cell_id = src AND a.analysis_ready JOIN qr b ON b.field_id = knn.field_id AND b.cell_id = dst AND b.analysis_ready
WHERE a.{f} IS NOT NULL AND b.{f} IS NOT NULL AND n >= 8 AND ss > 1e-12 GROUP BY s.field_id, n, mean, sd""" for f in _F2) + """)
SELECT field_id, feature, round(moran, 6) AS moran, n, round(mean, 6) AS mean, round(sd, 6) AS sd, CAST(row_number() OVER (PARTITION BY field_id ORDER BY abs(moran) DESC, feature) AS INT) AS rank FROM mo
QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY abs(moran) DESC, feature) <= 18""")
def f2(spark, d):
    # the rules' input takes this column under another name
    c = B.qc_flags(qc_input(cells(spark, d, _C2)).withColumn("actin_cortical_ratio", F.col("actin_mean_intensity")))
    return rnd(G.knn_moran(c, _F2, "analysis_ready"))


def _scales(c):
    return c.select("field_id").distinct().withColumn("pixel_size_um", F.lit(0.325))


def _delaunay(spark, d):
    c = points(cells(spark, d, _XY))
    return G.delaunay_edges(c, _scales(c))


@query("F3_delaunay_edges")
def f3(spark, d):
    return _delaunay(spark, d).withColumn("dist_um", r6("dist_um"))


@query("F4_degree_summary", "WITH " + cells_sql(_XY) + "," + KNN_SQL + """,
e AS (SELECT field_id, src, dst FROM knn UNION SELECT field_id, dst, src FROM knn), k AS (SELECT field_id, src, count(*) AS k FROM e GROUP BY ALL)
SELECT field_id, CAST(floor(sum(k) / 2) AS BIGINT) AS n_edges, count(*) AS n_nodes, round(avg(k), 6) AS mean_neighbours FROM k GROUP BY field_id""")
def f4(spark, d):
    return rnd(G.knn_degrees(points(cells(spark, d, _XY))))


_F5 = [f for f in G.NODE_FEATURES if f != "yap_nc_ratio_size_corrected"]
_F5Z = ", ".join(f"coalesce(({f} - avg({f}) OVER f) / CASE WHEN stddev_pop({f}) OVER f >= 1e-8 THEN stddev_pop({f}) OVER f ELSE 1 END, 0) AS {f}" for f in _F5)


@query("F5_graph_propagation", "WITH " + cells_sql(_XY + _F5) + "," + KNN_SQL + """,
st AS (SELECT field_id, cell_id, """ + _F5Z + """ FROM cells WINDOW f AS (PARTITION BY field_id)),
e AS MATERIALIZED (SELECT field_id, src, dst FROM knn UNION SELECT field_id, dst, src FROM knn UNION SELECT field_id, cell_id, cell_id FROM cells),
g AS (SELECT field_id, src, count(*) AS k FROM e GROUP BY ALL),
w AS MATERIALIZED (SELECT e.field_id, e.src, e.dst, 1e0 / sqrt(CAST(a.k * b.k AS DOUBLE)) AS w FROM e JOIN g a ON a.field_id = e.field_id AND a.src = e.src JOIN g b ON b.field_id = e.field_id AND b.src = e.dst),
h1 AS MATERIALIZED (SELECT w.field_id, w.src AS cell_id, """ + ", ".join(f"sum(w * {f}) AS {f}" for f in _F5) + """ FROM w JOIN st ON st.field_id = w.field_id AND st.cell_id = w.dst GROUP BY ALL)
SELECT w.field_id, w.src AS cell_id, """ + ", ".join(f"round(sum(w * {f}), 6) + 0e0 AS {f}" for f in _F5) + """
FROM w JOIN h1 ON h1.field_id = w.field_id AND h1.cell_id = w.dst GROUP BY ALL""")
def f5(spark, d):
    c = cells(spark, d, _XY + _F5)
    h = rnd(G.knn_propagate(c, _F5))
    return h.withColumns({f: F.col(f) + F.lit(0.0) for f in _F5})


def _node_cells(spark, d):
    have = [f for f in G.NODE_FEATURES if f != "yap_nc_ratio_size_corrected"]
    c = _keyed_cells(spark, d, have + _XY + ["yap_nc_ratio", "mechano_score"])
    return c, have + ["yap_nc_ratio"]


@query("F6_spatial_folds")
def f6(spark, d):
    c, _ = _node_cells(spark, d)
    return G.spatial_folds(c, _HASH_KEYS).groupBy("field_id", "fold", "spatial").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("centroid_x"), 4).alias("cx"))


@query("F7_context_regression")
def f7(spark, d):
    c, feats = _node_cells(spark, d)
    return rnd(G.delaunay_context(c, feats, "mechano_score", _HASH_KEYS, _scales(cells(spark, d, _XY))), 5)


@query("F8_context_importance")
def f8(spark, d):
    c, feats = _node_cells(spark, d)
    models = G.delaunay_models(c, feats, "mechano_score", _scales(cells(spark, d, _XY)))
    return rnd(L.importance(models, feats, ["_y"], ["field_id"]), 5)


@query("F9_embedding_pca")
def f9(spark, d):
    p = H.reduce_embedding(table(spark, d, "embeddings").select("vec_id", "embedding"))
    return p.select("vec_id", F.size("components").alias("n_components"), r6(F.abs(F.get("components", F.lit(0))), 4).alias("first"))


_COS = "list_dot_product(a.v, b.v)"


@query("F10_cosine_knn", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT src, dst, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM s) WHERE r <= 15""")
def f10(spark, d):
    return H.cosine_knn(table(spark, d, "embeddings").select("vec_id", "embedding")).withColumn("similarity", r6("similarity"))


@query("F11_communities")
def f11(spark, d):
    g = H.symmetric_graph(H.cosine_knn(table(spark, d, "embeddings").select("vec_id", "embedding")))
    g = pin(g)
    c = H.communities(g)
    m = H.modularity(g, c).withColumn("_k", F.lit(1))
    per = c.groupBy("community").agg(F.count(F.lit(1)).alias("size")).withColumn("_k", F.lit(1))
    return rnd(per.join(m, "_k").drop("_k"))


@query("F12_kmeans_clusters")
def f12(spark, d):
    p = H.reduce_embedding(table(spark, d, "embeddings").select("vec_id", "embedding"))
    return H.kmeans_clusters(p).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


_SF = [f for f in H.SUMMARY_FEATURES if f != "yap_nc_ratio_size_corrected"]


@query("F13_cluster_summaries", "WITH " + cells_sql(_SF) + """,
k AS (SELECT *, CASE WHEN field_id % 7 = 0 THEN -1 ELSE field_id % 5 END AS cluster FROM cells)
SELECT cluster, count(*) AS size, """ + ", ".join(f"round(avg({f}), 6) AS mean_{f}" for f in _SF) + """, round(count(*) * 1e0 / (SELECT count(*) FROM k), 6) AS fraction
FROM k WHERE cluster >= 0 GROUP BY cluster""")
def f13(spark, d):
    c = cells(spark, d, _SF).withColumn("cluster", F.expr("case when field_id % 7 = 0 then -1 else field_id % 5 end"))
    return rnd(H.cluster_summaries(c))


_AB, _BB = BLOCK_A, [b for b in BLOCK_B if b != "yap_nc_ratio_size_corrected"]


def _cross(spark, d):
    return H.cross_block(_keyed_cells(spark, d, _AB + _BB), _HASH_KEYS, _AB, _BB)


@query("F14_cross_block_prediction")
def f14(spark, d):
    out = _cross(spark, d)
    return rnd(out["r2"].unionByName(out["overall"].select(F.lit("overall").alias("target"), "r2")), 5)


@query("F15_cross_block_importance")
def f15(spark, d):
    return rnd(_cross(spark, d)["importance"], 5)


@query("F16_predicted_vs_actual")
def f16(spark, d):
    return rnd(_cross(spark, d)["predicted"], 4)
