"""Queries G1..G24: the nation graph, and brand priors over the signature targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofleet.operators import priors as G
from cytofleet.operators import rules as B
from cytofleet.operators.scale import quantiles
from cytofleet.plans.adapters import NATION_SQL, cells, cells_sql, nation_edges, table
from cytofleet.plans.q_population import rnd
from cytofleet.plans.q_raster import r6
from cytofleet.plans.registry import query
from cytofleet.session import pin

FIELD = ["field_id"]
PANEL = B.SIGNATURE
_SIG_SQL = "[" + ", ".join(f"'{g}'" for g in PANEL) + "]"

# --- nation graph ---------------------------------------------------------------

GRAPH_SQL = "WITH " + NATION_SQL + """,
g0 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(confidence) AS confidence FROM edges WHERE confidence > 0 GROUP BY ALL),
g AS MATERIALIZED (SELECT *, -ln(least(1e0, greatest(1e-6, confidence))) + 0e0 AS weight FROM g0)"""


def graph(spark, d):
    return G.build_graph(nation_edges(spark, d))


@query("G1_graph_build", GRAPH_SQL + " SELECT src, dst, round(confidence, 9) AS confidence, round(weight, 9) AS weight FROM g")
def g1(spark, d):
    return rnd(graph(spark, d), 9)


_CUR_SQL = """
cur AS (SELECT least('NATION_' || n_nationkey, 'NATION_' || (n_nationkey + 7) % 25) AS src, greatest('NATION_' || n_nationkey, 'NATION_' || (n_nationkey + 7) % 25) AS dst,
        0.30e0 + (n_nationkey % 8) / 10e0 AS c, '10.0000/' || n_nationkey AS doi, n_name || ' trade note' AS why FROM nation
  UNION ALL SELECT * FROM (VALUES
    ('GFPT1', 'OGT', 0.5e0, '10.1172/JCI94844', 'GFPT1 is the rate-limiting enzyme of the hexosamine biosynthetic pathway; its product UDP-GlcNAc is the substrate for OGT (Taparra et al. 2018, JCI).'),
    ('OGT', 'YAP1', 0.5e0, '10.1073/pnas.1619889114', 'O-GlcNAcylation of YAP at Ser109 by OGT regulates YAP transcriptional activity (Peng et al. 2017, PNAS).'),
    ('ITGB1', 'MGAT5', 0.5e0, '10.1016/j.cell.2007.01.049', 'MGAT5-mediated N-glycan branching on integrins regulates integrin clustering and mechanosensing (Lau et al. 2007, Cell).'),
    ('B4GALT1', 'ITGB1', 0.45e0, '10.1074/jbc.M807059200', 'Beta-1,4-galactosyltransferase modifies integrin N-glycans, altering integrin function (Isaji et al. 2009, JBC).'),
    ('GFPT1', 'MGAT5', 0.45e0, '10.1016/j.cell.2007.01.049', 'GFPT1-produced UDP-GlcNAc feeds into Golgi N-glycan branching via MGAT5 (Lau et al. 2007, Cell).')) t(a, b, c, d, e)),
ov AS (SELECT coalesce(g.src, cur.src) AS src, coalesce(g.dst, cur.dst) AS dst, greatest(confidence, c) AS confidence,
        CASE WHEN confidence IS NULL THEN 'added' WHEN c > confidence THEN 'upgraded' ELSE 'kept' END AS change,
        CASE WHEN confidence IS NULL OR c > confidence THEN doi END AS pubmed_doi, CASE WHEN confidence IS NULL OR c > confidence THEN why END AS reason
      FROM g FULL OUTER JOIN cur ON g.src = cur.src AND g.dst = cur.dst)"""


def overlaid(spark, d):
    n = table(spark, d, "nation")
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    cur = n.select(name(F.col("n_nationkey")).alias("src"), name((F.col("n_nationkey") + 7) % 25).alias("dst"), (F.lit(0.30) + (F.col("n_nationkey") % 8) / 10).alias("confidence"),
                   F.concat(F.lit("10.0000/"), F.col("n_nationkey").cast("string")).alias("pubmed_doi"), F.concat("n_name", F.lit(" trade note")).alias("reason"))
    return G.overlay_curated(graph(spark, d), cur.unionByName(G.curated_edges(spark)))


@query("G2_curated_overlay", GRAPH_SQL + "," + _CUR_SQL + """
SELECT src, dst, round(confidence, 9) AS confidence, round(-ln(least(1e0, greatest(1e-6, confidence))) + 0e0, 9) AS weight, change, CASE WHEN change = 'kept' THEN 'network' ELSE 'curated' END AS source, pubmed_doi, reason FROM ov""")
def g2(spark, d):
    return rnd(overlaid(spark, d), 9)


_ROUNDS = 24
_SRC_SQL = "src0 AS (SELECT n_name AS source FROM nation WHERE n_regionkey < 3), tgt0 AS (SELECT n_name AS target FROM nation WHERE n_regionkey >= 3)"


def paths_sql(edges: str) -> str:
    """Bellman-Ford as a chain of CTEs p0..pN over ``edges(src, dst, weight)``."""
    out = [f"bi AS MATERIALIZED (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges})", _SRC_SQL,
           "p0 AS MATERIALIZED (SELECT source, source AS node, 0e0 AS distance, [source] AS path FROM src0 WHERE source IN (SELECT src FROM bi))"]
    for i in range(_ROUNDS):
        out.append(f"""p{i + 1} AS MATERIALIZED (SELECT source, node, distance, path FROM (
  SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY distance, path) AS rn FROM (
    SELECT * FROM p{i} UNION ALL SELECT source, dst, distance + weight, list_append(path, dst) FROM p{i} JOIN bi ON bi.src = node WHERE NOT list_contains(path, dst))) WHERE rn = 1)""")
    return ",\n".join(out) + f",\npaths AS (SELECT * FROM p{_ROUNDS})"


def sources_targets(spark, d):
    n = table(spark, d, "nation")
    return n.filter("n_regionkey < 3").select(F.col("n_name").alias("source")), n.filter("n_regionkey >= 3").select(F.col("n_name").alias("target"))


def paths(spark, d):
    g = pin(graph(spark, d))
    s, t = sources_targets(spark, d)
    return G.shortest_paths(g, s), s, t, g


@query("G3_shortest_paths", GRAPH_SQL + "," + paths_sql("g") + " SELECT source, node, round(distance, 9) AS distance, array_to_string(path, '>') AS path FROM paths")
def g3(spark, d):
    return rnd(paths(spark, d)[0].withColumn("path", F.array_join("path", ">")), 9)


def evidence(spark, d):
    """(gene, target, distance, path, path_edges) on the overlaid graph."""
    g = pin(overlaid(spark, d))
    s, t = sources_targets(spark, d)
    p = G.path_evidence(G.shortest_paths(g, s), g.select("src", "dst", "confidence", "source", "pubmed_doi", "reason"))
    return p.join(t.withColumnRenamed("target", "node"), "node", "left_semi").select(F.col("source").alias("gene"), F.col("node").alias("target"), "distance", "path", "path_edges"), s, t


_EV_SQL = GRAPH_SQL + "," + _CUR_SQL + """,
ow AS MATERIALIZED (SELECT *, -ln(least(1e0, greatest(1e-6, confidence))) + 0e0 AS weight, CASE WHEN change = 'kept' THEN 'network' ELSE 'curated' END AS source_tag FROM ov),
""" + paths_sql("ow") + """,
ev AS (SELECT source AS gene, node AS target, distance, path FROM paths WHERE node IN (SELECT target FROM tgt0)),
pe AS (SELECT gene, target, i, path[i] AS a, path[i + 1] AS b FROM ev, (SELECT unnest(range(1, 25)) AS i) WHERE i < len(path)),
pa AS (SELECT pe.*, confidence, source_tag, pubmed_doi, reason FROM pe JOIN ow ON ow.src = least(a, b) AND ow.dst = greatest(a, b))"""


@query("G4_path_evidence", _EV_SQL + """ SELECT gene, target, CAST(i - 1 AS INT) AS i, a AS node_from, b AS node_to, round(confidence, 9) AS confidence, source_tag AS source, pubmed_doi, reason FROM pa""")
def g4(spark, d):
    e, _, _ = evidence(spark, d)
    x = e.select("gene", "target", F.explode("path_edges").alias("e"))
    return x.select("gene", "target", F.col("e.i").alias("i"), F.col("e.from").alias("node_from"), F.col("e.to").alias("node_to"), r6("e.confidence", 9).alias("confidence"), F.col("e.source").alias("source"), F.col("e.pubmed_doi").alias("pubmed_doi"), F.col("e.reason").alias("reason"))


_MED_SQL = """
md AS (SELECT s.source, median(coalesce(1 / (1 + distance), 0)) AS score, count(distance) AS reachable
       FROM src0 s CROSS JOIN tgt0 t LEFT JOIN paths p ON p.source = s.source AND p.node = t.target GROUP BY ALL)"""


@query("G5_median_inverse", GRAPH_SQL + "," + paths_sql("g") + "," + _MED_SQL + " SELECT source, round(score, 9) AS score, reachable FROM md")
def g5(spark, d):
    p, s, t, _ = paths(spark, d)
    return rnd(G.median_inverse(p, s, t), 9)


@query("G6_rank_genes", GRAPH_SQL + "," + paths_sql("g") + "," + _MED_SQL + """
SELECT source AS gene, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, source) AS INT) AS rank FROM md""")
def g6(spark, d):
    p, s, t, _ = paths(spark, d)
    m = G.median_inverse(p, s, t).select(F.col("source").alias("gene"), "score")
    return rnd(G.rank_genes(m), 9)


# --- brand priors -----------------------------------------------------------------


def _lines(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_discount")
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"), "p_size")
    target = F.get(F.array(*[F.lit(t) for t in PANEL]), F.pmod(F.col("p_size") + F.col("l_linenumber"), F.lit(len(PANEL))))
    return li.join(p, li.l_partkey == p.p_partkey).select("gene", target.alias("target"), "l_quantity", (F.floor(F.col("l_discount") * 100 + 0.5) * 4 + F.col("l_quantity")).alias("shift"))


_LINES_SQL = f"""
ln0 AS (SELECT p_brand AS gene, {_SIG_SQL}[(p_size + l_linenumber) % 15 + 1] AS target, l_quantity, floor(l_discount * 100 + 0.5e0) * 4 + l_quantity AS shift FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PRIOR_SQL = _LINES_SQL + """,
t1 AS (SELECT gene, target, 1e0 / (1 + avg(l_quantity) / 10) AS inverse FROM ln0 GROUP BY ALL),
s1 AS (SELECT gene, median(inverse) AS score FROM t1 GROUP BY ALL),
r1 AS (SELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM s1),
t2 AS (SELECT gene, target, median(shift) AS inverse FROM ln0 GROUP BY ALL),
s2 AS (SELECT gene, median(inverse) AS score FROM t2 GROUP BY ALL),
r2 AS (SELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM s2),
prior AS (SELECT 'pathway' AS source, gene, rank, score, target, inverse FROM r1 JOIN t1 USING (gene)
  UNION ALL SELECT 'perturbation', gene, rank, score, target, inverse FROM r2 JOIN t2 USING (gene))"""


def prior(spark, d):
    """Two prior sources, at most brands x targets rows each; materialised because every step below reads it."""
    x = _lines(spark, d)
    a = x.groupBy("gene", "target").agg((1 / (1 + F.avg("l_quantity") / 10)).alias("inverse"))
    b = quantiles(x, ["gene", "target"], "shift", {"inverse": 0.5})
    out = None
    for name, t in (("pathway", a), ("perturbation", b)):
        r = G.rank_genes(t.groupBy("gene").agg(F.median("inverse").alias("score")))
        one = r.join(t, "gene").select(F.lit(name).alias("source"), "gene", "rank", "score", "target", "inverse")
        out = one if out is None else out.unionByName(one)
    return pin(out)


def source_of(p, name):
    return p.filter(F.col("source") == name).groupBy("gene").agg(F.max("rank").alias("rank"), F.max("score").alias("score"))


@query("G7_shift_ranking", "WITH " + PRIOR_SQL + " SELECT gene, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r2")
def g7(spark, d):
    return rnd(G.shift_ranking(_lines(spark, d)))


@query("G8_rank_divergence", "WITH " + PRIOR_SQL + " SELECT gene, CAST(r1.rank AS INT) AS rank_a, CAST(r2.rank AS INT) AS rank_b, CAST(abs(r1.rank - r2.rank) AS INT) AS divergence FROM r1 JOIN r2 USING (gene)")
def g8(spark, d):
    p = prior(spark, d)
    return G.rank_divergence(source_of(p, "pathway"), source_of(p, "perturbation"))


@query("G9_combined_table", "WITH " + PRIOR_SQL + """,
a AS (SELECT * FROM r1 WHERE rank % 4 > 0), b AS (SELECT * FROM r2 WHERE rank % 5 > 0),
j AS (SELECT gene, a.rank AS rank_a, a.score AS score_a, b.rank AS rank_b, b.score AS score_b FROM a FULL OUTER JOIN b USING (gene))
SELECT gene, CAST(rank_a AS INT) AS rank_a, round(score_a, 6) AS score_a, CAST(rank_b AS INT) AS rank_b, round(score_b, 6) AS score_b,
  CAST(row_number() OVER (ORDER BY rank_a NULLS LAST, gene) AS INT) AS position FROM j""")
def g9(spark, d):
    p = prior(spark, d)
    return rnd(G.combined_table(source_of(p, "pathway").filter("rank % 4 > 0"), source_of(p, "perturbation").filter("rank % 5 > 0")))


@query("G10_prior_status", "WITH " + PRIOR_SQL + """,
m(source, available, g, err) AS (VALUES ('pathway', TRUE, 20, FALSE), ('perturbation', TRUE, 400, FALSE), ('few', TRUE, 1, FALSE), ('failed', TRUE, 1, TRUE), ('absent', FALSE, NULL, FALSE)),
a AS (SELECT source, gene FROM prior UNION ALL SELECT 'few', gene FROM prior WHERE rank <= 9 UNION ALL SELECT 'failed', gene FROM prior),
c AS (SELECT source, count(DISTINCT gene) AS n FROM a GROUP BY ALL)
SELECT m.source, CASE WHEN NOT available THEN 'missing' WHEN err THEN 'invalid' WHEN coalesce(n, 0) < 17 THEN 'invalid' WHEN g > 180 THEN 'stale' ELSE 'ready' END AS status,
  CASE WHEN available THEN n ELSE 0 END AS n_genes, CASE WHEN available THEN g * 1e0 END AS age_days FROM m LEFT JOIN c USING (source)""")
def g10(spark, d):
    p = prior(spark, d)
    genes = p.select("source", "gene", "rank", "score").unionByName(p.filter("rank <= 9").select(F.lit("few").alias("source"), "gene", "rank", "score")).unionByName(
        p.select(F.lit("failed").alias("source"), "gene", "rank", "score"))
    now = F.to_timestamp(F.lit("2025-06-30T00:00:00Z"))
    stamp = {"pathway": "2025-06-10T00:00:00Z", "perturbation": "2024-05-26T00:00:00+00:00", "few": "2025-06-29T00:00:00Z", "failed": "2025-06-29T00:00:00Z", "absent": None}
    named = spark.createDataFrame([(s, s != "absent", {**({"generated_utc": t} if t else {}), **({"error": "x"} if s == "failed" else {})}) for s, t in stamp.items()],
                                  "source string, available boolean, metadata map<string,string>")
    return rnd(G.prior_status(named, genes, now))


_MAPPED = sorted({G.FEATURE_READS.get(f, f) for f in G.FEATURE_TARGETS})
_FT_SQL = "ft(feature, reads, mean, std) AS (VALUES " + ", ".join(
    f"('{f}', '{G.FEATURE_READS.get(f, f)}', {m}e0, {s}e0)" for f, (_, m, s) in G.FEATURE_TARGETS.items()) + "), tg(feature, target) AS (VALUES " + ", ".join(
    f"('{f}', '{t}')" for f, (ts, _, _) in G.FEATURE_TARGETS.items() for t in ts) + "), pn(target) AS (VALUES " + ", ".join(f"('{t}')" for t in PANEL) + ")"
Z_SQL = "WITH " + cells_sql(_MAPPED) + "," + _FT_SQL + ", mn AS (" + " UNION ALL ".join(
    f"SELECT field_id, '{f}' AS reads, avg({f}) AS o FROM cells GROUP BY ALL" for f in _MAPPED) + """),
fz AS MATERIALIZED (SELECT field_id, feature, (o - mean) / std AS z FROM mn JOIN ft USING (reads) WHERE o IS NOT NULL),
wr AS (SELECT f.field_id, p.target, coalesce(sum(abs(z)), 0) AS w FROM (SELECT DISTINCT field_id FROM fz) f CROSS JOIN pn p
       LEFT JOIN (SELECT field_id, target, z FROM fz JOIN tg USING (feature)) q ON q.field_id = f.field_id AND q.target = p.target GROUP BY ALL),
wf AS (SELECT field_id, target, greatest(w / sum(w) OVER (PARTITION BY field_id), 1e0 / 150) AS f FROM wr),
wt AS MATERIALIZED (SELECT field_id, target, f / sum(f) OVER (PARTITION BY field_id) AS weight FROM wf),
sz AS MATERIALIZED (SELECT f.field_id, p.target, coalesce(avg(z), 0) AS z FROM (SELECT DISTINCT field_id FROM fz) f CROSS JOIN pn p
       LEFT JOIN (SELECT field_id, target, z FROM fz JOIN tg USING (feature)) q ON q.field_id = f.field_id AND q.target = p.target GROUP BY ALL)"""


def weights(spark, d):
    z = pin(G.feature_z(cells(spark, d, _MAPPED), G.fallback_cohort(spark), FIELD))
    panel = spark.createDataFrame([(t,) for t in PANEL], "target string")
    ft = G.feature_targets(spark)
    return z, pin(G.target_weights(z, ft, panel, FIELD)), G.signed_target_z(z, ft, panel, FIELD)


@query("G11_feature_z", Z_SQL + " SELECT field_id, feature, round(z, 6) AS z FROM fz")
def g11(spark, d):
    return rnd(weights(spark, d)[0])


@query("G12_target_weights", Z_SQL + " SELECT field_id, target, round(weight, 9) AS weight FROM wt")
def g12(spark, d):
    return rnd(weights(spark, d)[1], 9)


@query("G13_signed_target_z", Z_SQL + " SELECT field_id, target, round(z, 6) AS z FROM sz")
def g13(spark, d):
    return rnd(weights(spark, d)[2])


_WM_SQL = """
pw AS MATERIALIZED (SELECT field_id, source, gene, rank, target, inverse, weight, z FROM prior JOIN wt USING (target) JOIN sz USING (field_id, target)),
wm AS (SELECT field_id, source, gene, min(inverse) AS score FROM (
   SELECT *, sum(weight) OVER (PARTITION BY field_id, source, gene ORDER BY inverse, weight ROWS UNBOUNDED PRECEDING) AS c, sum(weight) OVER (PARTITION BY field_id, source, gene) AS t FROM pw)
   WHERE c >= t / 2 * (1 - 1e-12) GROUP BY ALL),
sm AS (SELECT field_id, source, gene, min(v) AS signed_score FROM (
   SELECT *, sum(weight) OVER (PARTITION BY field_id, source, gene ORDER BY v, weight ROWS UNBOUNDED PRECEDING) AS c, sum(weight) OVER (PARTITION BY field_id, source, gene) AS t
   FROM (SELECT *, sign(z) * inverse AS v FROM pw)) WHERE c >= t / 2 * (1 - 1e-12) GROUP BY ALL),
dy AS (SELECT field_id, source, gene, score, signed_score, st.rank AS static_rank, row_number() OVER (PARTITION BY field_id, source ORDER BY score DESC NULLS LAST, st.rank, gene) AS dynamic_rank
       FROM wm JOIN sm USING (field_id, source, gene) JOIN (SELECT DISTINCT source, gene, rank FROM prior) st USING (source, gene))"""
RERANK_SQL = Z_SQL + "," + PRIOR_SQL + "," + _WM_SQL


@query("G14_weighted_median", RERANK_SQL + " SELECT field_id, source, gene, round(score, 6) AS score FROM wm")
def g14(spark, d):
    p = prior(spark, d).join(weights(spark, d)[1], "target")
    return rnd(G.weighted_median(p, ["field_id", "source", "gene"], "inverse", "weight"))


def reranked(spark, d, signed=True):
    _, w, s = weights(spark, d)
    return G.rerank(prior(spark, d), w, FIELD, s if signed else None), w, s


@query("G15_dynamic_rerank", RERANK_SQL + """ SELECT field_id, gene, round(score, 6) AS score, CAST(static_rank AS INT) AS static_rank, CAST(dynamic_rank AS INT) AS dynamic_rank FROM dy WHERE source = 'pathway'""")
def g15(spark, d):
    r = reranked(spark, d, False)[0].filter("source = 'pathway'")
    return rnd(r.select("field_id", "gene", "score", "static_rank", "dynamic_rank"))


@query("G16_signed_score", RERANK_SQL + " SELECT field_id, gene, round(signed_score, 6) + 0e0 AS signed_score FROM dy WHERE source = 'pathway'")
def g16(spark, d):
    return rnd(reranked(spark, d)[0].filter("source = 'pathway'").select("field_id", "gene", "signed_score"))


@query("G17_rerank_second_prior", RERANK_SQL + " SELECT field_id, gene, round(score, 6) AS score, CAST(dynamic_rank AS INT) AS dynamic_rank FROM dy WHERE source = 'perturbation'")
def g17(spark, d):
    return rnd(reranked(spark, d, False)[0].filter("source = 'perturbation'").select("field_id", "gene", "score", "dynamic_rank"))


@query("G18_static_dynamic_delta", RERANK_SQL + " SELECT field_id, source, gene, CAST(static_rank - dynamic_rank AS INT) AS delta FROM dy")
def g18(spark, d):
    return reranked(spark, d, False)[0].select("field_id", "source", "gene", "delta")


@query("G19_reachable_targets", "WITH " + PRIOR_SQL + """
SELECT source, gene, count(*) FILTER (inverse > 20 OR source = 'pathway') AS n_reachable, array_to_string(list_sort(list(DISTINCT target) FILTER (inverse > 20 OR source = 'pathway')), ',') AS targets FROM prior GROUP BY ALL""")
def g19(spark, d):
    p = prior(spark, d).withColumn("inverse", F.when((F.col("inverse") > 20) | (F.col("source") == "pathway"), F.col("inverse")).otherwise(0.0))
    return G.reachable_targets(p).withColumn("targets", F.array_join("targets", ","))


@query("G20_inhibitor_lookup", "WITH " + PRIOR_SQL + """,
inh AS (SELECT 'drug' || p_size AS inhibitor, min(p_brand) || CASE WHEN p_size % 4 = 0 THEN '?' ELSE '' END AS target FROM part GROUP BY p_size
  UNION ALL SELECT * FROM (VALUES ('2-DG', 'HK2'), ('DON', 'GFPT1'), ('tunicamycin', 'DPAGT1'), ('benzyl-GalNAc', 'GALNT family'), ('PUGNAc', 'OGA')) t(a, b))
SELECT inhibitor, target, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM inh LEFT JOIN r1 ON r1.gene = inh.target""")
def g20(spark, d):
    inh = table(spark, d, "part").groupBy("p_size").agg(F.min("p_brand").alias("b")).select(
        F.concat(F.lit("drug"), F.col("p_size").cast("string")).alias("inhibitor"), F.concat("b", F.when(F.col("p_size") % 4 == 0, "?").otherwise("")).alias("target"))
    inh = inh.unionByName(B.fixed_inhibitors(spark))
    return rnd(G.inhibitor_lookup(inh, source_of(prior(spark, d), "pathway")))


@query("G21_drilldown", _EV_SQL + """,
cut AS (SELECT gene, target, max(distance) AS distance, max(len(path) - 1) AS l FROM ev WHERE distance < 1.5e0 GROUP BY ALL),
ag AS (SELECT gene, target, sum(-ln(least(1e0, greatest(1e-6, confidence)))) AS cost, bool_or(source_tag = 'curated') AS curated FROM pa GROUP BY ALL)
SELECT s.source AS gene, t.target, distance IS NOT NULL AS reachable, round(distance, 6) AS distance, CAST(l AS INT) AS path_length, CASE WHEN distance IS NOT NULL THEN round(cost, 6) END AS cost,
  distance IS NOT NULL AND curated AS curated
FROM src0 s CROSS JOIN tgt0 t LEFT JOIN cut c ON c.gene = s.source AND c.target = t.target LEFT JOIN ag a ON a.gene = s.source AND a.target = t.target""")
def g21(spark, d):
    e, s, t = evidence(spark, d)
    return rnd(G.complete_drilldown(e.filter("distance < 1.5"), s.withColumnRenamed("source", "gene"), t)).withColumn("curated", F.coalesce("curated", F.lit(False)))


@query("G22_signature_matrix", "WITH " + PRIOR_SQL + " SELECT CAST(max(rank) AS INT) AS rank, gene, " + ", ".join(
    f"round(coalesce(max(inverse) FILTER (target = '{t}'), 0), 6) AS {t}" for t in PANEL) + " FROM prior WHERE source = 'pathway' GROUP BY gene")
def g22(spark, d):
    return rnd(G.signature_matrix(prior(spark, d).filter("source = 'pathway'"), PANEL))


@query("G23_path_subnetwork", _EV_SQL + """
SELECT least(a, b) AS src, greatest(a, b) AS dst, round(max(confidence), 9) AS confidence, bool_or(target = 'NATION_3') AS selected FROM pa WHERE gene = 'NATION_0' GROUP BY ALL""")
def g23(spark, d):
    return rnd(G.path_subnetwork(evidence(spark, d)[0], "NATION_0", "NATION_3"), 9)


@query("G24_top_weights", Z_SQL + """
SELECT field_id, target, round(weight, 9) AS weight, round(z, 6) AS z, CAST(rn AS INT) AS rank, CASE WHEN abs(z) < 0.1e0 THEN 'neutral' WHEN z > 0 THEN 'up' ELSE 'down' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY round(weight, 12) DESC, target) AS rn FROM wt JOIN sz USING (field_id, target)) WHERE rn <= 3""")
def g24(spark, d):
    _, w, s = weights(spark, d)
    t = G.top_weights(w.withColumn("weight", F.round("weight", 12)), s, FIELD)
    return t.select("field_id", "target", r6("weight", 9).alias("weight"), r6("z").alias("z"), "rank", "direction")
