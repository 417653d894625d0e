"""Queries E1..E29 on the line-item cell table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofleet.functions.scalar import mix31_sql
from cytofleet.operators import population as P
from cytofleet.operators import rules as B
from cytofleet.operators import screen as Q
from cytofleet.plans.adapters import cells, cells_sql, spread_table, table
from cytofleet.plans.q_raster import RADIAL_SQL, r6, regions_sql, ring_values
from cytofleet.plans.registry import query
from cytofleet.session import pin

KEY = ["field_id", "cell_id"]


def rnd(df, digits=6, keep=()):
    """Round every double column."""
    return df.select(*[
        r6(n, digits).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes])


RESID_SQL = """
rs AS (SELECT field_id, count(*) AS n, avg(cell_area) AS mx, var_pop(cell_area) AS vx, var_pop(yap_nc_ratio) AS vy, covar_pop(yap_nc_ratio, cell_area) AS c
       FROM cells WHERE cell_area IS NOT NULL AND yap_nc_ratio IS NOT NULL GROUP BY field_id),
rg AS (SELECT *, CASE WHEN n >= 30 THEN CASE WHEN vx > 0 THEN c / vx ELSE 0 END END AS slope,
              CASE WHEN n >= 30 THEN CASE WHEN vx > 0 AND vy > 0 THEN c * c / (vx * vy) ELSE 0 END END AS r2 FROM rs),
res AS (SELECT cells.*, slope, r2, coalesce(r2 >= 0.05, FALSE) AS applied,
               CASE WHEN coalesce(r2 >= 0.05, FALSE) THEN yap_nc_ratio - slope * (cell_area - mx) ELSE yap_nc_ratio END AS yap_nc_ratio_size_corrected
        FROM cells JOIN rg USING (field_id))"""


@query("E1_residualisation", "WITH " + cells_sql(["yap_nc_ratio", "cell_area"]) + "," + RESID_SQL + """
SELECT field_id, cell_id, round(yap_nc_ratio_size_corrected, 6) AS corrected, round(slope, 9) AS slope, round(r2, 6) AS r2, applied FROM res""")
def e1(spark, d):
    r = P.residualise(cells(spark, d, ["yap_nc_ratio", "cell_area"]))
    return r.select(*KEY, r6("yap_nc_ratio_size_corrected").alias("corrected"), r6("slope", 9).alias("slope"), r6("r2").alias("r2"), "applied")


_HASH_KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]


def _keyed_cells(spark, d, features):
    """Cell table that also carries its integer keys (for hash draws)."""
    t = spread_table(spark, d, "lineitem")
    from cytofleet.plans.adapters import _CELL_ID, _FEATURES
    return t.select(
        F.col("l_suppkey").alias("field_id"), F.expr(_CELL_ID).alias("cell_id"), F.col("l_returnflag").alias("condition"), *_HASH_KEYS,
        *[F.expr(f"cast(floor(({_FEATURES[f]}) * 1024) as double) / 1024D").alias(f) for f in features])


def _keyed_sql(features):
    return cells_sql(features).replace("AS condition, ", "AS condition, " + ", ".join(_HASH_KEYS) + ", ")


_POISSON = " + ".join(f"CASE WHEN u >= {c}e0 THEN 1 ELSE 0 END" for c in P.POISSON1_CDF)
_BOOT = 200


@query("E2_bootstrap_slope_ci", "WITH " + _keyed_sql(["yap_nc_ratio", "cell_area"]) + f""",
m AS (SELECT field_id, avg(cell_area) AS mx, avg(yap_nc_ratio) AS my FROM cells GROUP BY ALL),
b AS (SELECT field_id, r AS replicate, cell_area - mx AS x, yap_nc_ratio - my AS y, {mix31_sql(42, 'r', *_HASH_KEYS)} / 2147483647e0 AS u
      FROM cells JOIN m USING (field_id), (SELECT unnest(range({_BOOT})) AS r)),
w AS (SELECT field_id, replicate, x, y, {_POISSON} AS w FROM b),
s AS (SELECT field_id, replicate, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w WHERE w > 0 GROUP BY ALL),
sl AS (SELECT field_id, CASE WHEN sxx - sx * sx / sw > 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END AS slope FROM s)
SELECT field_id, round(quantile_cont(slope, 0.025), 8) AS slope_ci_lo, round(quantile_cont(slope, 0.975), 8) AS slope_ci_hi, count(slope) AS n_resamples FROM sl GROUP BY ALL""")
def e2(spark, d):
    c = _keyed_cells(spark, d, ["yap_nc_ratio", "cell_area"])
    return rnd(P.bootstrap_slope_ci(c, "yap_nc_ratio", "cell_area", _HASH_KEYS, resamples=_BOOT), 8)


_Z = ["cell_area", "fa_mean_orientation_alignment", "nuclear_solidity"]


@query("E3_zscores", "WITH " + cells_sql(_Z) + """
SELECT field_id, cell_id, round((cell_area - avg(cell_area) OVER f) / stddev_pop(cell_area) OVER f, 6) AS z_cell_area,
  round((fa_mean_orientation_alignment - avg(fa_mean_orientation_alignment) OVER f) / stddev_pop(fa_mean_orientation_alignment) OVER f, 6) AS z_fa_mean_orientation_alignment,
  round((avg(nuclear_solidity) OVER f - nuclear_solidity) / stddev_pop(nuclear_solidity) OVER f, 6) AS z_nuclear_solidity
FROM cells WINDOW f AS (PARTITION BY field_id)""")
def e3(spark, d):
    z = P.zscores(cells(spark, d, _Z), ["cell_area", "fa_mean_orientation_alignment", "-nuclear_solidity"])
    return z.select(*KEY, *[r6(f"z_{f}").alias(f"z_{f}") for f in _Z])


_PANEL_IN = ["yap_nc_ratio", "cell_area"] + [f.lstrip("-") for f in P.SCORE_PANEL[1:]]


def scored(spark, d):
    return P.composite_score(P.residualise(cells(spark, d, _PANEL_IN), keep=True))


@query("E4_composite_score_pc1")
def e4(spark, d):
    s = scored(spark, d)
    return s.select(*KEY, r6("mechano_score", 5).alias("mechano_score"), "score_mode", "n_complete", r6("explained", 5).alias("explained"))


def _zsql(f):
    n = f.lstrip("-")
    diff = f"avg({n}) OVER f - {n}" if f.startswith("-") else f"{n} - avg({n}) OVER f"
    return f"CASE WHEN stddev_pop({n}) OVER f > 0 THEN ({diff}) / stddev_pop({n}) OVER f WHEN {n} IS NOT NULL THEN 0 END AS z_{n}"


_P5 = ["yap_nuclear_intensity", "fa_mature_fraction", "fa_mean_orientation_alignment", "-nuclear_solidity"]


@query("E5_equal_weight_score", "WITH " + cells_sql([f.lstrip("-") for f in _P5]) + ", z AS (SELECT field_id, cell_id, " + ", ".join(_zsql(f) for f in _P5) + """
FROM cells WINDOW f AS (PARTITION BY field_id))
SELECT field_id, cell_id, round(list_avg([x FOR x IN [""" + ", ".join("z_" + f.lstrip("-") for f in _P5) + """] IF x IS NOT NULL]), 6) AS mechano_score, 'weighted_sum' AS score_mode FROM z""")
def e5(spark, d):
    s = P.composite_score(cells(spark, d, [f.lstrip("-") for f in _P5]), _P5, mode="weighted_sum")
    return s.select(*KEY, r6("mechano_score").alias("mechano_score"), "score_mode")


@query("E6_score_summary")
def e6(spark, d):
    s = P.score_summary(scored(spark, d))
    load = F.transform_values("loadings", lambda k, v: F.round(v, 4))
    return rnd(s.withColumn("loadings", F.to_json(load)), 5)


# Batches with an injected shift and scale, so that there is something to correct.
_BF = ["cell_area", "fa_mean_orientation_alignment"]
_SHIFT = {"cell_area": "CASE batch WHEN 'A' THEN 0e0 WHEN 'N' THEN 1500e0 ELSE -800e0 END + cell_area * CASE batch WHEN 'A' THEN 1e0 WHEN 'N' THEN 1.25e0 ELSE 0.75e0 END",
          "fa_mean_orientation_alignment": "fa_mean_orientation_alignment * CASE batch WHEN 'A' THEN 1e0 WHEN 'N' THEN 1.5e0 ELSE 0.5e0 END"}
_BATCH_SQL = "WITH " + cells_sql(_BF) + ", bat AS (SELECT field_id, cell_id, batch, " + ", ".join(f"{e} AS {n}" for n, e in _SHIFT.items()) + " FROM cells)"


def _batched(spark, d):
    return cells(spark, d, _BF).select(*KEY, "batch", *[F.expr(e).alias(n) for n, e in _SHIFT.items()])


def _combat_sql(f):
    return f"""
{f}_g AS (SELECT avg({f}) AS gm, greatest(stddev_pop({f}), 1e-8) AS gs FROM bat),
{f}_z AS (SELECT field_id, cell_id, batch, ({f} - gm) / gs AS z, gm, gs FROM bat, {f}_g),
{f}_b AS (SELECT batch, count(*) AS n, avg(z) AS g, greatest(var_samp(z), 1e-8) AS d FROM {f}_z GROUP BY batch),
{f}_h AS (SELECT avg(g) AS gbar, greatest(var_samp(g), 1e-8) AS t2, avg(d) AS dm, greatest(var_samp(d), 1e-8) AS dv FROM {f}_b),
{f}_p AS (SELECT batch, n, (n * t2 * g + d * gbar) / (n * t2 + d) AS gst, (dm * dm + 2 * dv) / dv AS lam, (dm * dm * dm + dm * dv) / dv AS the FROM {f}_b, {f}_h),
{f}_s AS (SELECT batch, sum((z - gst) * (z - gst)) AS sse FROM {f}_z JOIN {f}_p USING (batch) GROUP BY batch),
{f}_c AS (SELECT field_id, cell_id, batch, (z - gst) / sqrt(greatest((the + 0.5e0 * sse) / (n / 2e0 + lam - 1), 1e-8)) * gs + gm AS v
          FROM {f}_z JOIN {f}_p USING (batch) JOIN {f}_s USING (batch))"""


@query("E7_combat", _BATCH_SQL + "," + ",".join(_combat_sql(f) for f in _BF) + """
SELECT a.field_id, a.cell_id, a.batch, round(a.v, 5) AS cell_area, round(b.v, 6) AS fa_mean_orientation_alignment
FROM cell_area_c a JOIN fa_mean_orientation_alignment_c b ON a.field_id = b.field_id AND a.cell_id = b.cell_id""")
def e7(spark, d):
    c = P.combat(_batched(spark, d), _BF)
    return c.select(*KEY, "batch", r6("cell_area", 5).alias("cell_area"), r6("fa_mean_orientation_alignment").alias("fa_mean_orientation_alignment"))


@query("E8_batch_effect", _BATCH_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, batch, avg({f}) AS m, var_samp({f}) AS v FROM bat GROUP BY batch" for f in _BF) + """),
r AS (SELECT feature, sqrt(var_samp(m) / avg(v)) AS ratio FROM s GROUP BY feature)
SELECT feature, round(ratio, 6) AS ratio, TRUE AS applicable, CAST(NULL AS VARCHAR) AS reason, 3 AS n_batches, 2 AS n_features,
  round((SELECT max(ratio) FROM r), 6) AS max_ratio, round((SELECT median(ratio) FROM r), 6) AS median_ratio FROM r""")
def e8(spark, d):
    b = _batched(spark, d)
    s = P.batch_effect_summary(b, _BF).withColumn("_k", F.lit(1))
    return rnd(P.batch_effect(b, _BF).withColumn("_k", F.lit(1)).join(s, "_k").drop("_k"))


_ST = ["cell_area", "fa_count", "glycocalyx_moran_i", "yap_nc_ratio"]


@query("E9_population_stats", "WITH " + cells_sql(_ST) + " " + " UNION ALL ".join(
    f"SELECT field_id, '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END, 6) AS std,"
    f" round(min({f}), 6) AS min, round(max({f}), 6) AS max FROM cells GROUP BY field_id" for f in _ST))
def e9(spark, d):
    return rnd(P.population_stats(cells(spark, d, _ST), _ST))


@query("E10_field_relative_z", "WITH " + cells_sql(["cell_area", "glycocalyx_moran_i"]) + """
SELECT field_id, cell_id, round((cell_area - avg(cell_area) OVER f) / stddev_pop(cell_area) OVER f, 6) AS z_cell_area,
  round(coalesce((glycocalyx_moran_i - avg(glycocalyx_moran_i) OVER f) / stddev_pop(glycocalyx_moran_i) OVER f, 0), 6) AS z_glycocalyx_moran_i
FROM cells WINDOW f AS (PARTITION BY field_id)""")
def e10(spark, d):
    z = P.relative_z(cells(spark, d, ["cell_area", "glycocalyx_moran_i"]), ["cell_area", "glycocalyx_moran_i"])
    return z.select(*KEY, r6("z_cell_area").alias("z_cell_area"), r6("z_glycocalyx_moran_i").alias("z_glycocalyx_moran_i"))


_HERO = [f for f in P.HERO_FEATURES if f != "yap_nc_ratio_size_corrected"]


@query("E11_hero_metrics", "WITH " + cells_sql(_HERO + ["cell_area"]) + "," + RESID_SQL + " SELECT field_id, count(*) AS cell_count, " + ", ".join(
    f"round(avg({f}), 6) AS mean_{f}" for f in P.HERO_FEATURES) + " FROM res GROUP BY field_id")
def e11(spark, d):
    return rnd(P.hero_metrics(P.residualise(cells(spark, d, _HERO + ["cell_area"]))))


@query("E12_mean_radial_profile", regions_sql(["glycocalyx"]) + "," + RADIAL_SQL + """
SELECT g.field_id, CAST(i AS INT) AS bin, round(avg(CAST(CAST(mean AS FLOAT) AS DOUBLE)), 5) AS mean, round(stddev_pop(CAST(CAST(mean AS FLOAT) AS DOUBLE)), 5) AS std
FROM (SELECT field_id, cell_id, unnest(range(20)) AS i FROM shape) g LEFT JOIN rb r ON r.field_id = g.field_id AND r.cell_id = g.cell_id AND r.bin = i GROUP BY ALL""")
def e12(spark, d):
    from cytofleet.operators import cells as D
    from cytofleet.operators import raster as R
    from cytofleet.plans.adapters import pixels
    px = pixels(spark, d, ["glycocalyx"])
    _, reg = ring_values(spark, d)
    roi = D.over(px, reg.ring).unionByName(D.over(px, reg.labels.select(*KEY, "y", "x")))
    prof = R.radial_profile(R.radial_bins(roi, reg.centroids))
    return rnd(P.mean_profile(prof.withColumn("radial_profile", F.col("radial_profile").cast("array<double>"))), 5)


_SA, _SB = Q.BLOCK_A, [b for b in Q.BLOCK_B if b != "yap_nc_ratio_size_corrected"]
#: All features of the synthetic cells that are numbers.
_CM = sorted({*_SA, *_SB, "cell_area", "nuclear_area", "fa_count", "fa_mean_area", "yap_nuclear_fraction"})


@query("E13_correlation_matrix", "WITH " + cells_sql(_CM) + " SELECT unnest([" + ", ".join(
    f"struct_pack(a := '{a}', b := '{b}', n := count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), r := round(corr({a}, {b}), 6))" for a in _CM for b in _CM)
    + "], recursive := true) FROM cells")
def e13(spark, d):
    return rnd(Q.correlation_matrix(cells(spark, d, _CM), _CM))


def _screen_sql(a, b):
    return (f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(ra, rb), 6) AS r FROM (SELECT "
            f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 AS rb "
            f"FROM cells WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("E14_cross_block_screen", "WITH " + cells_sql(_SA + _SB) + " " + " UNION ALL ".join(_screen_sql(a, b) for a in _SA for b in _SB))
def e14(spark, d):
    return rnd(Q.correlation_screen(cells(spark, d, _SA + _SB), _SA, _SB))


def _full_screen(spark, d):
    s = Q.correlation_screen(cells(spark, d, _SA + _SB), _SA, _SB)
    return Q.benjamini_hochberg(Q.with_parametric_p(s))


@query("E15_parametric_p")
def e15(spark, d):
    return rnd(Q.with_parametric_p(Q.correlation_screen(cells(spark, d, _SA + _SB), _SA, _SB)))


_PERM = 1000


#: Constants of the bijection, repeated here so that the twin does not rest on the operator.
_MULTIPLIERS = [(1103515245, 1566083941), (1812433253, 1234567891), (1664525013, 1299709021), (1640531527, 1181783497), (1597334677, 1220703125)]


def _mixed_sql(v, add, flip, m):
    return f"(xor(xor((({v} + 715827882) * {m} + {add}) % 2147483647, {flip}) * 1103515245 % 2147483647, {add}) * {m} % 2147483647)"


def _passes_sql(source, passes=9):
    """Rows of ``source`` with x sent through the bijection until it is below n (the driver's fields need few passes)."""
    base, sql = "field_id, rx, n, a, b, p, ka, kb, x", f"SELECT *, n AS x0 FROM ({source})"
    for _ in range(passes):
        still = lambda e: f"CASE WHEN x0 >= n THEN {e} END"
        sql = f"SELECT {base}, x0, {still('x % a')} AS l, {still('x // a')} AS r FROM ({sql})"
        for m1, m2 in _MULTIPLIERS:
            left, right = f"(l + {_mixed_sql('r', 'ka', 'kb', m1)}) % a", f"(r + {_mixed_sql('l', 'kb', 'ka', m2)}) % b"
            sql = f"SELECT {base}, x0, {still(left)} AS l, r FROM ({sql})"
            sql = f"SELECT {base}, x0, l, {still(right)} AS r FROM ({sql})"
        moved = "CASE WHEN x0 >= n THEN r * a + l ELSE x END"
        sql = f"SELECT field_id, rx, n, a, b, p, ka, kb, {moved} AS x, {moved} AS x0 FROM ({sql})"
    return f"SELECT field_id, p, rx, x AS pos FROM ({sql})"


@query("E16_permutation_p", "WITH " + _keyed_sql(["glycocalyx_coverage", "fa_mean_area"]) + f""",
rk AS (SELECT field_id, l_orderkey, l_partkey, l_linenumber,
         2 * rank() OVER (PARTITION BY field_id ORDER BY glycocalyx_coverage) + count(*) OVER (PARTITION BY field_id, glycocalyx_coverage) - 1 AS rx,
         2 * rank() OVER (PARTITION BY field_id ORDER BY fa_mean_area) + count(*) OVER (PARTITION BY field_id, fa_mean_area) - 1 AS ry FROM cells),
ob AS (SELECT field_id, count(*) AS n, sum(rx * ry) AS xy, sum(rx) AS sx, sum(ry) AS sy FROM rk GROUP BY ALL),
bs AS (SELECT field_id, rx, ry, row_number() OVER (PARTITION BY field_id ORDER BY {mix31_sql(42, *_HASH_KEYS)}, l_orderkey, l_partkey, l_linenumber, rx, ry) - 1 AS pos FROM rk),
pm AS (SELECT p, {mix31_sql(43, 'p')} AS ka, {mix31_sql(44, 'p')} AS kb FROM (SELECT unnest(range(1, {_PERM + 1})) AS p)),
sd AS (SELECT field_id, n, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM ob),
st AS (SELECT field_id, rx, n, a, (n + a - 1) // a AS b, p, ka, kb, pos AS x FROM bs JOIN sd USING (field_id), pm),
sh AS (""" + _passes_sql("SELECT * FROM st") + f"""),
pp AS (SELECT field_id, p, sum(sh.rx * s.ry) AS pxy FROM sh JOIN bs s USING (field_id, pos) GROUP BY ALL)
SELECT field_id, max(n) AS n, count(*) FILTER (abs(n * pxy - sx * sy) >= abs(n * xy - sx * sy)) AS extreme,
  round((count(*) FILTER (abs(n * pxy - sx * sy) >= abs(n * xy - sx * sy)) + 1) / {_PERM + 1}e0, 6) AS p FROM pp JOIN ob USING (field_id) GROUP BY field_id""")
def e16(spark, d):
    c = _keyed_cells(spark, d, ["glycocalyx_coverage", "fa_mean_area"])
    return rnd(Q.permutation_p(c, "glycocalyx_coverage", "fa_mean_area", _PERM, _HASH_KEYS, ["field_id"]))


@query("E17_benjamini_hochberg")
def e17(spark, d):
    return rnd(_full_screen(spark, d).withColumn("stars", B.stars(F.col("q"))), 9)


@query("E18_screen_headline")
def e18(spark, d):
    return rnd(Q.screen_headline(_full_screen(spark, d)))


_CF = [f for f in Q.COMPARED if f != "yap_nc_ratio_size_corrected"]


@query("E19_two_condition_comparison", "WITH " + cells_sql(_CF) + " " + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count({f}) FILTER (condition = 'A') AS n_a, count({f}) FILTER (condition = 'R') AS n_b,
  round((avg({f}) FILTER (condition = 'R') - avg({f}) FILTER (condition = 'A')) / sqrt((var_pop({f}) FILTER (condition = 'A') + var_pop({f}) FILTER (condition = 'R')) / 2), 3) AS cohens_d,
  round(avg({f}) FILTER (condition = 'A'), 4) AS mean_a, round(avg({f}) FILTER (condition = 'R'), 4) AS mean_b,
  round((avg({f}) FILTER (condition = 'R') - avg({f}) FILTER (condition = 'A')) / abs(avg({f}) FILTER (condition = 'A')) * 100, 1) AS delta_pct FROM cells""" for f in _CF))
def e19(spark, d):
    return rnd(Q.compare_conditions(cells(spark, d, _CF), "condition", "A", "R"))


_TEXT_SQL = "WITH t AS (SELECT n_chars * 1e0 AS v, quality FROM documents JOIN labels USING (doc_id))"


def _u_sql(src, v, arm, a):
    return f"""r AS (SELECT {arm} AS arm, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2e0 AS rk FROM {src}),
ti AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS tie FROM (SELECT count(*) AS n FROM {src} GROUP BY {v})),
uu AS (SELECT count(*) FILTER (arm = {a}) AS n_a, count(*) FILTER (arm <> {a}) AS n_b, sum(rk) FILTER (arm = {a}) AS s FROM r)"""


@query("E20_mann_whitney", _TEXT_SQL + "," + _u_sql("t", "v", "quality", "0") + """
SELECT 'n_chars' AS feature, n_a, n_b, s - n_a * (n_a + 1) / 2e0 AS u, tie,
  round((greatest(s - n_a * (n_a + 1) / 2e0, n_a * n_b - (s - n_a * (n_a + 1) / 2e0)) - n_a * n_b / 2e0 - 0.5e0)
    / sqrt(n_a * n_b / 12e0 * ((n_a + n_b + 1) - tie / ((n_a + n_b) * (n_a + n_b - 1e0)))), 6) AS z FROM uu, ti""")
def e20(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("value")).join(
        table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("arm")), "doc_id").withColumn("feature", F.lit("n_chars"))
    u = Q.rank_sum(t, "arm", "0", ["feature"])
    ab = F.col("n_a").cast("double") * F.col("n_b")
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    z = (F.greatest(F.col("u"), ab - F.col("u")) - ab / 2 - 0.5) / F.sqrt(ab / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    return u.withColumn("z", r6(z))


@query("E20_mann_whitney_p")
def e20p(spark, d):
    return rnd(Q.compare_with_p(cells(spark, d, _CF), "condition", "A", "R"))


@query("E21_top_deltas", "WITH " + cells_sql(_CF) + ", e AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, round((avg({f}) FILTER (condition = 'R') - avg({f}) FILTER (condition = 'A'))
      / sqrt((var_pop({f}) FILTER (condition = 'A') + var_pop({f}) FILTER (condition = 'R')) / 2), 3) AS cohens_d FROM cells""" for f in _CF) +
    ") SELECT feature, cohens_d FROM e ORDER BY abs(cohens_d) DESC, feature LIMIT 5")
def e21(spark, d):
    return Q.top_deltas(Q.compare_conditions(cells(spark, d, _CF), "condition", "A", "R")).select("feature", r6("cohens_d", 3).alias("cohens_d"))


_CAPF = ["cell_area", "glycocalyx_moran_i"]


@query("E21_capped_samples", "WITH " + cells_sql(_CAPF) + " " + " UNION ALL ".join(
    f"SELECT condition, '{f}' AS feature, count(*) AS n, round(sum({f}), 6) AS total FROM (SELECT condition, {f}, row_number() OVER (PARTITION BY condition ORDER BY field_id, cell_id) AS i"
    f" FROM cells WHERE {f} IS NOT NULL) WHERE i <= 500 GROUP BY condition" for f in _CAPF))
def e21b(spark, d):
    s = Q.capped_samples(cells(spark, d, _CAPF), "condition", _CAPF, ["field_id", "cell_id"])
    return s.select("condition", "feature", F.size("values").cast("bigint").alias("n"), r6(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)).alias("total"))


QC_IN = ["cell_area", "nuclear_area", "nuclear_to_cell_area_ratio", "solidity", "glycocalyx_mean_intensity", "yap_nuclear_intensity", "actin_cortical_ratio"]


def qc_input(c):
    """Columns renamed so every rule has an input."""
    return c.withColumnsRenamed({"solidity": "cell_solidity", "actin_cortical_ratio": "actin_mean_intensity"})


_S = "CASE WHEN stddev_pop({0}) OVER f > 0 THEN stddev_pop({0}) OVER f ELSE 1 END"
QC_SQL = f"""
q0 AS (SELECT *, avg(cell_area) OVER f AS am, {_S.format('cell_area')} AS asd, avg(nuclear_area) OVER f AS nm, {_S.format('nuclear_area')} AS nsd,
              avg(glycocalyx_mean_intensity) OVER f AS wm, {_S.format('glycocalyx_mean_intensity')} AS wsd FROM cells WINDOW f AS (PARTITION BY field_id)),
qc AS (SELECT *, [x FOR x IN [
   CASE WHEN cell_area < greatest(40, am - 2.5e0 * asd) THEN 'very small cell area' END,
   CASE WHEN cell_area > am + 3 * asd THEN 'very large cell area' END,
   CASE WHEN nuclear_area < greatest(12, nm - 2.5e0 * nsd) THEN 'low nuclear signal' END,
   CASE WHEN nuclear_to_cell_area_ratio < 0.03e0 OR nuclear_to_cell_area_ratio > 0.75e0 THEN 'abnormal nuclear-to-cell area ratio' END,
   CASE WHEN solidity < 0.72e0 THEN 'segmentation confidence low' END,
   CASE WHEN solidity < 0.65e0 THEN 'overlapping/touching cells' END,
   CASE WHEN glycocalyx_mean_intensity > 0.98e0 THEN 'saturated WGA channel' END,
   CASE WHEN actin_cortical_ratio > 0.98e0 THEN 'saturated actin channel' END,
   CASE WHEN yap_nuclear_intensity > 0.98e0 THEN 'saturated nuclear channel' END,
   CASE WHEN cell_area < 80 AND nuclear_area < 20 THEN 'high debris probability' END,
   CASE WHEN glycocalyx_mean_intensity < wm - 2 * wsd THEN 'low signal-to-background ratio' END] IF x IS NOT NULL] AS flags FROM q0),
qr AS (SELECT *, len([x FOR x IN flags IF x NOT IN ('overlapping/touching cells', 'low signal-to-background ratio')]) = 0 AS analysis_ready FROM qc)"""
_C22 = sorted(set(QC_IN + ["glycocalyx_pericellular_ratio", "fa_mature_fraction", "actin_stress_fiber_coherence", "mechano_score"]))


@query("E22_condition_summary", "WITH " + cells_sql(_C22) + "," + QC_SQL + """,
g AS (SELECT condition, count(*) AS n_total, count(*) FILTER (analysis_ready) AS n_ready, avg(glycocalyx_pericellular_ratio) FILTER (analysis_ready) AS wga,
        avg(fa_mature_fraction) FILTER (analysis_ready) AS fa, avg(actin_stress_fiber_coherence) FILTER (analysis_ready) AS actin, avg(cell_area) FILTER (analysis_ready) AS spread_area,
        avg(mechano_score) FILTER (analysis_ready) AS prototype_score FROM qr GROUP BY ALL)
SELECT condition, n_total, n_ready, round(wga, 6) AS wga, round(fa, 6) AS fa, round(actin, 6) AS actin, round(spread_area, 6) AS spread_area, round(prototype_score, 6) AS prototype_score,
  round((n_total - n_ready) * 1e0 / n_total, 6) AS qc_exclusion, round(prototype_score - (SELECT prototype_score FROM g WHERE condition = 'A'), 6) AS effect FROM g""")
def e22(spark, d):
    c = B.qc_flags(qc_input(cells(spark, d, _C22)))
    return rnd(P.condition_summary(c, P.condition_key(c)))


@query("E23_field_qc", "WITH " + cells_sql(QC_IN) + "," + QC_SQL + """,
raw AS (SELECT field_id, count(*) + field_id % 5 AS raw_masks FROM cells GROUP BY field_id),
g AS (SELECT field_id, count(*) AS measured, count(*) FILTER (analysis_ready) AS ready, count(*) FILTER (len(flags) > 0) AS fl,
        count(*) FILTER (list_contains(flags, 'saturated nuclear channel')) AS sn, count(*) FILTER (list_contains(flags, 'saturated WGA channel')) AS sw,
        count(*) FILTER (list_contains(flags, 'saturated actin channel')) AS sa FROM qr GROUP BY ALL)
SELECT field_id, raw_masks, measured, ready, fl + greatest(0, raw_masks - measured) AS flagged, greatest(0, raw_masks - ready) AS excluded,
  round(greatest(0, raw_masks - ready) * 1e0 / raw_masks, 6) AS excluded_fraction, round(measured * 1e0 / raw_masks, 6) AS segmentation_success,
  round(sn * 1e0 / measured, 6) AS sat_nuclear, round(sw * 1e0 / measured, 6) AS sat_wga, round(sa * 1e0 / measured, 6) AS sat_actin FROM g JOIN raw USING (field_id)""")
def e23(spark, d):
    c = cells(spark, d, QC_IN)
    raw = c.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).select("field_id", (F.col("n") + F.col("field_id") % 5).alias("raw_masks"))
    return rnd(P.field_qc(B.qc_flags(qc_input(c)), raw))


@query("E24_nearest_rank_groups", "WITH " + cells_sql(["mechano_score"]) + """,
q AS (SELECT field_id, s[CAST(floor(0.1e0 * (len(s) - 1)) AS INT) + 1] AS q10, s[CAST(floor(0.5e0 * (len(s) - 1)) AS INT) + 1] AS q50, s[CAST(floor(0.9e0 * (len(s) - 1)) AS INT) + 1] AS q90
      FROM (SELECT field_id, list(mechano_score ORDER BY mechano_score) AS s FROM cells WHERE mechano_score IS NOT NULL GROUP BY ALL))
SELECT field_id, q10, q50, q90, round(avg(mechano_score), 6) AS mean, count(*) FILTER (mechano_score <= q10) AS n_low,
  count(*) FILTER (mechano_score > q10 AND mechano_score < q90) AS n_mid, count(*) FILTER (mechano_score >= q90) AS n_high
FROM cells JOIN q USING (field_id) GROUP BY ALL""")
def e24(spark, d):
    return P.nearest_rank_groups(cells(spark, d, ["mechano_score"]), "mechano_score").withColumn("mean", r6("mean"))


@query("E24_extremes", "WITH " + cells_sql(["mechano_score"]) + """
SELECT field_id, cell_id, mechano_score AS value, CAST(rn AS INT) AS rank, side FROM (
  SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY mechano_score, cell_id) AS rn, 'low' AS side FROM cells
  UNION ALL SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY mechano_score DESC, cell_id) AS rn, 'high' AS side FROM cells) WHERE rn <= 5""")
def e24b(spark, d):
    return P.extremes(cells(spark, d, ["mechano_score"]), "mechano_score")


@query("E25_score_histogram", "WITH " + cells_sql(["mechano_score"]) + """,
m AS (SELECT field_id, min(mechano_score) AS lo, max(mechano_score) AS hi, avg(mechano_score) AS mean FROM cells GROUP BY ALL)
SELECT field_id, CAST(least(24, floor((mechano_score - lo) / (hi - lo) * 25)) AS INT) AS bin, count(*) AS n,
  round(lo + least(24, floor((mechano_score - lo) / (hi - lo) * 25)) * ((hi - lo) / 25), 10) AS left_edge, round(mean, 6) AS mean FROM cells JOIN m USING (field_id) GROUP BY ALL""")
def e25(spark, d):
    h = P.score_histogram(cells(spark, d, ["mechano_score"]))
    return h.select("field_id", "bin", "n", r6("left", 10).alias("left_edge"), r6("mean").alias("mean"))


@query("E26_top_cells", "WITH " + cells_sql(["mechano_score"]) + """
SELECT field_id, cell_id, mechano_score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY abs(mechano_score) DESC, cell_id) AS rn FROM cells) WHERE rn <= 5""")
def e26(spark, d):
    return P.top_cells(cells(spark, d, ["mechano_score"])).select(*KEY, "mechano_score", "rank")


_DV = ["cell_area", "fa_count", "glycocalyx_moran_i", "actin_cortical_ratio", "nuclear_area", "yap_nuclear_fraction", "fa_mean_area", "glycocalyx_coverage"]


@query("E27_top_deviations", "WITH " + cells_sql(_DV) + ", l AS (" + " UNION ALL ".join(
    f"SELECT field_id, cell_id, '{f}' AS feature, {f} AS value, ({f} - avg({f}) OVER f) / CASE WHEN stddev_pop({f}) OVER f > 0 THEN stddev_pop({f}) OVER f ELSE 1 END AS z FROM cells WINDOW f AS (PARTITION BY field_id)"
    for f in _DV) + """)
SELECT field_id, cell_id, CAST(rn AS INT) AS rank, feature, round(z, 6) AS z, value,
  CASE WHEN feature LIKE 'glycocalyx_%' THEN 'glycocalyx' WHEN feature LIKE 'yap_%' THEN 'yap' WHEN feature LIKE 'fa_%' THEN 'adhesion' WHEN feature LIKE 'actin_%' THEN 'actin' ELSE 'morphology' END AS family
FROM (SELECT *, row_number() OVER (PARTITION BY field_id, cell_id ORDER BY abs(z) DESC, feature) AS rn FROM l WHERE value IS NOT NULL) WHERE rn <= 6""")
def e27(spark, d):
    return P.top_deviations(cells(spark, d, _DV), _DV).withColumn("z", r6("z"))


@query("E28_adjacent_cells", "WITH " + cells_sql(["mechano_score"]) + """
SELECT field_id, cell_id, lag(cell_id) OVER w AS previous, lead(cell_id) OVER w AS next FROM cells WINDOW w AS (PARTITION BY field_id ORDER BY cell_id)""")
def e28(spark, d):
    return P.adjacent_cells(cells(spark, d, ["mechano_score"]))


_PW = ["cell_area", "glycocalyx_mean_intensity", "glycocalyx_coverage"]


_LONG_PW = " UNION ALL ".join(f"SELECT replicate, i, '{f}' AS feature, {f} AS value FROM dr WHERE {f} IS NOT NULL" for f in _PW)
# arms of 50 always take the normal tail, where p < 0.05 is z above its two-sided 5 percent point
POWER_SQL = "WITH " + _keyed_sql(_PW) + f""",
hs AS (SELECT cells.*, r AS replicate, {mix31_sql(42, 'r', *_HASH_KEYS)} AS h FROM cells, (SELECT unnest(range(1, 31)) AS r)),
dr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY h, l_orderkey, l_partkey, l_linenumber) AS i FROM hs) WHERE i <= 100),
lo AS ({_LONG_PW}),
ap AS (SELECT replicate, feature, effect, i <= 50 AS base, CASE WHEN i <= 50 THEN value ELSE value * effect END AS v
       FROM lo, (SELECT unnest([0.5e0, 0.67e0, 0.8e0, 0.9e0, 1.1e0, 1.25e0, 1.5e0, 2e0]) AS effect)),
ra AS (SELECT *, rank() OVER (PARTITION BY replicate, feature, effect ORDER BY v) AS lowest, count(*) OVER (PARTITION BY replicate, feature, effect, v) AS t FROM ap),
us AS (SELECT replicate, feature, effect, count(*) FILTER (base) AS na, count(*) FILTER (NOT base) AS nb, sum(lowest + (t - 1) / 2e0) FILTER (base) AS r, sum(t * t - 1) AS tie FROM ra GROUP BY ALL),
zs AS (SELECT feature, effect, na, nb, r - na * (na + 1) / 2e0 AS u, na * nb / 12e0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1e0))) AS var FROM us),
pw AS (SELECT feature, effect, count(*) FILTER (var > 0 AND (greatest(u, na * nb - u) - na * nb / 2e0 - 0.5e0) > 1.959963984540054e0 * sqrt(greatest(var, 0))) / 30e0 AS power FROM zs GROUP BY ALL
       UNION ALL SELECT DISTINCT feature, 1e0, 0e0 FROM zs),
md AS (SELECT feature, arg_min(effect, (round(abs(effect - 1), 9), effect)) FILTER (effect <> 1 AND power >= 0.8e0) AS min_detectable_effect FROM pw GROUP BY ALL)
SELECT feature, effect, power, min_detectable_effect, round(abs(min_detectable_effect - 1) * 100, 6) AS min_detectable_pct_shift FROM pw JOIN md USING (feature)"""


def power_grid(spark, d):
    return pin(Q.power_scan(_keyed_cells(spark, d, _PW), _PW, _HASH_KEYS))


@query("E29_power_scan", POWER_SQL)
def e29(spark, d):
    g = power_grid(spark, d)
    return g.join(Q.min_detectable(g), "feature")
