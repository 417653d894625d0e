"""Queries D1..D17 on the tile rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cytofleet.operators import cells as D
from cytofleet.operators import raster as R
from cytofleet.plans.adapters import FIELDS_SQL, LABELS_SQL, fields, labels, pixels, raster_sql, table
from cytofleet.plans.q_raster import (
    GLCM_SQL, INTERIOR_SQL, MORAN_SQL, RADIAL_SQL, RING_SQL, WIDTH_SQL, eroded_sql, otsu_sql, r6, regions_sql, ring_values,
)
from cytofleet.plans.registry import query

CELL = R.CELL
PI = "3.141592653589793e0"


def rounded(df, digits=6, keep=CELL):
    return df.select(*keep, *[r6(c, digits).alias(c) for c in df.columns if c not in keep])


_RV = "rv0 AS (SELECT r.field_id, r.cell_id, value FROM ring r JOIN pixels p USING (field_id, y, x))"


@query("D1_ring_intensity", regions_sql(["glycocalyx"]) + f""", {_RV}
SELECT field_id, cell_id, round(avg(value), 6) AS mean_intensity, round(sum(value), 6) AS integrated_intensity,
       round(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) END, 6) AS heterogeneity FROM rv0 GROUP BY ALL""")
def d1(spark, d):
    return rounded(D.intensity(ring_values(spark, d)[0]))


ENTROPY_SQL = """
eh AS (SELECT a.field_id, a.cell_id, lo, hi, CASE WHEN hi > lo THEN least(31, floor((value - lo) / (hi - lo) * 32)) ELSE 0 END AS bin, count(*) AS n
       FROM rv0 a JOIN (SELECT field_id, cell_id, min(value) AS lo, max(value) AS hi FROM rv0 GROUP BY ALL) b
         ON a.field_id = b.field_id AND a.cell_id = b.cell_id GROUP BY ALL),
ep AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY field_id, cell_id) AS p FROM eh),
ent AS (SELECT field_id, cell_id, CASE WHEN max(lo) < max(hi) THEN -sum(p * ln(p)) END AS shannon_entropy FROM ep GROUP BY ALL)"""


@query("D2_shannon_entropy", regions_sql(["glycocalyx"]) + f""", {_RV}, {ENTROPY_SQL}
SELECT field_id, cell_id, round(shannon_entropy, 6) AS shannon_entropy FROM ent""")
def d2(spark, d):
    return rounded(D.entropy(ring_values(spark, d)[0]))


COVER_SQL = otsu_sql("rv0", "field_id, cell_id", "ro") + """,
cov AS (SELECT a.field_id, a.cell_id, CASE WHEN NOT max(flat) THEN avg(CASE WHEN value > threshold THEN 1e0 ELSE 0e0 END) WHEN max(top) > 0 THEN 1e0 END AS coverage
        FROM rv0 a JOIN ro b ON a.field_id = b.field_id AND a.cell_id = b.cell_id GROUP BY ALL)"""


@query("D3_ring_coverage", regions_sql(["glycocalyx"]) + f""", {_RV}, {COVER_SQL}
SELECT field_id, cell_id, round(coverage, 6) AS coverage, round(q, 6) AS coverage_p75
FROM cov JOIN (SELECT a.field_id, a.cell_id, avg(CASE WHEN value > t THEN 1e0 ELSE 0e0 END) AS q
               FROM rv0 a JOIN (SELECT field_id, cell_id, quantile_cont(value, 0.75) AS t FROM rv0 GROUP BY ALL) b
                 ON a.field_id = b.field_id AND a.cell_id = b.cell_id GROUP BY ALL) USING (field_id, cell_id)""")
def d3(spark, d):
    v, _ = ring_values(spark, d)
    a = D.coverage(v)
    b = D.coverage(v, D.RingParams(coverage="percentile")).withColumnRenamed("coverage", "coverage_p75")
    return rounded(a.join(b, CELL))


@query("D4_pericellular_ratio", regions_sql(["glycocalyx"]) + f""", {_RV},
iv AS (SELECT r.field_id, r.cell_id, value FROM interior r JOIN pixels p USING (field_id, y, x))
SELECT a.field_id, a.cell_id, round(CASE WHEN i > 0 THEN r / i END, 6) AS pericellular_ratio
FROM (SELECT field_id, cell_id, avg(value) AS r FROM rv0 GROUP BY ALL) a LEFT JOIN (SELECT field_id, cell_id, avg(value) AS i FROM iv GROUP BY ALL) b
  ON a.field_id = b.field_id AND a.cell_id = b.cell_id""")
def d4(spark, d):
    v, reg = ring_values(spark, d)
    return rounded(D.pericellular_ratio(v, D.over(pixels(spark, d, ["glycocalyx"]), reg.interior)))


DECAY_SQL = """
dec AS (SELECT field_id, cell_id, CASE WHEN count(*) >= 2 THEN -regr_slope(ln(CAST(CAST(mean AS FLOAT) AS DOUBLE)), bin) END AS radial_decay_rate
        FROM rb WHERE mean > 0 GROUP BY ALL)"""


@query("D5_radial_decay_rate", regions_sql(["glycocalyx"]) + f""", {RADIAL_SQL}, {DECAY_SQL}
SELECT field_id, cell_id, round(radial_decay_rate, 5) AS radial_decay_rate FROM dec""")
def d5(spark, d):
    v, reg = ring_values(spark, d)
    roi = v.unionByName(D.over(pixels(spark, d, ["glycocalyx"]), reg.labels.select(*CELL, "y", "x")))
    return rounded(D.decay_rate(R.radial_bins(roi, reg.centroids)), 5)


YAP_SQL = """
yv AS (SELECT l.field_id, l.cell_id, nucleus_id, value FROM labels l JOIN pixels p USING (field_id, y, x) WHERE channel = 'yap'),
ya AS (SELECT field_id, cell_id, avg(value) FILTER (nucleus_id = cell_id) AS a, avg(value) FILTER (nucleus_id <> cell_id) AS b,
              sum(value) FILTER (nucleus_id = cell_id) AS n, sum(value) AS t FROM yv GROUP BY ALL),
yap AS (SELECT field_id, cell_id, a AS yap_nuclear_intensity, b AS yap_cytoplasmic_intensity,
               CASE WHEN b > 0 THEN a / b END AS yap_nc_ratio, CASE WHEN t > 0 THEN n / t END AS yap_nuclear_fraction FROM ya)"""


@query("D6_nuclear_partition", f"""WITH {raster_sql(['yap'])}, {YAP_SQL}
SELECT field_id, cell_id, round(yap_nuclear_intensity, 6) AS yap_nuclear_intensity, round(yap_cytoplasmic_intensity, 6) AS yap_cytoplasmic_intensity,
       round(yap_nc_ratio, 6) AS yap_nc_ratio, round(yap_nuclear_fraction, 6) AS yap_nuclear_fraction FROM yap""")
def d6(spark, d):
    return rounded(D.nuclear_partition(D.over(pixels(spark, d, ["yap"]), labels(spark, d))))


ADH_SQL = f"""WITH RECURSIVE {raster_sql(['paxillin'])},
mask AS (SELECT field_id, cell_id, y, x FROM labels),
vals AS (SELECT l.field_id, l.cell_id, l.y, l.x, value FROM labels l JOIN pixels p USING (field_id, y, x)),
{otsu_sql('vals', 'field_id, cell_id')},
bright AS (SELECT v.field_id, v.cell_id, y, x FROM vals v JOIN otsu o ON v.field_id = o.field_id AND v.cell_id = o.cell_id WHERE value > threshold),
reach AS (
  SELECT field_id, cell_id, y, x, y * 4294967296 + x AS seen FROM bright
  UNION
  SELECT m.field_id, m.cell_id, m.y, m.x, r.seen FROM reach r JOIN bright m
    ON m.field_id = r.field_id AND m.cell_id = r.cell_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND r.seen < m.y * 4294967296 + m.x),
comp AS (SELECT field_id, cell_id, y, x, min(seen) AS component FROM reach GROUP BY ALL),
fa0 AS (SELECT c.field_id, c.cell_id, component, count(*) AS area, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS r, var_pop(x) AS c, covar_pop(y, x) AS rc,
               max(pixel_size_um) AS px
        FROM comp c JOIN fields f ON f.field_id = c.field_id GROUP BY ALL),
fa1 AS (SELECT *, (r + c) / 2 + sqrt(((r - c) / 2) * ((r - c) / 2) + rc * rc) AS l1, (r + c) / 2 - sqrt(((r - c) / 2) * ((r - c) / 2) + rc * rc) AS l2
        FROM fa0 WHERE area BETWEEN greatest(1, round_even(0.5e0 / (px * px), 0)) AND greatest(greatest(1, round_even(0.5e0 / (px * px), 0)) + 1, round_even(50e0 / (px * px), 0))),
fa AS (SELECT *, 4 * sqrt(l1) * px AS major, CASE WHEN l2 > 1e-11 THEN sqrt(l1 / l2) END AS elong,
              CASE WHEN abs(r - c) < 1e-12 THEN CASE WHEN rc > 0 THEN {PI} / 4 ELSE -{PI} / 4 END ELSE 0.5e0 * atan2(2 * rc, r - c) END AS th FROM fa1)"""

EDGE_SQL = """
edge AS (
  SELECT DISTINCT l.field_id, l.cell_id, l.y + dy AS y, l.x + dx AS x
  FROM mask l JOIN fields f ON f.field_id = l.field_id, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)
  WHERE l.y + dy >= 0 AND l.x + dx >= 0 AND l.y + dy < height AND l.x + dx < width
    AND NOT EXISTS (SELECT 1 FROM mask q WHERE q.field_id = l.field_id AND q.cell_id = l.cell_id AND q.y = l.y + dy AND q.x = l.x + dx)),
dist AS (SELECT f.field_id, f.cell_id, component, min(sqrt(CAST((e.y - round_even(cy, 0)) * (e.y - round_even(cy, 0)) + (e.x - round_even(cx, 0)) * (e.x - round_even(cx, 0)) AS DOUBLE))) AS d0
         FROM fa f JOIN edge e ON e.field_id = f.field_id AND e.cell_id = f.cell_id GROUP BY ALL),
fd AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM mask m WHERE m.field_id = f.field_id AND m.cell_id = f.cell_id AND m.y = round_even(cy, 0) AND m.x = round_even(cx, 0)) THEN d0 ELSE 0 END AS ed
       FROM fa f LEFT JOIN dist d ON d.field_id = f.field_id AND d.cell_id = f.cell_id AND d.component = f.component)"""

_FA = ["fa_count", "fa_density_per_um2", "fa_mean_area", "fa_total_area", "fa_mean_area_um2", "fa_total_area_um2", "fa_mean_elongation",
       "fa_mean_distance_to_edge", "fa_mean_distance_to_edge_um", "fa_peripheral_fraction"]


def _adhesions(spark, d):
    from cytofleet.session import pin
    lab, f = labels(spark, d), fields(spark, d)
    spots = pin(D.adhesion_pixels(D.over(pixels(spark, d, ["paxillin"]), lab), f))
    return D.adhesion_features(spots, lab, f), spots


@query("D7_adhesion_morphometrics", ADH_SQL + "," + EDGE_SQL + """,
g AS (SELECT field_id, cell_id, count(*) AS n, avg(area) AS ma, sum(area) AS ta, avg(elong) AS me, avg(ed) AS md,
             avg(CASE WHEN ed <= greatest(1e0, 6.5e0 / px) THEN 1e0 ELSE 0e0 END) AS pf FROM fd GROUP BY ALL),
cl AS (SELECT l.field_id, cell_id, count(*) AS ca, max(pixel_size_um) AS px FROM labels l JOIN fields f ON f.field_id = l.field_id GROUP BY ALL)
SELECT c.field_id, c.cell_id, coalesce(n, 0) * 1e0 AS fa_count, round(coalesce(n, 0) / (ca * px * px), 6) AS fa_density_per_um2,
  round(ma, 6) AS fa_mean_area, coalesce(ta, 0) * 1e0 AS fa_total_area, round(ma * px * px, 6) AS fa_mean_area_um2,
  round(coalesce(ta, 0) * px * px, 6) AS fa_total_area_um2, round(me, 5) AS fa_mean_elongation, round(md, 6) AS fa_mean_distance_to_edge,
  round(md * px, 6) AS fa_mean_distance_to_edge_um, round(pf, 6) AS fa_peripheral_fraction
FROM cl c LEFT JOIN g ON g.field_id = c.field_id AND g.cell_id = c.cell_id""")
def d7(spark, d):
    f = _adhesions(spark, d)[0].select(*CELL, *_FA)
    return rounded(f.drop("fa_mean_elongation")).join(f.select(*CELL, r6("fa_mean_elongation", 5).alias("fa_mean_elongation")), CELL)


@query("D8_adhesion_maturity", ADH_SQL + """
SELECT l.field_id, l.cell_id, count(*) FILTER (major < 0.5e0) * 1e0 AS fa_nascent_count, count(*) FILTER (major >= 0.5e0 AND major < 1) * 1e0 AS fa_focal_complex_count,
  count(*) FILTER (major >= 1 AND major < 5) * 1e0 AS fa_mature_count, count(*) FILTER (major >= 5) * 1e0 AS fa_fibrillar_count,
  round(CASE WHEN count(major) > 0 THEN count(*) FILTER (major >= 1) * 1e0 / count(major) END, 6) AS fa_mature_fraction
FROM (SELECT DISTINCT field_id, cell_id FROM labels) l LEFT JOIN fa ON fa.field_id = l.field_id AND fa.cell_id = l.cell_id GROUP BY ALL""")
def d8(spark, d):
    return rounded(_adhesions(spark, d)[0].select(
        *CELL, "fa_nascent_count", "fa_focal_complex_count", "fa_mature_count", "fa_fibrillar_count", "fa_mature_fraction"))


#: Second moments from whole numbers: sums of squares leave the sign of a zero covariance to chance otherwise.
_ROUNDED = "var_pop(y) AS r, var_pop(x) AS c, covar_pop(y, x) AS rc"
_EXACT = ", ".join(f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b})) * 1e0 / (count(*) * count(*)) AS {n}" for a, b, n in (("y", "y", "r"), ("x", "x", "c"), ("y", "x", "rc")))


@query("D9_axial_alignment", ADH_SQL.replace(_ROUNDED, _EXACT) + """
SELECT l.field_id, l.cell_id, round(CASE WHEN count(th) >= 2 THEN sqrt(avg(sin(2 * th)) * avg(sin(2 * th)) + avg(cos(2 * th)) * avg(cos(2 * th))) END, 5) AS fa_mean_orientation_alignment
FROM (SELECT DISTINCT field_id, cell_id FROM labels) l LEFT JOIN fa ON fa.field_id = l.field_id AND fa.cell_id = l.cell_id GROUP BY ALL""")
def d9(spark, d):
    return rounded(_adhesions(spark, d)[0].select(*CELL, "fa_mean_orientation_alignment"), 5)


@query("D10_actin_cortical_ratio", f"""WITH {raster_sql(['actin'])}, {WIDTH_SQL},
{eroded_sql('deep', 'CAST(greatest(1, round_even(3.25e0 / pixel_size_um, 0)) AS INT)')}
SELECT field_id, cell_id, round(avg(value), 6) AS actin_mean_intensity,
  round(CASE WHEN avg(value) FILTER (k) > 0 THEN avg(value) FILTER (NOT k) / avg(value) FILTER (k) END, 6) AS actin_cortical_ratio
FROM (SELECT m.field_id, m.cell_id, value, EXISTS (SELECT 1 FROM deep q WHERE q.field_id = m.field_id AND q.cell_id = m.cell_id AND q.y = m.y AND q.x = m.x) AS k
      FROM mask m JOIN pixels p ON p.field_id = m.field_id AND p.y = m.y AND p.x = m.x) GROUP BY ALL""")
def d10(spark, d):
    lab = labels(spark, d)
    return rounded(D.cortical_ratio(D.over(pixels(spark, d, ["actin"]), lab.select(*CELL, "y", "x")), lab, fields(spark, d)))


MOMENT_SQL = f"""
mo0 AS (SELECT field_id, cell_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS r, var_pop(x) AS c, covar_pop(y, x) AS rc FROM {{src}} GROUP BY ALL),
mo AS (SELECT *, (r + c) / 2 + sqrt(((r - c) / 2) * ((r - c) / 2) + rc * rc) AS l1, (r + c) / 2 - sqrt(((r - c) / 2) * ((r - c) / 2) + rc * rc) AS l2 FROM mo0)"""


@query("D11_moment_shape", f"""WITH {raster_sql(['actin'])}, {MOMENT_SQL.format(src='labels')}
SELECT field_id, cell_id, area, round(cy, 6) AS cy, round(cx, 6) AS cx, round(4 * sqrt(l1), 5) AS major_axis, round(4 * sqrt(l2), 5) AS minor_axis,
  round(sqrt(l1 / l2), 5) AS aspect_ratio, round(sqrt(1 - l2 / l1), 5) AS eccentricity,
  round(abs(CASE WHEN abs(r - c) < 1e-12 THEN CASE WHEN rc > 0 THEN {PI} / 4 ELSE -{PI} / 4 END ELSE 0.5e0 * atan2(2 * rc, r - c) END), 5) AS orientation,
  round(sqrt(4e0 * area / {PI}), 6) AS equivalent_diameter FROM mo""")
def d11(spark, d):
    m = D.moments(labels(spark, d)).withColumn("orientation", F.abs("orientation"))
    out = rounded(m, 5, CELL + ["area"])
    return out.drop("cy", "cx", "equivalent_diameter").join(
        m.select(*CELL, *[r6(c).alias(c) for c in ("cy", "cx", "equivalent_diameter")]), CELL)


PERIM_SQL = """
bd AS (SELECT a.field_id, a.cell_id, a.y, a.x FROM {src} a LEFT JOIN {src} b ON b.field_id = a.field_id AND b.cell_id = a.cell_id
         AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
cd AS (SELECT a.field_id, a.cell_id, a.y, a.x, 1 + coalesce(sum(CASE WHEN b.y IS NULL THEN 0 WHEN b.y = a.y OR b.x = a.x THEN 2 ELSE 10 END), 0) AS code
       FROM bd a LEFT JOIN bd b ON b.field_id = a.field_id AND b.cell_id = a.cell_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY ALL),
pe AS (SELECT field_id, cell_id, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1e0 WHEN code IN (21, 33) THEN sqrt(2e0) WHEN code IN (13, 23) THEN (1 + sqrt(2e0)) / 2 ELSE 0 END) AS perimeter
       FROM cd GROUP BY ALL)"""


@query("D12_perimeter_circularity", f"""WITH {raster_sql(['actin'])}, {PERIM_SQL.format(src='labels')}
SELECT field_id, cell_id, round(perimeter, 6) AS perimeter, round(CASE WHEN perimeter > 0 THEN 4 * {PI} * area / (perimeter * perimeter) END, 6) AS circularity
FROM pe JOIN (SELECT field_id, cell_id, count(*) AS area FROM labels GROUP BY ALL) USING (field_id, cell_id)""")
def d12(spark, d):
    lab = labels(spark, d)
    a = lab.groupBy(*CELL).agg(F.count(F.lit(1)).alias("area"))
    p = D.perimeter(lab).join(a, CELL).withColumn("circularity", D.circularity(F.col("area"), F.col("perimeter")))
    return rounded(p.drop("area"))


@query("D13_convex_hull_solidity")
def d13(spark, d):
    return rounded(D.convex_hull(labels(spark, d)), 6, CELL + ["convex_area"])


@query("D14_nuclear_morphometry", f"""WITH {raster_sql(['dapi'])}, nuc AS (SELECT field_id, cell_id, y, x FROM labels WHERE nucleus_id = cell_id),
{MOMENT_SQL.format(src='nuc').replace(_ROUNDED, _EXACT)}, {PERIM_SQL.format(src='nuc')}
SELECT field_id, cell_id, mo.area * 1e0 AS nuclear_area, round(perimeter, 6) AS nuclear_perimeter,
  round(CASE WHEN perimeter > 0 THEN 4 * {PI} * mo.area / (perimeter * perimeter) END, 6) AS nuclear_circularity,
  round(CASE WHEN l2 > 1e-11 THEN sqrt(l1 / l2) END, 5) AS nuclear_aspect_ratio,
  round(CASE WHEN l1 > 0 THEN sqrt(greatest(0, 1 - CASE WHEN l2 > 1e-11 THEN l2 ELSE 0 END / l1)) WHEN mo.area > 0 THEN 0 END, 4) AS nuclear_eccentricity, round(mo.area * 1e0 / ca, 6) AS nuclear_to_cell_area_ratio
FROM (SELECT field_id, cell_id, count(*) AS ca FROM labels GROUP BY ALL) c LEFT JOIN mo USING (field_id, cell_id) LEFT JOIN pe USING (field_id, cell_id)""")
def d14(spark, d):
    n = D.nuclear_morphology(labels(spark, d)).drop("nuclear_solidity")
    return n.select(*CELL, "nuclear_area", r6("nuclear_perimeter").alias("nuclear_perimeter"), r6("nuclear_circularity").alias("nuclear_circularity"),
                    r6("nuclear_aspect_ratio", 5).alias("nuclear_aspect_ratio"), r6("nuclear_eccentricity", 4).alias("nuclear_eccentricity"),
                    r6("nuclear_to_cell_area_ratio").alias("nuclear_to_cell_area_ratio"))


@query("D14_nuclear_solidity")
def d14_solidity(spark, d):
    return D.nuclear_morphology(labels(spark, d)).select(*CELL, r6("nuclear_solidity").alias("nuclear_solidity"))


FAMILY_SQL = f"""{_RV}, iv AS (SELECT r.field_id, r.cell_id, value FROM interior r JOIN pixels p USING (field_id, y, x)),
{ENTROPY_SQL}, {COVER_SQL}, {GLCM_SQL}, {MORAN_SQL}, {RADIAL_SQL}, {DECAY_SQL},
ri AS (SELECT field_id, cell_id, avg(value) AS m, sum(value) AS s, stddev_pop(value) / avg(value) AS cv FROM rv0 GROUP BY ALL),
ii AS (SELECT field_id, cell_id, avg(value) AS i FROM iv GROUP BY ALL),
fam AS (SELECT sh.field_id, sh.cell_id, m AS mean_intensity, s AS integrated_intensity, cv AS heterogeneity, shannon_entropy, coverage,
   CASE WHEN i > 0 THEN m / i END AS pericellular_ratio, radial_decay_rate, contrast AS haralick_contrast, homogeneity AS haralick_homogeneity,
   correlation AS haralick_correlation, energy AS haralick_energy, moran_i
 FROM shape sh LEFT JOIN ri USING (field_id, cell_id) LEFT JOIN ii USING (field_id, cell_id) LEFT JOIN ent USING (field_id, cell_id) LEFT JOIN cov USING (field_id, cell_id)
   LEFT JOIN dec USING (field_id, cell_id) LEFT JOIN glcm USING (field_id, cell_id) LEFT JOIN moran USING (field_id, cell_id))"""
_FAMILY = ["mean_intensity", "integrated_intensity", "heterogeneity", "shannon_entropy", "coverage", "pericellular_ratio", "radial_decay_rate",
           "haralick_contrast", "haralick_homogeneity", "haralick_correlation", "haralick_energy", "moran_i"]


@query("D15_second_stain_family", regions_sql(["heparan_sulfate"]) + "," + FAMILY_SQL +
       " SELECT field_id, cell_id, " + ", ".join(f"round({c}, 5) AS hs_{c}" for c in _FAMILY) + " FROM fam")
def d15(spark, d):
    reg = D.build_regions(labels(spark, d), fields(spark, d))
    f = D.stain_features(pixels(spark, d, ["heparan_sulfate"]), reg, "heparan_sulfate", "glycocalyx")
    return rounded(D.rename_prefix(f, "glycocalyx_", "hs_").drop("hs_radial_profile"), 5)


@query("D16_profile_assembly")
def d16(spark, d):
    names = ["dapi", "glycocalyx", "yap", "paxillin", "actin"]
    # one branch per channel: a filter on the channel drops the others before their values are computed
    px = D.check_channels(reduce(DataFrame.unionByName, [pixels(spark, d, [c]) for c in names]))
    return D.expand_profile(D.assemble_profiles(px, labels(spark, d), fields(spark, d), names))


@query("D17_attach_embeddings", """
WITH e AS (SELECT vec_id // 64 AS field_id, CAST(vec_id % 64 + 1 AS INT) AS cell_id, vec_id, embedding FROM embeddings)
SELECT field_id, cell_id, vec_id, CAST(round(CAST(embedding[1] AS DOUBLE), 6) AS DOUBLE) AS first_component, len(embedding) AS width FROM e
UNION ALL SELECT DISTINCT field_id, 0, NULL, NULL, NULL FROM e""")
def d17(spark, d):
    # every vector belongs to a cell of its own; cell 0 of each field stands for a crop that was skipped
    e = table(spark, d, "embeddings").select(
        F.expr("vec_id div 64").alias("field_id"), F.expr("cast(vec_id % 64 + 1 as int)").alias("cell_id"), "embedding", "vec_id")
    cells = e.select(*CELL).unionByName(e.select("field_id", F.lit(0).alias("cell_id")).distinct())
    out = D.attach_embeddings(cells, e, 64).join(e.select(*CELL, "vec_id"), CELL, "left")
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return out.select(*CELL, "vec_id", first.alias("first_component"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("width"))
