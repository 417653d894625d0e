"""Queries C1..C21 on the tile rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofleet.functions import scalar as S
from cytofleet.operators import cells as D
from cytofleet.operators import raster as R
from cytofleet.plans.adapters import (
    FIELDS_SQL, LABELS_SQL, fields, labels, pixels, pixels_sql, raster_sql,
)
from cytofleet.plans.registry import query

CELL = R.CELL
PI = 3.141592653589793


def r6(c, d: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, d) + F.lit(0.0)


# --- shared SQL fragments -----------------------------------------------------

WIDTH_SQL = f"""
mask AS (SELECT field_id, cell_id, y, x FROM labels),
shape AS (SELECT field_id, cell_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM labels GROUP BY ALL),
width AS (
  SELECT s.field_id, cell_id, area, cy, cx,
         CAST(greatest(greatest(2, round_even(1e0 / pixel_size_um, 0)), round_even(0.1e0 * sqrt(4e0 * area / {PI}e0), 0)) AS INT) AS ring_px
  FROM shape s JOIN fields f ON s.field_id = f.field_id),
offs AS (SELECT dy, dx FROM (SELECT unnest(range(-40, 41)) AS dy) a, (SELECT unnest(range(-40, 41)) AS dx) b WHERE abs(dy) + abs(dx) <= 40)"""

RING_SQL = """
ring AS (
  SELECT DISTINCT m.field_id, m.cell_id, m.y + dy AS y, m.x + dx AS x
  FROM mask m JOIN width w ON m.field_id = w.field_id AND m.cell_id = w.cell_id
       JOIN offs ON abs(dy) + abs(dx) <= ring_px
       JOIN fields f ON f.field_id = m.field_id
  WHERE m.y + dy >= 0 AND m.x + dx >= 0 AND m.y + dy < height AND m.x + dx < f.width
    AND NOT EXISTS (SELECT 1 FROM mask q WHERE q.field_id = m.field_id AND q.cell_id = m.cell_id AND q.y = m.y + dy AND q.x = m.x + dx))"""


def eroded_sql(name: str, depth: str) -> str:
    """Pixels whose whole diamond of radius ``depth`` (SQL over width w / fields f) lies in the mask."""
    return f"""
{name} AS (
  SELECT m.field_id, m.cell_id, m.y, m.x
  FROM mask m JOIN width w ON m.field_id = w.field_id AND m.cell_id = w.cell_id
       JOIN fields f ON f.field_id = m.field_id
       JOIN offs ON abs(dy) + abs(dx) <= {depth}
       JOIN mask q ON q.field_id = m.field_id AND q.cell_id = m.cell_id AND q.y = m.y + dy AND q.x = m.x + dx
  GROUP BY m.field_id, m.cell_id, m.y, m.x, {depth}
  HAVING count(*) = 2 * {depth} * {depth} + 2 * {depth} + 1)"""


INTERIOR_SQL = eroded_sql("core", "greatest(1, ring_px // 2)") + """,
interior AS (
  SELECT * FROM core
  UNION ALL
  SELECT m.* FROM mask m WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.field_id = m.field_id AND c.cell_id = m.cell_id))"""


def regions_sql(channels: list[str]) -> str:
    return "WITH " + raster_sql(channels) + "," + WIDTH_SQL + "," + RING_SQL + "," + INTERIOR_SQL


def otsu_sql(src: str, keys: str, name: str = "otsu") -> str:
    """CTEs giving ``name(keys, threshold, flat, top)`` from ``src(keys, value)``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
{name}_h AS (
  SELECT {', '.join('a.' + k for k in keys.split(', '))}, lo, hi,
         CASE WHEN hi > lo THEN least(255, floor((value - lo) / (hi - lo) * 256)) ELSE 0 END AS bin, count(*) AS n
  FROM {src} a JOIN (SELECT {keys}, min(value) AS lo, max(value) AS hi FROM {src} GROUP BY ALL) b ON {on}
  GROUP BY ALL),
{name}_w AS (
  SELECT *, sum(n) OVER u AS w1, sum(n * bin) OVER u AS s1, sum(n) OVER v AS w2, sum(n * bin) OVER v AS s2
  FROM {name}_h
  WINDOW u AS (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING),
         v AS (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{name} AS (
  SELECT {keys}, CASE WHEN lo < hi THEN lo + (bin + 0.5e0) * ((hi - lo) / 256) END AS threshold, lo = hi AS flat, hi AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY
          coalesce(CAST(w1 AS DOUBLE) * w2 * (s1 / w1 - s2 / w2) * (s1 / w1 - s2 / w2), -1) DESC, bin) AS rn FROM {name}_w)
  WHERE rn = 1)"""


def ring_values(spark: SparkSession, d: str, channel: str = "glycocalyx") -> tuple[DataFrame, D.Regions]:
    reg = D.build_regions(labels(spark, d), fields(spark, d))
    return D.over(pixels(spark, d, [channel]), reg.ring), reg


# --- queries --------------------------------------------------------------------

_RADIUS_SQL = "radius AS (SELECT field_id, CASE WHEN pixel_size_um > 0 THEN greatest(1, round_even(7.5e0 / pixel_size_um, 0)) END AS r FROM fields)"


@query("C1_white_tophat", f"""WITH {pixels_sql(['dapi', 'glycocalyx', 'actin'])}, {FIELDS_SQL}, {_RADIUS_SQL},
a AS (SELECT p.*, r FROM pixels p JOIN radius USING (field_id) WHERE channel <> 'dapi'),
b AS (SELECT *, min(value) OVER (PARTITION BY field_id, channel, y ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS e FROM a),
c AS (SELECT *, min(e) OVER (PARTITION BY field_id, channel, x ORDER BY y RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS f FROM b),
g AS (SELECT *, max(f) OVER (PARTITION BY field_id, channel, x ORDER BY y RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS h FROM c),
i AS (SELECT *, max(h) OVER (PARTITION BY field_id, channel, y ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS o FROM g)
SELECT field_id, channel, y, x, value - o AS value FROM i
UNION ALL SELECT field_id, channel, y, x, value FROM pixels WHERE channel = 'dapi'""")
def c1(spark, d):
    radius = fields(spark, d).select("field_id", S.background_radius_px(7.5, "pixel_size_um").alias("radius_px"))
    return R.white_tophat(pixels(spark, d, ["dapi", "glycocalyx", "actin"]), radius)


@query("C2_otsu_threshold", f"""WITH {raster_sql(['paxillin'])},
vals AS (SELECT l.field_id, cell_id, value FROM labels l JOIN pixels p USING (field_id, y, x)),
{otsu_sql('vals', 'field_id, cell_id')}
SELECT field_id, cell_id, threshold, flat, top FROM otsu""")
def c2(spark, d):
    return R.otsu_threshold(D.over(pixels(spark, d, ["paxillin"]), labels(spark, d)), CELL)


@query("C3_percentile_threshold", f"""WITH {raster_sql(['glycocalyx'])}
SELECT field_id, cell_id, round(quantile_cont(value, 0.75), 6) AS threshold, 0.5e0 AS fixed
FROM labels l JOIN pixels p USING (field_id, y, x) GROUP BY ALL""")
def c3(spark, d):
    v = D.over(pixels(spark, d, ["glycocalyx"]), labels(spark, d))
    a = R.level_threshold(v, CELL, "percentile")
    b = R.level_threshold(v, CELL, "fixed", fixed=0.5).withColumnRenamed("threshold", "fixed")
    return a.join(b, CELL).select(*CELL, r6("threshold").alias("threshold"), "fixed")


@query("C4_dilation_ring", f"""WITH {raster_sql(['actin'])}, {WIDTH_SQL}, {RING_SQL}
SELECT r.field_id, r.cell_id, r.y, r.x FROM ring r""")
def c4(spark, d):
    lab, f = labels(spark, d), fields(spark, d)
    shape = lab.groupBy(*CELL).agg(F.count(F.lit(1)).alias("area"))
    width = R.ring_width(shape.join(f.select("field_id", "pixel_size_um"), "field_id"), S.ring_floor_px("pixel_size_um"))
    return R.dilation_ring(lab.select(*CELL, "y", "x"), width, f)


@query("C5_erosion_interior", f"""WITH {raster_sql(['actin'])}, {WIDTH_SQL}, {INTERIOR_SQL}
SELECT field_id, cell_id, y, x FROM interior""")
def c5(spark, d):
    lab, f = labels(spark, d), fields(spark, d)
    shape = lab.groupBy(*CELL).agg(F.count(F.lit(1)).alias("area"))
    width = R.ring_width(shape.join(f.select("field_id", "pixel_size_um"), "field_id"), S.ring_floor_px("pixel_size_um"))
    return R.interior(lab.select(*CELL, "y", "x"), width)


BRIGHT_SQL = f"""WITH RECURSIVE {raster_sql(['paxillin'])},
mask AS (SELECT l.field_id, l.cell_id, l.y, l.x FROM labels l JOIN pixels p USING (field_id, y, x) WHERE value > 0.6e0),
reach AS (
  SELECT field_id, cell_id, y, x, y * 4294967296 + x AS seen FROM mask
  UNION
  SELECT m.field_id, m.cell_id, m.y, m.x, r.seen FROM reach r JOIN mask m
    ON m.field_id = r.field_id AND m.cell_id = r.cell_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND r.seen < m.y * 4294967296 + m.x),
comp AS (SELECT field_id, cell_id, y, x, CAST(min(seen) AS BIGINT) AS first_pixel FROM reach GROUP BY ALL)"""


def _bright(spark, d):
    return D.over(pixels(spark, d, ["paxillin"]), labels(spark, d)).filter("value > 0.6").select(*CELL, "y", "x")


def _canonical(comp: DataFrame) -> DataFrame:
    """Name a component by its first pixel in scan order (row * 2^32 + column)."""
    first = F.min(F.col("y").cast("bigint") * 4294967296 + F.col("x")).alias("first_pixel")
    from cytofleet.operators.scale import attach_stats
    return attach_stats(comp, [*CELL, "component"], first)


@query("C6_connected_components", BRIGHT_SQL + " SELECT field_id, cell_id, y, x, first_pixel FROM comp")
def c6(spark, d):
    return _canonical(R.components(_bright(spark, d))).select(*CELL, "y", "x", "first_pixel")


@query("C7_component_size_filter", BRIGHT_SQL + """
SELECT field_id, cell_id, first_pixel, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) BETWEEN 3 AND 40""")
def c7(spark, d):
    kept = R.size_filter(R.components(_bright(spark, d)), CELL, F.lit(3), F.lit(40))
    return _canonical(kept).groupBy(*CELL, "first_pixel").agg(F.count(F.lit(1)).alias("size"))


@query("C8_seeded_region_growth")
def c8(spark, d):
    lab = labels(spark, d)
    seeds = lab.filter("nucleus_id > 0").select("field_id", "y", "x", F.col("nucleus_id").alias("label"))
    return R.seeded_growth(pixels(spark, d, ["actin"]).drop("channel"), seeds)


@query("C9_nucleus_matching", f"""WITH {raster_sql(['dapi'])},
c AS (SELECT field_id, nucleus_id, round_even(avg(y), 0) AS cy, round_even(avg(x), 0) AS cx FROM labels WHERE nucleus_id > 0 GROUP BY ALL)
SELECT c.field_id, nucleus_id, l.cell_id, l.y, l.x FROM c JOIN (SELECT field_id, y, x, cell_id FROM labels) l
  ON l.field_id = c.field_id AND l.y = cy AND l.x = cx""")
def c9(spark, d):
    lab = labels(spark, d)
    return R.match_nuclei(lab.filter("nucleus_id > 0"), lab)


@query("C10_candidate_mask_selection", f"""WITH {raster_sql(['dapi'])},
areas AS (SELECT field_id, k AS candidate, cell_id, count(*) AS area
          FROM labels l JOIN pixels p USING (field_id, y, x), (VALUES (0), (1), (2)) c(k) WHERE value > k * 0.3e0 AND (k > 0 OR cell_id < 3) GROUP BY ALL),
per AS (SELECT a.field_id, candidate, count(*) AS n, max(greatest(5, floor(height * width / 40000))) AS min_cells,
               count(*) FILTER (sqrt(4e0 * area / {PI}e0) BETWEEN 0.05e0 * greatest(height, width) AND 0.5e0 * greatest(height, width)) AS in_band
        FROM areas a JOIN fields USING (field_id) GROUP BY ALL),
agg AS (SELECT field_id, CAST(max(min_cells) AS INT) AS min_cells, coalesce(max(n) FILTER (candidate = 0), 0) AS incumbent_cells,
               max(in_band) AS best_cells FROM per GROUP BY ALL)
SELECT field_id, min_cells, incumbent_cells, best_cells,
  CASE WHEN incumbent_cells < min_cells AND best_cells >= min_cells
       THEN (SELECT min(candidate) FROM per p WHERE p.field_id = a.field_id AND p.in_band = a.best_cells) ELSE 0 END AS chosen
FROM agg a""")
def c10(spark, d):
    v = D.over(pixels(spark, d, ["dapi"]), labels(spark, d)).withColumn("candidate", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    v = v.filter((F.col("value") > F.col("candidate") * F.lit(0.3)) & ((F.col("candidate") > 0) | (F.col("cell_id") < 3)))
    areas = v.groupBy("field_id", "candidate", "cell_id").agg(F.count(F.lit(1)).alias("area"))
    return R.select_candidate_mask(areas, fields(spark, d))


@query("C11_distance_to_edge", f"""WITH {raster_sql(['actin'])}, mask AS (SELECT field_id, cell_id, y, x FROM labels),
pts AS (SELECT field_id, cell_id, nucleus_id, avg(y) AS cy, avg(x) AS cx FROM labels GROUP BY ALL),
edge AS (
  SELECT DISTINCT l.field_id, l.cell_id, l.y + dy AS y, l.x + dx AS x
  FROM mask l JOIN fields f ON f.field_id = l.field_id, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)
  WHERE l.y + dy >= 0 AND l.x + dx >= 0 AND l.y + dy < height AND l.x + dx < width
    AND NOT EXISTS (SELECT 1 FROM mask q WHERE q.field_id = l.field_id AND q.cell_id = l.cell_id AND q.y = l.y + dy AND q.x = l.x + dx))
SELECT p.field_id, p.cell_id, nucleus_id,
  round(CASE WHEN EXISTS (SELECT 1 FROM mask m WHERE m.field_id = p.field_id AND m.cell_id = p.cell_id AND m.y = round_even(cy, 0) AND m.x = round_even(cx, 0))
       THEN (SELECT min(sqrt(CAST((e.y - round_even(cy, 0)) * (e.y - round_even(cy, 0)) + (e.x - round_even(cx, 0)) * (e.x - round_even(cx, 0)) AS DOUBLE)))
             FROM edge e WHERE e.field_id = p.field_id AND e.cell_id = p.cell_id) ELSE 0 END, 6) AS edge_distance
FROM pts p""")
def c11(spark, d):
    lab = labels(spark, d)
    pts = lab.groupBy(*CELL, "nucleus_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return R.edge_distance(pts, lab, fields(spark, d)).select(*CELL, "nucleus_id", r6("edge_distance").alias("edge_distance"))


@query("C12_structure_tensor")
def c12(spark, d):
    f = fields(spark, d)
    sigma = f.select("field_id", S.sigma_px(0.65, "pixel_size_um").alias("sigma_px"))
    t = R.structure_tensor(pixels(spark, d, ["actin"]), sigma, 0.65 / 0.2)
    return R.fibre_features(t, labels(spark, d))


_GLCM_OFFS = ", ".join(f"({k}, {dy}, {dx}, {m})" for k, (dy, dx, m) in enumerate(R.GLCM_OFFSETS))
GLCM_SQL = f"""
st AS (SELECT r.field_id, r.cell_id, count(*) AS n, min(value) AS lo, max(value) AS hi, min(r.y) AS y0, max(r.y) AS y1, min(r.x) AS x0, max(r.x) AS x1
       FROM ring r JOIN pixels p USING (field_id, y, x) GROUP BY ALL HAVING count(*) >= 100 AND max(value) > min(value)),
patch AS (SELECT s.field_id, cell_id, p.y, p.x, CAST(greatest(0, least(15, round_even((value - lo) / (hi - lo) * 15, 0))) AS INT) AS g
          FROM st s JOIN pixels p ON p.field_id = s.field_id AND p.y BETWEEN y0 AND y1 AND p.x BETWEEN x0 AND x1),
pr AS (SELECT a.field_id, a.cell_id, k, m, a.g AS i, b.g AS j
       FROM patch a JOIN (VALUES {_GLCM_OFFS}) o(k, dy, dx, m) ON TRUE
       JOIN patch b ON b.field_id = a.field_id AND b.cell_id = a.cell_id AND b.y = a.y + dy AND b.x = a.x + dx),
sym AS (SELECT field_id, cell_id, k, m, i, j, count(*) AS c FROM (SELECT * FROM pr UNION ALL SELECT field_id, cell_id, k, m, j, i FROM pr) GROUP BY ALL),
pn AS (SELECT *, c * 1e0 / sum(c) OVER (PARTITION BY field_id, cell_id, k) AS p FROM sym),
mu AS (SELECT field_id, cell_id, k, m, sum(p * i) AS mi FROM pn GROUP BY ALL),
pk AS (SELECT field_id, cell_id, k, m, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity,
              sum(p * (i - mi) * (j - mi)) / sum(p * (i - mi) * (i - mi)) AS correlation, sqrt(sum(p * p)) AS energy
       FROM pn JOIN mu USING (field_id, cell_id, k, m) GROUP BY ALL),
glcm AS (SELECT field_id, cell_id, sum(contrast * m) / 12 AS contrast, sum(homogeneity * m) / 12 AS homogeneity,
                sum(correlation * m) / 12 AS correlation, sum(energy * m) / 12 AS energy FROM pk GROUP BY ALL)"""


@query("C13_glcm_texture", regions_sql(["glycocalyx"]) + "," + GLCM_SQL + """
SELECT field_id, cell_id, round(contrast, 6) AS contrast, round(homogeneity, 6) AS homogeneity,
       round(correlation, 6) AS correlation, round(energy, 6) AS energy FROM glcm""")
def c13(spark, d):
    reg = D.build_regions(labels(spark, d), fields(spark, d))
    g = R.glcm_texture(D.channel(pixels(spark, d, ["glycocalyx"]), "glycocalyx"), reg.ring)
    return g.select(*CELL, *[r6(c).alias(c) for c in ("contrast", "homogeneity", "correlation", "energy")])


MORAN_SQL = """
rv AS (SELECT r.field_id, r.cell_id, r.y, r.x, value FROM ring r JOIN pixels p USING (field_id, y, x)),
zz AS (SELECT *, value - avg(value) OVER (PARTITION BY field_id, cell_id) AS z FROM rv),
mp AS (SELECT a.field_id, a.cell_id, sum(a.z * b.z) AS cross_sum, count(*) AS w FROM zz a JOIN zz b
         ON a.field_id = b.field_id AND a.cell_id = b.cell_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
ms AS (SELECT field_id, cell_id, count(*) AS n, sum(z * z) AS ss FROM zz GROUP BY ALL),
moran AS (SELECT field_id, cell_id, CASE WHEN n >= 50 AND w > 0 AND ss > 0 THEN (n * 1e0 / w) * (cross_sum / ss) END AS moran_i
          FROM ms LEFT JOIN mp USING (field_id, cell_id))"""


@query("C14_moran_on_mask", regions_sql(["glycocalyx"]) + "," + MORAN_SQL +
       " SELECT field_id, cell_id, round(moran_i, 6) AS moran_i FROM moran")
def c14(spark, d):
    v, _ = ring_values(spark, d)
    return R.moran_on_mask(v).select(*CELL, r6("moran_i").alias("moran_i"))


RADIAL_SQL = """
roi AS (SELECT field_id, cell_id, y, x FROM ring UNION ALL SELECT field_id, cell_id, y, x FROM mask),
rd AS (SELECT o.field_id, o.cell_id, value, sqrt((o.y - cy) * (o.y - cy) + (o.x - cx) * (o.x - cx)) AS dist
       FROM roi o JOIN shape s USING (field_id, cell_id) JOIN pixels p ON p.field_id = o.field_id AND p.y = o.y AND p.x = o.x),
rb AS (SELECT field_id, cell_id, CAST(least(19, floor(dist / top * 20)) AS INT) AS bin, avg(value) AS mean
       FROM (SELECT *, max(dist) OVER (PARTITION BY field_id, cell_id) AS top FROM rd) WHERE top > 0 GROUP BY ALL)"""


@query("C15_radial_profile", regions_sql(["glycocalyx"]) + "," + RADIAL_SQL + """
SELECT g.field_id, g.cell_id, CAST(i AS INT) AS bin, round(CAST(CAST(mean AS FLOAT) AS DOUBLE), 5) AS mean
FROM (SELECT field_id, cell_id, unnest(range(20)) AS i FROM shape) g LEFT JOIN rb r ON r.field_id = g.field_id AND r.cell_id = g.cell_id AND r.bin = i""")
def c15(spark, d):
    px = pixels(spark, d, ["glycocalyx"])
    _, reg = ring_values(spark, d)
    roi = D.over(px, reg.ring).unionByName(D.over(px, reg.labels.select(*CELL, "y", "x")))
    prof = R.radial_profile(R.radial_bins(roi, reg.centroids))
    return prof.select(*CELL, F.posexplode("radial_profile").alias("bin", "mean")).withColumn("mean", r6(F.col("mean").cast("double"), 5))


@query("C16_densest_window", f"""WITH {pixels_sql(['dapi', 'glycocalyx'])},
a AS (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n FROM pixels WINDOW w AS (PARTITION BY field_id, channel, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
b AS (SELECT field_id, channel, y, x, sum(s) OVER w AS t, count(*) OVER w AS m FROM a WHERE n = 16 WINDOW w AS (PARTITION BY field_id, channel, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT field_id, channel, y, x, round(t, 6) AS total FROM
  (SELECT *, row_number() OVER (PARTITION BY field_id, channel ORDER BY t DESC, y, x) AS rn FROM b WHERE m = 16) WHERE rn = 1""")
def c16(spark, d):
    return R.densest_window(pixels(spark, d, ["dapi", "glycocalyx"]), 16).withColumn("total", r6("total"))


@query("C17_contrast_stretch", f"""WITH {pixels_sql(['dapi', 'actin'])},
q AS (SELECT field_id, channel, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.995) AS hi FROM pixels GROUP BY ALL)
SELECT field_id, channel, y, x, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS value FROM pixels JOIN q USING (field_id, channel)""")
def c17(spark, d):
    return R.contrast_stretch(pixels(spark, d, ["dapi", "actin"])).withColumn("value", r6("value"))


@query("C18_cell_crops", f"""WITH {raster_sql(['dapi'])},
bx AS (SELECT l.field_id, cell_id, greatest(0, min(y) - 15) AS y0, least(max(height) - 1, max(y) + 15) AS y1,
              greatest(0, min(x) - 15) AS x0, least(max(width) - 1, max(x) + 15) AS x1 FROM labels l JOIN fields f ON f.field_id = l.field_id GROUP BY ALL),
cr AS (SELECT b.field_id, cell_id, channel, y - y0 AS cy, x - x0 AS cx, value, min(value) OVER w AS lo, max(value) OVER w AS hi
       FROM bx b JOIN pixels p ON p.field_id = b.field_id AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 WINDOW w AS (PARTITION BY b.field_id, cell_id, channel))
SELECT field_id, cell_id, channel, cy, cx, round((value - lo) / (hi - lo) * 255, 6) AS value FROM cr""")
def c18(spark, d):
    return R.cell_crops(pixels(spark, d, ["dapi"]), labels(spark, d), fields(spark, d), F.lit(15)).withColumn("value", r6("value"))


@query("C19_boundary_extraction", f"""WITH {raster_sql(['actin'])},
n AS (SELECT l.field_id, l.cell_id, l.y, l.x, count(q.y) AS k FROM labels l LEFT JOIN labels q
   ON q.field_id = l.field_id AND q.cell_id = l.cell_id AND abs(q.y - l.y) + abs(q.x - l.x) = 1 GROUP BY ALL)
SELECT field_id, cell_id, 'outline' AS kind, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM n WHERE k < 4
  AND field_id IN (SELECT field_id FROM labels GROUP BY field_id HAVING count(DISTINCT cell_id) <= 3)
UNION ALL SELECT field_id, cell_id, 'centroid', round(avg(y), 6), round(avg(x), 6) FROM labels
  WHERE field_id IN (SELECT field_id FROM labels GROUP BY field_id HAVING count(DISTINCT cell_id) > 3) GROUP BY field_id, cell_id""")
def c19(spark, d):
    lab = labels(spark, d)
    return R.outlines(lab, max_cells=3).withColumns({"y": r6("y"), "x": r6("x")})


@query("C20_ring_and_axis_geometry", regions_sql(["actin"]) + """,
whole AS (SELECT field_id, cell_id, y, x FROM mask UNION ALL SELECT field_id, cell_id, y, x FROM ring),
o AS (SELECT a.field_id, a.cell_id, a.y, a.x FROM whole a LEFT JOIN whole b ON b.field_id = a.field_id AND b.cell_id = a.cell_id
        AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
i AS (SELECT a.field_id, a.cell_id, a.y, a.x FROM mask a LEFT JOIN mask b ON b.field_id = a.field_id AND b.cell_id = a.cell_id
        AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
mo AS (SELECT field_id, cell_id, var_pop(y) AS r, var_pop(x) AS c, covar_pop(y, x) AS rc, avg(y) AS cy, avg(x) AS cx FROM labels GROUP BY ALL),
ax AS (SELECT *, pi() / 2 - 0.5e0 * atan2(2 * rc, r - c) AS ang FROM mo)
SELECT 'outer' AS kind, field_id, cell_id, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, NULL::DOUBLE AS y_to, NULL::DOUBLE AS x_to FROM o
UNION ALL SELECT 'inner', field_id, cell_id, y, x, NULL, NULL FROM i
UNION ALL SELECT 'axis', field_id, cell_id, round(cy - sin(ang) * 5, 5), round(cx - cos(ang) * 5, 5), round(cy + sin(ang) * 5, 5), round(cx + cos(ang) * 5, 5) FROM ax""")
def c20(spark, d):
    _, reg = ring_values(spark, d, "actin")
    none = F.lit(None).cast("double")
    mask = reg.labels.select(*CELL, "y", "x")
    lines = R.ring_outlines(mask, reg.ring).select(
        "kind", *CELL, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), none.alias("y_to"), none.alias("x_to"))
    shape = D.moments(mask).withColumn("angle", F.lit(PI / 2) - F.col("orientation"))
    seg = R.axis_segments(shape, 10.0).select(
        F.lit("axis").alias("kind"), *CELL, *[r6(a, 5).alias(b) for a, b in (("y_from", "y"), ("x_from", "x"), ("y_to", "y_to"), ("x_to", "x_to"))])
    return lines.unionByName(seg)


@query("C21_point_in_polygon", f"""WITH {raster_sql(['actin'])},
bx AS (SELECT field_id, cell_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY ALL),
pt AS (SELECT vec_id AS point_id, vec_id // 64 AS field_id, CAST((label * 7 + vec_id) % 64 AS DOUBLE) AS px, CAST((vec_id * 13) % 64 AS DOUBLE) + 0.5e0 AS py FROM embeddings),
hit AS (SELECT p.field_id, point_id, cell_id FROM pt p JOIN bx b ON b.field_id = p.field_id
        WHERE abs(px - (x0 + x1) / 2e0) * (y1 - y0) + abs(py - (y0 + y1) / 2e0) * (x1 - x0) < (x1 - x0) * (y1 - y0) / 2e0)
SELECT p.field_id, p.point_id, min(cell_id) AS cell_id FROM pt p LEFT JOIN hit h USING (field_id, point_id) GROUP BY ALL""")
def c21(spark, d):
    from cytofleet.plans.adapters import table
    b = R.bounding_boxes(labels(spark, d))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    # diamonds inscribed in each cell's box
    poly = b.select("field_id", "cell_id", F.col("cell_id").alias("ord"), F.array(
        corner(F.col("x0"), my), corner(mx, F.col("y0")), corner(F.col("x1"), my), corner(mx, F.col("y1"))).alias("vertices"))
    e = table(spark, d, "embeddings")
    pts = e.select(F.col("vec_id").alias("point_id"), F.expr("vec_id div 64").alias("field_id"),
                   F.expr("cast((label * 7 + vec_id) % 64 as double)").alias("px"), F.expr("cast((vec_id * 13) % 64 as double) + 0.5D").alias("py"))
    return R.points_in_polygons(pts, poly)
