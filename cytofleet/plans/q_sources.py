"""Queries A1..A14 and S1."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from cytofleet.operators import cells as D
from cytofleet.operators import population as P
from cytofleet.operators import priors as G
from cytofleet.operators import rules as B
from cytofleet.operators import screen as Q
from cytofleet.plans.adapters import cells, cells_sql, nation_pairs, NATION_SQL, pixels, pixels_sql, table
from cytofleet.plans.q_population import POWER_SQL, power_grid, rnd
from cytofleet.plans.q_raster import r6
from cytofleet.plans.registry import query
from cytofleet.session import pin
from cytofleet.sources import tables as A
from cytofleet.streaming.ingest import ingest_fields


@query("A1_pixel_scan", """
SELECT vec_id AS field_id, 'raw' AS channel, CAST(CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN p // 16 ELSE p % 2 END AS INT) AS plane,
  CAST(CASE vec_id % 3 WHEN 0 THEN p // 8 WHEN 1 THEN 0 ELSE p // 2 // 4 END AS INT) AS y, CAST(CASE vec_id % 3 WHEN 0 THEN p % 8 WHEN 1 THEN p % 16 ELSE p // 2 % 4 END AS INT) AS x,
  round(CAST(v AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings)""")
def a1(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("field_id"), F.lit("raw").alias("channel"), F.col("embedding").alias("values"))
    # one third of the vectors as 8 x 8, as four channels of 1 x 16, and as 8 x 4 with two channels
    shapes = [F.array(*[F.lit(v) for v in s]) for s in ((8, 8), (4, 1, 16), (8, 4, 2))]
    k = F.col("field_id") % 3
    return A.flatten_tiles(t, F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).otherwise(shapes[2])).withColumn("value", r6("value"))


_STACK_SQL = """st AS (SELECT user_id % 5 AS field_id, event_id % 16 AS y, (event_id // 16) % 16 AS x,
  CASE WHEN user_id % 5 = 4 THEN NULL WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END AS z, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 10 AS t, value FROM events)"""


def stack(spark, d):
    e = table(spark, d, "events")
    z = F.when(F.expr("user_id % 5 = 4"), None).when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    return e.select(F.expr("user_id % 5").alias("field_id"), F.lit("raw").alias("channel"), F.expr("event_id % 16").alias("y"), F.expr("(event_id div 16) % 16").alias("x"),
                    z.alias("z"), F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 10).alias("t"), "value")


@query("A2_z_projection", f"""WITH {_STACK_SQL}, f AS (SELECT st.* FROM st JOIN (SELECT field_id, min(t) AS t FROM st WHERE z IS NOT NULL GROUP BY ALL) USING (field_id, t) WHERE z IS NOT NULL)
SELECT field_id, 'raw' AS channel, CAST(t AS BIGINT) AS t, y, x, value, CAST(NULL AS BIGINT) AS planes FROM st WHERE z IS NULL
UNION ALL SELECT field_id, 'raw' AS channel, CAST(NULL AS BIGINT) AS t, y, x, max(value) AS value, max(n) AS planes FROM f JOIN (SELECT field_id, CASE WHEN count(DISTINCT z) > 1 THEN count(DISTINCT z) END AS n FROM f GROUP BY ALL) USING (field_id) GROUP BY ALL""")
def a2(spark, d):
    return A.z_project(stack(spark, d))


@query("A3_max_scaling", f"""WITH {pixels_sql(['dapi', 'actin'])}, m AS (SELECT field_id, max(value) AS m FROM pixels GROUP BY ALL)
SELECT field_id, channel, y, x, round(CASE WHEN m > 0 THEN value / m ELSE value END, 6) AS value FROM pixels JOIN m USING (field_id)""")
def a3(spark, d):
    return A.max_scale(pixels(spark, d, ["dapi", "actin"])).withColumn("value", r6("value"))


# every supplier is an acquisition with 3 to 7 channels
_CH_SQL = "ch AS (SELECT s_suppkey AS field_id, unnest(range(3 + s_suppkey % 5)) AS channel_idx FROM supplier), canon(i, role) AS (VALUES (0, 'dapi'), (1, 'glycocalyx'), (2, 'yap'), (3, 'paxillin'), (4, 'actin'), (5, 'heparan_sulfate'))"


def _channels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("field_id"))
    return s, s.select("field_id", F.explode(F.sequence(F.lit(0), F.expr("cast(2 + field_id % 5 as int)"))).alias("channel_idx"))


@query("A4_positional_channels", f"""WITH {_CH_SQL}
SELECT field_id, CAST(channel_idx AS INT) AS channel_idx, role, 'assigned' AS status FROM ch LEFT JOIN canon ON i = channel_idx
UNION ALL SELECT s_suppkey, NULL, role, 'missing' FROM supplier, canon WHERE i BETWEEN 1 AND 4 AND i >= 3 + s_suppkey % 5""")
def a4(spark, d):
    s, ch = _channels(spark, d)
    roles = A.positional_roles(ch)
    miss = A.missing_roles(roles, s).select("field_id", F.lit(None).cast("int").alias("channel_idx"), "role", F.lit("missing").alias("status"))
    return roles.withColumn("status", F.lit("assigned")).unionByName(miss)


@query("A4_explicit_channels", f"""WITH {_CH_SQL},
asg AS (SELECT s_suppkey AS field_id, k AS channel_idx, r AS role FROM supplier,
  (VALUES (0, 'dapi'), (1, 'glycocalyx'), (2, NULL), (3, 'actin'), (4, 'heparan_sulfate'), (5, 'yap')) a(k, r)),
ok AS (SELECT field_id, CAST(channel_idx AS INT) AS channel_idx, role FROM asg JOIN ch USING (field_id, channel_idx) WHERE role IS NOT NULL)
SELECT field_id, channel_idx, role, 'assigned' AS status FROM ok
UNION ALL SELECT s_suppkey, NULL, role, 'missing' FROM supplier, canon WHERE i BETWEEN 1 AND 4 AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.field_id = s_suppkey AND ok.role = canon.role)""")
def a4b(spark, d):
    s, ch = _channels(spark, d)
    form = s.withColumn("roles", F.lit('{"0": "DAPI", "1": " WGA-lectin ", "2": "unknown", "3": "Phalloidin", "4": "anti-HS", "5": "yap"}'))
    roles = A.explicit_roles(ch, form)
    miss = A.missing_roles(roles, s).select("field_id", F.lit(None).cast("int").alias("channel_idx"), "role", F.lit("missing").alias("status"))
    return roles.withColumn("status", F.lit("assigned")).unionByName(miss)


@query("A4_manifest_channels", f"""WITH {_CH_SQL}
SELECT field_id, CAST(channel_idx AS INT) AS channel_idx, role, (field_id % 3 = 0 AND role = 'yap') AS substitute FROM ch JOIN canon ON i = channel_idx""")
def a4c(spark, d):
    s, ch = _channels(spark, d)
    manifest = s.filter("field_id % 3 = 0").select("field_id", F.lit("yap").alias("role"), F.lit(False).alias("matches_protocol"))
    return A.manifest_roles(ch, manifest)


@query("A5_content_hash", f"""WITH {pixels_sql(['dapi', 'actin'])},
p2 AS (SELECT field_id, channel, y, x, value FROM pixels UNION ALL SELECT field_id + (SELECT max(vec_id // 64) + 1 FROM embeddings), channel, y, x, value FROM pixels WHERE field_id % 2 = 0),
r AS (SELECT field_id, channel, y, sha256(string_agg(CAST(CAST(value * 4096 AS BIGINT) AS VARCHAR), ',' ORDER BY x)) AS h FROM p2 GROUP BY ALL),
f AS (SELECT field_id, sha256(string_agg(h, ',' ORDER BY channel, y)) AS image_hash FROM r GROUP BY ALL)
SELECT image_hash, min(field_id) AS field_id, count(*) AS copies FROM f GROUP BY ALL""")
def a5(spark, d):
    p = pixels(spark, d, ["dapi", "actin"])
    # every second field again, under ids that no field has
    free = table(spark, d, "embeddings").agg((F.expr("max(vec_id) div 64") + 1).alias("_free"))
    again = p.filter("field_id % 2 = 0").join(F.broadcast(free)).withColumn("field_id", F.col("field_id") + F.col("_free")).drop("_free")
    p = p.unionByName(again)
    return A.unique_images(A.content_hash(p, (F.col("value") * 4096).cast("bigint").cast("string")))


@query("A6_manifest_scan", """
SELECT 'ds' || p_partkey AS name, p_brand AS source, CASE WHEN p_partkey % 5 = 0 THEN p_size / 50e0 ELSE coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size / 100e0 END, 0.325e0) END AS pixel_size_um
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def a6(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("ds"), F.col("p_partkey").cast("string"))
    lines = p.select(F.to_json(F.struct(name.alias("name"), F.col("p_brand").alias("source"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") / 100).alias("pixel_size_um"))).alias("value"))
    on_disk = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("ds"), F.col("l_partkey").cast("string")).alias("name"))
    form = p.filter("p_partkey % 5 = 0").select(name.alias("name"), (F.col("p_size") / 50).alias("pixel_size_um"))
    return A.scan_manifest(lines, on_disk, form)


@query("A7_prior_scan", """WITH c AS (SELECT n_regionkey, n_name, n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'region' || n_regionkey AS source, n_name AS gene, CAST(n_nationkey // 5 + 1 AS INT) AS rank, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 10e0 ELSE n_nationkey / 20e0 END AS score,
  c_mktsegment AS target, CASE n % 3 WHEN 0 THEN n * 1e0 WHEN 1 THEN n / 2e0 ELSE n / 4e0 END AS inverse FROM c""")
def a7(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name", "n_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    # a plain number, an object with "inverse", or an object with "distance" only
    num = F.format_string("%.1f", F.col("n").cast("double"))
    value = F.when(F.col("n") % 3 == 0, num).when(F.col("n") % 3 == 1, F.format_string('{"inverse": %.2f, "distance": 9}', F.col("n") / 2)).otherwise(
        F.format_string('{"distance": %.2f}', F.col("n") / 4))
    pair = F.concat(F.lit('"'), "c_mktsegment", F.lit('": '), value)
    gene = c.groupBy("n_regionkey", "n_name", "n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("t"))
    score = F.when(F.col("n_nationkey") % 2 == 0, F.format_string('"score": %.2f', F.col("n_nationkey") / 10)).otherwise(F.format_string('"median_cosine_shift": %.2f', F.col("n_nationkey") / 20))
    doc = F.concat(F.lit('"'), "n_name", F.lit('": {"rank": '), F.expr("cast(n_nationkey div 5 + 1 as string)"), F.lit(", "), score, F.lit(', "per_mechano_gene": {'), "t", F.lit("}}"))
    docs = gene.groupBy("n_regionkey").agg(F.array_join(F.collect_list(doc), ", ").alias("g")).select(
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit('{"metadata": {"v": "1"}, "genes": {'), "g", F.lit("}}")).alias("value"))
    return A.parse_prior(docs)


@query("A8_edge_scan", "WITH " + NATION_SQL + ", s AS (SELECT a, b, CAST(floor(n * 1000 / (SELECT max(n) FROM pairs)) AS BIGINT) AS score FROM pairs) SELECT a AS src, b AS dst, score / 1000e0 AS confidence FROM s WHERE score >= 400")
def a8(spark, d):
    from cytofleet.operators.scale import attach_stats
    p = attach_stats(nation_pairs(spark, d), [], F.max("n").alias("m"))
    e = p.select("src", "dst", F.floor(F.col("n") * 1000 / F.col("m")).alias("score"))
    return A.scan_edges(e)


_PANELS_SQL = """SELECT 'perturbation', unnest(['SDC1', 'SDC2', 'SDC3', 'SDC4', 'GPC1', 'GPC3', 'GPC4', 'GPC6', 'EXT1', 'EXT2', 'NDST1', 'NDST2', 'HPSE', 'GFPT1', 'GFPT2',
  'OGT', 'MGAT5', 'B4GALT1', 'HAS1', 'HAS2', 'HAS3', 'CD44'])
UNION ALL SELECT 'signature', unnest(['YAP1', 'WWTR1', 'CTGF', 'CYR61', 'ANKRD1', 'RHOA', 'ROCK1', 'ROCK2', 'MYL9', 'ITGB1', 'PTK2', 'VCL', 'PXN', 'TLN1', 'PIEZO1'])
UNION ALL SELECT 'inhibitors', unnest(['HK2', 'GFPT1', 'DPAGT1', 'GALNT family', 'OGA'])"""


@query("A9_validated_panel", "SELECT r_name AS panel, n_name AS gene FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL " + _PANELS_SQL)
def a9(spark, d):
    p = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("panel"), F.col("n_name").alias("gene"))
    sizes = table(spark, d, "region").select(F.col("r_name").alias("panel"), F.lit(5).alias("size"))
    fixed = spark.createDataFrame(list(B.PANEL_SIZES.items()), "panel string, size int")
    return A.validated_panel(p.unionByName(B.fixed_panels(spark)), sizes.unionByName(fixed))


_COH = ["yap_nc_ratio", "fa_count", "nuclear_solidity"]


@query("A10_reference_cohort", "WITH " + cells_sql(_COH) + ", fb(feature, mean, std) AS (VALUES " + ", ".join(
    f"('{f}', {m}e0, {s}e0)" for f, (_, m, s) in G.FEATURE_TARGETS.items()) + "), co AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) AS m, {'0e0' if f == 'fa_count' else f'stddev_pop({f})'} AS s FROM cells" for f in _COH) + """)
SELECT feature, round(coalesce(m, mean), 6) AS mean, round(coalesce(s, std), 6) AS std, m IS NULL AS used_fallback FROM fb LEFT JOIN (SELECT * FROM co WHERE s > 0) USING (feature)""")
def a10(spark, d):
    c = P.summarise(cells(spark, d, _COH), [], _COH, {"mean": F.avg, "std": F.stddev_pop})
    c = c.withColumn("std", F.when(F.col("feature") == "fa_count", 0.0).otherwise(F.col("std")))  # an unusable entry
    return rnd(A.load_cohort(G.fallback_cohort(spark), c))


_SINK = ["cell_area", "glycocalyx_moran_i"]


@query("A11_feature_sink", "WITH " + cells_sql(_SINK) + " SELECT field_id, cell_id, batch, condition, cell_area, glycocalyx_moran_i FROM cells")
def a11(spark, d):
    path = A.shared_path(spark, "features")
    # laid out by batch here: one folder per return flag
    A.write_features(cells(spark, d, _SINK).withColumn("deep_0", F.lit(0.0)), path, partition=["batch"])
    return spark.read.parquet(path)


@query("A11_feature_sink_csv", "WITH " + cells_sql(_SINK) + " SELECT field_id, cell_id, cell_area, glycocalyx_moran_i FROM cells")
def a11b(spark, d):
    path = A.shared_path(spark, "features-csv")
    A.write_features(cells(spark, d, _SINK).drop("batch", "condition"), path, "csv")
    return spark.read.schema("field_id long, cell_id string, cell_area double, glycocalyx_moran_i double").option("header", True).csv(path)


_SUMMARY = T.StructType([
    T.StructField("field_id", T.LongType()),
    T.StructField("summary", T.StructType([T.StructField("cell_count", T.LongType()), T.StructField("mean_fa_count", T.DoubleType()), T.StructField("mean_mechano_score", T.DoubleType())])),
    T.StructField("seed", T.IntegerType()), T.StructField("schema_version", T.IntegerType())])


@query("A12_summary_sink", "WITH " + cells_sql(["fa_count", "mechano_score"]) + """
SELECT field_id, count(*) AS cell_count, round(avg(fa_count), 6) AS mean_fa_count, round(avg(mechano_score), 6) AS mean_mechano_score, 42 AS seed, 1 AS schema_version FROM cells GROUP BY ALL""")
def a12(spark, d):
    path = A.shared_path(spark, "summary")
    A.write_text(A.summary_records(P.hero_metrics(cells(spark, d, ["fa_count", "mechano_score"]))), path)
    back = A.from_records(spark.read.text(path), _SUMMARY)
    return rnd(back.select("field_id", "summary.*", "seed", "schema_version"))


@query("A13_records_round_trip", "WITH " + cells_sql(_SINK) + " SELECT field_id, cell_id, cell_area, glycocalyx_moran_i FROM cells")
def a13(spark, d):
    c = cells(spark, d, _SINK).drop("batch", "condition")
    return A.from_records(A.to_records(c.withColumn("deep_0", F.lit(1.0))), c.schema)


@query("A14_power_sink", POWER_SQL)
def a14(spark, d):
    path = A.shared_path(spark, "power")
    g = power_grid(spark, d)
    A.write_power(g, Q.min_detectable(g), path)
    grid = spark.read.schema("feature string, effect double, power double").json(f"{path}/grid")
    head = spark.read.schema("feature string, min_detectable_effect double, min_detectable_pct_shift double").option("header", True).csv(f"{path}/summary")
    return grid.join(head, "feature", "left")


@query("S1_incremental_ingest", "WITH " + pixels_sql(["dapi", "actin"]) + """
SELECT field_id, channel, round(avg(value), 6) AS mean, count(*) AS n FROM pixels GROUP BY ALL""")
def s1(spark, d):
    """Two arrivals of the same fields under different ids: the second adds nothing."""
    base = A.shared_path(spark, "ingest")
    p = pixels(spark, d, ["dapi", "actin"])

    def plan(batch):
        return batch.groupBy("field_id", "channel").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))

    enc = (F.col("value") * 4096).cast("bigint").cast("string")
    n = pin(p.groupBy("field_id").agg(F.count(F.lit(1)).alias("n_pixels")))  # one row per field, read by every trigger
    far = n.agg(F.max("field_id").alias("m")).first()["m"] + 1
    for shift in (0, far):
        p.withColumn("field_id", F.col("field_id") + shift).write.mode("append").parquet(f"{base}/in")
        # two files per trigger, so that fields are spread over triggers
        ingest_fields(spark, f"{base}/in", f"{base}/out", f"{base}/state", plan, n.withColumn("field_id", F.col("field_id") + shift), max_files=2, encode=enc)
    return spark.read.parquet(f"{base}/out").select("field_id", "channel", r6("mean").alias("mean"), "n")
