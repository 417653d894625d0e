"""Driver tables seen through the data model: pixels, labels, cells, edges.

Each adapter is a narrow projection of one driver table (plus an explode), so it scales with
the table. ``*_SQL`` holds the same projection as a CTE list for the SQL twins.

Raster layout: 64 consecutive vectors form one 64 x 64 field of 8 x 8 tiles; a field holds up
to four disk-shaped cells, one per 32 x 32 block. Intensities are quantised to 12 bits, as a
camera does, which also makes sums independent of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# channel -> (multiplier, offset) of the vector element that feeds tile position p
_MIX = {
    "dapi": (1, 0),
    "glycocalyx": (5, 3),
    "yap": (11, 17),
    "paxillin": (1, 0),
    "actin": (27, 9),
    "heparan_sulfate": (37, 21),
}
# channel -> share of the structured part of the signal
_SHARE = {"dapi": 0.75, "glycocalyx": 0.5, "yap": 0.5, "paxillin": 0.0, "actin": 0.5, "heparan_sulfate": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact table with at least one partition per core.

    A small file holding a single row group is read by one task, which would then do all the
    map-side work of an operator alone. Only such inputs are redistributed; a table with enough
    splits (any large one) is returned as read.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _raw(v: Column) -> Column:
    """Squash a real value into (0, 1) with rational arithmetic only."""
    return (v / (F.lit(0.1) + F.abs(v)) + 1) / 2


_RAW_SQL = "(({v}) / (0.1e0 + abs({v})) + 1) / 2"


def _tile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = e.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    y = F.expr("cast((vec_id % 64) div 8 * 8 + p div 8 as int)")
    x = F.expr("cast(vec_id % 8 * 8 + p % 8 as int)")
    e = e.select(F.expr("vec_id div 64").alias("field_id"), y.alias("y"), x.alias("x"), "p", "embedding")
    block = F.expr("(y div 32) * 2 + x div 32")
    return e.withColumns({
        "block": block.cast("int"),
        "d2": F.expr("cast((y % 32 - 16) * (y % 32 - 16) + (x % 32 - 16) * (x % 32 - 16) as int)"),
        "r": (F.lit(9) + F.pmod(F.col("field_id") + block, F.lit(4))).cast("int"),
    })


_TILE_SQL = """
tile AS (
  SELECT field_id, y, x, p, embedding, (y // 32) * 2 + x // 32 AS block,
         (y % 32 - 16) * (y % 32 - 16) + (x % 32 - 16) * (x % 32 - 16) AS d2,
         9 + (field_id + (y // 32) * 2 + x // 32) % 4 AS r
  FROM (SELECT vec_id // 64 AS field_id, ((vec_id % 64) // 8) * 8 + p // 8 AS y,
               (vec_id % 8) * 8 + p % 8 AS x, p, embedding
        FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings)))"""

# structured part of each channel, valid in both dialects
_SHAPE = {
    "dapi": "CASE WHEN d2 < 25 THEN 1 ELSE 0 END",
    "glycocalyx": "CASE WHEN d2 >= r * r AND d2 < (r + 3) * (r + 3) THEN 1 ELSE 0 END",
    "yap": "CASE WHEN d2 < 25 THEN 1 ELSE 0 END",
    "paxillin": "0",
    "actin": "CASE WHEN d2 >= (r - 2) * (r - 2) AND d2 < r * r THEN 1 ELSE 0 END",
    "heparan_sulfate": "CASE WHEN d2 >= r * r AND d2 < (r + 2) * (r + 2) THEN 1 ELSE 0 END",
}


def pixels(spark: SparkSession, sf_dir: str, channels: list[str] | None = None) -> DataFrame:
    """pixels(field_id, channel, y, x, value)."""
    names = channels or list(_MIX)
    t = _tile_positions(spark, sf_dir)

    def value(c: str) -> Column:
        m, o = _MIX[c]
        v = F.expr(f"cast(embedding[cast((p * {m} + {o}) % 64 as int)] as double)")
        s = _SHARE[c]
        return F.floor((_raw(v) * F.lit(1 - s) + F.expr(_SHAPE[c]) * F.lit(s)) * 4096) / F.lit(4096.0)

    if len(names) == 1:
        return t.select("field_id", F.lit(names[0]).alias("channel"), "y", "x", value(names[0]).alias("value"))
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), value(c).alias("value")) for c in names])
    return t.select("field_id", "y", "x", F.inline(rows)).select("field_id", "channel", "y", "x", "value")


def pixels_sql(channels: list[str] | None = None) -> str:
    """CTE list defining ``tile`` and ``pixels``."""
    parts = []
    for c in channels or list(_MIX):
        m, o = _MIX[c]
        raw = _RAW_SQL.format(v=f"CAST(embedding[(p * {m} + {o}) % 64 + 1] AS DOUBLE)")
        s = _SHARE[c]
        parts.append(
            f"SELECT field_id, '{c}' AS channel, y, x, floor((({raw}) * {1 - s}e0 + ({_SHAPE[c]}) * {s}e0) * 4096)"
            f" / 4096e0 AS value FROM tile"
        )
    return _TILE_SQL + ",\npixels AS (" + "\nUNION ALL ".join(parts) + ")"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels(field_id, y, x, cell_id, nucleus_id); background omitted, nucleus_id 0 outside the nucleus."""
    t = _tile_positions(spark, sf_dir)
    raw = _raw(F.expr("cast(embedding[p] as double)"))
    rim = F.expr("d2 < (r - 2) * (r - 2)")
    return t.filter(F.expr("d2 < r * r") & (rim | (raw >= 0.3))).select(
        "field_id", "y", "x", (F.col("block") + 1).cast("int").alias("cell_id"),
        F.when(F.expr("d2 < (4 + block % 3) * (4 + block % 3)"), F.col("block") + 1).otherwise(0).cast("int").alias("nucleus_id"),
    )


LABELS_SQL = f"""
labels AS (
  SELECT field_id, y, x, block + 1 AS cell_id,
         CASE WHEN d2 < (4 + block % 3) * (4 + block % 3) THEN block + 1 ELSE 0 END AS nucleus_id
  FROM tile
  WHERE d2 < r * r AND (d2 < (r - 2) * (r - 2) OR {_RAW_SQL.format(v='CAST(embedding[p + 1] AS DOUBLE)')} >= 0.3e0))"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields(field_id, height, width, pixel_size_um); one row per field."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.expr("vec_id div 64").alias("field_id")).agg(
        F.max(F.expr("cast((vec_id % 64) div 8 * 8 + 8 as int)")).alias("height"),
        F.max(F.expr("cast(vec_id % 8 * 8 + 8 as int)")).alias("width"),
    ).withColumn("pixel_size_um", F.expr("case field_id % 3 when 0 then 0.325D when 1 then 0.65D else 0.2D end"))


FIELDS_SQL = """
fields AS (
  SELECT vec_id // 64 AS field_id, max(((vec_id % 64) // 8) * 8 + 8) AS height, max((vec_id % 8) * 8 + 8) AS width,
         CASE (vec_id // 64) % 3 WHEN 0 THEN 0.325e0 WHEN 1 THEN 0.65e0 ELSE 0.2e0 END AS pixel_size_um
  FROM embeddings GROUP BY vec_id // 64)"""


def raster_sql(channels: list[str] | None = None) -> str:
    return pixels_sql(channels) + "," + LABELS_SQL + "," + FIELDS_SQL


# ---------------------------------------------------------------------------
# Cell table from lineitem. Expressions are valid in both dialects.
# ---------------------------------------------------------------------------

_Q, _E = "l_quantity", "l_extendedprice"
_D, _T = "round(l_discount * 100)", "round(l_tax * 100)"
_FEATURES = {
    "cell_area": f"{_Q} * 100e0",
    "yap_nc_ratio": f"({_E} + 600e0 * {_Q}) / 20000e0",
    "yap_nuclear_intensity": f"{_E} / 100000e0 + {_Q} / 100e0",
    "yap_nuclear_fraction": f"((l_partkey * 3) % 89) / 100e0 + {_D} / 100e0",
    "fa_count": "(l_partkey % 60) * 1e0",
    "fa_density_per_um2": f"({_D} + {_Q} / 10e0) / 20e0",
    "fa_mature_fraction": f"{_D} / 10e0",
    "fa_total_area": f"{_Q} * 3e0 + {_D} * 7e0 + (l_partkey % 50)",
    "fa_total_area_um2": f"({_Q} * 3e0 + {_D} * 7e0 + (l_partkey % 50)) * 0.105625e0",
    "fa_mean_area": f"({_D} * 4e0 + (l_partkey % 23)) * 1e0",
    "fa_mean_elongation": "1e0 + ((l_partkey * 11) % 37) / 20e0",
    "fa_peripheral_fraction": "((l_orderkey * 7) % 101) / 100e0",
    "fa_mean_orientation_alignment": "CASE WHEN l_linenumber = 7 THEN NULL ELSE ((l_partkey * 7) % 101) / 100e0 END",
    "actin_stress_fiber_coherence": f"({_T} * 10e0 + {_Q}) / 130e0",
    "actin_cortical_ratio": "0.5e0 + ((l_orderkey * 13) % 151) / 100e0",
    "nuclear_area": f"{_Q} * 12e0 + (l_partkey % 31)",
    "nuclear_aspect_ratio": f"1e0 + ({_D} * 5e0 + (l_partkey % 40)) / 90e0",
    "nuclear_solidity": f"1e0 - ({_T} + (l_orderkey % 5)) / 40e0",
    "nuclear_to_cell_area_ratio": "0.05e0 + (l_partkey % 30) / 100e0",
    "glycocalyx_mean_intensity": f"{_Q} / 60e0 + ((l_orderkey * 3) % 17) / 100e0",
    "glycocalyx_integrated_intensity": f"{_Q} * 4e0 + ((l_orderkey * 3) % 17)",
    "glycocalyx_pericellular_ratio": f"0.2e0 + ({_D} * 6e0 + ((l_orderkey * 5) % 43)) / 50e0",
    "glycocalyx_coverage": "((l_partkey * 13) % 97) / 97e0",
    "glycocalyx_heterogeneity": f"0.1e0 + ({_T} * 8e0 + (l_partkey % 13)) / 80e0",
    "glycocalyx_shannon_entropy": f"1e0 + {_E} / 50000e0",
    "glycocalyx_radial_decay_rate": "((l_orderkey * 17) % 61) / 100e0 - 0.3e0",
    "glycocalyx_haralick_contrast": f"{_D} * 2e0 + ((l_partkey * 5) % 19)",
    "glycocalyx_haralick_homogeneity": f"1e0 / (1e0 + {_D})",
    "glycocalyx_haralick_correlation": "((l_partkey * 19) % 201) / 100e0 - 1e0",
    "glycocalyx_haralick_energy": f"0.05e0 + {_T} / 20e0",
    "glycocalyx_moran_i": "CASE WHEN l_linenumber = 3 THEN NULL ELSE ((l_orderkey * 29) % 180) / 200e0 END",
    "solidity": "0.6e0 + ((l_partkey * 23) % 41) / 100e0",
    "mechano_score": f"({_E} / 25000e0 + {_D} / 5e0 - 3e0)",
    "centroid_x": "((l_orderkey * 37) % 4093) * 1e0",
    "centroid_y": "((l_partkey * 53) % 4091) * 1e0",
}
CELL_FEATURES = list(_FEATURES)
_CELL_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"


def cells(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Cell table: one row per line item; field = supplier, batch = return flag."""
    t = spread_table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("field_id"),
        F.expr(_CELL_ID).alias("cell_id"),
        F.col("l_returnflag").alias("batch"),
        F.col("l_returnflag").alias("condition"),
        *[F.expr(f"cast(floor(({_FEATURES[f]}) * 1024) as double) / 1024D").alias(f) for f in features or CELL_FEATURES],
    )


def cells_sql(features: list[str] | None = None) -> str:
    cols = ", ".join(f"floor(({_FEATURES[f]}) * 1024) / 1024e0 AS {f}" for f in features or CELL_FEATURES)
    return (
        f"cells AS (SELECT l_suppkey AS field_id, {_CELL_ID} AS cell_id, l_returnflag AS batch,"
        f" l_returnflag AS condition, {cols} FROM lineitem)"
    )


# ---------------------------------------------------------------------------
# Interaction graph between nations from orders, customers and suppliers.
# ---------------------------------------------------------------------------


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs(src, dst, n): traded lines between two different nations, lower name first."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    # lines per (order, supplier nation) first, so the big join carries counts
    per = (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .groupBy("l_orderkey", "b").agg(F.count(F.lit(1)).alias("n"))
        .join(o, F.col("l_orderkey") == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .filter(F.col("a") != F.col("b"))
    )
    return per.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("n").alias("n"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, confidence): all pairs at or above the score threshold of an edge scan.

    The score of a pair is its place between the least and the most traded pair, from 0 to 1000.
    """
    from cytofleet.operators.scale import attach_stats
    from cytofleet.sources.tables import scan_edges

    p = attach_stats(nation_pairs(spark, sf_dir), [], F.max("n").alias("m"), F.min("n").alias("l"))
    score = F.floor((F.col("n") - F.col("l")) * 1000 / F.greatest(F.lit(1), F.col("m") - F.col("l")))
    name = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string"))
    return scan_edges(p.select(name("src").alias("src"), name("dst").alias("dst"), score.alias("score")))


NATION_SQL = """
pairs AS (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (
  SELECT 'NATION_' || a AS src, 'NATION_' || b AS dst, score / 1000e0 AS confidence
  FROM (SELECT a, b, floor((n - lo) * 1000 / greatest(1, hi - lo)) AS score FROM pairs, (SELECT min(n) AS lo, max(n) AS hi FROM pairs)) WHERE score >= 400)"""
