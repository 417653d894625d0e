"""Scans, normalisation on ingest, and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cytofleet.schema import CHANNELS, DEFAULT_PIXEL_SIZE_UM, PIXELS
from cytofleet.session import ensure_checkpoint_dir

IMAGE = ["field_id", "channel"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh location in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- A1 .. A3 ---------------------------------------------------------------


def image_layout(shape: Column) -> Column:
    """HW, HWC or CHW by an image's shape: a small first and a large last axis mean channels first; other ranks raise."""
    n = F.size(shape)
    first, last = F.get(shape, F.lit(0)), F.get(shape, F.lit(2))
    return (F.when(n == 2, "HW").when((n == 3) & (first <= 8) & (last > 8), "CHW").when(n == 3, "HWC")
            .otherwise(F.raise_error(F.concat(F.lit("expected a 2D or 3D image, got "), n.cast("string"), F.lit(" axes")))))


def flatten_tiles(tiles: DataFrame, shape: Column, values: str = "values", keys: Sequence[str] = IMAGE) -> DataFrame:
    """Array-valued images to pixel rows: keys, plane (channel axis, 0 for HW), y, x, value.

    ``shape`` is an array of axis sizes, in the order of the flat array; see ``image_layout``.
    """
    d = tiles.withColumn("_s", shape).withColumn("_l", image_layout(F.col("_s")))
    at = lambda i: F.get(F.col("_s"), F.lit(i))
    d = d.select(*keys, F.when(F.col("_l") == "CHW", at(1)).otherwise(at(0)).alias("_h"), F.when(F.col("_l") == "CHW", at(2)).otherwise(at(1)).alias("_w"),
                 F.when(F.col("_l") == "HWC", at(2)).otherwise(F.lit(1)).alias("_c"), F.posexplode(values).alias("_p", "value"))
    return d.select(
        *keys, F.expr("cast(case when _c > 1 then _p % _c else _p div (_w * _h) end as int)").alias("plane"),
        F.expr("cast(_p div _c div _w % _h as int)").alias("y"), F.expr("cast(_p div _c % _w as int)").alias("x"), F.col("value").cast("double").alias("value"))


def stack_axes(a0: Column, a1: Column) -> Column:
    """Axis order of a bare four-dimensional stack by its first two sizes; ambiguous sizes raise."""
    return (F.when((a0 <= 8) & (a1 > 8), "CZYX").when((a1 <= 8) & (a0 > 8), "ZCYX").when((a0 > 8) & (a1 > 8), "ZYXC")
            .otherwise(F.raise_error(F.lit("ambiguous stack: the first two axes may be planes or channels"))))


def z_project(stack: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Maximum over planes in the first time frame; ``planes`` is NULL for a single plane.

    An image has a Z axis if its ``axes`` text says so, or, without that column or text, if its rows have a ``z``.
    Images without one keep all their time frames in ``t``, which is NULL for projected images.
    """
    k = list(keys)
    named = F.contains(F.upper("axes"), F.lit("Z")) if "axes" in stack.columns else F.lit(None).cast("boolean")
    d = stack.withColumn("_z", F.coalesce(named, F.col("z").isNotNull()))
    flat = d.filter(~F.col("_z")).select(*k, F.col("t").cast("bigint").alias("t"), "y", "x", "value", F.lit(None).cast("bigint").alias("planes"))
    deep = d.filter("_z")
    first = deep.join(deep.groupBy(*k).agg(F.min("t").alias("_t")), k).filter(F.col("t").eqNullSafe(F.col("_t")))
    planes = first.groupBy(*k).agg(F.countDistinct("z").alias("_n"))
    top = first.groupBy(*k, "y", "x").agg(F.max("value").alias("value")).join(planes, k)
    return top.select(*k, F.lit(None).cast("bigint").alias("t"), "y", "x", "value", F.when(F.col("_n") > 1, F.col("_n")).alias("planes")).unionByName(flat)


def max_scale(pixels: DataFrame) -> DataFrame:
    """Divide every channel of a field by the field's overall maximum when it is positive."""
    top = pixels.groupBy("field_id").agg(F.max("value").alias("_m"))
    v = F.when(F.col("_m") > 0, F.col("value") / F.col("_m")).otherwise(F.col("value"))
    return pixels.join(top, "field_id").select("field_id", "channel", "y", "x", v.alias("value"))


# --- A4 -------------------------------------------------------------------

# Channel names accepted in explicit assignments.
ROLE_ALIASES = {
    "dapi": "dapi", "wga-lectin": "glycocalyx", "wga": "glycocalyx", "glycocalyx": "glycocalyx", "yap": "yap", "yap antibody": "yap",
    "paxillin": "paxillin", "phalloidin": "actin", "actin": "actin", "heparan_sulfate": "heparan_sulfate",
    "anti-hs (10e4 / f58-10e4)": "heparan_sulfate", "anti-hs": "heparan_sulfate"}
OPTIONAL_CHANNELS = ["heparan_sulfate"]


def positional_roles(channels: DataFrame) -> DataFrame:
    """(field_id, channel_idx) -> role in canonical order; indexes beyond it get NULL."""
    role = F.get(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel_idx"))
    return channels.select("field_id", "channel_idx", role.alias("role"))


def explicit_roles(channels: DataFrame, assignment: DataFrame) -> DataFrame:
    """``assignment(field_id, roles)`` holds a JSON object index -> display name.

    Names are trimmed, lower-cased and mapped through the aliases; unknown names and indexes the
    field does not have are ignored; the last index wins when a role repeats.
    """
    m = F.from_json("roles", T.MapType(T.StringType(), T.StringType()))
    d = assignment.select("field_id", F.explode(m).alias("_i", "_r"))
    alias = F.create_map(*[F.lit(v) for kv in ROLE_ALIASES.items() for v in kv])
    d = d.select("field_id", F.col("_i").cast("int").alias("channel_idx"), F.try_element_at(alias, F.trim(F.lower("_r"))).alias("role")).filter("role is not null")
    return d.join(channels.select("field_id", "channel_idx"), ["field_id", "channel_idx"]).groupBy("field_id", "role").agg(
        F.max("channel_idx").alias("channel_idx")).select("field_id", "channel_idx", "role")


def manifest_roles(channels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Positional roles plus ``substitute``: slots whose manifest row says the protocol does not match.

    ``manifest(field_id, role, matches_protocol)``.
    """
    d = positional_roles(channels).filter("role is not null").join(manifest, ["field_id", "role"], "left")
    return d.select("field_id", "channel_idx", "role", (~F.coalesce("matches_protocol", F.lit(True))).alias("substitute"))


def missing_roles(roles: DataFrame, fields: DataFrame) -> DataFrame:
    """(field_id, role) of non-nuclear, non-optional canonical channels without an assignment."""
    need = [c for c in CHANNELS if c != "dapi" and c not in OPTIONAL_CHANNELS]
    want = fields.select("field_id", F.explode(F.array(*[F.lit(c) for c in need])).alias("role"))
    return want.join(roles.select("field_id", "role"), ["field_id", "role"], "left_anti")


# --- A5 -------------------------------------------------------------------


def content_hash(pixels: DataFrame, encode: Column) -> DataFrame:
    """SHA-256 identity per field: row hashes in scan order, hashed again.

    Two levels keep every task's input to one image row or one list of row hashes.
    """
    rows = pixels.select("field_id", "channel", "y", "x", encode.alias("_v")).groupBy("field_id", "channel", "y").agg(
        F.array_sort(F.collect_list(F.struct("x", "_v"))).alias("_r"))
    text = F.array_join(F.transform("_r", lambda s: s["_v"]), ",")
    rows = rows.select("field_id", "channel", "y", F.sha2(text, 256).alias("_h"))
    g = rows.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("channel", "y", "_h"))).alias("_l"))
    return g.select("field_id", F.sha2(F.array_join(F.transform("_l", lambda s: s["_h"]), ","), 256).alias("image_hash"))


def unique_images(hashes: DataFrame) -> DataFrame:
    """One field per content hash (lowest id) and how many fields share it."""
    return hashes.groupBy("image_hash").agg(F.min("field_id").alias("field_id"), F.count(F.lit(1)).alias("copies"))


# --- A6 .. A10 ----------------------------------------------------------------

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("pixel_size_um", T.DoubleType())])


def scan_manifest(lines: DataFrame, existing: DataFrame, form: DataFrame | None = None) -> DataFrame:
    """JSON manifest lines (column ``value``) restricted to names that exist; pixel size form > manifest > default."""
    d = lines.select(F.from_json("value", MANIFEST).alias("m")).select("m.*").filter("name is not null")
    d = d.join(existing.select("name").distinct(), "name", "left_semi")
    if form is not None:
        d = d.join(form.select("name", F.col("pixel_size_um").alias("_f")), "name", "left")
    else:
        d = d.withColumn("_f", F.lit(None).cast("double"))
    return d.withColumn("pixel_size_um", F.coalesce("_f", "pixel_size_um", F.lit(DEFAULT_PIXEL_SIZE_UM))).drop("_f")


_GENE = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("median_cosine_shift", T.DoubleType()),
    T.StructField("per_mechano_gene", T.MapType(T.StringType(), T.StringType()))])
PRIOR_DOC = T.StructType([
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("genes", T.MapType(T.StringType(), _GENE))])


def parse_prior(docs: DataFrame) -> DataFrame:
    """``docs(source, value)`` JSON -> prior(source, gene, rank, score, target, inverse).

    A target's value is a number or an object; ``inverse`` then ``distance`` then 0.
    """
    d = docs.select("source", F.from_json("value", PRIOR_DOC).alias("d")).select("source", F.explode("d.genes").alias("gene", "g"))
    d = d.select("source", "gene", F.col("g.rank").alias("rank"), F.coalesce("g.score", "g.median_cosine_shift").alias("score"),
                 F.explode_outer("g.per_mechano_gene").alias("target", "_v"))
    num = F.col("_v").try_cast("double")
    obj = lambda k: F.get_json_object("_v", f"$.{k}").try_cast("double")
    inverse = F.when(F.col("target").isNotNull(), F.coalesce(num, obj("inverse"), obj("distance"), F.lit(0.0)))
    return d.select("source", "gene", "rank", "score", "target", inverse.alias("inverse"))


def prior_metadata(docs: DataFrame) -> DataFrame:
    return docs.select("source", F.from_json("value", PRIOR_DOC).alias("d")).select("source", F.col("d.metadata").alias("metadata"))


def scan_edges(edges: DataFrame, score: str = "score", threshold: int = 400) -> DataFrame:
    """Interactions with score (0..1000) at or above the threshold; confidence = score / 1000."""
    return edges.filter(F.col(score) >= threshold).withColumn("confidence", F.col(score) / F.lit(1000.0)).drop(score)


def validated_panel(panel: DataFrame, sizes: DataFrame) -> DataFrame:
    """``panel(panel, gene)`` passes through when every panel has its expected size, else raises.

    ``sizes(panel, size)`` holds one row per expected panel; all of them are compared, by one join of counts.
    """
    counts = panel.groupBy("panel").agg(F.countDistinct("gene").alias("n"))
    wrong = sizes.join(counts, "panel", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> size")
    first = wrong.orderBy("panel").first()
    if first:
        raise ValueError(f"panel {first['panel']} has {first['n']} genes, expected {first['size']}")
    return panel


def load_cohort(fallback: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """(feature, mean, std, used_fallback): usable cohort entries, the fallback for the rest."""
    if cohort is None:
        return fallback.withColumn("used_fallback", F.lit(True))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = cohort.filter(finite("mean") & finite("std") & (F.col("std") > 0)).select("feature", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return fallback.join(good, "feature", "left").select(
        "feature", F.coalesce("_m", "mean").alias("mean"), F.coalesce("_s", "std").alias("std"), F.col("_m").isNull().alias("used_fallback"))


# --- A11 .. A14 ---------------------------------------------------------------


def write_features(cells: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ("field_id",)) -> None:
    """Per-cell table without ``deep_`` columns. Parquet is laid out by field, clustered first to avoid tiny files.

    Clustering is rebalanced by measured size: a partition value with many rows is written by several tasks, small ones share a task.
    """
    out = cells.drop(*[c for c in cells.columns if c.startswith("deep_")])
    if fmt == "csv":
        out.write.mode("errorifexists").option("header", True).csv(path)
        return
    out.hint("rebalance", *partition).write.mode("errorifexists").partitionBy(*partition).parquet(path)


def summary_records(summary: DataFrame, keys: Sequence[str] = ("field_id",), seed: int = 42, version: int = 1) -> DataFrame:
    """One JSON record per field with provenance."""
    body = [c for c in summary.columns if c not in keys]
    return summary.select(F.to_json(F.struct(
        *keys, F.struct(*body).alias("summary"), F.lit(seed).alias("seed"), F.lit(version).alias("schema_version"))).alias("value"))


def write_text(records: DataFrame, path: str) -> None:
    records.select("value").write.mode("errorifexists").text(path)


def to_records(cells: DataFrame) -> DataFrame:
    keep = [c for c in cells.columns if not c.startswith("deep_")]
    return cells.select(F.to_json(F.struct(*keep)).alias("value"))


def from_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    return records.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_power(grid: DataFrame, summary: DataFrame, path: str) -> None:
    grid.write.mode("errorifexists").json(f"{path}/grid")
    summary.write.mode("errorifexists").option("header", True).csv(f"{path}/summary")
