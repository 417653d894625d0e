"""Per-cell features: hash aggregations of pixels joined to regions, keyed by (field_id, cell_id)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from cytofleet.functions import scalar as S
from cytofleet.operators import raster as R
from cytofleet.operators.scale import attach_stats
from cytofleet.session import pin

CELL = R.CELL


@dataclass(frozen=True)
class RingParams:
    adaptive: bool = True
    fixed_px: int = 10
    radial_bins: int = 20
    entropy_bins: int = 32
    glcm_levels: int = 16
    glcm_min_pixels: int = 100
    moran_min_pixels: int = 50
    coverage: str = "otsu"
    percentile: float = 75.0
    fixed: float = 50.0


@dataclass(frozen=True)
class AdhesionParams:
    threshold: str = "otsu"
    threshold_fixed: float = 0.5
    min_area_um2: float = 0.5
    max_area_um2: float = 50.0
    peripheral_um: float = 6.5
    nascent_um: float = 0.5
    complex_um: float = 1.0
    mature_um: float = 5.0


@dataclass(frozen=True)
class ActinParams:
    sigma_um: float = 0.65
    cortical_um: float = 3.25


def channel(pixels: DataFrame, name: str) -> DataFrame:
    return pixels.filter(F.col("channel") == name).select("field_id", "y", "x", "value")


def over(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """Pixel values over region pixels (one channel). Pixels are never broadcast: their compressed size says little about the driver's memory."""
    return region.join(pixels.select("field_id", "y", "x", "value").hint("merge"), ["field_id", "y", "x"])


# --- D1 .. D5 ---------------------------------------------------------------


def intensity(values: DataFrame) -> DataFrame:
    """Mean, sum and coefficient of variation (population; NULL for zero mean)."""
    m = F.avg("value")
    cv = F.when(m != 0, F.try_divide(F.stddev_pop("value"), m))
    return values.groupBy(*CELL).agg(
        m.alias("mean_intensity"), F.sum("value").alias("integrated_intensity"), cv.alias("heterogeneity"))


def entropy(values: DataFrame, bins: int = 32) -> DataFrame:
    """Shannon entropy in nats of an equal-width histogram; NULL for flat regions."""
    h = attach_stats(R.histogram(values, CELL, bins=bins), CELL, F.sum("n").alias("_t"))
    p = F.col("n") / F.col("_t")
    return h.groupBy(*CELL).agg(
        F.when(F.max("lo") < F.max("hi"), -F.sum(p * F.log(p))).alias("shannon_entropy"))


def coverage(values: DataFrame, params: RingParams = RingParams()) -> DataFrame:
    """Share of region pixels above the threshold; a flat positive region is 1, a flat dark one NULL (Otsu)."""
    if params.coverage == "otsu":
        t = R.otsu_threshold(values, CELL)
        d = values.join(t, CELL).groupBy(*CELL).agg(
            F.max("flat").alias("flat"), F.max("top").alias("top"),
            F.avg(F.when(F.col("value") > F.col("threshold"), 1.0).otherwise(0.0)).alias("share"))
        out = F.when(~F.col("flat"), F.col("share")).when(F.col("top") > 0, F.lit(1.0))
        return d.select(*CELL, out.alias("coverage"))
    t = R.level_threshold(values, CELL, params.coverage, percentile=params.percentile, fixed=params.fixed)
    return values.join(t, CELL).groupBy(*CELL).agg(
        F.avg(F.when(F.col("value") > F.col("threshold"), 1.0).otherwise(0.0)).alias("coverage"))


def pericellular_ratio(ring_values: DataFrame, interior_values: DataFrame) -> DataFrame:
    ring = ring_values.groupBy(*CELL).agg(F.avg("value").alias("_r"))
    core = interior_values.groupBy(*CELL).agg(F.avg("value").alias("_i"))
    return ring.join(core, CELL, "left").select(*CELL, S.guarded_ratio("_r", "_i").alias("pericellular_ratio"))


def decay_rate(binned: DataFrame) -> DataFrame:
    """Minus the slope of ln(profile) on the bin index over positive bins (at least two)."""
    v = F.col("mean").cast("float").cast("double")
    pos = binned.filter(v > 0)
    return pos.groupBy(*CELL).agg(
        F.when(F.count(F.lit(1)) >= 2, -F.regr_slope(F.log(v), F.col("bin").cast("double"))).alias("radial_decay_rate"))


# --- D6 -------------------------------------------------------------------


def nuclear_partition(values: DataFrame) -> DataFrame:
    """``values(field_id, cell_id, nucleus_id, value)``: the nucleus shares the cell's id."""
    inside = F.col("nucleus_id") == F.col("cell_id")
    nuc, cyt = F.avg(F.when(inside, F.col("value"))), F.avg(F.when(~inside, F.col("value")))
    g = values.groupBy(*CELL).agg(
        nuc.alias("yap_nuclear_intensity"), cyt.alias("yap_cytoplasmic_intensity"),
        F.sum(F.when(inside, F.col("value"))).alias("_n"), F.sum("value").alias("_t"))
    return g.select(
        *CELL, "yap_nuclear_intensity", "yap_cytoplasmic_intensity",
        S.guarded_ratio("yap_nuclear_intensity", "yap_cytoplasmic_intensity").alias("yap_nc_ratio"),
        S.guarded_ratio("_n", "_t").alias("yap_nuclear_fraction"))


# --- D11 .. D14 -------------------------------------------------------------


def moments(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Area, centroid, axis lengths, aspect ratio, eccentricity, orientation, equivalent diameter."""
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    g = mask.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.sum(y).alias("_y"), F.sum(x).alias("_x"),
        F.sum(y * y).alias("_yy"), F.sum(x * x).alias("_xx"), F.sum(x * y).alias("_xy"))
    n = F.col("area")
    # whole numbers, so that symmetric regions have a covariance of exactly zero
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    second = lambda ab, a, b: (whole("area") * whole(ab) - whole(a) * whole(b)).cast("double") / (n * n)
    g = g.withColumns({
        "cy": F.col("_y") / n, "cx": F.col("_x") / n,
        "_r": second("_yy", "_y", "_y"), "_c": second("_xx", "_x", "_x"), "_rc": second("_xy", "_y", "_x")})
    half = (F.col("_r") + F.col("_c")) / 2
    skew = (F.col("_r") - F.col("_c")) / 2
    root = F.sqrt(skew * skew + F.col("_rc") * F.col("_rc"))
    g = g.withColumns({"_l1": half + root, "_l2": F.when(half - root > 1e-11, half - root).otherwise(0.0)})
    g = g.withColumns({"major_axis": 4 * F.sqrt("_l1"), "minor_axis": 4 * F.sqrt("_l2")})
    quarter = F.lit(math.pi / 4)
    tilt = F.when(F.abs(F.col("_r") - F.col("_c")) < 1e-12, F.when(F.col("_rc") > 0, quarter).otherwise(-quarter)).otherwise(
        F.lit(0.5) * F.atan2(2 * F.col("_rc"), F.col("_r") - F.col("_c")))
    return g.select(
        *keys, "area", "cy", "cx", "major_axis", "minor_axis",
        F.when(F.col("minor_axis") > 0, F.try_divide(F.col("major_axis"), F.col("minor_axis"))).alias("aspect_ratio"),
        F.when(F.col("_l1") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_l2"), F.col("_l1"))))).otherwise(0.0).alias("eccentricity"),
        tilt.alias("orientation"),
        F.sqrt(F.lit(4.0) * n / F.lit(math.pi)).alias("equivalent_diameter"))


def perimeter(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Outline length from border pixels: 1, sqrt 2 or their mean by 3x3 border pattern."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    code = {(dy, dx): 2 if dy == 0 or dx == 0 else 10 for dy, dx in around}
    spots = F.array(
        F.struct(F.col("y").alias("y"), F.col("x").alias("x"), F.lit(1).alias("code"), F.lit(True).alias("me")),
        *[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(code[dy, dx]).alias("code"), F.lit(False).alias("me"))
          for dy, dx in around])
    met = R.boundary(mask, keys).select(*keys, F.inline(spots)).groupBy(*keys, "y", "x").agg(
        F.sum("code").alias("code"), F.max("me").alias("me")).filter("me")
    # Border pattern codes and their lengths.
    c = F.col("code")
    w = F.when(c.isin(5, 7, 15, 17, 25, 27), 1.0).when(c.isin(21, 33), math.sqrt(2)).when(c.isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return met.groupBy(*keys).agg(F.sum(w).alias("perimeter"))


@pandas_udf(LongType())
def _hull_pixels(ys: pd.Series, x0s: pd.Series, x1s: pd.Series) -> pd.Series:
    """Pixels whose centre lies in the convex hull of the row extremes widened by half a pixel."""
    out = []
    for y, a, b in zip(ys, x0s, x1s):
        y, a, b = np.asarray(y, float), np.asarray(a, float), np.asarray(b, float)
        pts = np.concatenate([
            np.column_stack([q, r]) for q, r in (
                (y, a - 0.5), (y, b + 0.5), (y - 0.5, a), (y + 0.5, a), (y - 0.5, b), (y + 0.5, b))])
        pts = np.unique(pts, axis=0)

        def chain(seq):
            h = []
            for p in seq:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(p)
            return np.array(h)

        low, high = chain(pts), chain(pts[::-1])[::-1]
        rows = np.arange(math.ceil(y.min() - 0.5), math.floor(y.max() + 0.5) + 1)
        left = np.minimum(np.interp(rows, low[:, 0], low[:, 1]), np.interp(rows, high[:, 0], high[:, 1]))
        right = np.maximum(np.interp(rows, low[:, 0], low[:, 1]), np.interp(rows, high[:, 0], high[:, 1]))
        n = np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1
        out.append(int(np.maximum(n, 0).sum()))
    return pd.Series(out, dtype="int64")


def convex_hull(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Convex pixel count and solidity. Spark reduces each region to two pixels per image row first."""
    rows = mask.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("_r"), F.sum("n").alias("area"))
    hull = _hull_pixels(F.col("_r.y"), F.col("_r.x0"), F.col("_r.x1"))
    return g.select(*keys, hull.alias("convex_area"), "area").select(
        *keys, "convex_area", (F.col("area") / F.col("convex_area")).alias("solidity"))


def circularity(area: Column, outline: Column) -> Column:
    return F.when(outline > 0, F.try_divide(F.lit(4 * math.pi) * area, outline * outline))


def cell_morphology(labels: DataFrame) -> DataFrame:
    m = moments(labels).join(perimeter(labels), CELL, "left").join(convex_hull(labels), CELL, "left")
    return m.select(
        *CELL, F.col("area").cast("double").alias("cell_area"), F.col("perimeter").alias("cell_perimeter"),
        circularity(F.col("area"), F.col("perimeter")).alias("cell_circularity"), F.col("aspect_ratio").alias("cell_aspect_ratio"),
        F.col("solidity").alias("cell_solidity"), F.col("convex_area").cast("double").alias("cell_spread_area"),
        F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"))


def nuclear_morphology(labels: DataFrame) -> DataFrame:
    """Seven nuclear outputs; cells without a nucleus get NULLs."""
    nuc = labels.filter(F.col("nucleus_id") == F.col("cell_id"))
    m = moments(nuc).join(perimeter(nuc), CELL, "left").join(convex_hull(nuc), CELL, "left")
    n = m.select(
        *CELL, F.col("area").cast("double").alias("nuclear_area"), F.col("perimeter").alias("nuclear_perimeter"),
        circularity(F.col("area"), F.col("perimeter")).alias("nuclear_circularity"), F.col("aspect_ratio").alias("nuclear_aspect_ratio"),
        F.col("solidity").alias("nuclear_solidity"), F.col("eccentricity").alias("nuclear_eccentricity"))
    cells = labels.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_a"))
    return cells.join(n, CELL, "left").withColumn(
        "nuclear_to_cell_area_ratio", F.col("nuclear_area") / F.col("_a")).drop("_a")


# --- D7 .. D9 ---------------------------------------------------------------


def adhesion_pixels(values: DataFrame, fields: DataFrame, params: AdhesionParams = AdhesionParams()) -> DataFrame:
    """Size-filtered bright components per cell: (field_id, cell_id, y, x, component, size)."""
    if params.threshold == "fixed":
        bright = values.filter(F.col("value") > params.threshold_fixed)
    elif params.threshold == "otsu":
        # flat cells have a NULL threshold, so nothing passes
        t = R.otsu_threshold(values, CELL).select(*CELL, "threshold")
        bright = values.join(t, CELL).filter(F.col("value") > F.col("threshold"))
    else:
        raise ValueError(f"unknown threshold method {params.threshold}")
    comp = R.components(bright.select(*CELL, "y", "x"))
    px = F.col("pixel_size_um")
    comp = comp.join(fields.select("field_id", "pixel_size_um"), "field_id")
    return R.size_filter(comp, CELL, S.min_area_px(params.min_area_um2, px),
                         S.max_area_px(params.min_area_um2, params.max_area_um2, px)).select(*CELL, "y", "x", "component", "size")


def alignment(angle: str) -> Column:
    """Length of the mean double-angle vector; NULL below two angles."""
    a = 2 * F.col(angle)
    return F.when(F.count(angle) >= 2, F.hypot(F.avg(F.sin(a)), F.avg(F.cos(a))))


def adhesion_features(adhesions: DataFrame, labels: DataFrame, fields: DataFrame,
                      params: AdhesionParams = AdhesionParams()) -> DataFrame:
    """Sixteen adhesion outputs; cells without adhesions get counts 0 and shapes NULL."""
    per = moments(adhesions, [*CELL, "component"])
    dist = R.edge_distance(per.select(*CELL, "component", "cy", "cx"), labels, fields).select(*CELL, "component", "edge_distance")
    cells = labels.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_area"))
    px = F.col("pixel_size_um")
    per = per.join(dist, [*CELL, "component"]).join(fields.select("field_id", "pixel_size_um"), "field_id").withColumns({
        "_major": F.col("major_axis") * px,
        "_near": F.col("edge_distance") <= S.distance_px(params.peripheral_um, px)})
    m = F.col("_major")
    g = per.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.avg("area").alias("_mean"), F.sum("area").cast("double").alias("_total"),
        F.avg("aspect_ratio").alias("fa_mean_elongation"), F.avg("edge_distance").alias("fa_mean_distance_to_edge"),
        F.avg(F.col("_near").cast("double")).alias("fa_peripheral_fraction"), alignment("orientation").alias("fa_mean_orientation_alignment"),
        F.count_if(m < params.nascent_um).alias("_n0"),
        F.count_if((m >= params.nascent_um) & (m < params.complex_um)).alias("_n1"),
        F.count_if((m >= params.complex_um) & (m < params.mature_um)).alias("_n2"),
        F.count_if(m >= params.mature_um).alias("_n3"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    d = cells.join(g, CELL, "left").join(fields.select("field_id", "pixel_size_um"), "field_id")
    return d.select(
        *CELL, zero("n").alias("fa_count"), (zero("n") / (F.col("_area") * px * px)).alias("fa_density_per_um2"),
        F.col("_mean").alias("fa_mean_area"), zero("_total").alias("fa_total_area"),
        (F.col("_mean") * px * px).alias("fa_mean_area_um2"), (zero("_total") * px * px).alias("fa_total_area_um2"),
        "fa_mean_elongation", "fa_mean_distance_to_edge",
        (F.col("fa_mean_distance_to_edge") * px).alias("fa_mean_distance_to_edge_um"),
        "fa_peripheral_fraction", "fa_mean_orientation_alignment",
        zero("_n0").alias("fa_nascent_count"), zero("_n1").alias("fa_focal_complex_count"),
        zero("_n2").alias("fa_mature_count"), zero("_n3").alias("fa_fibrillar_count"),
        ((F.col("_n2") + F.col("_n3")) / F.col("n")).alias("fa_mature_fraction"))


# --- D10 ------------------------------------------------------------------


def cortical_ratio(values: DataFrame, labels: DataFrame, fields: DataFrame, params: ActinParams = ActinParams()) -> DataFrame:
    """Cell mean, and outermost ring mean over deep interior mean."""
    depth = labels.select(*CELL).distinct().join(fields.select("field_id", "pixel_size_um"), "field_id").select(
        *CELL, S.width_px(params.cortical_um, "pixel_size_um").alias("depth_px"))
    deep = R.eroded(labels.select(*CELL, "y", "x"), depth).withColumn("_deep", F.lit(True))
    d = values.join(deep, [*CELL, "y", "x"], "left")
    g = d.groupBy(*CELL).agg(
        F.avg("value").alias("actin_mean_intensity"),
        F.avg(F.when(F.col("_deep").isNull(), F.col("value"))).alias("_rim"),
        F.avg(F.when(F.col("_deep"), F.col("value"))).alias("_core"))
    return g.select(*CELL, "actin_mean_intensity", S.guarded_ratio("_rim", "_core").alias("actin_cortical_ratio"))


def actin_features(pixels: DataFrame, labels: DataFrame, fields: DataFrame, params: ActinParams = ActinParams()) -> DataFrame:
    raw = pixels.filter(F.col("channel") == "actin")
    sigma = fields.select("field_id", S.sigma_px(params.sigma_um, "pixel_size_um").alias("sigma_px"))
    top = fields.agg(F.min("pixel_size_um").alias("p")).first()["p"]
    widest = max(0.5, params.sigma_um / top) if top else 0.5
    fibre = R.fibre_features(R.structure_tensor(raw, sigma, widest), labels).select(
        *CELL, F.col("coherence").alias("actin_stress_fiber_coherence"), F.col("orientation_deg").alias("actin_dominant_orientation"))
    return cortical_ratio(over(raw, labels), labels, fields, params).join(fibre, CELL, "left")


# --- D15 .. D17 -------------------------------------------------------------


@dataclass(frozen=True)
class Regions:
    """Region tables shared by the channel families."""

    labels: DataFrame
    ring: DataFrame
    width: DataFrame
    centroids: DataFrame
    cut: bool

    @cached_property
    def interior(self) -> DataFrame:
        """Made and materialised when it is first read, since most families need rings only."""
        inner = R.interior(self.labels.select(*CELL, "y", "x"), self.width)
        return pin(inner) if self.cut else inner


def build_regions(labels: DataFrame, fields: DataFrame, params: RingParams = RingParams(), cut: bool = True) -> Regions:
    """Rings and interiors, materialised once because every channel family reads them."""
    shape = labels.groupBy(*CELL).agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    width = R.ring_width(shape.join(fields.select("field_id", "pixel_size_um"), "field_id"),
                         S.ring_floor_px("pixel_size_um"), params.adaptive, params.fixed_px)
    ring = R.dilation_ring(labels.select(*CELL, "y", "x"), width, fields)
    return Regions(labels, pin(ring) if cut else ring, width, shape, cut)


def stain_features(pixels: DataFrame, regions: Regions, name: str, prefix: str, params: RingParams = RingParams()) -> DataFrame:
    """The ring family (12 scalars and a profile) on any channel, prefixed."""
    px = channel(pixels, name)
    # values meet all regions in one join and are kept, because every family reads them
    spots = regions.ring.select(*CELL, "y", "x", F.lit("ring").alias("_part")).unionByName(
        regions.labels.select(*CELL, "y", "x", F.lit("mask").alias("_part"))).unionByName(
        regions.interior.select(*CELL, "y", "x", F.lit("core").alias("_part")))
    met = pin(over(px, spots))
    part = lambda *names: met.filter(F.col("_part").isin(*names)).drop("_part")
    ring, roi = part("ring"), part("ring", "mask")
    binned = R.radial_bins(roi, regions.centroids, params.radial_bins)
    parts = [
        intensity(ring), entropy(ring, params.entropy_bins), coverage(ring, params),
        pericellular_ratio(ring, part("core")),
        R.radial_profile(binned, params.radial_bins), decay_rate(binned),
        R.glcm_texture(px, ring, params.glcm_levels, params.glcm_min_pixels).select(
            *CELL, *[F.col(c).alias(f"haralick_{c}") for c in ("contrast", "homogeneity", "correlation", "energy")]),
        R.moran_on_mask(ring, params.moran_min_pixels),
    ]
    out = regions.centroids.select(*CELL)
    for p in parts:
        out = out.join(p, CELL, "left")
    return out.withColumnsRenamed({c: f"{prefix}_{c}" for c in out.columns if c not in CELL})


def rename_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnsRenamed({c: new + c[len(old):] for c in df.columns if c.startswith(old)})


def check_channels(pixels: DataFrame) -> DataFrame:
    """Raise when channels of a field cover different extents; otherwise pass the pixels through."""
    per = pixels.groupBy("field_id", "channel").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.count(F.lit(1)).alias("n"))
    odd = per.groupBy("field_id").agg(F.countDistinct("h", "w", "n").alias("k")).filter("k > 1").limit(1).collect()
    if odd:
        raise ValueError(f"channels of field {odd[0]['field_id']} differ in shape")
    return pixels


def assemble_profiles(pixels: DataFrame, labels: DataFrame, fields: DataFrame, channels: Sequence[str],
                      ring: RingParams = RingParams(), adhesion: AdhesionParams = AdhesionParams(),
                      actin: ActinParams = ActinParams()) -> DataFrame:
    """One row per cell; families of absent channels are skipped, an empty mask gives an empty table."""
    labels = pin(labels)  # every family reads them
    regions = build_regions(labels, fields, ring)
    out = cell_morphology(labels)
    parts = []
    if "glycocalyx" in channels:
        parts.append(stain_features(pixels, regions, "glycocalyx", "glycocalyx", ring))
    if "heparan_sulfate" in channels:
        parts.append(stain_features(pixels, regions, "heparan_sulfate", "hs", ring))
    if "yap" in channels:
        parts.append(nuclear_partition(over(channel(pixels, "yap"), labels)))
    if "paxillin" in channels:
        spots = pin(adhesion_pixels(over(channel(pixels, "paxillin"), labels), fields, adhesion))
        parts.append(adhesion_features(spots, labels, fields, adhesion))
    if "actin" in channels:
        parts.append(actin_features(pixels, labels, fields, actin))
    parts.append(nuclear_morphology(labels))
    for p in parts:
        out = out.join(p, CELL, "left")
    return out


def attach_embeddings(cells: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Left join of ``embeddings(field_id, cell_id, embedding)``; a wrong vector width is an error."""
    checked = embeddings.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"embedding width differs from {width}")).cast("array<float>")))
    return cells.join(checked.select(*CELL, "embedding"), CELL, "left")


def expand_profile(cells: DataFrame, column: str = "glycocalyx_radial_profile", bins: int = 20) -> DataFrame:
    """Array column to ``<column>_00`` .. ; the array is dropped."""
    return cells.select("*", *[F.get(column, F.lit(i)).alias(f"{column}_{i:02d}") for i in range(bins)]).drop(column)
