"""Scalar rules: quality flags, tags, interpretation levels, lookups, catalogue facets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytofleet.operators.scale import attach_stats, evaluated
from cytofleet.schema import CHANNELS, numeric_columns, present

FIELD = ["field_id"]

# --- B3 -------------------------------------------------------------------

_EXTRA = re.compile(r"(coherence|ratio|coverage|solidity|area|moran|entropy|score|density)")


def select_features(df: DataFrame, allow: Sequence[str] = (), extras: int = 18) -> list[str]:
    """Allowed numeric features in order, then the first ``extras`` other matching names, sorted."""
    have = numeric_columns(df)
    first = [c for c in allow if c in have]
    return first + sorted(c for c in have if c not in first and _EXTRA.search(c))[:extras]


# --- B5, B7 ---------------------------------------------------------------


def drop_substitutes(df: DataFrame, substitutes: DataFrame, on: Sequence[str] = ("field_id", "channel")) -> DataFrame:
    return df.join(substitutes.select(*on).distinct(), list(on), "left_anti")


def complete_rows(df: DataFrame, cols: Sequence[str], minimum: int) -> DataFrame:
    """Rows without NULL or NaN in ``cols``; fewer than ``minimum`` rows is an error."""
    kept = df.na.drop(subset=list(cols))
    if len(kept.select(*cols[:1]).limit(minimum).take(minimum)) < minimum:
        raise ValueError(f"fewer than {minimum} complete rows")
    return kept


# --- B8, B9 ---------------------------------------------------------------


def qc_flags(cells: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """Adds ``flags``, ``blocking_flags`` and ``analysis_ready`` from field-relative rules.

    Uses the columns that exist; ``bbox_*`` with ``height``/``width`` enable the edge rule. Zero
    spread counts as one, as in the population statistics.
    """
    have = set(cells.columns)
    get = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    area = F.coalesce(get("cell_area"), get("cell_spread_area"))
    d = cells.withColumns({
        "_area": area, "_nuc": get("nuclear_area"), "_sol": get("cell_solidity"), "_wga": get("glycocalyx_mean_intensity"),
        "_act": get("actin_mean_intensity"), "_nin": get("yap_nuclear_intensity"),
        "_nc": F.coalesce(get("nuclear_to_cell_area_ratio"), F.when(area > 0, F.try_divide(get("nuclear_area"), area)))})
    aggs = []
    for c in ("_area", "_nuc", "_wga"):
        aggs += [F.avg(c).alias(c + "m"), F.stddev_pop(c).alias(c + "s")]
    d = attach_stats(d, keys, *aggs)
    sd = lambda c: F.when(F.col(c + "s") > 0, F.col(c + "s")).otherwise(1.0)
    edge = F.lit(False)
    if {"bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "height", "width"} <= have:
        edge = ((F.col("bbox_x0") <= 1) | (F.col("bbox_y0") <= 1) | (F.col("bbox_x1") >= F.col("width") - 2) | (F.col("bbox_y1") >= F.col("height") - 2))
    a = F.col("_area")
    # (condition, label, blocking) in reporting order
    rules = [
        (edge, "edge-truncated cell", True),
        (a < F.greatest(F.lit(40.0), F.col("_aream") - 2.5 * sd("_area")), "very small cell area", True),
        (a > F.col("_aream") + 3 * sd("_area"), "very large cell area", True),
        (F.col("_nuc") < F.greatest(F.lit(12.0), F.col("_nucm") - 2.5 * sd("_nuc")), "low nuclear signal", True),
        ((F.col("_nc") < 0.03) | (F.col("_nc") > 0.75), "abnormal nuclear-to-cell area ratio", True),
        (F.col("_sol") < 0.72, "segmentation confidence low", True),
        (F.col("_sol") < 0.65, "overlapping/touching cells", False),
        (F.col("_wga") > 0.98, "saturated WGA channel", True),
        (F.col("_act") > 0.98, "saturated actin channel", True),
        (F.col("_nin") > 0.98, "saturated nuclear channel", True),
        ((a < 80) & (F.col("_nuc") < 20), "high debris probability", True),
        (F.col("_wga") < F.col("_wgam") - 2 * sd("_wga"), "low signal-to-background ratio", False),
    ]
    collect = lambda only: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t, b in rules if b or not only]))
    d = d.withColumns({"flags": collect(False), "blocking_flags": collect(True)})
    d = d.withColumn("analysis_ready", F.size("blocking_flags") == 0)
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def is_visible(mode: str = "analysis_ready", exclude_edge: bool = False, exclude_saturated: bool = False) -> Column:
    """Condition on flagged cells: ``all``, ``analysis_ready`` (optionally without edge or saturated flags) or ``qc_failed``."""
    if mode == "all":
        return F.lit(True)
    if mode == "qc_failed":
        return ~F.col("analysis_ready") | (F.size("flags") > 0)
    out = F.col("analysis_ready")
    if exclude_edge:
        out = out & ~F.array_contains("flags", "edge-truncated cell")
    if exclude_saturated:
        out = out & ~F.exists("flags", lambda f: f.contains("saturated"))
    return out


def visible_cells(flagged: DataFrame, mode: str = "analysis_ready", exclude_edge: bool = False, exclude_saturated: bool = False) -> DataFrame:
    """The flagged cells that :func:`is_visible` keeps."""
    return flagged.filter(is_visible(mode, exclude_edge, exclude_saturated))


def count_visible(flagged: DataFrame, views: dict[str, dict], keys: Sequence[str] = FIELD) -> DataFrame:
    """(mode, keys, n): visible cells per view and field, all views in one pass over the flagged cells; empty views have no row."""
    names = list(views)
    shown = evaluated(flagged, {f"_v{i}": is_visible(**views[name]) for i, name in enumerate(names)})
    per = shown.groupBy(*keys).agg(*[F.count_if(F.col(f"_v{i}")).alias(f"_v{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(name).alias("mode"), F.col(f"_v{i}").alias("n")) for i, name in enumerate(names)])
    return per.select(*keys, F.inline(rows)).filter("n > 0").select("mode", *keys, "n")


# --- B10 ------------------------------------------------------------------


def phenotype_tag(ratio: Column, score: Column) -> Column:
    """Rule table on ratio (.8 / .4) and score (+-1); empty when neither side is remarkable."""
    g = F.when(ratio > 0.8, "WGA proxy high").when(ratio < 0.4, "WGA proxy low")
    m = F.when(score > 1.0, "prototype high").when(score < -1.0, "prototype low")
    return F.when(ratio.isNotNull() & score.isNotNull(), F.concat_ws(" / ", g, m)).otherwise("")


def narrative_tag(ratio_z: Column, yap: Column, fa: Column, actin: Column, yap_real: bool, fa_real: bool) -> Column:
    parts = [F.when(ratio_z > 1, "WGA proxy high").when(ratio_z < -1, "WGA proxy low")]
    if yap_real:
        parts.append(F.when(yap > 1.3, "YAP nuclear-enriched").when(yap < 0.8, "YAP cytoplasmic-enriched"))
    else:
        parts.append(F.when(yap.isNotNull(), "YAP/TAZ placeholder output"))
    parts.append(F.when(fa > 0.5, "FA-mature").when(fa.isNotNull(), "FA-nascent") if fa_real else F.when(fa.isNotNull(), "FA placeholder output"))
    parts.append(F.when(actin > 0.6, "aligned stress fibers"))
    text = F.concat_ws(" / ", *parts)
    return F.when(text == "", "Prototype mechanophenotype profile").otherwise(text)


# --- B12 ------------------------------------------------------------------

# Signature layers.
LAYERS = {
    "effectors": ["YAP1", "WWTR1"], "response": ["CTGF", "CYR61", "ANKRD1"], "actomyosin": ["RHOA", "ROCK1", "ROCK2", "MYL9"],
    "adhesion": ["ITGB1", "PTK2", "VCL", "PXN", "TLN1"], "ion_channel": ["PIEZO1"],
}
LAYER_LABELS = {
    "effectors": "Mechanosensitive transcriptional effectors",
    "response": "YAP/TAZ-response genes",
    "actomyosin": "Actomyosin tension",
    "adhesion": "Adhesion clutch",
    "ion_channel": "Mechanosensitive ion channel",
}
# Display names of targets.
TARGET_ALIASES = {
    "YAP1": "YAP1",
    "WWTR1": "WWTR1/TAZ",
    "TAZ": "WWTR1/TAZ",
    "CTGF": "CCN2/CTGF",
    "CCN2": "CCN2/CTGF",
    "CYR61": "CYR61/CCN1",
    "CCN1": "CYR61/CCN1",
    "ANKRD1": "ANKRD1",
    "RHOA": "RHOA",
    "ROCK1": "ROCK1",
    "ROCK2": "ROCK2",
    "MYL9": "MYL9",
    "ITGB1": "ITGB1",
    "PTK2": "PTK2/FAK",
    "FAK": "PTK2/FAK",
    "VCL": "VCL",
    "PXN": "PXN",
    "TLN1": "TLN1",
    "PIEZO1": "PIEZO1",
}
# Gene classes.
CLASSES = {
    "HA/CD44 axis": ["CD44", "HAS1", "HAS2", "HAS3"],
    "HSPG core proteins": ["SDC1", "SDC2", "SDC3", "SDC4", "GPC1", "GPC3", "GPC4", "GPC6"],
    "HS biosynthesis/remodeling": ["EXT1", "EXT2", "NDST1", "NDST2", "HPSE"],
    "N/O-glycosylation and HBP/O-GlcNAc": ["MGAT5", "B4GALT1", "GFPT1", "GFPT2", "OGT"],
}
SIGNATURE = [g for genes in LAYERS.values() for g in genes]
# Perturbed genes.
PERTURBATION_PANEL = [
    "SDC1", "SDC2", "SDC3", "SDC4", "GPC1", "GPC3", "GPC4", "GPC6", "EXT1", "EXT2", "NDST1", "NDST2", "HPSE", "GFPT1", "GFPT2",
    "OGT", "MGAT5", "B4GALT1", "HAS1", "HAS2", "HAS3", "CD44"]
# Inhibitor -> target.
INHIBITORS = {"2-DG": "HK2", "DON": "GFPT1", "tunicamycin": "DPAGT1", "benzyl-GalNAc": "GALNT family", "PUGNAc": "OGA"}
#: Sizes that the fixed panels must have.
PANEL_SIZES = {"perturbation": 22, "signature": 15, "inhibitors": 5}


def fixed_panels(spark: SparkSession) -> DataFrame:
    """panel(panel, gene): the perturbed genes, the signature and the inhibitors' targets."""
    rows = [("perturbation", g) for g in PERTURBATION_PANEL] + [("signature", g) for g in SIGNATURE] + [("inhibitors", g) for g in INHIBITORS.values()]
    return spark.createDataFrame(rows, "panel string, gene string")


def fixed_inhibitors(spark: SparkSession) -> DataFrame:
    """inhibitors(inhibitor, target)."""
    return spark.createDataFrame(list(INHIBITORS.items()), "inhibitor string, target string")


def lookup(name: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    """Group name of a member by a constant map."""
    pairs = [F.lit(v) for group, members in table.items() for m in members for v in (m, group)]
    hit = F.try_element_at(F.create_map(*pairs), name)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def relabel(name: Column, table: dict[str, str]) -> Column:
    """Value of a constant map; NULL for names that it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), name)


def rename_nodes(path: Column, aliases: DataFrame | dict[str, str]) -> Column:
    """Apply an alias map to every node of a path; unknown names stay."""
    m = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.transform(path, lambda n: F.coalesce(F.try_element_at(m, n), n))


def lookup_join(df: DataFrame, names: DataFrame, key: str, default: str = "Other", out: str = "class") -> DataFrame:
    """Left join of ``names(<key>, <out>)`` with a default for unmatched keys."""
    return df.join(names, key, "left").withColumn(out, F.coalesce(out, F.lit(default)))


# --- B13, B16 ---------------------------------------------------------------

# Markers, metadata and score groups with their weights.
CORE_MARKERS = ["nuclear", "wga_proxy", "actin", "yap", "focal_adhesion"]
REQUIRED_METADATA = ["condition", "biologicalReplicate", "technicalReplicate"]
ANY_METADATA = ["perturbation", "substrateStiffness", "mechanicalStimulation"]
SCORE_GROUPS = [("Morphology", None, 0.25), ("Actin coherence", "actin", 0.20), ("WGA proxy", "wga_proxy", 0.20),
                ("YAP N/C", "yap", 0.20), ("FA maturity", "focal_adhesion", 0.15)]


def _flag(m: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(m), F.lit(key)), F.lit(False))


def interpretation_level(config: DataFrame) -> DataFrame:
    """Rule ladder over ``dataset_type``, ``allowed``, ``markers``, ``metadata`` and ``controls`` maps."""
    markers, required, some = F.lit(True), F.lit(True), F.lit(False)
    for k in CORE_MARKERS:
        markers = markers & _flag("markers", k)
    for k in REQUIRED_METADATA:
        required = required & _flag("metadata", k)
    for k in ANY_METADATA:
        some = some | _flag("metadata", k)
    controls = (F.size("controls") > 0) & F.forall(F.map_values("controls"), lambda v: v == "validated")
    level = (
        F.when((F.col("dataset_type") == "technical_demo") | ~F.coalesce(F.col("allowed"), F.lit(False)), "technical_demo")
        .when(~(markers & required & some), "marker_quantification")
        .when(F.coalesce(controls, F.lit(False)), "validated_biological_inference")
        .otherwise("phenotype_comparison"))
    return config.withColumn("interpretation_level", level)


def score_groups(config: DataFrame) -> DataFrame:
    """One row per dataset and score group: weight and whether its marker is real."""
    groups = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).cast("string").alias("marker"), F.lit(w).alias("weight")) for g, m, w in SCORE_GROUPS])
    keep = [c for c in config.columns if c not in ("group", "marker", "weight")]
    d = config.select(*keep, F.inline(groups))
    real = F.coalesce(F.try_element_at("markers", "marker"), F.lit(False))
    return d.withColumn("active", F.col("marker").isNull() | real)


# --- B14, B15, B17, B18 ------------------------------------------------------


def control_label(well: Column) -> Column:
    """Edge columns (2 or lower, 23 or higher) hold controls; NULL without digits."""
    n = F.regexp_replace(well, "[^0-9]", "").try_cast("int")
    return F.when(n.isNull(), None).when((n <= 2) | (n >= 23), "DMSO control").otherwise("Compound-treated")


def stars(q: Column) -> Column:
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*")


def overlay_values(cells: DataFrame, feature: str, diverging: bool = False, stops: int = 5, keys: Sequence[str] = FIELD) -> DataFrame:
    """Position of each cell on a colour ramp in [0, 1] and the lower stop's index."""
    d = attach_stats(cells.filter(F.col(feature).isNotNull()), keys, F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    reach = F.greatest(F.abs("_lo"), F.abs("_hi"))
    lo, span = (-reach, 2 * reach) if diverging else (F.col("_lo"), F.col("_hi") - F.col("_lo"))
    t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(feature) - lo, span))))
    return d.withColumn("position", t).withColumn(
        "stop", F.when(F.col("position").isNotNull(), F.least(F.floor(F.col("position") * (stops - 1)), F.lit(stops - 2))).cast("int")).drop("_lo", "_hi")


# Pixel-size presets in matching order.
PIXEL_PRESETS = [("leica-100x", 0.063), ("zeiss-63x-airy", 0.084), ("leica-63x", 0.103), ("zeiss-63x", 0.137), ("zeiss-40x", 0.163), ("zeiss-20x", 0.227),
                 ("leica-20x", 0.325), ("leica-20x-2x", 0.163), ("bbbc022", 0.656)]


def pixel_preset(um: Column) -> Column:
    """First preset within one percent, else ``custom``."""
    out = F.when(F.lit(False), F.lit(""))
    for name, v in PIXEL_PRESETS:
        out = out.when(F.abs(um - v) / v < 0.01, name)
    return out.otherwise("custom")


# --- H1 .. H4 ---------------------------------------------------------------


def panel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def uncovered(required: DataFrame, validated: DataFrame) -> DataFrame:
    """Required entries that are not validated; empty means the requirement holds."""
    return required.exceptAll(validated.intersect(required)).distinct()


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Ordered de-duplication: the first row of every key."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def replace_entries(catalogue: DataFrame, fresh: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Drop entries whose name starts with the prefix, then append the new ones (idempotent)."""
    return catalogue.filter(~F.col(name).startswith(prefix)).unionByName(fresh)


def search_catalogue(items: DataFrame, text: str = "", source: str | None = None, channel: str | None = None,
                     columns: Sequence[str] = ("name", "source", "note")) -> DataFrame:
    """Case-insensitive substring search plus facet filters on ``sources`` and ``channels`` arrays."""
    out = items
    if text.strip():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *present(items, list(columns)))), F.lit(text.strip().lower())))
    if source:
        out = out.filter(F.array_contains("sources", source))
    if channel:
        out = out.filter(F.array_contains("channels", channel))
    return out


def sort_catalogue(items: DataFrame, mode: str = "label") -> DataFrame:
    order = {
        "label": [F.asc("name")], "source": [F.asc("source"), F.asc("name")], "cell_line": [F.asc("cell_line"), F.asc("name")],
        "pixel_size": [F.asc_nulls_last("pixel_size_um"), F.asc("name")]}
    return items.orderBy(*order[mode])


# Facet display order.
FACET_ORDER = ["bundled", "upload", "real", "substitute", *CHANNELS[:2], "actin", "yap", "paxillin", "heparan_sulfate", "fibrosis"]


def facet_counts(items: DataFrame, facet: str) -> DataFrame:
    """Items per facet value plus an ``all`` row; ``position`` follows the fixed priority, then the name.

    ``position`` is the fixed priority (0 for all, 1000 for names outside the list).
    """
    per = items.select(F.explode(F.array_distinct(facet)).alias("facet")).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
    every = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("facet"), "n")
    at = F.array_position(F.array(*[F.lit(f) for f in FACET_ORDER]), F.col("facet"))
    pos = F.when(F.col("facet") == "all", 0).when(at > 0, at).otherwise(1000)
    return per.unionByName(every).withColumn("position", pos.cast("int"))
