"""Interaction graph, shortest paths, and evidence-weighted rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cytofleet.functions.scalar import edge_cost
from cytofleet.operators.scale import quantiles, with_panel
from cytofleet.session import pin

# Feature -> targets and fallback (mean, std). The third reads yap_nc_ratio.
FEATURE_TARGETS = {
    "yap_nc_ratio": (["YAP1", "WWTR1"], 1.0, 0.3),
    "yap_nuclear_fraction": (["YAP1", "WWTR1"], 0.5, 0.2),
    "yap_target_ctgf_cyr61_ankrd1": (["CTGF", "CYR61", "ANKRD1"], 1.0, 0.3),
    "fa_count": (["ITGB1", "PTK2", "VCL", "PXN"], 50.0, 30.0),
    "fa_mean_elongation": (["TLN1", "VCL"], 1.5, 0.5),
    "fa_peripheral_fraction": (["ITGB1", "PTK2"], 0.3, 0.2),
    "fa_mean_area": (["TLN1", "VCL"], 25.0, 15.0),
    "actin_stress_fiber_coherence": (["RHOA", "ROCK1", "ROCK2", "MYL9"], 0.4, 0.15),
    "actin_cortical_ratio": (["RHOA", "MYL9"], 1.0, 0.5),
    "nuclear_to_cell_area_ratio": (["PIEZO1"], 0.15, 0.05),
    "nuclear_solidity": (["PIEZO1"], 0.95, 0.05),
}
FEATURE_READS = {"yap_target_ctgf_cyr61_ankrd1": "yap_nc_ratio"}
# Curated interactions with their source and rationale.
CURATED = [
    ("GFPT1", "OGT", 0.50, "10.1172/JCI94844",
     "GFPT1 is the rate-limiting enzyme of the hexosamine biosynthetic pathway; its product UDP-GlcNAc is the substrate for OGT (Taparra et al. 2018, JCI)."),
    ("OGT", "YAP1", 0.50, "10.1073/pnas.1619889114",
     "O-GlcNAcylation of YAP at Ser109 by OGT regulates YAP transcriptional activity (Peng et al. 2017, PNAS)."),
    ("MGAT5", "ITGB1", 0.50, "10.1016/j.cell.2007.01.049",
     "MGAT5-mediated N-glycan branching on integrins regulates integrin clustering and mechanosensing (Lau et al. 2007, Cell)."),
    ("B4GALT1", "ITGB1", 0.45, "10.1074/jbc.M807059200",
     "Beta-1,4-galactosyltransferase modifies integrin N-glycans, altering integrin function (Isaji et al. 2009, JBC)."),
    ("GFPT1", "MGAT5", 0.45, "10.1016/j.cell.2007.01.049",
     "GFPT1-produced UDP-GlcNAc feeds into Golgi N-glycan branching via MGAT5 (Lau et al. 2007, Cell)."),
]
PAIR = ["src", "dst"]


def pair_key(df: DataFrame) -> DataFrame:
    """Undirected key: the smaller name first."""
    return df.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


# --- G1, G2 ---------------------------------------------------------------


def build_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges with weight -ln(confidence); non-positive confidence is dropped, duplicates keep the strongest."""
    e = pair_key(edges.filter((F.col("confidence") > 0) & (F.col("src") != F.col("dst"))))
    g = e.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"))
    return g.withColumn("weight", edge_cost("confidence"))


def curated_edges(spark: SparkSession) -> DataFrame:
    """(src, dst, confidence, pubmed_doi, reason) of the fixed curated interactions."""
    return spark.createDataFrame(CURATED, "src string, dst string, confidence double, pubmed_doi string, reason string")


def overlay_curated(graph: DataFrame, curated: DataFrame) -> DataFrame:
    """A curated edge replaces one only when strictly stronger; ``change`` is added, upgraded or kept.

    Edges that come from ``curated`` carry its ``pubmed_doi`` and ``reason``, if it has these columns; they are NULL
    for the others. Of equal pairs in ``curated`` the strongest counts.
    """
    for c in ("pubmed_doi", "reason"):
        if c not in curated.columns:
            curated = curated.withColumn(c, F.lit(None).cast("string"))
    c = pair_key(curated.filter("confidence > 0")).groupBy(*PAIR).agg(
        F.max(F.struct(F.col("confidence").alias("c"), F.col("pubmed_doi").alias("d"), F.col("reason").alias("r"))).alias("_b"))
    d = graph.select(*PAIR, "confidence").join(c.select(*PAIR, F.col("_b.c").alias("_c"), F.col("_b.d").alias("_d"), F.col("_b.r").alias("_r")), PAIR, "full_outer")
    change = F.when(F.col("confidence").isNull(), "added").when(F.col("_c") > F.col("confidence"), "upgraded").otherwise("kept")
    best = F.greatest("confidence", "_c")
    return d.select(*PAIR, best.alias("confidence"), edge_cost(best).alias("weight"), change.alias("change"),
                    F.when(change == "kept", "network").otherwise("curated").alias("source"),
                    F.when(change != "kept", F.col("_d")).alias("pubmed_doi"), F.when(change != "kept", F.col("_r")).alias("reason"))


def both_directions(graph: DataFrame) -> DataFrame:
    back = graph.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return graph.unionByName(back)


# --- G3, G4 ---------------------------------------------------------------


def shortest_paths(graph: DataFrame, sources: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(source, node, distance, path) for every node reachable from ``sources(source)``.

    Rounds relax only the rows improved in the previous round. Equal distances resolve to the
    smaller path array, so results do not depend on row order. State is checkpointed each round.
    """
    hop = both_directions(graph.select(*PAIR, "weight"))
    start = sources.join(hop.select(F.col("src").alias("source")).distinct(), "source", "left_semi").distinct()
    state = pin(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.array("source").alias("path")))
    front = state
    for _ in range(max_rounds):
        step = front.join(hop, front["node"] == hop["src"]).select(
            "source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("dst")).alias("path"),
            F.array_contains("path", F.col("dst")).alias("_loop")).filter("not _loop")
        best = step.groupBy("source", "node").agg(F.min(F.struct("distance", "path")).alias("n"))
        old = state.select("source", "node", F.struct("distance", "path").alias("o"))
        merged = pin(old.join(best, ["source", "node"], "full_outer").select(
            "source", "node", F.coalesce(F.least("o", "n"), "o", "n").alias("b"),
            (F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n") < F.col("o")))).alias("_new")))
        state = merged.select("source", "node", F.col("b.distance").alias("distance"), F.col("b.path").alias("path"))
        front = merged.filter("_new").select("source", "node", F.col("b.distance").alias("distance"), F.col("b.path").alias("path"))
        if front.isEmpty():
            return state
    raise RuntimeError("shortest paths did not converge")


def path_evidence(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``path_edges``: the attributes of each edge along the path, in order (NULL for a single node)."""
    attrs = [c for c in edges.columns if c not in PAIR]
    e = both_directions(edges).select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.struct(*attrs).alias("_e"))
    at = paths.select("source", "node", F.posexplode("path").alias("i", "from"), "path").withColumn("to", F.get("path", F.col("i") + 1)).filter("to is not null")
    hit = at.join(e, (at["from"] == e["_a"]) & (at["to"] == e["_b"]), "left")
    edge = F.struct("i", "from", "to", *[F.col(f"_e.{c}").alias(c) for c in attrs])
    # one path per (source, node): at most as many edges as the path is long
    per = hit.groupBy("source", "node").agg(F.array_sort(F.collect_list(edge)).alias("path_edges"))
    return paths.join(per, ["source", "node"], "left")


# --- G5 .. G9 ---------------------------------------------------------------


def median_inverse(paths: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Median over targets of 1/(1+d), 0 when unreachable; no targets gives 0. The panel bounds the median."""
    grid = with_panel(sources, targets)
    d = grid.join(paths.select("source", F.col("node").alias("target"), "distance"), ["source", "target"], "left")
    inv = F.coalesce(1 / (1 + F.col("distance")), F.lit(0.0))
    g = d.groupBy("source").agg(F.median(inv).alias("score"), F.count_if(F.col("distance").isNotNull()).alias("reachable"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sources.distinct().join(g, "source", "left").select("source", zero("score"), zero("reachable"))


def rank_genes(df: DataFrame, keys: Sequence[str] = (), gene: str = "gene", score: str = "score") -> DataFrame:
    """Rank by score descending, name ascending; NULL scores last."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(gene))))


def shift_ranking(shifts: DataFrame) -> DataFrame:
    """``shifts(gene, target, shift)`` -> median per (gene, target), then median over targets, ranked.

    The first level may hold any number of cells per pair, so it uses order statistics; the second
    is bounded by the target panel.
    """
    ok = shifts.filter(F.col("shift").isNotNull() & ~F.isnan("shift"))
    per = quantiles(ok, ["gene", "target"], "shift", {"m": 0.5})
    g = per.groupBy("gene").agg(F.median("m").alias("score"))
    every = shifts.select("gene").distinct().join(g, "gene", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rank_genes(every)


def rank_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """|rank difference| on common genes; an unavailable (empty) source gives an empty table."""
    return a.select("gene", F.col("rank").alias("rank_a")).join(b.select("gene", F.col("rank").alias("rank_b")), "gene").withColumn(
        "divergence", F.abs(F.col("rank_a") - F.col("rank_b")))


def combined_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of genes with both ranks and scores; ``position`` sorts by first rank (missing last), then gene."""
    j = a.select("gene", F.col("rank").alias("rank_a"), F.col("score").alias("score_a")).join(
        b.select("gene", F.col("rank").alias("rank_b"), F.col("score").alias("score_b")), "gene", "full_outer")
    w = Window.orderBy(F.asc_nulls_last("rank_a"), "gene")
    return j.withColumn("position", F.row_number().over(w))


# --- G10 ------------------------------------------------------------------


def prior_status(meta: DataFrame, genes: DataFrame, now: Column, min_genes: int = 17, fresh_days: int = 180) -> DataFrame:
    """``meta(source, available, metadata map)`` and ``genes(source, gene, rank, score)`` -> one status per source."""
    g = genes.groupBy("source").agg(
        F.countDistinct("gene").alias("n_genes"), F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("_bad"),
        F.count_if(F.col("rank") <= 0).alias("_neg"))
    d = meta.join(g, "source", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0)))
    stamp = F.try_to_timestamp(F.try_element_at("metadata", F.lit("generated_utc")))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / F.lit(86400e6)
    d = d.withColumn("age_days", F.when(F.col("available"), age))
    status = (
        F.when(~F.col("available"), "missing")
        .when(F.map_contains_key("metadata", "error"), "invalid")
        .when((F.col("n_genes") == 0) | (F.col("n_genes") < min_genes), "invalid")
        .when((F.col("_bad") > 0) | (F.col("_neg") > 0), "invalid")
        .when(F.col("age_days") > fresh_days, "stale").otherwise("ready"))
    return d.select("source", status.alias("status"), F.when(F.col("available"), F.col("n_genes")).otherwise(0).alias("n_genes"), "age_days")


# --- G11 .. G18 -------------------------------------------------------------


def feature_targets(spark) -> DataFrame:
    """feature_targets(feature, target): constant map, 11 features."""
    rows = [(f, t) for f, (ts, _, _) in FEATURE_TARGETS.items() for t in ts]
    return spark.createDataFrame(rows, "feature string, target string")


def fallback_cohort(spark) -> DataFrame:
    return spark.createDataFrame([(f, m, s) for f, (_, m, s) in FEATURE_TARGETS.items()], "feature string, mean double, std double")


def feature_z(cells: DataFrame, cohort: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, z): field mean against the cohort for mapped features; absent ones are omitted."""
    reads = {f: FEATURE_READS.get(f, f) for f in FEATURE_TARGETS}
    have = {f: c for f, c in reads.items() if c in cells.columns}
    means = cells.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in sorted(set(have.values()))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("observed")) for f, c in have.items()])
    long = means.select(*keys, F.inline(rows)).filter(F.col("observed").isNotNull())
    return long.join(cohort.select("feature", "mean", "std"), "feature").select(
        *keys, "feature", F.try_divide(F.col("observed") - F.col("mean"), F.col("std")).alias("z"))


def target_weights(z: DataFrame, targets: DataFrame, panel: DataFrame, keys: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """(keys, target, weight): sum of |z| per target, L1, floored at 1/(10n), renormalised; uniform without signal.

    Every key group holds one row per panel target, so the windows below are panel-sized.
    """
    keys = list(keys)
    contrib = z.join(targets, "feature").groupBy(*keys, "target").agg(F.sum(F.abs("z")).alias("_w"), F.max(F.abs("z")).alias("_x"))
    base = z.select(*keys).distinct() if keys else z.groupBy().agg(F.count(F.lit(1)).alias("_c"))
    grid = with_panel(base, panel.select("target")).drop("_c")
    d = grid.join(contrib, [*keys, "target"], "left").withColumns({"_w": F.coalesce("_w", F.lit(0.0)), "_x": F.coalesce("_x", F.lit(0.0))})
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    d = d.withColumns({"_n": n, "_t": F.sum("_w").over(w), "_any": F.max("_x").over(w) > eps})
    flat = 1 / F.col("_n")
    d = d.withColumn("_f", F.when(F.col("_any") & (F.col("_t") > 0), F.greatest(F.try_divide(F.col("_w"), F.col("_t")), flat / 10)).otherwise(flat))
    return d.select(*keys, "target", (F.col("_f") / F.sum("_f").over(w)).alias("weight"))


def signed_target_z(z: DataFrame, targets: DataFrame, panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, target, z): mean signed z per panel target, 0 without evidence."""
    keys = list(keys)
    per = z.join(targets, "feature").groupBy(*keys, "target").agg(F.avg("z").alias("z"))
    base = z.select(*keys).distinct() if keys else z.groupBy().agg(F.count(F.lit(1)).alias("_c"))
    grid = with_panel(base, panel.select("target")).drop("_c")
    return grid.join(per, [*keys, "target"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "score") -> DataFrame:
    """Lower weighted median: the first value whose cumulative weight reaches half. Groups are panel-sized."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(weight) > 0))
    w = Window.partitionBy(*keys)
    run = w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    d = ok.withColumns({"_c": F.sum(weight).over(run), "_t": F.sum(weight).over(w)})
    hit = d.filter(F.col("_c") >= F.col("_t") / 2 * (1 - 1e-12)).groupBy(*keys).agg(F.min(value).alias(out))
    return df.select(*keys).distinct().join(hit, list(keys), "left")


def _row_median(entries: Column) -> Column:
    """Lower weighted median of an array of (value, weight) structs, as in :func:`weighted_median`."""
    ok = F.filter(entries, lambda e: e["v"].isNotNull() & ~F.isnan(e["v"]) & (e["w"] > 0))
    total = F.aggregate(F.transform(ok, lambda e: e["w"]), F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("c"), (total / 2 * (1 - 1e-12)).alias("half"), F.lit(None).cast("double").alias("hit"))

    def step(acc: Column, e: Column) -> Column:
        c = acc["c"] + e["w"]
        return F.struct(c.alias("c"), acc["half"].alias("half"), F.coalesce(acc["hit"], F.when(c >= acc["half"], e["v"])).alias("hit"))

    return F.aggregate(F.array_sort(ok), start, step)["hit"]


def rerank(prior: DataFrame, weights: DataFrame, keys: Sequence[str] = (), signed: DataFrame | None = None) -> DataFrame:
    """Dynamic scores and ranks per (keys, source, gene) from target weights.

    ``prior(source, gene, rank, score, target, inverse)``. Ties fall back to the static rank, then
    the name; genes without shared targets come last. With ``signed(target, z)`` a ``signed_score``
    (weighted median of sign(z) * inverse) is added.

    A gene is one row with its targets in an array, a key group one row with a map from target to weight; their
    medians are taken inside the row, so only (keys, source, gene) rows are shuffled, for the ranks. ``weights`` and
    ``signed`` hold a target once per key group; a second row for it is an error.
    """
    keys = list(keys)
    entry = F.when(F.col("target").isNotNull(), F.struct("target", F.col("inverse").cast("double").alias("inverse")))
    genes = prior.groupBy("source", "gene").agg(F.max("rank").alias("static_rank"), F.collect_list(entry).alias("_e"))
    by_target = lambda df, value, out: df.filter(F.col("target").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("target", value))).alias(out))
    groups = by_target(weights, "weight", "_w")
    if signed is not None:
        z = by_target(signed, "z", "_z")
        groups = groups.join(z, keys, "left") if keys else groups.join(z)  # without keys both are one row
    d = with_panel(groups, genes)

    def median(value) -> Column:
        return _row_median(F.transform("_e", lambda e: F.struct(value(e).alias("v"), F.element_at("_w", e["target"]).alias("w"))))

    use = [*keys, "source", "gene", "static_rank", median(lambda e: e["inverse"]).alias("score")]
    if signed is not None:
        use.append(median(lambda e: F.signum(F.element_at("_z", e["target"])) * e["inverse"]).alias("signed_score"))
    d = d.select(*use)
    # one gene panel per (keys, source)
    w = Window.partitionBy(*keys, "source").orderBy(F.desc_nulls_last("score"), "static_rank", "gene")
    d = d.withColumn("dynamic_rank", F.row_number().over(w))
    return d.withColumn("delta", F.col("static_rank") - F.col("dynamic_rank"))


# --- G19 .. G24 -------------------------------------------------------------


def reachable_targets(prior: DataFrame) -> DataFrame:
    """Per gene: number and sorted names of targets with a finite positive score."""
    ok = (F.col("inverse") > 0) & ~F.isnan("inverse") & (F.col("inverse") < float("inf"))
    return prior.groupBy("source", "gene").agg(
        F.count_if(ok).alias("n_reachable"), F.array_sort(F.collect_set(F.when(ok, F.col("target")))).alias("targets"))


def inhibitor_lookup(inhibitors: DataFrame, ranking: DataFrame) -> DataFrame:
    return inhibitors.join(ranking.select(F.col("gene").alias("target"), "rank", "score"), "target", "left")


def complete_drilldown(evidence: DataFrame, genes: DataFrame, panel: DataFrame) -> DataFrame:
    """Every (gene, panel target) gets a row: distance, path length in edges, cost and curated flag."""
    grid = with_panel(genes.select("gene"), panel.select("target"))
    d = grid.join(evidence, ["gene", "target"], "left")
    edges = F.filter("path_edges", lambda e: e.isNotNull())
    return d.select(
        "gene", "target", F.col("distance").isNotNull().alias("reachable"), "distance",
        F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("path_length"),
        F.aggregate(F.transform(edges, lambda e: edge_cost(e["confidence"])), F.lit(0.0), lambda a, v: a + v).alias("cost"),
        F.exists(edges, lambda e: e["source"] == "curated").alias("curated"))


def signature_matrix(prior: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Gene x target values in rank order, 0 for unreachable; the panel fixes the columns."""
    g = prior.groupBy("gene").pivot("target", list(panel)).agg(F.first("inverse"))
    r = prior.groupBy("gene").agg(F.max("rank").alias("rank"))
    return r.join(g, "gene").select("rank", "gene", *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(t) for t in panel])


def path_subnetwork(evidence: DataFrame, gene: str | Column, selected_target: str) -> DataFrame:
    """Distinct undirected edges over a gene's paths, strongest attributes kept, edges of one path flagged."""
    e = evidence.filter(F.col("gene") == gene).select("gene", "target", F.explode("path_edges").alias("e"))
    d = e.select(
        F.least("e.from", "e.to").alias("src"), F.greatest("e.from", "e.to").alias("dst"), F.col("e.confidence").alias("confidence"),
        (F.col("target") == selected_target).alias("_s"))
    return d.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"), F.max("_s").alias("selected"))


def top_weights(weights: DataFrame, signed: DataFrame, keys: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Largest weights with direction; |z| below .1 is neutral."""
    from cytofleet.operators.scale import top_k

    d = weights.join(signed, [*keys, "target"])
    d = top_k(d, keys, [F.desc("weight"), F.asc("target")], k)
    return d.withColumn("direction", F.when(F.abs("z") < 0.1, "neutral").when(F.col("z") > 0, "up").otherwise("down"))
