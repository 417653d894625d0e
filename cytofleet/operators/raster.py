"""Raster algebra on the long pixel table. Nothing here gathers an image into one task.

Neighbourhood work is either a window along one image axis (partitioned by field, channel
and row or column) or one aggregation over rows scattered to neighbouring positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cytofleet.functions.scalar import half_even
from cytofleet.operators.scale import attach_stats, quantiles
from cytofleet.schema import NUCLEAR_CHANNEL
from cytofleet.session import pin

CELL = ["field_id", "cell_id"]
IMAGE = ["field_id", "channel"]
TILE = 64


# --- C1 -------------------------------------------------------------------


def white_tophat(pixels: DataFrame, radius: DataFrame, skip: Sequence[str] = (NUCLEAR_CHANNEL,)) -> DataFrame:
    """Subtract the opening by a (2r+1)-sided square; ``radius(field_id, radius_px)`` differs by field.

    The order key x/(r+0.5) turns a per-field radius into the constant range frame [-1, 1].
    Rows, columns, columns, rows: three exchanges, each task holds single image lines.
    """
    p = pixels.filter(~F.col("channel").isin(*skip)).join(radius, "field_id")
    step = F.col("radius_px") + F.lit(0.5)
    p = p.withColumns({"_kx": F.col("x") / step, "_ky": F.col("y") / step})
    row = Window.partitionBy(*IMAGE, "y").orderBy("_kx").rangeBetween(-1, 1)
    column = Window.partitionBy(*IMAGE, "x").orderBy("_ky").rangeBetween(-1, 1)
    p = p.withColumn("_a", F.min("value").over(row))
    p = p.withColumn("_b", F.min("_a").over(column))
    p = p.withColumn("_c", F.max("_b").over(column))
    p = p.withColumn("_d", F.max("_c").over(row))
    cleaned = p.select(
        *IMAGE, "y", "x",
        F.when(F.col("radius_px") > 0, F.col("value") - F.col("_d")).otherwise(F.col("value")).alias("value"),
    )
    return cleaned.unionByName(pixels.filter(F.col("channel").isin(*skip)).select(*cleaned.columns))


# --- C2, C3 ---------------------------------------------------------------


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 256) -> DataFrame:
    """Equal-width counts over each group's own range; the last bin is closed.

    Adds ``lo``/``hi``; a flat group has lo = hi and a single bin.
    """
    d = attach_stats(
        df.filter(F.col(value).isNotNull()).select(*keys, value), keys, F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    span = F.col("hi") - F.col("lo")
    b = F.when(span > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / span * bins))).otherwise(0)
    return d.groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )


def otsu_threshold(df: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 256) -> DataFrame:
    """Between-class-variance maximum per group: (keys, threshold, flat, top).

    Flat groups get a NULL threshold. Moments are kept in bin units, so they are exact integers
    and ties resolve to the first bin.
    """
    h = histogram(df, keys, value, bins)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumns({
        "w1": F.sum("n").over(upto), "s1": F.sum(F.col("n") * F.col("bin")).over(upto),
        "w2": F.sum("n").over(after), "s2": F.sum(F.col("n") * F.col("bin")).over(after),
    })
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    h = h.withColumn("between", F.col("w1").cast("double") * F.col("w2") * gap * gap)
    centre = F.col("lo") + (F.col("bin") + F.lit(0.5)) * ((F.col("hi") - F.col("lo")) / bins)
    return h.groupBy(*keys).agg(
        F.max_by(F.when(F.col("lo") < F.col("hi"), centre), F.struct(F.coalesce("between", F.lit(-1.0)), -F.col("bin"))).alias("threshold"),
        (F.max("lo") == F.max("hi")).alias("flat"),
        F.max("hi").alias("top"),
    )


def level_threshold(df: DataFrame, keys: Sequence[str], method: str, value: str = "value",
                    percentile: float = 75.0, fixed: float = 50.0) -> DataFrame:
    """Coverage alternatives: exact linear percentile or a fixed level."""
    if method == "percentile":
        return quantiles(df, keys, value, {"threshold": percentile / 100.0})
    if method == "fixed":
        return df.select(*keys).distinct().withColumn("threshold", F.lit(float(fixed)))
    raise ValueError(f"unknown threshold method {method}")


# --- C4, C5, C19: boundaries, rings, interiors ------------------------------


def adjacency(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Every mask pixel and every pixel 4-adjacent to the mask, per region.

    Columns: keys, y, x, ``inside`` and ``nbrs`` (how many 4-neighbours are in the region).
    One exchange: each pixel is scattered to itself and its four neighbours.
    """
    spots = F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(dy == 0 and dx == 0).alias("me"))
        for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    ])
    return mask.select(*keys, F.inline(spots)).groupBy(*keys, "y", "x").agg(
        F.max("me").alias("inside"), F.count_if(~F.col("me")).alias("nbrs")
    )


def boundary(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Region pixels with a 4-neighbour outside the region."""
    return adjacency(mask, keys).filter(F.col("inside") & (F.col("nbrs") < 4)).select(*keys, "y", "x")


def shell(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Pixels just outside the region (positions off the image included)."""
    return adjacency(mask, keys).filter(~F.col("inside")).select(*keys, "y", "x")


def _diamond(k: Column) -> Column:
    """Array of offsets (dy, dx) with |dy| + |dx| <= k."""
    reach = lambda dy: F.transform(
        F.sequence(F.abs(dy) - k, k - F.abs(dy)), lambda dx: F.struct(dy.alias("dy"), dx.alias("dx"))
    )
    return F.flatten(F.transform(F.sequence(-k, k), reach))


def spread(points: DataFrame, k: Column, keys: Sequence[str] = CELL) -> DataFrame:
    """Distinct positions within city-block distance ``k`` of the points."""
    d = points.withColumn("_o", F.explode(_diamond(k.cast("int"))))
    return d.select(
        *keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")
    ).distinct()


def ring_width(areas: DataFrame, floor_px: Column, adaptive: bool = True, fixed_px: int = 10) -> DataFrame:
    """Adds ``ring_px``: a tenth of the equivalent diameter, at least ``floor_px``."""
    if not adaptive:
        return areas.withColumn("ring_px", F.lit(fixed_px))
    diameter = F.sqrt(F.lit(4.0) * F.col("area") / F.lit(3.141592653589793))
    return areas.withColumn("ring_px", F.greatest(floor_px, half_even(F.lit(0.1) * diameter)))


def dilation_ring(mask: DataFrame, width: DataFrame, fields: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Pixels within ``ring_px`` of the region but outside it, clipped to the image.

    Only boundary pixels are spread, so the work follows the outline, not the area. Tables of pixels are never broadcast.
    """
    grown = spread(boundary(mask, keys).hint("merge").join(width.select(*keys, "ring_px"), list(keys)), F.col("ring_px"), keys)
    clipped = grown.join(fields.select("field_id", "height", "width"), "field_id").filter(
        (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    ).drop("height", "width")
    return clipped.join(mask.select(*keys, "y", "x").hint("merge"), [*keys, "y", "x"], "left_anti")


def eroded(mask: DataFrame, depth: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Region pixels farther than ``depth_px`` from anything outside (the image border counts as outside).

    What a shell pixel wears away is one stretch per image line. Along a line, a region pixel stays if as many stretches have ended as begun.
    """
    k, dy = F.col("depth_px").cast("int"), F.col("_dy")
    worn = shell(mask, keys).hint("merge").join(depth.select(*keys, "depth_px"), list(keys)).withColumn("_dy", F.explode(F.sequence(-k, k)))
    reach = k - F.abs(dy)
    worn = worn.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") - reach).alias("_a"), (F.col("x") + reach + 1).alias("_b"))
    ends = F.array(F.struct(F.col("_a").alias("x"), F.lit(1).alias("_n")), F.struct(F.col("_b").alias("x"), F.lit(-1).alias("_n")))
    steps = worn.select(*keys, "y", F.inline(ends)).groupBy(*keys, "y", "x").agg(F.sum("_n").cast("int").alias("_n"))
    others = [c for c in mask.columns if c not in (*keys, "y", "x")]
    rows = mask.withColumns({"_n": F.lit(0), "_own": F.lit(True)}).unionByName(steps.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    line = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n", F.sum("_n").over(line)).filter(F.col("_own") & (F.col("_n") == 0)).select(*keys, "y", "x", *others)


def interior(mask: DataFrame, width: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Erosion by half the ring width (at least 1); regions worn away entirely keep all pixels."""
    depth = width.select(*keys, F.greatest(F.lit(1), F.floor(F.col("ring_px") / 2).cast("int")).alias("depth_px"))
    core = eroded(mask, depth, keys)
    lost = mask.select(*keys).distinct().join(core.select(*keys).distinct(), list(keys), "left_anti")
    return core.unionByName(mask.join(lost, list(keys), "left_semi"))


# --- C6, C7: connected components -------------------------------------------


def _row_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "y").orderBy("x")
    runs = mask.select(*keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("_g"))
    return runs.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g").withColumn(
        "run", F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("x0").cast("bigint")
    )


def star_components(edges: DataFrame, keys: Sequence[str], max_rounds: int = 60) -> DataFrame:
    """(keys, v, root) for every vertex of ``edges(keys, u, v)``; root is the smallest vertex.

    Alternating large-star and small-star contraction: O(log n) rounds whatever the diameter.
    The minimum of a neighbourhood is aggregated and joined back, so a hub vertex is never
    gathered into one task.
    """
    keys = list(keys)

    def nearest(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        return pairs.join(low, [*keys, "u"]).withColumn("_m", F.least("_m", "u"))

    e = pin(edges.filter(F.col("u") != F.col("v")).select(
        *keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = nearest(both).filter(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        near = nearest(large)
        small = near.select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            near.select(*keys, "u", F.col("_m").alias("v")))
        e = pin(small.filter(F.col("u") != F.col("v")).distinct())
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row["n"], row["h"]):
            # u -> root pairs; roots themselves appear only on the right
            return e.select(*keys, F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
                e.select(*keys, "v", F.col("v").alias("root")).distinct())
        mark = (row["n"], row["h"])
    raise RuntimeError("connected components did not converge")


# Most runs of a region whose components are found in one group.
GROUP_RUNS = 65_536


def _joined_runs(touch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``star_components`` of regions of bounded size, each in one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        u, v = at.reshape(-1, 2).T
        root = np.arange(names.size)
        while True:
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            # the roots learn as well, so that long chains close in few passes
            np.minimum.at(low, root, low.copy())
            low = low[low]
            if (low == root).all():
                return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "v": names, "root": names[root]})
            root = low

    schema = StructType([*(touch.schema[k] for k in keys), StructField("v", LongType()), StructField("root", LongType())])
    return touch.groupBy(*keys).applyInPandas(run, schema)


def components(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """8-connected components of a mask: (keys, y, x, component), numbered by first pixel in scan order.

    Pixels are first compressed to horizontal runs; touching runs of adjacent rows are found by
    an equi-join on (row, 64-pixel column band). Regions of at most ``GROUP_RUNS`` runs are joined in one group each, larger ones
    are contracted in rounds.
    """
    keys = list(keys)
    runs = pin(_row_runs(mask, keys))
    band = lambda a, b: F.explode(F.sequence(F.floor(a / TILE), F.floor(b / TILE)))
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"),
                     F.col("run").alias("u"), band(F.col("x0") - 1, F.col("x1") + 1).alias("_band"))
    down = runs.select(*keys, "y", "x0", "x1", F.col("run").alias("v"), band(F.col("x0"), F.col("x1")).alias("_band"))
    touch = up.join(down, [*keys, "y", "_band"]).filter(
        (F.col("x0") <= F.col("a1") + 1) & (F.col("x1") >= F.col("a0") - 1)
    ).select(*keys, "u", "v")
    sizes = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > GROUP_RUNS).drop("_n")
    if large.isEmpty():
        roots = _joined_runs(touch, keys)
    else:
        large = pin(large)
        roots = _joined_runs(touch.join(large, keys, "left_anti"), keys).unionByName(star_components(touch.join(large, keys, "left_semi"), keys))
    roots = roots.select(*keys, F.col("v").alias("run"), "root")
    named = runs.join(roots, [*keys, "run"], "left").withColumn("component", F.coalesce("root", "run"))
    return named.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def size_filter(comp: DataFrame, keys: Sequence[str], lo: Column, hi: Column | None = None) -> DataFrame:
    """Keep components whose pixel count lies in [lo, hi]; bounds may be columns of ``comp``."""
    sized = attach_stats(comp, [*keys, "component"], F.count(F.lit(1)).alias("size"))
    keep = F.col("size") >= lo
    return sized.filter(keep if hi is None else keep & (F.col("size") <= hi))


# --- C8 -------------------------------------------------------------------

_STEP = 1 << 20
_NEVER = np.iinfo(np.int64).max


def _flood_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Flood one tile (plus the halo rows of its neighbours) to its local fixed point."""
    y0, x0 = pdf["y"].min(), pdf["x"].min()
    shape = (pdf["y"].max() - y0 + 3, pdf["x"].max() - x0 + 3)
    at = (pdf["y"].to_numpy() - y0 + 1, pdf["x"].to_numpy() - x0 + 1)
    grid = lambda name, fill: np.full(shape, fill, dtype=np.int64)
    time, label, lvl, free = grid("t", _NEVER), grid("l", _NEVER), grid("v", 0), np.zeros(shape, bool)
    time[at], label[at], lvl[at] = pdf["t"], pdf["label"], pdf["lvl"]
    free[at] = (pdf["own"] & ~pdf["seed"]).to_numpy()
    label[free] = _NEVER
    shifts = ((0, 1), (0, -1), (1, 1), (1, -1))

    def arrivals() -> list[np.ndarray]:
        out = []
        for axis, by in shifts:
            t = np.roll(time, by, axis)
            step = np.where(t // _STEP >= lvl, t + 1, lvl * _STEP + 1)
            out.append(np.where(t == _NEVER, _NEVER, step))
        return out

    while True:
        best = np.where(free, np.minimum(time, np.minimum.reduce(arrivals())), time)
        if (best == time).all():
            break
        time = best
    reach = arrivals()
    while True:
        offers = [np.where(r == time, np.roll(label, by, axis), _NEVER) for r, (axis, by) in zip(reach, shifts)]
        best = np.where(free & (time < _NEVER), np.minimum.reduce(offers), label)
        if (best == label).all():
            break
        label = best
    out = pdf.assign(t=time[at], label=label[at])
    return out[out["own"]]


def seeded_growth(signal: DataFrame, seeds: DataFrame, levels: int = 16, tile: int = TILE, max_rounds: int = 200) -> DataFrame:
    """Level-ordered flooding from seeds over pixels with signal > 0, bright levels first.

    ``signal(field_id, y, x, value)`` with value in [0, 1], ``seeds(field_id, y, x, label)``.
    A pixel's flood time is (darkest level on the way, steps since that level was entered); it
    takes the label of the neighbour that floods it, the lowest label on ties. Approximates a
    watershed of the negated signal at ``levels`` grey levels.

    Each round floods fixed-size tiles to their local fixed point, then neighbouring tiles swap
    one-pixel halos; rounds follow the number of tiles a flood crosses, not its pixel length.
    """
    lvl = (F.lit(levels) - F.ceil(F.least(F.lit(1.0), F.col("value")) * levels)).cast("long")
    base = signal.filter(F.col("value") > 0).select("field_id", "y", "x", lvl.alias("lvl")).join(
        seeds.select("field_id", "y", "x", F.col("label").cast("long").alias("_s")), ["field_id", "y", "x"], "left")
    fresh = F.lit(_NEVER)
    state = base.select(
        "field_id", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"),
        "y", "x", "lvl", F.col("_s").isNotNull().alias("seed"), F.lit(True).alias("own"),
        F.when(F.col("_s").isNotNull(), F.lit(-_STEP)).otherwise(fresh).alias("t"), F.coalesce("_s", fresh).alias("label"))
    state = pin(state)
    mark = None
    for _ in range(max_rounds):
        py, px = F.pmod("y", F.lit(tile)), F.pmod("x", F.lit(tile))
        to = F.array_compact(F.array(
            F.when(py == 0, F.struct((F.col("ty") - 1).alias("ty"), F.col("tx").alias("tx"))),
            F.when(py == tile - 1, F.struct((F.col("ty") + 1).alias("ty"), F.col("tx").alias("tx"))),
            F.when(px == 0, F.struct(F.col("ty").alias("ty"), (F.col("tx") - 1).alias("tx"))),
            F.when(px == tile - 1, F.struct(F.col("ty").alias("ty"), (F.col("tx") + 1).alias("tx")))))
        halo = state.filter(F.col("t") < fresh).select(
            "field_id", F.inline(to), "y", "x", "lvl", "seed", F.lit(False).alias("own"), "t", "label")
        grown = state.unionByName(halo).groupBy("field_id", "ty", "tx").applyInPandas(_flood_tile, state.schema)
        state = pin(grown)
        row = state.agg(F.sum(F.xxhash64("field_id", "y", "x", "t", "label").cast("decimal(38,0)")).alias("h")).first()
        if mark == row["h"]:
            return state.filter(F.col("label") < fresh).select("field_id", "y", "x", F.col("label").cast("int").alias("label"))
        mark = row["h"]
    raise RuntimeError("seeded growth did not converge")


# --- C9, C10, C11 -----------------------------------------------------------


def match_nuclei(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """Nucleus -> id of the cell under its rounded centroid; nuclei over background are dropped."""
    c = nuclei.groupBy("field_id", "nucleus_id").agg(half_even(F.avg("y")).alias("y"), half_even(F.avg("x")).alias("x"))
    return c.join(cells.select("field_id", "y", "x", "cell_id"), ["field_id", "y", "x"]).select(
        "field_id", "nucleus_id", "cell_id", "y", "x")


def select_candidate_mask(areas: DataFrame, fields: DataFrame, incumbent: int = 0) -> DataFrame:
    """Low-count retry. ``areas(field_id, candidate, cell_id, area)``; side = longer image side.

    The incumbent stays unless it has fewer than max(5, area//200^2) cells and another candidate
    has strictly more cells with an equivalent diameter in [.05, .5] of the side, reaching the minimum.
    """
    f = fields.withColumn("side", F.greatest("height", "width")).withColumn(
        "min_cells", F.greatest(F.lit(5), F.floor(F.col("height") * F.col("width") / 40000).cast("int")))
    d = areas.join(f.select("field_id", "side", "min_cells"), "field_id")
    diameter = F.sqrt(F.lit(4.0) * F.col("area") / F.lit(3.141592653589793))
    fits = (diameter >= F.lit(0.05) * F.col("side")) & (diameter <= F.lit(0.5) * F.col("side"))
    per = d.groupBy("field_id", "candidate").agg(
        F.count_if(fits).alias("in_band"), F.count(F.lit(1)).alias("n"), F.max("min_cells").alias("min_cells"))
    best = F.max_by("candidate", F.struct("in_band", -F.col("candidate")))
    out = per.groupBy("field_id").agg(
        F.max("min_cells").alias("min_cells"),
        F.coalesce(F.max(F.when(F.col("candidate") == incumbent, F.col("n"))), F.lit(0)).alias("incumbent_cells"),
        best.alias("best"), F.max("in_band").alias("best_cells"))
    swap = (F.col("incumbent_cells") < F.col("min_cells")) & (F.col("best_cells") >= F.col("min_cells"))
    return out.select("field_id", "min_cells", "incumbent_cells", "best_cells",
                      F.when(swap, F.col("best")).otherwise(F.lit(incumbent)).alias("chosen"))


def edge_distance(points: DataFrame, mask: DataFrame, fields: DataFrame) -> DataFrame:
    """Euclidean distance from (field_id, cell_id, cy, cx) to the nearest in-image pixel outside the cell.

    Zero if the rounded centroid itself lies outside. The image border is not an edge.
    """
    keyed = points.withColumns({"y": half_even(F.col("cy")), "x": half_even(F.col("cx"))})
    edge = shell(mask).join(fields.select("field_id", "height", "width"), "field_id").filter(
        (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    ).select(*CELL, F.col("y").alias("ey"), F.col("x").alias("ex"))
    d2 = (F.col("ey") - F.col("y")) * (F.col("ey") - F.col("y")) + (F.col("ex") - F.col("x")) * (F.col("ex") - F.col("x"))
    near = keyed.select(*CELL, "y", "x").distinct().join(edge, CELL, "left").groupBy(*CELL, "y", "x").agg(
        F.sqrt(F.min(d2).cast("double")).alias("_d"))
    here = mask.select(*CELL, "y", "x").distinct().withColumn("_in", F.lit(True))
    out = keyed.join(near, [*CELL, "y", "x"]).join(here, [*CELL, "y", "x"], "left")
    return out.withColumn("edge_distance", F.when(F.col("_in"), F.col("_d")).otherwise(F.lit(0.0))).drop("y", "x", "_d", "_in")


# --- C12 ------------------------------------------------------------------


_TENSOR = ["arr", "arc", "acc"]


def _smooth_lines(reach: int):
    """Gaussian of the arrays of a line, mirrored at both ends by ``reach`` positions (edge repeated); NULLs count as 0 and stay NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigma = b["sigma_px"].to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(b["_a"].value_lengths().to_numpy())]
            at = b["_a"].flatten().to_numpy()
            flat = [b[c].flatten() for c in _TENSOR]
            v = np.stack([f.fill_null(0.0).to_numpy() for f in flat])
            out = np.empty_like(v)
            for s, lo, hi in zip(sigma, starts[:-1], starts[1:]):
                x, line = at[lo:hi], v[:, lo:hi]
                left, right = line[:, x < reach][:, ::-1], line[:, x > x[-1] - reach][:, ::-1]
                wide = np.concatenate([np.zeros((3, reach)), left, line, right, np.zeros((3, reach))], axis=1)
                p, n = reach + left.shape[1], hi - lo
                acc, total = line * 1.0, 1.0
                for j in range(1, min(reach, int(4.0 * s + 0.5)) + 1):
                    weight = math.exp(-(j * j / 2.0) / (s * s))
                    acc = acc + weight * (wide[:, p - j:p - j + n] + wide[:, p + j:p + j + n])
                    total = total + 2 * weight
                out[:, lo:hi] = acc / total
            offsets = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(o, mask=f.is_null().to_numpy(zero_copy_only=False))) for o, f in zip(out, flat)]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([lists[_TENSOR.index(c)] if c in _TENSOR else b[c] for c in names], names)

    return run


def structure_tensor(pixels: DataFrame, sigma: DataFrame, max_sigma: float) -> DataFrame:
    """Smoothed products of Sobel derivatives: (field_id, channel, y, x, arr, arc, acc).

    ``sigma(field_id, sigma_px)``. Both filters are separable: the derivatives are one window pass along rows and one along
    columns, the smoothing takes whole columns, then whole rows, as arrays in Arrow batches.
    """
    row, column = [*IMAGE, "y"], [*IMAGE, "x"]
    wr, wc = Window.partitionBy(*row).orderBy("x"), Window.partitionBy(*column).orderBy("y")
    prev = lambda c, w: F.coalesce(F.lag(c, 1).over(w), F.col(c))
    nxt = lambda c, w: F.coalesce(F.lead(c, 1).over(w), F.col(c))
    p = pixels.join(sigma, "field_id").withColumns({
        "_dx": nxt("value", wr) - prev("value", wr),
        "_sx": prev("value", wr) + 2 * F.col("value") + nxt("value", wr),
    })
    p = p.withColumns({
        "_gc": prev("_dx", wc) + 2 * F.col("_dx") + nxt("_dx", wc),
        "_gr": nxt("_sx", wc) - prev("_sx", wc),
    })
    p = p.select(*IMAGE, "y", "x", "sigma_px",
                 (F.col("_gr") * F.col("_gr")).alias("arr"), (F.col("_gr") * F.col("_gc")).alias("arc"),
                 (F.col("_gc") * F.col("_gc")).alias("acc"))
    reach = int(4.0 * max_sigma + 0.5)
    for axis, keys in (("y", column), ("x", row)):
        lines = p.groupBy(*keys, "sigma_px").agg(F.array_sort(F.collect_list(F.struct(axis, *_TENSOR))).alias("_l"))
        lines = lines.select(*keys, "sigma_px", F.col(f"_l.{axis}").alias("_a"), *[F.col(f"_l.{c}").alias(c) for c in _TENSOR])
        done = lines.mapInArrow(_smooth_lines(reach), lines.schema)
        p = done.select(*keys, "sigma_px", F.inline(F.arrays_zip(F.col("_a").alias(axis), *_TENSOR)))
    p = p.select(*IMAGE, "y", "x", "sigma_px", *_TENSOR)
    return p.drop("sigma_px")


def fibre_features(tensor: DataFrame, mask: DataFrame) -> DataFrame:
    """Per cell: mean coherence in [0, 1] and dominant fibre angle in degrees, (-90, 90]."""
    half = (F.col("arr") + F.col("acc")) / 2
    root = F.sqrt(((F.col("arr") - F.col("acc")) / 2) ** 2 + F.col("arc") ** 2)
    l1, l2 = half + root, half - root
    d = tensor.join(mask.select(*CELL, "y", "x"), ["field_id", "y", "x"])
    g = d.groupBy(*CELL).agg(
        F.avg((l1 - l2) / (l1 + l2 + F.lit(1e-12))).alias("_c"),
        F.avg("arc").alias("_rc"), F.avg(F.col("arr") - F.col("acc")).alias("_d"))
    angle = F.degrees(F.lit(0.5) * F.atan2(2 * F.col("_rc"), F.col("_d"))) + 90.0
    return g.select(*CELL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c"))).alias("coherence"),
                    F.when(angle > 90.0, angle - 180.0).otherwise(angle).alias("orientation_deg"))


# --- boxes ------------------------------------------------------------------


def bounding_boxes(mask: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return mask.groupBy(*keys).agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels inside closed boxes of the same field, as an equi-join on (field, tile row, tile column)."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    b = boxes.withColumn("_ty", F.explode(span("y0", "y1"))).withColumn("_tx", F.explode(span("x0", "x1")))
    p = pixels.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    return p.join(b, ["field_id", "_ty", "_tx"]).filter(
        F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    ).drop("_ty", "_tx")


# --- C13 ------------------------------------------------------------------

# Co-occurrence offsets (dy, dx) and how many of the 12 (distance, angle) pairs use them.
GLCM_OFFSETS = [
    (0, 1, 1), (1, 1, 2), (1, 0, 1), (1, -1, 2), (0, 2, 1), (2, 0, 1), (0, 4, 1), (3, 3, 1), (4, 0, 1), (3, -3, 1),
]


def _count_pairs(levels: int):
    """Rows of grey levels with the four rows below them -> (cell, offset, i, j, n), counted per batch."""
    reach = max(abs(dx) for _, dx, _ in GLCM_OFFSETS)
    below = sorted({dy for dy, _, _ in GLCM_OFFSETS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at:at + 512] for b in batches for at in range(0, len(b), 512)):
            size = np.fromiter(map(len, pdf["r0"]), np.int64, len(pdf))
            # rows lie behind one another, with a margin of missing pixels as wide as the largest shift
            start = np.cumsum(size + reach) - size
            lines = {}
            for dy in below:
                lines[dy] = np.full(int(start[-1] + size[-1]) + reach, -1, np.int64)
                for at, k, row in zip(start, size, pdf[f"r{dy}"], strict=True):
                    if row is not None:
                        lines[dy][at:at + k] = row
            cell, names = pd.factorize(pd.MultiIndex.from_frame(pdf[CELL]))
            owner = np.zeros(lines[0].size, np.int64)
            owner[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(cell, size)
            at = np.flatnonzero(lines[0] >= 0)
            found = []
            for k, (dy, dx, _) in enumerate(GLCM_OFFSETS):
                u, v = lines[0][at], lines[dy][at + dx]
                ok = v >= 0
                u, v = u[ok], v[ok]
                found.append(((owner[at[ok]] * len(GLCM_OFFSETS) + k) * levels + np.minimum(u, v)) * levels + np.maximum(u, v))
            code, n = np.unique(np.concatenate(found), return_counts=True)
            code, j = np.divmod(code, levels)
            code, i = np.divmod(code, levels)
            code, k = np.divmod(code, len(GLCM_OFFSETS))
            out = names.take(code).to_frame(index=False, name=CELL)
            yield out.assign(offset=k.astype("int32"), i=i.astype("int32"), j=j.astype("int32"), n=n)

    return run


def glcm_texture(pixels: DataFrame, ring: DataFrame, levels: int = 16, min_pixels: int = 100) -> DataFrame:
    """Co-occurrence contrast, homogeneity, correlation and energy over the ring's bounding box.

    ``pixels`` is one channel, whose values ``ring`` may have already. Grey levels come from the ring's own range; box pixels outside the
    ring take part. Repeated offsets are counted once with their multiplicity.

    A box row is one array of grey levels (-1 where a pixel is missing or NULL; of a repeated pixel the lowest level counts);
    it meets the rows up to four below it in a window, and the pairs are counted inside the arrays.
    """
    values = ring if "value" in ring.columns else ring.join(pixels, ["field_id", "y", "x"])
    stats = values.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    ).filter((F.col("n") >= min_pixels) & (F.col("hi") > F.col("lo")))
    q = F.bround((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1), 0)
    patch = pixels_in_boxes(pixels, stats).filter(F.col("value").isNotNull()).select(
        *CELL, "y", (F.col("x") - F.col("x0")).cast("int").alias("x"), (F.col("x1") - F.col("x0") + 1).cast("int").alias("_n"),
        F.greatest(F.lit(0), F.least(F.lit(levels - 1), q)).cast("int").alias("g"))
    rows = patch.groupBy(*CELL, "y", "_n").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("_s"))
    gap = lambda n: F.array_repeat(F.lit(-1), n)

    def filled(e: Column, k: Column) -> Column:
        before = F.coalesce(F.get("_s", k - 1)["x"], F.lit(-1))
        return F.when(e["x"] > before, F.concat(gap(e["x"] - before - 1), F.array(e["g"]))).otherwise(gap(F.lit(0)))

    last = F.element_at("_s", -1)["x"]
    rows = rows.select(*CELL, "y", F.concat(F.flatten(F.transform("_s", filled)), gap(F.col("_n") - last - 1)).cast("array<smallint>").alias("r0"))
    w = Window.partitionBy(*CELL).orderBy("y")
    rows = rows.withColumns({f"r{dy}": F.first("r0").over(w.rangeBetween(dy, dy)) for dy in sorted({d for d, _, _ in GLCM_OFFSETS} - {0})})
    schema = StructType([*(rows.schema[c] for c in CELL), *(StructField(c, IntegerType()) for c in ("offset", "i", "j")), StructField("n", LongType())])
    multiplicity = F.element_at(F.array(*[F.lit(m) for _, _, m in GLCM_OFFSETS]), F.col("offset") + 1)
    counts = rows.drop("y").mapInPandas(_count_pairs(levels), schema).withColumn("weight", multiplicity)
    pairs = counts.groupBy(*CELL, "offset", "weight", "i", "j").agg(F.sum("n").alias("n"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    diff = (i - j) * (i - j)
    per = pairs.groupBy(*CELL, "offset", "weight").agg(
        F.sum(n).alias("t"), F.sum(n * diff).alias("_c"), F.sum(n / (1 + diff)).alias("_h"),
        F.sum(n * (i + j)).alias("_s"), F.sum(n * (i * i + j * j)).alias("_q"), F.sum(n * 2 * i * j).alias("_x"),
        F.sum(F.when(i == j, n * n).otherwise(n * n / F.lit(2.0))).alias("_e"))
    t = F.col("t")
    mu = F.col("_s") / (2 * t)
    var = F.col("_q") / (2 * t) - mu * mu
    cov = F.col("_x") / (2 * t) - mu * mu
    per = per.select(*CELL, "weight", (F.col("_c") / t).alias("contrast"), (F.col("_h") / t).alias("homogeneity"),
                     F.when(var > 1e-15, cov / var).otherwise(1.0).alias("correlation"),
                     (F.sqrt(F.col("_e").cast("double")) / t).alias("energy"))
    names = ["contrast", "homogeneity", "correlation", "energy"]
    return per.groupBy(*CELL).agg(*[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in names])


# --- C14 ------------------------------------------------------------------


def moran_on_mask(values: DataFrame, min_pixels: int = 50, keys: Sequence[str] = CELL) -> DataFrame:
    """Moran's I with rook neighbours inside the region. ``values(keys, y, x, value)``."""
    d = attach_stats(values.select(*keys, "y", "x", "value"), keys, F.avg("value").alias("_mean"))
    z = F.col("value") - F.col("_mean")
    spots = F.array(
        F.struct(F.col("y").alias("y"), F.col("x").alias("x"), z.alias("me"), F.lit(None).cast("double").alias("nb")),
        F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x"), F.lit(None).cast("double").alias("me"), z.alias("nb")),
        F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x"), F.lit(None).cast("double").alias("me"), z.alias("nb")))
    met = d.select(*keys, F.inline(spots)).groupBy(*keys, "y", "x").agg(
        F.max("me").alias("me"), F.sum("nb").alias("nb"), F.count("nb").alias("k")).filter(F.col("me").isNotNull())
    g = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (2 * F.sum(F.col("me") * F.col("nb"))).alias("cross"),
        (2 * F.sum("k")).alias("pairs"), F.sum(F.col("me") * F.col("me")).alias("ss"))
    ok = (F.col("n") >= min_pixels) & (F.col("pairs") > 0) & (F.col("ss") > 0)
    return g.select(*keys, F.when(ok, F.try_divide(F.col("n"), F.col("pairs")) * F.try_divide(F.col("cross"), F.col("ss"))).alias("moran_i"))


# --- C15 ------------------------------------------------------------------


def radial_bins(values: DataFrame, centroids: DataFrame, bins: int = 20) -> DataFrame:
    """Mean value per distance bin from (cy, cx): (field_id, cell_id, bin, mean), empty bins absent.

    Values are dealt by cell once; the largest distances and the bins read the same exchange.
    """
    d = values.repartition(*CELL).join(centroids.select(*CELL, "cy", "cx"), CELL).withColumn(
        "_d", F.sqrt((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2))
    d = attach_stats(d, CELL, F.max("_d").alias("_top")).filter(F.col("_top") > 0)
    b = F.least(F.lit(bins - 1), F.floor(F.col("_d") / F.col("_top") * bins)).cast("int")
    return d.groupBy(*CELL, b.alias("bin")).agg(F.avg("value").alias("mean"))


def radial_profile(binned: DataFrame, bins: int = 20) -> DataFrame:
    """Array form with NULL for empty bins, float precision."""
    at = [F.max(F.when(F.col("bin") == i, F.col("mean"))).cast("float") for i in range(bins)]
    return binned.groupBy(*CELL).agg(F.array(*at).alias("radial_profile"))


# --- C16, C17 ---------------------------------------------------------------


def densest_window(pixels: DataFrame, size: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Top-left corner of the size x size window with the largest sum; first row, then column, on ties."""
    wx = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(0, size - 1)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(0, size - 1)
    s = pixels.withColumns({"_s": F.sum("value").over(wx), "_n": F.count("value").over(wx)}).filter(F.col("_n") == size)
    s = s.withColumns({"_t": F.sum("_s").over(wy), "_m": F.count("_s").over(wy)}).filter(F.col("_m") == size)
    best = s.groupBy(*keys).agg(F.max_by(F.struct("y", "x", "_t"), F.struct("_t", -F.col("y"), -F.col("x"))).alias("_b"))
    return best.select(*keys, F.col("_b.y").alias("y"), F.col("_b.x").alias("x"), F.col("_b._t").alias("total"))


def contrast_stretch(pixels: DataFrame, lo: float = 0.01, hi: float = 0.995, min_span: float = 0.0) -> DataFrame:
    """clip((v - q_lo) / (q_hi - q_lo)) per field and channel; flat images become 0."""
    q = quantiles(pixels, IMAGE, "value", {"_lo": lo, "_hi": hi})
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(float(min_span)))
    v = F.when(span > 0, (F.col("value") - F.col("_lo")) / span).otherwise(0.0)
    return pixels.join(q, IMAGE).select(
        *IMAGE, "y", "x", F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias("value"))


# --- C18 ------------------------------------------------------------------


def cell_crops(pixels: DataFrame, mask: DataFrame, fields: DataFrame, pad: Column, scale: str = "minmax") -> DataFrame:
    """Pixels of each cell's padded box, clipped to the image, in box coordinates (cy, cx).

    ``minmax``: thumbnail 0..255 per crop; ``max``: divided by the crop's own maximum.
    """
    boxes = bounding_boxes(mask).join(fields, "field_id").withColumn("_pad", pad).select(
        *CELL,
        F.greatest(F.lit(0), F.col("y0") - F.col("_pad")).alias("y0"), F.least(F.col("height") - 1, F.col("y1") + F.col("_pad")).alias("y1"),
        F.greatest(F.lit(0), F.col("x0") - F.col("_pad")).alias("x0"), F.least(F.col("width") - 1, F.col("x1") + F.col("_pad")).alias("x1"))
    crop = pixels_in_boxes(pixels, boxes)
    crop = attach_stats(crop, [*CELL, "channel"], F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    if scale == "minmax":
        v = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).otherwise(0.0)
    else:
        v = F.when(F.col("_hi") > 0, F.col("value") / F.col("_hi")).otherwise(F.col("value"))
    return crop.select(*CELL, "channel", (F.col("y") - F.col("y0")).alias("cy"), (F.col("x") - F.col("x0")).alias("cx"), v.alias("value"))


# --- C19, C20, C21 ----------------------------------------------------------


def outlines(mask: DataFrame, max_cells: int = 500) -> DataFrame:
    """Boundary pixels per cell; fields with more than ``max_cells`` cells give one centroid row per cell."""
    per = mask.groupBy(*CELL).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    crowded = per.groupBy("field_id").agg((F.count(F.lit(1)) > max_cells).alias("crowded"))
    line = boundary(mask).join(crowded.filter(~F.col("crowded")), "field_id").select(
        *CELL, F.lit("outline").alias("kind"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    dots = per.join(crowded.filter("crowded"), "field_id").select(
        *CELL, F.lit("centroid").alias("kind"), F.col("cy").alias("y"), F.col("cx").alias("x"))
    return line.unionByName(dots)


def ring_outlines(mask: DataFrame, ring: DataFrame) -> DataFrame:
    """Outer outline of cell+ring and inner outline of the cell."""
    whole = mask.select(*CELL, "y", "x").unionByName(ring.select(*CELL, "y", "x"))
    return boundary(whole).withColumn("kind", F.lit("outer")).unionByName(
        boundary(mask).withColumn("kind", F.lit("inner")))


def axis_segments(shapes: DataFrame, length: float) -> DataFrame:
    """End points of a segment of the given length through the centroid along ``angle`` (radians from x)."""
    dy, dx = F.sin("angle") * (length / 2), F.cos("angle") * (length / 2)
    return shapes.select(*CELL, (F.col("cy") - dy).alias("y_from"), (F.col("cx") - dx).alias("x_from"),
                         (F.col("cy") + dy).alias("y_to"), (F.col("cx") + dx).alias("x_to"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: int = TILE) -> DataFrame:
    """First polygon (by ``ord``) containing each point, even-odd rule.

    ``points(field_id, point_id, px, py)``, ``polygons(field_id, cell_id, ord, vertices array<struct<x,y>>)``.
    Boxes are bucketed by tile so the join stays an equi-join; unmatched points get NULL.
    """
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    g = polygons.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    g = g.withColumn("_ty", F.explode(span("y0", "y1"))).withColumn("_tx", F.explode(span("x0", "x1")))
    p = points.withColumns({"_ty": F.floor(F.col("py") / tile), "_tx": F.floor(F.col("px") / tile)})
    near = p.join(g, ["field_id", "_ty", "_tx"]).filter(
        F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    follow = F.concat(F.slice("vertices", 2, F.size("vertices") - 1), F.slice("vertices", 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["y"] > F.col("py")) != (b["y"] > F.col("py"))
        at = F.when(straddles, (b["x"] - a["x"]) * (F.col("py") - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return F.coalesce(F.col("px") < at, F.lit(False))

    hits = F.size(F.filter(F.zip_with("vertices", follow, crosses), lambda c: c))
    inside = near.filter(hits % 2 == 1).groupBy("field_id", "point_id").agg(F.min_by("cell_id", "ord").alias("cell_id"))
    return points.join(inside, ["field_id", "point_id"], "left").select("field_id", "point_id", "cell_id")
