"""Correlation screens, false-discovery control, two-condition tests, empirical power."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofleet.functions.scalar import P31, mix31, mix31_numpy
from cytofleet.functions.tails import correlation_p_udf, rank_sum_p_udf
from cytofleet.operators.population import summarise
from cytofleet.operators.scale import attach_stats, column, largest_group, prefix_sums, schema_of, split_small, top_k, value_ranks
from cytofleet.schema import present
from cytofleet.session import pin

# Largest rank table (rows) that is broadcast; about 10 MB.
BROADCAST_ROWS = 300_000
# Most rows whose positions and ranks are broadcast for permutations; about 80 MB as a hashed relation.
POSITION_ROWS = 1_000_000
# Most rows of a group that one task permutes; n times a sum of rank products stays inside 64 bits.
PERMUTED_ROWS = 20_000
# Rows of a larger group that stay together, so that a task leaves few sums.
PERMUTED_BLOCK = 4_000

# The two blocks of the screen and the compared features.
BLOCK_A = [
    "glycocalyx_mean_intensity", "glycocalyx_integrated_intensity", "glycocalyx_pericellular_ratio", "glycocalyx_coverage",
    "glycocalyx_heterogeneity", "glycocalyx_shannon_entropy", "glycocalyx_radial_decay_rate", "glycocalyx_haralick_contrast",
    "glycocalyx_haralick_homogeneity", "glycocalyx_haralick_correlation", "glycocalyx_haralick_energy", "glycocalyx_moran_i"]
BLOCK_B = [
    "mechano_score", "yap_nc_ratio_size_corrected", "yap_nuclear_intensity", "fa_density_per_um2", "fa_mature_fraction",
    "fa_total_area_um2", "fa_mean_orientation_alignment", "actin_stress_fiber_coherence", "actin_cortical_ratio",
    "nuclear_aspect_ratio", "nuclear_solidity", "nuclear_to_cell_area_ratio"]
COMPARED = [
    "glycocalyx_mean_intensity", "glycocalyx_pericellular_ratio", "glycocalyx_heterogeneity", "glycocalyx_shannon_entropy",
    "glycocalyx_haralick_contrast", "glycocalyx_moran_i", "yap_nc_ratio_size_corrected", "yap_nuclear_intensity",
    "fa_mature_fraction", "fa_density_per_um2", "actin_stress_fiber_coherence", "actin_cortical_ratio", "mechano_score",
    "nuclear_aspect_ratio", "nuclear_solidity", "cell_area"]


def pair_correlations(df: DataFrame, columns_a: dict[str, Column | dict[str, Column]], columns_b: dict[str, Column | dict[str, Column]],
                      keys: Sequence[str] = (), min_n: int = 2, chunk: int = 7, upper: bool = False) -> DataFrame:
    """Pearson r over pairwise complete rows for every (a, b): (keys, a, b, n, r).

    Rows are fanned out by a and by runs of ``chunk`` partners (which keeps the aggregation within
    code generation) and reduced to sums before the shuffle. A column may be a dict
    ``partner -> Column`` when its values depend on the partner. Columns should be roughly centred.
    Constant sides give NULL. With ``upper``, both sides have the same columns, and runs that lie before a are left out.
    """
    pick = lambda c, other: c[other] if isinstance(c, dict) else c
    runs = [list(columns_b)[i:i + chunk] for i in range(0, len(columns_b), chunk)]
    width = max(len(r) for r in runs)
    none = F.lit(None).cast("double")
    fan = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(g).alias("g"), *[
            (pick(ca, run[j]) if j < len(run) else none).alias(f"x{j}") for j in range(width)], *[
            (pick(columns_b[run[j]], a) if j < len(run) else none).alias(f"y{j}") for j in range(width)])
        for i, (a, ca) in enumerate(columns_a.items()) for g, run in enumerate(runs) if not upper or (g + 1) * chunk > i])
    rows = df.select(*keys, F.inline(fan))
    aggs = []
    for j in range(width):
        both = F.col(f"x{j}").isNotNull() & F.col(f"y{j}").isNotNull()
        x, y = F.when(both, F.col(f"x{j}")), F.when(both, F.col(f"y{j}"))
        aggs += [F.count(x).alias(f"n{j}"), F.sum(x).alias(f"sx{j}"), F.sum(y).alias(f"sy{j}"), F.sum(x * x).alias(f"sxx{j}"), F.sum(y * y).alias(f"syy{j}"),
                 F.sum(x * y).alias(f"sxy{j}"), F.min(x).alias(f"x0{j}"), F.max(x).alias(f"x1{j}"), F.min(y).alias(f"y0{j}"), F.max(y).alias(f"y1{j}")]
    g = rows.groupBy(*keys, "a", "g").agg(*aggs)
    names = F.array(*[F.array(*[F.lit(run[j] if j < len(run) else None).cast("string") for j in range(width)]) for run in runs])
    parts = ("n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1")
    out = F.array(*[F.struct(F.get(F.get(names, F.col("g")), F.lit(j)).alias("b"), *[F.col(f"{s}{j}").alias(s) for s in parts]) for j in range(width)])
    g = g.select(*keys, "a", F.inline(out)).filter("b is not null")
    return pearson(g, [*keys, "a", "b"], min_n)


def pearson(g: DataFrame, keep: Sequence[str], min_n: int = 2) -> DataFrame:
    """(keep, n, r) from the sums of pairs: n, sx, sy, sxx, syy, sxy, and the extremes x0, x1, y0, y1. Constant sides give NULL."""
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx, vy = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    ok = (n >= min_n) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (vx > 0) & (vy > 0)
    r = F.when(ok, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    return g.select(*keep, "n", r.alias("r")).withColumn(
        "r", F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))


def centred(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Subtract group means (keeps later product sums exact enough)."""
    d = attach_stats(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), list(keys), *[F.avg(c).alias(f"{c}@m") for c in columns])
    return d.select(*keys, *[(F.col(c) - F.col(f"{c}@m")).alias(c) for c in columns])


def pair_sums(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, x0, x1, y0, y1) over the complete rows of features i <= j, by place.

    A task sums all pairs as matrix products and leaves one row per pair, so that rows are neither fanned out nor shuffled.
    """
    features = list(features)
    k = len(features)
    i, j = np.triu_indices(k)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)  # of the first feature where the second is there
        for batch in batches:
            there = np.column_stack([batch.column(f).is_valid().to_numpy(zero_copy_only=False) for f in features])
            x = np.column_stack([batch.column(f).fill_null(0.0).to_numpy(zero_copy_only=False) for f in features])
            m = there.astype(float)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
            least, most = np.where(there, x, np.inf), np.where(there, x, -np.inf)
            full = there.all(0)
            low[:, full] = np.minimum(low[:, full], least.min(0, initial=np.inf)[:, None])
            high[:, full] = np.maximum(high[:, full], most.max(0, initial=-np.inf)[:, None])
            for c in np.flatnonzero(~full):
                low[:, c] = np.minimum(low[:, c], least[there[:, c]].min(0, initial=np.inf))
                high[:, c] = np.maximum(high[:, c], most[there[:, c]].max(0, initial=-np.inf))
        sums = [n, sx, sx.T, sxx, sxx.T, sxy, low, high, low.T, high.T]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, *(s[i, j] for s in sums))], names=["i", "j", *names])

    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    parts = wide.mapInArrow(run, ", ".join(["i long", "j long", *[f"{c} double" for c in names]]))
    how = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    g = parts.groupBy("i", "j").agg(*[how.get(c, F.sum)(c).alias(c) for c in names])
    return g.withColumn("n", F.col("n").cast("long"))


def correlation_matrix(cells: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise complete Pearson of all features: one triangle is computed, then mirrored."""
    c = {f: F.col(f) for f in features}
    mid = centred(cells, features, keys)
    if keys:
        place = F.create_map(*[F.lit(x) for f in enumerate(features) for x in reversed(f)])
        half = pair_correlations(mid, c, c, keys, upper=True).filter(place[F.col("a")] <= place[F.col("b")])
    else:
        names = F.array(*[F.lit(f) for f in features])
        g = pair_sums(mid, features).withColumns({"a": F.get(names, F.col("i")), "b": F.get(names, F.col("j"))})
        half = pearson(g, ["a", "b"])
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.withColumn("_p", F.explode(both)).select(*keys, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), "n", "r")


def validity_classes(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """feature -> representative with exactly the same NULL rows (features of one family share NULLs).

    Per row the NULLs form a bit mask; OR-ing, for each feature, the masks of the rows that disagree
    with it leaves one small row for the driver.
    """
    bits = F.lit(0).cast("long")
    for i, f in enumerate(features):
        bits = bits.bitwiseOR(F.when(F.col(f).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    d = df.select(bits.alias("_m"))
    row = d.agg(*[F.bit_or(F.when(F.col("_m").bitwiseAND(F.lit(1 << i)) != 0, F.bitwise_not("_m")).otherwise(F.col("_m"))).alias(f"m{i}") for i in range(len(features))]).first()
    rep = {f: f for f in features}
    for i, a in enumerate(features):
        for j in range(i + 1, len(features)):
            b = features[j]
            if not ((row[f"m{i}"] or 0) >> j) & 1 and rep[b] == b:
                rep[b] = rep[a]
    return rep


def _rank_products(cells: DataFrame, a_cols: Sequence[str], b_cols: Sequence[str], rep: dict[str, str], name: dict[tuple[str, str], str], ranks: DataFrame) -> DataFrame:
    """All pairs (a, b, n, r) of one group from rank tables of bounded size: each task leaves one sum of centred rank products per pair.

    A pair's ranks are taken among its complete rows, so their number, mean and variance follow from the rank tables; only
    the products need the rows, as matrix products per pair of NULL patterns.
    """
    spark = cells.sparkSession
    table = {t: g.sort_values("value") for t, g in ranks.toPandas().groupby("task")}  # BROADCAST_ROWS rows at most
    values, centred_rank, size, square = {}, {}, {}, {}
    for f in {t[0] for t in name}:
        values[f] = np.unique(np.concatenate([table[n]["value"].to_numpy(float) for t, n in name.items() if t[0] == f and n in table] or [np.empty(0)]))
    for t, n in name.items():
        column = np.zeros(max(1, len(values[t[0]])))
        size[t], square[t] = 0, 0.0
        if n in table:
            g = table[n]
            size[t] = int(g["n"].sum())
            mid = g["rank"].to_numpy(float) - (size[t] + 1) / 2
            column[np.searchsorted(values[t[0]], g["value"].to_numpy(float))] = mid
            square[t] = float((g["n"].to_numpy(float) * mid * mid).sum())
        centred_rank[t] = column
    held = spark.sparkContext.broadcast((values, centred_rank))
    groups = [([a for a in a_cols if rep[a] == ra], [b for b in b_cols if rep[b] == rb], ra, rb)
              for ra in sorted({rep[a] for a in a_cols}) for rb in sorted({rep[b] for b in b_cols})]
    features = list(dict.fromkeys([*a_cols, *b_cols]))
    pairs = [(a, b) for many_a, many_b, _, _ in groups for a in many_a for b in many_b]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, centred_rank = held.value
        total = [np.zeros((len(many_a), len(many_b))) for many_a, many_b, _, _ in groups]
        for batch in batches:
            at, there = {}, {}
            for f in features:
                c = batch.column(f)
                there[f] = c.is_valid().to_numpy(zero_copy_only=False)
                v = c.fill_null(0.0).to_numpy(zero_copy_only=False)
                at[f] = np.minimum(np.searchsorted(values[f], v), max(0, len(values[f]) - 1))
            for (many_a, many_b, ra, rb), sums in zip(groups, total, strict=True):
                both = there[ra] & there[rb]
                x = np.stack([centred_rank[a, rb][at[a]] * both for a in many_a])
                y = np.stack([centred_rank[b, ra][at[b]] * both for b in many_b])
                sums += x @ y.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs)), pa.int64()), pa.array(np.concatenate([t.ravel() for t in total]))], names=["i", "p"])

    wide = cells.select(*[F.col(f).cast("double").alias(f) for f in features])
    sums = wide.mapInArrow(products, "i long, p double").groupBy("i").agg(F.sum("p").alias("p"))
    rows = [(i, a, b, size[a, rep[b]], square[a, rep[b]], square[b, rep[a]]) for i, (a, b) in enumerate(pairs)]
    known = spark.createDataFrame(rows, "i long, a string, b string, n long, _x double, _y double")
    r = F.when((F.col("n") >= 5) & (F.col("_x") > 0) & (F.col("_y") > 0), F.try_divide(F.col("p"), F.sqrt("_x") * F.sqrt("_y")))
    return known.join(F.broadcast(sums), "i", "left").select("a", "b", "n", r.alias("r")).withColumn("r", F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))


def correlation_screen(cells: DataFrame, block_a: Sequence[str] = tuple(BLOCK_A), block_b: Sequence[str] = tuple(BLOCK_B),
                       keys: Sequence[str] = (), row_id: Sequence[str] = ("field_id", "cell_id"), method: str = "spearman",
                       limit: int | None = None) -> DataFrame:
    """All (a, b) pairs with n and r; fewer than five complete rows or a constant side give NULL.

    Spearman ranks each feature once per distinct NULL pattern of its partners instead of once per
    pair; ranks come from distinct values and their running counts. Without keys and while all rank tables together stay
    within ``BROADCAST_ROWS`` (measured), tasks look ranks up and leave only sums of products.
    """
    a_cols, b_cols = present(cells, list(block_a)), present(cells, list(block_b))
    if method == "pearson":
        mid = centred(cells, [*a_cols, *b_cols], keys)
        return pair_correlations(mid, {c: F.col(c) for c in a_cols}, {c: F.col(c) for c in b_cols}, keys, 5)
    rep = validity_classes(cells, a_cols + b_cols)
    tasks = sorted({(a, rep[b]) for a in a_cols for b in b_cols} | {(b, rep[a]) for a in a_cols for b in b_cols})
    name = {t: f"t{i}" for i, t in enumerate(tasks)}
    # equal values are counted once per feature and pattern of present partners; the tasks share these counts
    ids = [c for c in row_id if c not in keys]
    cells = cells.select(*keys, *ids, *a_cols, *b_cols)
    classes = sorted(set(rep.values()))
    mask = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(classes)), F.lit(0).cast("long"))
    fan = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("value")) for f in dict.fromkeys([*a_cols, *b_cols])])
    counts = cells.withColumn("_m", mask).select(*keys, "_m", F.inline(fan)).filter(F.col("value").isNotNull())
    counts = pin(counts.groupBy(*keys, "_f", "_m", "value").agg(F.count(F.lit(1)).alias("n")))
    look = F.array(*[F.struct(F.lit(t[0]).alias("_g"), F.lit(1 << classes.index(t[1])).cast("long").alias("_bit"), F.lit(name[t]).alias("task")) for t in tasks])
    per = counts.withColumn("_t", F.explode(F.filter(look, lambda t: (t["_g"] == F.col("_f")) & (F.col("_m").bitwiseAND(t["_bit"]) != 0))))
    per = per.groupBy(*keys, F.col("_t.task").alias("task"), "value").agg(F.sum("n").alias("n"))
    ranks = prefix_sums(per, [*keys, "task"], "value", {"before": "n"}, limit)
    ranks = pin(ranks.select(*keys, "task", "value", "n", (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank")))
    if not keys and ranks.count() <= BROADCAST_ROWS:
        return _rank_products(cells, a_cols, b_cols, rep, name, ranks)
    fan = F.array(*[F.struct(F.lit(name[t]).alias("task"), F.when(F.col(t[1]).isNotNull(), F.col(t[0]).cast("double")).alias("value")) for t in tasks])
    long = cells.select(*keys, *ids, F.inline(fan)).filter(F.col("value").isNotNull())
    # Rank tables are broadcast onto the wide rows, smallest first, as long as all of them together stay within
    # the measured bound; the others are joined by value in long form and gathered per row.
    size = {r["task"]: r["n"] for r in ranks.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    small, held = [], 0
    for t in sorted(tasks, key=lambda t: (size.get(name[t], 0), name[t])):
        held += size.get(name[t], 0)
        if held <= BROADCAST_ROWS:
            small.append(t)
    wide = cells
    for t in small:
        look = F.broadcast(ranks.filter(F.col("task") == name[t]).select(*keys, F.col("value").alias("_v"), F.col("rank").alias(name[t])))
        value = F.when(F.col(t[1]).isNotNull(), F.col(t[0]).cast("double"))
        wide = wide.withColumn("_v", value).join(look, [*keys, "_v"], "left").drop("_v")
    big = [t for t in tasks if t not in small]
    if big:
        part = long.filter(F.col("task").isin([name[t] for t in big])).join(ranks, [*keys, "task", "value"])
        part = part.groupBy(*keys, *ids).agg(*[F.max(F.when(F.col("task") == name[t], F.col("rank"))).alias(name[t]) for t in big])
        wide = wide.join(part, [*keys, *ids], "left")
    # a group whose features are all NULL still reports its pairs
    ca = {a: {b: F.col(name[(a, rep[b])]) for b in b_cols} for a in a_cols}
    cb = {b: {a: F.col(name[(b, rep[a])]) for a in a_cols} for b in b_cols}
    return pair_correlations(wide, ca, cb, keys, 5)


def with_parametric_p(pairs: DataFrame) -> DataFrame:
    """Two-sided p with n-2 degrees of freedom; Python sees the pair table only."""
    known = pairs.filter(F.col("r").isNotNull()).withColumn("p", correlation_p_udf(F.col("r"), F.col("n").cast("double")))
    return known.unionByName(pairs.filter(F.col("r").isNull()).withColumn("p", F.lit(None).cast("double")))


def hash_buckets(df: DataFrame, keys: Sequence[str], rows: int = 500_000) -> int:
    """Power-of-two bucket count that keeps every hash range of the largest group near ``rows`` rows."""
    n = largest_group(df, keys) if keys else df.count()
    return min(1 << 20, 1 << max(0, (n - 1) // rows).bit_length())


def hash_order(df: DataFrame, keys: Sequence[str], hashed: str, tie: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """0-based position of each row by (31-bit hash, tie) within a group.

    Hash values are uniform, so equal hash ranges are equal shares of a group; their number follows
    the measured size of the largest group and no task orders a whole hot group.
    """
    k = hash_buckets(df, keys) if buckets is None else buckets
    d = df.withColumn("_b", F.shiftright(F.col(hashed), 32 - k.bit_length()).cast("int"))
    sizes = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    wl = Window.partitionBy(*keys, "_b").orderBy(hashed, *tie)
    d = d.withColumn("_i", F.row_number().over(wl) - 1).join(base, [*keys, "_b"])
    return d.withColumn(out, F.col("_base") + F.col("_i")).drop("_b", "_i", "_base")


#: Multipliers of the ten rounds of the bijection (fewer leave small groups uneven), scattering and offset inside a round.
ROUND_MULTIPLIERS = (1103515245, 1566083941, 1812433253, 1234567891, 1664525013, 1299709021, 1640531527, 1181783497, 1597334677, 1220703125)
SCATTER, OFFSET = 1103515245, 715827882
#: Walks outside the domain. The space exceeds the domain by less than one side, so a walk from a small domain ends
#: within that many steps for certain; from a large one (side over 64) it goes on with a chance below 1/64 per step.
WALKS = 64


def _mixed(v: Column, add: Column, flip: Column, m: Column) -> Column:
    h = ((v + F.lit(OFFSET)) * m + add) % F.lit(P31)
    h = h.bitwiseXOR(flip) * F.lit(SCATTER) % F.lit(P31)
    return h.bitwiseXOR(add) * m % F.lit(P31)


def permuted_position(df: DataFrame, pos: str, n: str, perm: str, out: str, seed: int = 42) -> DataFrame:
    """Adds the image of a position below ``n`` under the permutation numbered ``perm``.

    A Feistel network with modular addition, a keyed bijection of the numbers below a * b, the smallest near-square at
    or above n, is cut to n by walking the cycle until it is back inside. Only integer arithmetic within the row:
    nothing is sorted or shuffled. The first pass is one projection per half round, so that no half is computed
    twice; the few rows that leave the domain walk on inside one expression.
    """
    a, b, ka, kb = (F.col(c) for c in ("_a", "_b", "_ka", "_kb"))
    rounds = [(F.lit(m1), F.lit(m2)) for m1, m2 in zip(ROUND_MULTIPLIERS[::2], ROUND_MULTIPLIERS[1::2], strict=True)]
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(n).cast("double")))).cast("bigint")
    over = F.col(n) + a - 1
    d = df.withColumns({"_a": side, "_ka": mix31(seed + 1, perm), "_kb": mix31(seed + 2, perm)})
    d = d.withColumn("_b", ((over - over % a) / a).cast("bigint"))
    d = d.withColumn("_l", F.col(pos).cast("bigint") % a)
    d = d.withColumn("_r", ((F.col(pos) - F.col("_l")) / a).cast("bigint"))
    for m1, m2 in rounds:
        d = d.withColumn("_l", (F.col("_l") + _mixed(F.col("_r"), ka, kb, m1)) % a)
        d = d.withColumn("_r", (F.col("_r") + _mixed(F.col("_l"), kb, ka, m2)) % b)
    d = d.withColumn("_x", F.col("_r") * a + F.col("_l"))

    halves = F.array(*[F.struct(m1.alias("m1"), m2.alias("m2")) for m1, m2 in rounds])

    def one_round(s: Column, m: Column) -> Column:
        left = (s["l"] + _mixed(s["r"], ka, kb, m["m1"])) % a
        return F.struct(left.alias("l"), ((s["r"] + _mixed(left, kb, ka, m["m2"])) % b).alias("r"))

    def again(x: Column, _: Column) -> Column:
        start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("bigint").alias("r"))
        return F.when(x < F.col(n), x).otherwise(F.aggregate(halves, start, one_round, lambda s: s["r"] * a + s["l"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("_x"), again)
    d = d.withColumn("_x", F.when(F.col("_x") < F.col(n), F.col("_x")).otherwise(walked))
    lost = F.raise_error(F.lit("a permuted position did not come back into its domain")).cast("bigint")
    # never NULL, so that a join on it adds no filter, which would repeat all rounds below the projections
    return d.withColumn(out, F.coalesce(F.when(F.col("_x") < F.col(n), F.col("_x")).otherwise(lost), F.lit(-1).cast("bigint"))).drop("_a", "_b", "_ka", "_kb", "_l", "_r", "_x")


def permuted_positions(n: int, perm: np.ndarray, seed: int = 42) -> np.ndarray:
    """The images of all positions below ``n`` inside a task, one row per permutation: those of ``permuted_position``.

    A half is moved by a number that follows from the permutation and the other half alone, so these numbers are looked up.
    """
    a = max(1, math.ceil(math.sqrt(n)))
    b = (n + a - 1) // a
    ka, kb = (mix31_numpy(seed + i, perm)[:, None] for i in (1, 2))

    def mixed(v: np.ndarray, add: np.ndarray, flip: np.ndarray, m: int) -> np.ndarray:
        h = ((v + OFFSET) * m + add) % P31
        h = (h ^ flip) * SCATTER % P31
        return (h ^ add) * m % P31

    rounds = list(zip(ROUND_MULTIPLIERS[::2], ROUND_MULTIPLIERS[1::2], strict=True))
    turns = [((mixed(np.arange(b), ka, kb, m1) % a).astype(np.int32).ravel(), (mixed(np.arange(a), kb, ka, m2) % b).astype(np.int32).ravel()) for m1, m2 in rounds]

    def passed(x: np.ndarray, row: np.ndarray) -> np.ndarray:
        right, left = x // a, x % a
        for by_right, by_left in turns:
            left = left + np.take(by_right, row * b + right)
            left -= (left >= a) * np.int32(a)
            right = right + np.take(by_left, row * a + left)
            right -= (right >= b) * np.int32(b)
        return right * a + left

    x = passed(np.arange(n, dtype=np.int32)[None, :], np.arange(len(perm), dtype=np.int32)[:, None])
    while (out := x >= n).any():  # the few that left the domain walk on
        row, at = np.nonzero(out)
        x[row, at] = passed(x[row, at], row)
    return x


def doubled_ranks(v: np.ndarray) -> np.ndarray:
    """Twice the average rank of every value, so that ties stay whole numbers."""
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (2 * np.cumsum(n) - n + 1)[at]


def permutation_p(cells: DataFrame, x: str, y: str, permutations: int, row_keys: Sequence[str], keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Empirical two-sided p of Spearman's rho: (k+1)/(N+1) over keyed bijections of the row positions.

    Rows are ranked and numbered once by hash, those with equal keys by their ranks; each permutation then pairs the x rank of a row with
    the y rank at the permuted position. A group of at most ``PERMUTED_ROWS`` rows does so in one task, so that only its rows
    are shuffled; see ``dealt_permutation_p`` for larger ones. Ranks are kept doubled, so all sums are exact integers. Groups
    with fewer than five complete rows or a constant side get NULL.
    """
    if not keys:
        return permutation_p(cells.withColumn("_all", F.lit(1)), x, y, permutations, row_keys, ["_all"], seed).drop("_all")
    keys, row_keys = list(keys), list(row_keys)
    d = cells.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *row_keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    small, large = split_small(d, keys, PERMUTED_ROWS)
    order = [(c, "ascending") for c in ("_h", *row_keys, "_rx", "_ry")]

    def run(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        for c in "xy":
            t = t.append_column(f"_r{c}", pa.array(doubled_ranks(column(t, f"_{c}"))))
        t = t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_start"))
        n, rx, ry = t.num_rows, column(t, "_rx"), column(t, "_ry")  # sums below 2^53
        away = lambda s: np.abs(n * np.asarray(s, np.int64) - np.int64(rx.sum()) * np.int64(ry.sum()))
        at_once, extreme = max(1, (1 << 16) // n), 0
        for lo in range(1, permutations + 1, at_once):
            perm = np.arange(lo, min(lo + at_once, permutations + 1))
            extreme += int((away(ry[permuted_positions(n, perm, seed)] @ rx) >= away(rx @ ry)).sum())
        ok = n >= 5 and np.ptp(rx) > 0 and np.ptp(ry) > 0
        p = pa.array([(extreme + 1) / (permutations + 1.0) if ok else None], pa.float64())
        return pa.table([*(t.column(c).slice(0, 1) for c in keys), pa.array([n]), pa.array([extreme]), p], [*keys, "n", "extreme", "p"])

    out = small.withColumn("_h", mix31(seed, *row_keys)).groupBy(*keys).applyInArrow(run, schema_of(d, keys, "n long, extreme long, p double"))
    return out if large is None else out.unionByName(dealt_permutation_p(large, permutations, row_keys, keys, seed))


def dealt_permutation_p(d: DataFrame, permutations: int, row_keys: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``permutation_p`` of groups of any size from ``d(keys, row_keys, _x, _y)`` without NULLs.

    Positions meet by one equi-join with partial sums. Below ``POSITION_ROWS`` rows (measured) the positions are broadcast,
    so that only the sums are shuffled, one per permutation and block of ``PERMUTED_BLOCK`` rows; above, rows x permutations are
    dealt by position. Products are summed in two halves, so all sums are exact integers (groups of up to 2^30 rows).
    """
    keys = list(keys)
    twice = (2 * F.col("before") + F.col("n") + 1).cast("bigint")
    rx = value_ranks(d, keys, "_x").select(*keys, "_x", twice.alias("rx"))
    ry = value_ranks(d, keys, "_y").select(*keys, "_y", twice.alias("ry"))
    d = d.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"]).select(*keys, *row_keys, "rx", "ry")
    placed = pin(hash_order(d.withColumn("_h", mix31(seed, *row_keys)), keys, "_h", [*row_keys, "rx", "ry"], "_pos").select(*keys, "_pos", "rx", "ry"))
    product = F.col("rx") * F.col("ry")
    halves = F.sum(F.shiftright(product, 32)).alias("_hi"), F.sum(product.bitwiseAND(F.lit((1 << 32) - 1))).alias("_lo")
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    joined = dec("_hi") * F.lit(1 << 32).cast("decimal(11,0)") + dec("_lo")
    obs = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *halves, F.sum("rx").alias("_sx"), F.sum("ry").alias("_sy"),
        (F.min("rx") < F.max("rx")).alias("_vx"), (F.min("ry") < F.max("ry")).alias("_vy"))
    obs = pin(obs.withColumn("_xy", joined.cast("decimal(38,0)")).drop("_hi", "_lo"))
    rows = placed.count()
    parts = max(d.sparkSession.sparkContext.defaultParallelism, rows * permutations // 4_000_000)
    size = obs.select(*keys, "n")
    left = placed.select(*keys, "_pos", "rx")
    left = left.join(size, keys).repartition(parts, *keys, F.floor(F.col("_pos") / PERMUTED_BLOCK))
    left = left.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    left = permuted_position(left, "_pos", "n", "perm", "_at", seed).select(*keys, "perm", "rx", F.col("_at").alias("_pos"))
    right = placed.select(*keys, F.col("_pos").cast("bigint").alias("_pos"), "ry")
    right = F.broadcast(right) if rows <= POSITION_ROWS else right.hint("shuffle_hash")
    met = left.join(right, [*keys, "_pos"]).groupBy(*keys, "perm").agg(*halves).select(*keys, "perm", joined.cast("decimal(38,0)").alias("_p"))
    j = met.join(obs, keys)
    # |n*sum(xy) - sum(x)*sum(y)| compares |rho| without dividing
    total = dec("_sx") * dec("_sy")
    size = lambda c: F.abs(F.col("n").cast("decimal(19,0)") * F.col(c) - total)
    g = j.groupBy(*keys).agg(F.count_if(size("_p") >= size("_xy")).alias("extreme"), F.max("n").alias("n"), F.first("_vx").alias("_vx"), F.first("_vy").alias("_vy"))
    ok = (F.col("n") >= 5) & F.col("_vx") & F.col("_vy")
    return g.select(*keys, "n", "extreme", F.when(ok, (F.col("extreme") + 1) / F.lit(permutations + 1.0)).alias("p"))


def benjamini_hochberg(pairs: DataFrame, keys: Sequence[str] = (), p: str = "p", tie: Sequence[str] = ("a", "b")) -> DataFrame:
    """Adds ``q`` over one family per key group (the screen: at most |A| x |B| rows); NULL p stays NULL."""
    fam = list(keys)
    known = pairs.filter(F.col(p).isNotNull())
    order = [F.col(p), *[F.col(c) for c in tie]]
    w = Window.partitionBy(*fam).orderBy(*order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*fam))
    tail = Window.partitionBy(*fam).orderBy(F.col("_i")).rowsBetween(0, Window.unboundedFollowing)
    d = known.withColumns({"_i": F.row_number().over(w), "_m": m})
    d = d.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(tail)))).drop("_i", "_m")
    return d.unionByName(pairs.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def screen_headline(screen: DataFrame, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Strongest pair by |r| (first by name on ties), number significant, number tested."""
    best = F.min_by(F.struct("a", "b", "r"), F.struct(-F.abs("r"), F.col("a"), F.col("b")))
    g = screen.filter(F.col("r").isNotNull()).groupBy(*keys).agg(best.alias("_b"), F.count_if(F.col("q") < alpha).alias("n_significant"), F.count("r").alias("n_tested"))
    return g.select(*keys, F.col("_b.a").alias("a"), F.col("_b.b").alias("b"), F.col("_b.r").alias("r"), "n_significant", "n_tested")


# --- E19 .. E21 -------------------------------------------------------------


def compare_conditions(cells: DataFrame, condition: str, a: str, b: str, features: Sequence[str] = tuple(COMPARED), min_n: int = 3) -> DataFrame:
    """Cohen's d, means and percent change per feature; rounding 3, 4 and 1 digits."""
    use = present(cells, list(features))
    s = summarise(cells.filter(F.col(condition).isin(a, b)), [condition], use, {"n": F.count, "m": F.avg, "v": F.var_pop})
    at = lambda c, arm: F.max(F.when(F.col(condition) == arm, F.col(c)))
    g = s.groupBy("feature").agg(*[at(c, arm).alias(f"{c}_{tag}") for c in ("n", "m", "v") for arm, tag in ((a, "a"), (b, "b"))])
    g = g.filter((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    sd = F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    diff = F.col("m_b") - F.col("m_a")
    return g.select(
        "feature", "n_a", "n_b", F.round(F.when(sd > 0, F.try_divide(diff, sd)).otherwise(0.0), 3).alias("cohens_d"),
        F.round("m_a", 4).alias("mean_a"), F.round("m_b", 4).alias("mean_b"),
        F.round(F.when(F.abs("m_a") > 1e-9, diff / F.abs("m_a") * 100).otherwise(0.0), 1).alias("delta_pct"))


def rank_sum(long: DataFrame, arm: str, a: str, keys: Sequence[str], value: str = "value", limit: int | None = None) -> DataFrame:
    """Mann-Whitney U of arm ``a`` against the other arm: (keys, n_a, n_b, u, tie), from distinct values only."""
    keys = list(keys)
    c = long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(F.col(arm) == a).alias("na"), F.count(F.lit(1)).alias("n"))
    c = prefix_sums(c, keys, value, {"before": "n"}, limit)
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    n = F.col("n").cast("double")
    g = c.groupBy(*keys).agg(F.sum("na").alias("n_a"), F.sum(F.col("n") - F.col("na")).alias("n_b"),
                             F.sum(rank * F.col("na")).alias("_r"), F.sum(n * n * n - n).alias("tie"))
    return g.select(*keys, "n_a", "n_b", (F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / F.lit(2.0)).alias("u"), "tie")


def with_rank_sum_p(u: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return u.withColumn("p", rank_sum_p_udf(d("u"), d("n_a"), d("n_b"), d("tie")))


def compare_with_p(cells: DataFrame, condition: str, a: str, b: str, features: Sequence[str] = tuple(COMPARED)) -> DataFrame:
    from cytofleet.operators.scale import unpivot

    use = present(cells, list(features))
    long = unpivot(cells.filter(F.col(condition).isin(a, b)), [condition], use)
    p = with_rank_sum_p(rank_sum(long, condition, a, ["feature"])).select("feature", F.round("p", 6).alias("p_value"))
    return compare_conditions(cells, condition, a, b, features).join(p, "feature")


def top_deltas(effects: DataFrame, k: int = 5) -> DataFrame:
    return effects.orderBy(F.desc(F.abs("cohens_d")), "feature").limit(k)


def capped_samples(cells: DataFrame, condition: str, features: Sequence[str], order: Sequence[str], cap: int = 500) -> DataFrame:
    """First ``cap`` raw values per condition and feature in row order, as arrays (a display sample)."""
    from cytofleet.operators.scale import unpivot

    long = unpivot(cells, [condition, *order], present(cells, list(features))).filter(F.col("value").isNotNull())
    kept = top_k(long, [condition, "feature"], [F.asc(c) for c in order], cap, "_i")
    return kept.groupBy(condition, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda s: s["value"]).alias("values"))


# --- E29 ------------------------------------------------------------------

# Multiplicative effects of the power scan.
EFFECTS = [0.5, 0.67, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0]


def hash_draws(df: DataFrame, row_keys: Sequence[str], k: int, replicates: int, seed: int, margin: float = 6.0) -> DataFrame:
    """The first ``k`` rows by hash order of every replicate, as ``replicate`` and ``_i`` (from 1); fewer if there are fewer rows.

    Hashes are uniform, so a row is kept for a replicate if its hash lies below a limit under which ``k`` rows and
    ``margin`` standard deviations more (one row at least) are expected; the table is read once and never multiplied by the replicates, only about
    k rows each go on. A replicate that came out short is noticed and all are drawn again with twice the limit, so
    the rows are those of a full sort.
    """
    n = df.count()
    # the hashes of one row, compiled; the array of all replicates is made for the few rows that any of them keeps
    lowest = [F.least(*[mix31(seed, F.lit(r), *row_keys) for r in run]) if len(run) > 1 else mix31(seed, F.lit(run[0]), *row_keys)
              for run in (range(i, min(i + 10, replicates + 1)) for i in range(1, replicates + 1, 10))]
    share = max(1.0, k + margin * math.sqrt(k)) / n if n else 1.0
    while True:
        limit = math.ceil(P31 * min(1.0, share))
        tries = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(r.alias("replicate"), mix31(seed, r, *row_keys).alias("_h")))
        some = [low < limit for low in lowest]
        near = df.filter(functools.reduce(lambda a, b: a | b, some)) if some else df
        kept = pin(near.withColumn("_d", F.filter(tries, lambda t: t["_h"] < limit)).select("*", F.inline("_d")).drop("_d"))
        if limit >= P31:
            break
        full = kept.groupBy("replicate").count().filter(F.col("count") >= min(k, n)).count()
        if full == replicates:
            break
        share *= 2
    return top_k(kept, ["replicate"], [F.asc("_h"), *[F.asc(c) for c in row_keys]], k, "_i").drop("_h")


def power_scan(cells: DataFrame, features: Sequence[str], row_keys: Sequence[str], cells_per_arm: int = 50, replicates: int = 30,
               alpha: float = 0.05, seed: int = 42, effects: Sequence[float] = tuple(EFFECTS)) -> DataFrame:
    """Share of replicates rejecting equality per (feature, effect); effect 1 is skipped with power 0.

    Arms are the first and second ``cells_per_arm`` rows by hash order, drawn anew per replicate;
    the treated arm is scaled by the effect.
    """
    from cytofleet.operators.scale import unpivot

    d = hash_draws(cells.select(*row_keys, *features), row_keys, 2 * cells_per_arm, replicates, seed)
    d = d.withColumn("arm", F.when(F.col("_i") <= cells_per_arm, "baseline").otherwise("treated"))
    long = unpivot(d, ["replicate", "arm"], features).filter(F.col("value").isNotNull())
    long = long.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects if e != 1.0])))
    long = long.withColumn("value", F.when(F.col("arm") == "treated", F.col("value") * F.col("effect")).otherwise(F.col("value")))
    # numbers are bounded: replicates x effects x features groups of 2 * cells_per_arm values
    p = with_rank_sum_p(rank_sum(long, "arm", "baseline", ["feature", "effect", "replicate"]))
    ok = (F.col("n_a") >= 5) & (F.col("n_b") >= 5) & (F.col("p") < alpha)
    g = p.groupBy("feature", "effect").agg((F.count_if(ok) / F.lit(float(replicates))).alias("power"))
    none = g.select("feature").distinct().select("feature", F.lit(1.0).alias("effect"), F.lit(0.0).alias("power"))
    return g.unionByName(none)


def min_detectable(power: DataFrame, target: float = 0.8) -> DataFrame:
    """Smallest shift from 1 whose power reaches the target; NULL if none does."""
    hit = F.when((F.col("effect") != 1.0) & (F.col("power") >= target), F.col("effect"))
    shift = F.struct(F.round(F.abs(F.col("effect") - 1.0), 9), F.col("effect"))
    g = power.withColumn("_e", hit).groupBy("feature").agg(F.min_by("_e", F.when(F.col("_e").isNotNull(), shift)).alias("min_detectable_effect"))
    return g.withColumn("min_detectable_pct_shift", F.round(F.abs(F.col("min_detectable_effect") - 1.0) * 100, 6))
