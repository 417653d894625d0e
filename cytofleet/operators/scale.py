"""Group operations that stay distributed when one key holds a large share of the rows.

* statistics are aggregated (map-side partial sums) and joined back; AQE broadcasts the
  statistics when their measured size is small and splits hot join partitions otherwise;
* top-k uses ``row_number() <= k``, which Spark prunes before the shuffle;
* order statistics and prefix sums first collapse equal values, then either use one plain
  window (when the largest group is measured to be small) or range-bucket each group, so
  that no task sorts a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cytofleet.session import pin

# Largest group that a single window task may sort.
GROUP_LIMIT = 2_000_000
BUCKETS = 256


def attach_stats(df: DataFrame, keys: Sequence[str], *aggs: Column, keep: bool = False) -> DataFrame:
    """Add group aggregates to every row without a per-group window.

    ``keep`` materialises the statistics (one row per group) when the result is read repeatedly.
    Without keys the statistics are a single row.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    stats = pin(stats) if keep else stats
    return df.join(stats, keys) if keys else df.join(F.broadcast(stats))


def evaluated(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer merges adjacent projections, so an expensive column used in many aggregates would
    be evaluated once per use. A one-element generator keeps its result as a value.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def with_panel(df: DataFrame, panel: DataFrame, limit: int = 10_000) -> DataFrame:
    """Every row with every row of a panel (a gene or target list).

    A panel counted at ``limit`` rows or fewer is broadcast; a larger one is joined without a hint.
    """
    small = panel.limit(limit + 1).count() <= limit
    right = panel.withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(right) if small else right, "_k").drop("_k")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def split_small(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups of ``limit`` rows at most, and the rest; None if a count finds no larger group."""
    keys = list(keys)
    large = pin(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys))
    if large.isEmpty():
        return df, None
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def column(table, name: str) -> np.ndarray:
    """A numeric column of an Arrow table as doubles, NULL as NaN."""
    return table.column(name).to_numpy().astype(float)


def schema_of(df: DataFrame, keys: Sequence[str], rest: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keys), *T.StructType.fromDDL(rest)])


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    limit: int | None = None,
) -> DataFrame:
    """Per group, running totals *before* each row by ascending numeric ``order``.

    ``sums`` maps output column to the summed input column. ``order`` is distinct in a group.
    Groups above ``limit`` rows are cut into value ranges; each range is summed by its own
    task and only the per-range totals (at most ``BUCKETS`` per group) are scanned together.
    """
    keys = list(keys)
    if not keys:
        return prefix_sums(df.withColumn("_all", F.lit(1)), ["_all"], order, sums, limit).drop("_all")
    limit = GROUP_LIMIT if limit is None else limit
    df = pin(df)  # measured here and read again below
    if largest_group(df, keys) <= limit:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({o: F.coalesce(F.sum(c).over(w), F.lit(0)) for o, c in sums.items()})
    qs = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = pin(df.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(order, qs, 10 * BUCKETS))).alias("_cuts")
    ))
    placed = df.join(cuts, keys).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    ).drop("_cuts")
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{o}").over(wb), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    w = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({o: F.coalesce(F.sum(c).over(w), F.lit(0)) for o, c in sums.items()})
    out = local.join(base, [*keys, "_b"])
    return out.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums}).drop(
        "_b", *[f"_o_{o}" for o in sums]
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values per group with ``n`` copies, ``before`` smaller rows, average ``rank``."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counts, keys, value, {"before": "n"}, limit).withColumn(
        "rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
    method: str = "linear",
    limit: int | None = None,
) -> DataFrame:
    """Exact quantiles per group by order statistics (never a per-group value buffer).

    ``linear`` interpolates between neighbours, ``nearest`` takes element ``floor(p*(n-1))``.
    """
    keys = list(keys)
    ranked = value_ranks(df, keys, value, limit)
    sized = attach_stats(ranked, keys, F.sum("n").alias("_n"))
    # row index range of a distinct value: before .. before+n-1
    picks = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
        a = F.max(F.when(inside(lo), F.col(value)))
        if method == "nearest":
            picks.append(a.alias(name))
            continue
        b = F.max(F.when(inside(hi), F.col(value)))
        frac = F.max(pos - lo)
        picks.append((a + (b - a) * frac).alias(name))
    return sized.groupBy(*keys).agg(*picks)


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; every feature is widened to double first."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(list(ids), list(features), name, value)
