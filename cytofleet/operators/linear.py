"""Least squares for many groups and targets at once from one pass of cross moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def coefficients(m: np.ndarray, p: int) -> np.ndarray | None:
    """Intercept and ``p`` slopes per target, a column each, from the moments of [1, x, y]; None without rows."""
    if m[0, 0] <= 0:
        return None
    a, b = m[: 1 + p, : 1 + p], m[: 1 + p, 1 + p:]
    # centre first: the slopes come from covariances, the intercept from the means
    mx, my = a[0, 1:] / a[0, 0], b[0] / a[0, 0]
    cov = a[1:, 1:] / a[0, 0] - np.outer(mx, mx)
    cxy = b[1:] / a[0, 0] - np.outer(mx, my)
    w = np.linalg.pinv(cov, rcond=1e-10, hermitian=True) @ cxy
    return np.vstack([my - mx @ w, w])


@pandas_udf(ArrayType(DoubleType()))
def _solve(moments: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    """Coefficients (intercept, slopes) per target, flattened, from upper-triangular moments of [1, x, y]."""
    out = []
    for flat, np_, nq in zip(moments, p, q):
        m = np.zeros((1 + np_ + nq,) * 2)
        m[np.triu_indices(len(m))] = flat
        w = coefficients(m + np.triu(m, 1).T, np_)
        out.append(None if w is None else w.T.ravel().tolist())
    return pd.Series(out)


def cross_moments(d: DataFrame, cols: Sequence[str], keys: Sequence[str], out: str = "_m") -> DataFrame:
    """Sums of products of [1, cols...] per group as one flat upper triangle.

    Each row is fanned out once per column and meets only as many running sums as there are columns,
    which keeps the aggregation small enough to be compiled; partial sums leave each task.
    """
    n = len(cols) + 1
    rows = d.select(*keys, *[F.col(c).cast("double").alias(f"_c{j}") for j, c in enumerate(cols, 1)])
    fan = F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(1.0) if i == 0 else F.col(f"_c{i}")).alias("_x")) for i in range(n)])
    rows = rows.select(*keys, *[f"_c{j}" for j in range(1, n)], F.inline(fan))
    sums = [F.sum("_x").alias("_s0"), *[F.sum(F.col("_x") * F.col(f"_c{j}")).alias(f"_s{j}") for j in range(1, n)]]
    g = rows.groupBy(*keys, "_i").agg(*sums)
    g = g.withColumn("_r", F.array(*[F.col(f"_s{j}") for j in range(n)]))
    per = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_r"))).alias("_l"))  # n entries
    return per.select(*keys, F.flatten(F.transform("_l", lambda s: F.slice(s["_r"], s["_i"] + 1, F.lit(n)))).alias(out))


def group_moments(d: DataFrame, cols: Sequence[str], group: str, shift: dict[str, float]) -> DataFrame:
    """(group, _i, _v): sums of products of [1, cols - shift...] for a few integer groups, the upper triangle in long form.

    Meant for a handful of groups that are spread over all tasks (folds): a task keeps one matrix per group and leaves it
    once, so the shuffle does not grow with the rows.
    """
    names = list(cols)
    base = np.array([shift[c] for c in names], float)
    upper = np.triu_indices(len(names) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]) - base])
            g = batch.column(group).to_numpy(zero_copy_only=False)
            for k in np.unique(g).tolist():
                part = x[g == k]
                total[k] = total.get(k, 0.0) + part.T @ part
        for k, m in total.items():
            v = m[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=[group, "_i", "_v"])

    rows = d.select(F.col(group).cast("int").alias(group), *[F.col(c).cast("double").alias(c) for c in names])
    return rows.mapInArrow(run, f"{group} int, _i int, _v double").groupBy(group, "_i").agg(F.sum("_v").alias("_v"))


def _moments(d: DataFrame, x: Sequence[str], y: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return cross_moments(d, [*x, *y], keys)


def fold_models(d: DataFrame, x: Sequence[str], y: Sequence[str], keys: Sequence[str], fold: str) -> DataFrame:
    """One model per (keys, fold) trained on the other folds: total moments minus the fold's own.

    The data is read once for all folds and targets; Python receives one row of moments per model.
    """
    keys = list(keys)
    per = _moments(d, x, y, [*keys, fold])
    size = (1 + len(x) + len(y)) * (2 + len(x) + len(y)) // 2
    rows = per.select(*keys, fold, F.posexplode("_m").alias("_i", "_v"))
    total = rows.groupBy(*keys, "_i").agg(F.sum("_v").alias("_t"))
    rest = rows.join(total, [*keys, "_i"]).groupBy(*keys, fold).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", (F.col("_t") - F.col("_v")).alias("v")))), lambda s: s["v"]).alias("_m"))
    return rest.filter(F.size("_m") == size).select(*keys, fold, _solve("_m", F.lit(len(x)), F.lit(len(y))).alias("coef"))


def full_models(d: DataFrame, x: Sequence[str], y: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _moments(d, x, y, keys).select(*keys, _solve("_m", F.lit(len(x)), F.lit(len(y))).alias("coef"))


def predict(d: DataFrame, models: DataFrame, x: Sequence[str], y: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Adds ``<target>_hat`` per target; NULL where the group has no model."""
    j = d.join(models, list(keys), "left") if keys else d.join(F.broadcast(models))
    width = 1 + len(x)
    out = {}
    for t, name in enumerate(y):
        v = F.get("coef", F.lit(t * width))
        for i, c in enumerate(x):
            v = v + F.col(c) * F.get("coef", F.lit(t * width + 1 + i))
        out[f"{name}_hat"] = v
    return j.withColumns(out).drop("coef")


def importance(models: DataFrame, x: Sequence[str], y: Sequence[str], keys: Sequence[str], signed_sum: bool = False) -> DataFrame:
    """(keys, feature, importance) summing to one: absolute slopes added over targets, or |sum of slopes|."""
    width = 1 + len(x)
    parts = []
    for i, c in enumerate(x):
        ws = [F.get("coef", F.lit(t * width + 1 + i)) for t in range(len(y))]
        v = F.abs(sum(ws[1:], ws[0])) if signed_sum else sum((F.abs(w) for w in ws[1:]), F.abs(ws[0]))
        parts.append(F.struct(F.lit(c).alias("feature"), v.alias("w")))
    d = models.select(*keys, F.array(*parts).alias("_p"))
    total = F.aggregate(F.transform("_p", lambda s: s["w"]), F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("_t", total).select(*keys, "_t", F.inline("_p"))
    return d.select(*keys, "feature", F.when(F.col("_t") > 0, F.try_divide(F.col("w"), F.col("_t"))).otherwise(0.0).alias("importance"))
