"""Scalar column expressions: guarded arithmetic, unit resolution, portable hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """``c`` where it is a finite number, else NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """num/den, NULL unless both sides are finite and the denominator is positive."""
    n, d = finite(num), finite(den)
    return F.when(d > 0, F.try_divide(n, d))


def half_even(c: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(c, 0).cast("int")


def background_radius_px(radius_um: float, px: Column | str, override_px: int | None = None) -> Column:
    """Background window radius; 0 disables it, a non-positive pixel size is an error."""
    if override_px is not None:
        return F.lit(int(override_px))
    if radius_um <= 0:
        return F.lit(0)
    p = col(px)
    checked = F.when(p > 0, p).otherwise(F.raise_error(F.lit("pixel_size_um must be positive")).cast("double"))
    return F.greatest(F.lit(1), half_even(F.lit(float(radius_um)) / checked))


def min_area_px(area_um2: float, px: Column | str) -> Column:
    return F.greatest(F.lit(1), half_even(F.lit(float(area_um2)) / (col(px) * col(px))))


def max_area_px(min_um2: float, max_um2: float, px: Column | str) -> Column:
    return F.greatest(min_area_px(min_um2, px) + 1, half_even(F.lit(float(max_um2)) / (col(px) * col(px))))


def distance_px(distance_um: float, px: Column | str) -> Column:
    """Real-valued pixel distance, at least one pixel."""
    return F.greatest(F.lit(1.0), F.lit(float(distance_um)) / col(px))


def ring_floor_px(px: Column | str) -> Column:
    """Smallest pericellular ring width: about 1 um, never under 2 px."""
    return F.greatest(F.lit(2), half_even(F.lit(1.0) / col(px)))


def sigma_px(sigma_um: float, px: Column | str) -> Column:
    return F.greatest(F.lit(0.5), F.lit(float(sigma_um)) / col(px))


def width_px(width_um: float, px: Column | str) -> Column:
    return F.greatest(F.lit(1), half_even(F.lit(float(width_um)) / col(px)))


def edge_cost(confidence: Column | str) -> Column:
    """-ln(confidence) with the confidence clamped to [1e-6, 1]; NULL stays NULL."""
    c = col(confidence)
    return F.when(c.isNotNull(), -F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), c))) + F.lit(0.0))


P31 = 2147483647
_COMBINE = [1103515245, 1566083941, 1812433253, 1234567891, 1664525013]
_ROUNDS = [(15, 1103515245), (13, 1566083941)]


def mix31(seed: int, *keys: Column | str) -> Column:
    """Deterministic 31-bit hash of up to five non-negative integer keys.

    Keys are combined linearly modulo a Mersenne prime, then two xor-shift and multiply rounds
    scatter the result. Only integer arithmetic is used, so another SQL engine can reproduce every
    draw digit by digit.
    """
    h = F.lit((seed * 48271 + 11) % P31).cast("bigint")
    for k, m in zip(keys, _COMBINE, strict=False):
        h = (h + col(k).cast("bigint") % F.lit(P31)) * F.lit(m) % F.lit(P31)
    for s, m in _ROUNDS:
        h = h.bitwiseXOR(F.shiftright(h, s)) * F.lit(m) % F.lit(P31)
    return h


def _fold31(h: np.ndarray) -> np.ndarray:
    """Non-negative 64-bit integers modulo 2**31 - 1, without a division."""
    for _ in range(2):
        h = (h & P31) + (h >> 31)
    h -= (h >= P31) * np.int64(P31)
    return h


def mix31_numpy(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The same hash of whole arrays of 64-bit integers inside a task."""
    h = np.int64((seed * 48271 + 11) % P31)
    for k, m in zip(keys, _COMBINE, strict=False):
        h = _fold31((h + k % P31) * np.int64(m))
    for s, m in _ROUNDS:
        h = _fold31((h ^ (h >> s)) * np.int64(m))
    return h


def unit31(seed: int, *keys: Column | str) -> Column:
    """Uniform draw in [0, 1) from :func:`mix31`."""
    return mix31(seed, *keys) / F.lit(float(P31))


def hash31(seed: int, *keys: Column | str) -> Column:
    """31-bit hash of keys of any type, for draws nobody has to reproduce outside Spark."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(P31))


def mix31_sql(seed: int, *keys: str) -> str:
    """The same hash as ANSI SQL text, for checks against another engine."""
    h = f"CAST({(seed * 48271 + 11) % P31} AS BIGINT)"
    for k, m in zip(keys, _COMBINE, strict=False):
        h = f"((({h} + CAST({k} AS BIGINT) % {P31}) * {m}) % {P31})"
    for s, m in _ROUNDS:
        h = f"((xor({h}, {h} >> {s}) * {m}) % {P31})"
    return h
