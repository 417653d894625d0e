import itertools
import math

import pytest
from pyspark.sql import functions as F

from cytofleet.functions import scalar as S
from cytofleet.functions import tails


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_half_even_and_px_resolution(spark):
    r = one(spark, S.half_even(F.lit(2.5)), S.half_even(F.lit(3.5)), S.background_radius_px(7.5, F.lit(0.325)), S.background_radius_px(0, F.lit(0.3)),
            S.ring_floor_px(F.lit(2.0)), S.sigma_px(0.65, F.lit(10.0)))
    assert list(r) == [2, 4, 23, 0, 2, 0.5]


def test_non_positive_pixel_size_is_an_error(spark):
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(S.background_radius_px(7.5, F.lit(0.0))).collect()


def test_guarded_ratio(spark):
    nan = F.lit(float("nan"))
    r = one(spark, S.guarded_ratio(F.lit(1.0), F.lit(2.0)), S.guarded_ratio(F.lit(1.0), F.lit(0.0)), S.guarded_ratio(nan, F.lit(1.0)),
            S.guarded_ratio(F.lit(1.0), F.lit(-1.0)), S.edge_cost(F.lit(1.0)), S.edge_cost(F.lit(0.0)))
    assert list(r)[:4] == [0.5, None, None, None]
    assert r[4] == 0.0 and abs(r[5] - -math.log(1e-6)) < 1e-12


def test_hash_is_uniform_and_portable(spark):
    import duckdb

    got = [r[0] for r in spark.range(2000).select(S.mix31(42, "id", F.col("id") + 5)).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT {S.mix31_sql(42, 'id', '(id + 5)')} FROM range(2000) t(id)").fetchall()]
    assert got == want
    assert abs(sum(got) / len(got) / S.P31 - 0.5) < 0.03 and len(set(got)) == 2000


def test_tails():
    # t distribution, 10 degrees of freedom: t = 2.228139 is the two-sided 5 percent point
    t, n = 2.2281388519649385, 12
    r = t / math.sqrt(t * t + n - 2)
    assert abs(tails.correlation_p(r, n) - 0.05) < 1e-9
    assert abs(tails.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    # 3 against 3, completely separated: 2 of 20 orders
    assert abs(tails.exact_u_two_sided(0, 3, 3) - 0.1) < 1e-12
    # 2 against 3: U=1 has 1+1 of 10 orders at or below, doubled
    assert abs(tails.exact_u_two_sided(1, 2, 3) - 0.4) < 1e-12


def test_exact_u_against_all_orders():
    for n1, n2 in ((1, 1), (1, 6), (2, 5), (4, 4), (5, 3)):
        us = [sum(ranks) - n1 * (n1 - 1) // 2 for ranks in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * sum(v >= max(u, n1 * n2 - u) for v in us) / len(us))
            assert abs(tails.exact_u_two_sided(u, n1, n2) - want) < 1e-15
    # beyond 64 bits the counts stay whole numbers; a large arm costs as many steps as the small one has values
    assert abs(tails.exact_u_two_sided(8 * 3000 / 2, 8, 3000) - 1.0) < 1e-3
    assert tails.exact_u_two_sided(0, 8, 3000) == 2 / math.comb(3008, 8)
