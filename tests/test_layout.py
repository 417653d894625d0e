"""Image layouts and axis rules."""

import pytest
from pyspark.sql import functions as F

from cytofleet.sources import tables as A


def pixels(spark, shape):
    n = 1
    for s in shape:
        n *= s
    d = spark.createDataFrame([(1, "raw", [float(i) for i in range(n)], list(shape))], "field_id long, channel string, values array<double>, shape array<int>")
    return {(r["plane"], r["y"], r["x"]): r["value"] for r in A.flatten_tiles(d, F.col("shape")).collect()}


@pytest.mark.parametrize("shape,order", [((3, 4), "yx"), ((2, 3, 9), "cyx"), ((3, 4, 2), "yxc"), ((9, 10, 3), "yxc"), ((10, 9, 12), "yxc")])
def test_layouts(spark, shape, order):
    got = pixels(spark, shape)
    size = dict(zip(order, shape, strict=True))
    want = {}
    for c in range(size.get("c", 1)):
        for y in range(size["y"]):
            for x in range(size["x"]):
                at = {"c": c, "y": y, "x": x}
                flat = 0
                for o in order:
                    flat = flat * size[o] + at[o]
                want[c, y, x] = float(flat)
    assert got == want


def test_other_ranks_raise(spark):
    with pytest.raises(Exception, match="expected a 2D or 3D image"):
        pixels(spark, (2, 2, 2, 2))


def test_axis_rules(spark):
    rows = [(1, "raw", 5, z, 0, 0, float(z)) for z in (1, 2)] + [(1, "raw", 6, 1, 0, 0, 9.0)]
    rows += [(2, "raw", t, None, 0, 0, float(t)) for t in (1, 2)]  # time only
    rows += [(3, "raw", None, 7, 0, 0, 1.0)]  # one plane
    stack = spark.createDataFrame(rows, "field_id long, channel string, t int, z int, y int, x int, value double")
    got = sorted((r["field_id"], r["t"] or 0, r["value"], r["planes"]) for r in A.z_project(stack).collect())
    assert got == [(1, 0, 2.0, 2), (2, 1, 1.0, None), (2, 2, 2.0, None), (3, 0, 1.0, None)]
    # the axes text comes first: a field that names no Z axis keeps its frames
    named = stack.withColumn("axes", F.when(F.col("field_id") == 1, "TYX"))
    assert sum(r["field_id"] == 1 for r in A.z_project(named).collect()) == 3


def test_bare_stacks(spark):
    axes = lambda a, b: spark.range(1).select(A.stack_axes(F.lit(a), F.lit(b)).alias("a")).first()["a"]
    assert [axes(3, 40), axes(40, 3), axes(40, 50)] == ["CZYX", "ZCYX", "ZYXC"]
    with pytest.raises(Exception, match="ambiguous"):
        axes(5, 5)
