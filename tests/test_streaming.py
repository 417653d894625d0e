import pytest
from pyspark.sql import functions as F

from cytofleet.sources import tables as A
from cytofleet.streaming.ingest import ingest_fields, process_batch


def test_same_content_is_processed_once_and_replays_are_idempotent(spark):
    base = A.shared_path(spark, "test-ingest")

    def arrive(fid, scale):
        spark.createDataFrame([(fid, "dapi", y, x, scale * (y + x)) for y in range(3) for x in range(4)], "field_id long, channel string, y int, x int, value double") \
            .coalesce(1).write.mode("append").parquet(f"{base}/in")

    plan = lambda b: b.groupBy("field_id").agg(F.sum("value").alias("s"))
    sizes = spark.createDataFrame([(f, 12) for f in range(1, 9)], "field_id long, n_pixels long")
    arrive(1, 1.0)
    arrive(2, 2.0)
    ingest_fields(spark, f"{base}/in", f"{base}/out", f"{base}/state", plan, sizes)
    assert {r["field_id"] for r in spark.read.parquet(f"{base}/out").collect()} == {1, 2}
    arrive(3, 1.0)  # content of field 1
    arrive(4, 5.0)
    ingest_fields(spark, f"{base}/in", f"{base}/out", f"{base}/state", plan, sizes)
    out = spark.read.parquet(f"{base}/out")
    assert sorted(r["field_id"] for r in out.collect()) == [1, 2, 4]
    # replaying the last batch replaces its own output only
    last = out.agg(F.max("batch")).first()[0]
    process_batch(plan, f"{base}/out", sizes)(spark.read.parquet(f"{base}/in").filter("field_id > 2"), last)
    assert sorted(r["field_id"] for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 4]


def test_fields_wait_until_they_are_complete(spark):
    """One file per trigger; a field lies in two files, another one stays unfinished."""
    base = A.shared_path(spark, "test-parts")

    def arrive(fid, ys, scale=1.0):
        spark.createDataFrame([(fid, "dapi", y, x, scale * (y + x)) for y in ys for x in range(4)], "field_id long, channel string, y int, x int, value double") \
            .coalesce(1).write.mode("append").parquet(f"{base}/in")

    plan = lambda b: b.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = spark.createDataFrame([(1, 16), (2, 16), (3, 8)], "field_id long, n_pixels long")
    run = lambda: ingest_fields(spark, f"{base}/in", f"{base}/out", f"{base}/state", plan, sizes, max_files=1)
    for part in ((1, (0, 1)), (2, (0,)), (1, (2, 3)), (9, (0,))):
        arrive(*part)
    run()
    rows = lambda: sorted((r["field_id"], r["n"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert rows() == [(1, 16)]
    arrive(2, (1, 2, 3), 2.0)
    arrive(3, (0, 1))
    run()
    assert rows() == [(1, 16), (2, 16), (3, 8)]
    arrive(3, (0, 1))
    run()
    assert rows() == [(1, 16), (2, 16), (3, 8)]
    arrive(3, (0, 1), 5.0)
    with pytest.raises(Exception, match="other content"):
        run()


def test_a_waiting_pixel_is_written_once(spark):
    """Eight fields, one row of each per file and trigger; only the last trigger completes them. A later arrival starts from nothing."""
    base = A.shared_path(spark, "test-once")
    plan = lambda b: b.groupBy("field_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    sizes = spark.createDataFrame([(f, 24) for f in range(8)], "field_id long, n_pixels long")
    rows = lambda: sorted((r["field_id"], r["s"], r["n"]) for r in spark.read.parquet(f"{base}/out").collect())
    want = [(f, float(sum(f * 100 + y * 4 + x for y in range(6) for x in range(4))), 24) for f in range(8)]
    for again in range(2):
        for y in range(6):
            spark.createDataFrame([(f, "dapi", y, x, float(f * 100 + y * 4 + x)) for f in range(8) for x in range(4)],
                                  "field_id long, channel string, y int, x int, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")
        ingest_fields(spark, f"{base}/in", f"{base}/out", f"{base}/state", plan, sizes, max_files=1)
        assert rows() == want
        assert spark.read.parquet(f"{base}/out-waiting").count() == (again + 1) * 5 * 8 * 4


def test_content_hash_depends_on_content_only(spark):
    rows = [(f, "c", y, x, float(y * 3 + x + (f == 3))) for f in (1, 2, 3) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "field_id long, channel string, y int, x int, value double")
    h = {r["field_id"]: r["image_hash"] for r in A.content_hash(df.orderBy(F.rand(1)), F.col("value").cast("string")).collect()}
    assert h[1] == h[2] != h[3]


def test_plans_of_expressible_operators_stay_in_the_engine(spark):
    from fixtures import SF
    from cytofleet.plans import catalogue
    for name in ("C1_white_tophat", "D6_nuclear_partition", "E1_residualisation", "E3_zscores", "E7_combat", "E19_two_condition_comparison", "B8_qc_flags", "E26_top_cells"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    plan = catalogue.QUERIES["E19_two_condition_comparison"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag" in plan or "l_returnflag" in plan.split("PushedFilters")[1][:80]


def test_every_query_has_a_known_prefix():
    from cytofleet.plans import catalogue
    want = [f"{p}{i}" for p, n in (("A", 14), ("B", 18), ("C", 21), ("D", 17), ("E", 29), ("F", 16), ("G", 24), ("H", 4), ("S", 1)) for i in range(1, n + 1)]
    have = {n.split("_")[0] for n in catalogue.QUERIES}
    assert have == set(want)
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
