"""Incremental ingestion of arriving fields: each content is processed once, and only when it is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cytofleet.schema import PIXELS
from cytofleet.session import pin
from cytofleet.sources.tables import content_hash

RegionPlan = Callable[[DataFrame], DataFrame]
#: Folders of the ledger; a batch reads those of its own hashes and fields only.
SLOTS = 64


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def _known(spark: SparkSession, path: str, rows: DataFrame, key: str, batch_id: int, columns: list[str]) -> DataFrame | None:
    """Ledger rows of other batches in the slots of ``rows``."""
    if not _exists(spark, path):
        return None
    slots = [r["s"] for r in rows.select(_slot(key).alias("s")).distinct().collect()]  # SLOTS numbers at most
    ledger = spark.read.schema("field_id long, image_hash string, batch int, slot int").parquet(path)
    return ledger.filter(F.col("slot").isin(slots) & (F.col("batch") != batch_id)).select(*columns)


def _pending(spark: SparkSession, sink: str, fields: DataFrame, batch_id: int) -> DataFrame | None:
    """(field_id, batch, n): earlier batches that hold back pixels of ``fields``, since the field was last complete."""
    path = f"{sink}-counts"
    if not _exists(spark, path):
        return None
    mine = lambda p, c: spark.read.schema(f"{c}, batch int").parquet(p).filter(F.col("batch") < batch_id).join(fields.select("field_id"), "field_id", "left_semi")
    held = mine(path, "field_id long, n long")
    if _exists(spark, f"{sink}-fields"):
        done = mine(f"{sink}-fields", "field_id long").groupBy("field_id").agg(F.max("batch").alias("_done"))
        held = held.join(done, "field_id", "left").filter(F.col("_done").isNull() | (F.col("batch") > F.col("_done")))
    return held.select("field_id", "batch", "n")


def process_batch(plan: RegionPlan, sink: str, expected: DataFrame, encode=None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: complete fields are hashed, known content is skipped, features are appended.

    ``expected(field_id, n_pixels)`` says how many pixels a field has. Fields with fewer so far, or without an expected
    number, are held back until the rest arrives; more is an error. A pixel that waits is written once, in the folder of its batch,
    with the number of pixels per field beside it, and is read again when its field is complete. A field that arrives again
    with other content is an error too, with the same content it is skipped. A batch writes to its own ``batch=``
    folders in overwrite mode, so a replay after a failure replaces what the failed attempt left. Inside a batch the
    lowest field id of equal content wins. Known content is looked up in a ledger laid out by hash and by field.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = pin(batch)
        counts = rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))
        pending = _pending(spark, sink, counts, batch_id)
        if pending is not None:
            pending = pin(pending)
            counts = counts.unionByName(pending.select("field_id", "n")).groupBy("field_id").agg(F.sum("n").alias("n"))
        counts = pin(counts.join(expected.select("field_id", "n_pixels"), "field_id", "left"))
        over = counts.filter("n > n_pixels").orderBy("field_id").first()
        if over:
            raise ValueError(f"field {over['field_id']} has {over['n']} pixels, expected {over['n_pixels']}")
        whole = counts.filter("n = n_pixels").select("field_id")
        held = rows.join(whole, "field_id", "left_anti").select(*batch.columns)
        held.write.mode("overwrite").parquet(f"{sink}-waiting/batch={batch_id}")
        held.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{sink}-counts/batch={batch_id}")
        ready = rows.join(whole, "field_id", "left_semi").select(*batch.columns)
        if pending is not None:
            early = pending.join(whole, "field_id", "left_semi").select("field_id", "batch")
            since = [r["batch"] for r in early.select("batch").distinct().collect()]  # batch numbers; other folders are not read
            if since:
                old = spark.read.schema(StructType([*batch.schema, StructField("batch", IntegerType())])).parquet(f"{sink}-waiting")
                ready = ready.unionByName(old.filter(F.col("batch").isin(since)).join(early, ["field_id", "batch"], "left_semi").select(*batch.columns))
                ready = pin(ready)
        hashes = pin(content_hash(ready, F.col("value").cast("string") if encode is None else encode).select("field_id", "image_hash"))
        fields = _known(spark, f"{sink}-fields", hashes, "field_id", batch_id, ["field_id", F.col("image_hash").alias("was")])
        if fields is not None:
            changed = hashes.join(fields, "field_id").filter("image_hash <> was").orderBy("field_id").first()
            if changed:
                raise ValueError(f"field {changed['field_id']} arrived again with other content")
        first = hashes.groupBy("image_hash").agg(F.min("field_id").alias("field_id"))
        known = _known(spark, f"{sink}-hashes", hashes, "image_hash", batch_id, ["image_hash"])
        if known is not None:
            first = first.join(known, "image_hash", "left_anti")
        first = pin(first)
        out = plan(ready.join(first.select("field_id"), "field_id", "left_semi")).join(first, "field_id")
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        for name, key, what in (("hashes", "image_hash", first), ("fields", "field_id", hashes)):
            # batch first, so that a replay replaces its own folder; slots below it prune the reads
            what.withColumn("slot", _slot(key)).write.mode("overwrite").partitionBy("slot").parquet(f"{sink}-{name}/batch={batch_id}")

    return run


def ingest_fields(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: RegionPlan, expected: DataFrame, max_files: int = 100, encode=None) -> None:
    """Drain all pixel files that have arrived under ``source`` into ``sink``; callable again later.

    A field may be spread over files and triggers; see ``process_batch``. Progress lives in ``checkpoint``.
    """
    stream = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", max_files).parquet(source)
    q = stream.writeStream.foreachBatch(process_batch(plan, sink, expected, encode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
