"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytofleet.session import ensure_checkpoint_dir

#: A word is a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a bit table, as a power of two.
BITS = 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Later steps then restart from files that every executor can read, so a lost executor costs no more
    than the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged frames that no later step reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_split(key: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest`` modulo ``parts``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def texts(batches: Iterator, column: str = "text") -> Iterator[tuple]:
    """(batch, list of UTF-8 bytes or None) for every Arrow batch; long batches come in slices.

    A slice holds at most 256 rows, so a worker keeps few whole texts at a time.
    """
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield part, part.column(column).cast(pa.large_binary()).to_pylist()


def bit_table(grams: DataFrame) -> bytes:
    """A table of 2**BITS bits with the top bits of every hash ``g`` set: 256 rows of 4 KB reach the driver at most."""
    slot = F.shiftrightunsigned("g", 64 - BITS) + 1
    rows = grams.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    table = bytearray(1 << (BITS - 3))
    for r in rows:
        at = (r["b"] - 1) * 4096
        table[at:at + len(r["m"])] = r["m"]
    return bytes(table)


def held(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = grams >> np.uint64(64 - BITS)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
