"""Packing into optimal length buckets.

Texts are measured in words and cut into pieces of at most ``max_len`` words, so a histogram of lengths has at most
``max_len`` rows whatever the corpus; it is the one thing the driver sees. Dynamic programming over it chooses
``buckets`` upper bounds that minimise the padding of all pieces to the bound of their bucket. In a bucket of bound b,
batches hold ``max(1, budget // b)`` pieces, which is the token budget.

Batches are dealt in the order of a hash of the piece, so their content does not follow the source order. A bucket may hold
most pieces: it is dealt by hash ranges, the ranges are counted, the counts are scanned (one row per range), and
places inside a range are numbered by the task that has it. No task sorts a whole bucket.

Defined cases: null and empty texts have no piece to pack and give one row with length 0, bucket 0 and no batch;
pieces that tie in hash are ordered by id and piece; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofleet.llm.common import WORD, stage

#: Pieces per hash range, about.
RANGE = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, that minimise the sum of counts * (bound - length).

    ``lengths`` ascends. cost(k, j) = min over i of cost(k - 1, i) + padding of lengths i..j-1 to the j-th; exact, one
    vector step per cell.
    """
    n = lengths.size
    if not n:
        return []
    count = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    total = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.int64)])
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, come = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            way = cost[:j] + lengths[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(way.argmin())
            if way[i] < new[j]:
                new[j], come[j] = way[i], i
        cost = new
        back.append(come)
    out, j = [], n
    for come in reversed(back):
        if come[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(come[j])
    return out[::-1]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def pack(
    docs: DataFrame, max_len: int = 2048, buckets: int = 8, budget: int = 16_384, keep: tuple[str, ...] = ("doc_id",),
    length: Column | None = None,
) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, bucket, batch, place.

    ``start`` is the first word of the piece, ``bucket`` its bound (the padded length), ``batch`` counts from 0 within
    the bucket, ``place`` from 0 within the batch. ``length`` is the number of words unless given.
    """
    size = (words(F.col("text")) if length is None else length).cast("long")
    measured = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], size.alias("_n"), F.xxhash64("text").alias("_t"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / max_len) - 1, F.lit(0)))
    pieces = measured.withColumn("piece", F.explode(cuts)).withColumn("start", F.col("piece") * max_len).withColumn(
        "length", F.least(F.lit(max_len).cast("long"), F.col("_n") - F.col("start")))
    mixed = F.xxhash64(*[f"_k{i}" for i in range(len(keep))], "_t", "piece")
    pieces = stage(pieces.withColumn("_h", mixed).drop("_t", "_n"), "pieces")

    histogram = pieces.filter("length > 0").groupBy("length").count().orderBy("length").collect()  # at most max_len rows
    bounds = boundaries(np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    total = sum(r["count"] for r in histogram)
    bucket = F.lit(0)
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, b).otherwise(bucket)
    ranges = max(1, -(-total // RANGE))
    # the high bits of the hash choose the range, so that the ranges in their order give the order by hash
    spot = F.floor((F.shiftrightunsigned("_h", 32)) * ranges / (1 << 32)).cast("int")
    dealt = pieces.filter("length > 0").withColumns({"bucket": bucket.cast("long"), "_r": spot})
    inside = Window.partitionBy("bucket", "_r").orderBy(F.shiftrightunsigned("_h", 32), "_h", *[f"_k{i}" for i in range(len(keep))], "piece")
    counted = dealt.groupBy("bucket", "_r").count()
    before = Window.partitionBy("bucket").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("bucket", "_r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    placed = dealt.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["bucket", "_r"])
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    spot = F.col("_o") + F.col("_i")
    full = placed.withColumns({"batch": F.floor(spot / fits), "place": spot % fits})
    empty = pieces.filter("length <= 0").withColumns({
        "bucket": F.lit(0).cast("long"), "batch": F.lit(None).cast("long"), "place": F.lit(None).cast("long")})
    names = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    out = [*names, "piece", "start", "length", "bucket", "batch", "place"]
    return full.select(*out).unionByName(empty.select(*out))
