"""Mixing sources to target weights by hash thresholds.

The size of a text is its number of words. Sources in the order of their code points, null last, have the weights
``weights``, repeating, and share ``total`` times all sizes; a target stops at ``most`` times the size of its source, and the
excess is shared again by weight until no target is above.

Every document has a hash of its id and text. A source takes each of its documents ``full`` times and, for the rest, once
more those whose hash lies below a threshold. The threshold comes from nested histograms: sizes are summed by source and the
leading ``BITS`` bits of the hash, a prefix sum over a source's buckets finds the one in which the rest is reached, and only the
documents of that bucket are summed again by the next bits. After ``LEVELS`` levels the boundary is a single hash value,
whose documents share what is left in proportion to their sizes. Nothing is sorted but at most ``2 ** BITS`` sums a
source, and every level reads a smaller part of a narrow table written once. The same rows give the same mix in any order.

Defined cases: null and empty texts have size 0 and are never taken; a source without words has target 0; null ids and
repeated rows are documents of their own (equal rows share a hash, so they share the boundary evenly; up to one word a row
is rounded off there); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofleet.llm.common import stage, unstage
from cytofleet.llm.packing import words

BITS, LEVELS = 12, 5
#: Rounds in which targets are found; each settles at least one source or is the last.
ROUNDS = 1000


def spot() -> Column:
    """60 bits of a hash of id and text; MD5, so that other engines can repeat it."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A round shares what capped sources leave among the others by weight and caps those that come out above; it reads one
    aggregated row a source, and the driver sees two sums a round.
    """
    # numbered in order without a single task: range partitions, counted, then offsets
    order = [F.col("source").asc_nulls_last()]
    dealt = stage(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = dealt.withColumn("_i", place).join(offsets, "_part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_i") + F.col("_o")) % len(weights) + 1).cast("int"))
    state = stage(numbered.select("source", "source_size", weight.alias("_w"), F.lit(False).alias("_full")), "targets")
    unstage(dealt)
    whole = None
    for _ in range(ROUNDS):
        sums = state.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("_full"), F.col("source_size"))).alias("full"),
            F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("w")).first()
        whole = (sums["all"] or 0) * total if whole is None else whole
        share = (whole - (sums["full"] or 0) * most) * F.col("_w") / F.lit(sums["w"] or 1.0)
        above = ~F.col("_full") & (share > F.col("source_size") * most)
        if sums["w"] is None or state.filter(above).isEmpty():
            return state.select(
                "source", "source_size", F.when(F.col("_full"), F.col("source_size") * most).otherwise(share).cast("double").alias("target"))
        state = stage(state.withColumn("_full", F.col("_full") | above), "targets")
    raise RuntimeError(f"targets did not settle in {ROUNDS} rounds")


def thresholds(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, low, left, tie): documents with a hash below ``low`` are taken, those at ``low`` share ``left`` of ``tie`` words.

    ``sized`` has source, size, u; ``rest`` has source and rest, the words to take once more, less than the source holds.
    """
    open_ = rest.filter("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("low"))
    inside = sized
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:  # only the boundary bucket of each source is looked at again
            inside = sized.join(open_.select(F.col("source").alias("_s"), F.shiftright("low", shift + BITS).alias("_b")), F.col("source").eqNullSafe(F.col("_s")) & (
                F.shiftright("u", shift + BITS) == F.col("_b"))).drop("_s", "_b")
        sums = inside.groupBy("source", F.shiftright("u", shift).alias("b")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
        reached = sums.withColumn("_e", upto).join(
            open_.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s"))).filter("_e > left AND _e - s <= left")
        open_ = stage(reached.select(
            "source", (F.col("left") - F.col("_e") + F.col("s")).alias("left"), F.shiftleft("b", shift).alias("low"), F.col("s").alias("tie")), "boundary")
    return open_


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every document, its source, size, source_size, target and ``taken``.

    ``taken`` counts words of the mix: whole copies and, for a document on the threshold, a part of one.
    """
    sized = stage(docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], "source", words(F.col("text")).cast("long").alias("size"), spot().alias("u")), "sizes")
    of = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most).withColumn(
        "_words", F.round("target").cast("long")).withColumn(
        "_full", F.when(F.col("source_size") > 0, F.call_function("div", F.col("_words"), F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")), "shares")
    rest = of.select("source", (F.col("_words") - F.col("_full") * F.col("source_size")).alias("rest"))
    edge = thresholds(sized, rest)
    told = of.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    once = F.when(F.col("u") < F.col("low"), F.col("size")).when(
        F.col("u") == F.col("low"), F.call_function("div", F.col("left") * F.col("size"), F.greatest("tie", F.lit(1)))).otherwise(0)
    return sized.join(told, F.col("source").eqNullSafe(F.col("_s"))).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "source", "size", "source_size", "target",
        (F.col("size") * F.col("_full") + F.coalesce(once, F.lit(0))).cast("long").alias("taken"))
