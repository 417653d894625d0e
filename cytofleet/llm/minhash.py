"""Pairs of texts whose sets of ``size``-word shingles have a Jaccard similarity of ``similar`` or more.

Words and the rule for short texts are those of ``simhash``: a text with fewer words has one shingle, the whole sequence; a
text without words has no set and meets nothing. Texts with one set (a set hash of 64 bits) are one node.

Candidates: ``BANDS`` bands of ``ROWS`` independent minima each; sets that agree in a whole band share a bucket. A pair with
similarity 0.8 shares none with probability (1 - 0.8 ** 4) ** 20 = 0.00003, and less if it is more similar; this is the only
loss. Candidates are verified by exact similarity of their shingle hashes.

Only sets that share a bucket with another set go on. Their pairs come from an exact prefix filter: with the shingles of every
set ordered by how many of these sets have them, rarest first, two sets of similarity t share one among the first
n - ceil(t n) + 1 of either. If their first common shingle is at places i and j (from 0), they share at most
min(n - i, m - j), which must reach t / (1 + t) (n + m). A passage that many texts quote stands last in that order, so it brings
no pairs; edited copies have their own shingles first, which uses up the places that an unsimilar pair would need.

A shingle's sets are not paired off at once: first every member meets one leader, the set with the fewest rarer shingles;
then only members that are still in different components meet each other, within size classes. The components are those of
all pairs, and a large group of near copies costs about one comparison a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cytofleet.llm.common import bit_table, held, texts
from cytofleet.llm.decontam import Grams

BANDS, ROWS = 20, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int = 5):
        self.size, self.grams = size, Grams(size)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if 0 < len(words) < self.size:
            return np.array([self.grams.digest(b" ".join(words), 42)], np.uint64)
        return np.unique(self.grams(words))


def set_hash(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One bucket number per band, the band included."""
    low = np.full(_FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, shingles.size, 4096):
        part = shingles[lo:lo + 4096]
        low = np.minimum(low, [np.min(part * f) for f in _FACTORS])
    low = low.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(s, items): the shingle hashes of every set named in ``nodes``, once; texts are read again, not kept."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bit_table(nodes.select(F.col("s").alias("g"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, of = np.frombuffer(wanted.value, np.uint8), Shingles(size)
        for _, raw in texts(batches):
            sets = [x for x in map(of, raw) if x.size]
            keys = np.array([set_hash(x) for x in sets], np.uint64)
            at = np.flatnonzero(held(table, keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], ["s", "items"])

    found = docs.select("text").mapInArrow(run, "s long, items array<long>").join(nodes, "s", "left_semi")
    return found.dropDuplicates(["s"])


def prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """(g, s, n, j): the shingles at the first places j of every set of n, without those that no other set has."""
    one = sets.select("s", F.size("items").alias("n"), F.explode("items").alias("g"))
    often = one.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    order = F.sort_array(F.collect_list(F.struct("c", "g")))
    kept = one.join(often, "g").groupBy("s", "n").agg(order.alias("l"))
    places = F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1
    # shingles of one set only come first and are left out
    own = F.col("n") - F.size("l")
    first = F.slice("l", F.lit(1), F.greatest(F.lit(0), places - own).cast("int"))
    return kept.select("s", "n", own.alias("o"), F.posexplode(first).alias("i", "x")).select(
        F.col("x.g").alias("g"), "s", "n", (F.col("o") + F.col("i")).alias("j"))


def able(n: Column, j: Column, m: Column, i: Column, similar: float) -> Column:
    """Whether sets of n and m shingles whose first common one is at places j and i can be similar enough."""
    least = F.ceil(F.lit(similar / (1 + similar)) * (n + m) - 1e-9)
    return F.least(n - j, m - i) >= least


def led_pairs(places: DataFrame, similar: float) -> DataFrame:
    """(a, b): every set and the leader of each of its shingles, if they can be similar."""
    lead = places.groupBy("g").agg(F.min(F.struct("j", "s", "n")).alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(
        "g", F.col("l.s").alias("a"), F.col("l.n").alias("m"), F.col("l.j").alias("i"))
    met = places.join(lead, "g").filter((F.col("s") != F.col("a")) & able(*map(F.col, ("n", "j", "m", "i")), similar))
    return met.select("a", F.col("s").alias("b")).distinct()


def apart_pairs(places: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """(a, b): sets with a common shingle that can be similar and are in different components; ``roots`` has s, root."""
    placed = places.join(roots, "s")
    apart = placed.groupBy("g").agg(F.min("root").alias("l"), F.max("root").alias("h")).filter("l <> h").select("g")
    # similar sets are of one size class or of neighbouring ones
    size = F.floor(F.log(F.col("n").cast("double")) / -math.log(similar)).cast("int")
    mine = placed.join(apart, "g", "left_semi").withColumn("z", size)
    other = mine.select("g", F.col("s").alias("b"), F.col("n").alias("m"), F.col("j").alias("i"), F.col("root").alias("r"),
                        F.explode(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)).alias("z"))
    both = mine.join(other, ["g", "z"]).filter(
        (F.col("s") < F.col("b")) & (F.col("root") != F.col("r")) & able(*map(F.col, ("n", "j", "m", "i")), similar))
    return both.select(F.col("s").alias("a"), "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; two sets at a time are in memory, in no Arrow batch."""
    size = sets.select("s", F.size("items").alias("n"))
    sized = pairs.join(size.select(F.col("s").alias("a"), F.col("n").alias("p")), "a").join(size.select(F.col("s").alias("b"), F.col("n").alias("q")), "b")
    # the smaller set bounds the intersection
    able = sized.filter(F.least("p", "q") >= similar * F.greatest("p", "q"))
    whole = able.join(sets.select(F.col("s").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("s").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return whole.filter(both >= similar * (F.col("p") + F.col("q") - both)).select("a", "b")
