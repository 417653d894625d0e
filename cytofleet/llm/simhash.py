"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: A-Z are lower-cased, words are runs of anything but space and tab to carriage return, shingles are
``size`` words joined by one space, repeats included. A shingle's hash is XXH64 of its UTF-8 bytes with seed
42; a fingerprint bit is set if it is set in more than half of the hashes. A text with fewer words has one
shingle, the whole sequence; a text without words has fingerprint zero.

Linking: two fingerprints at most ``radius`` bits apart have balls of half that radius which meet. Each distinct
fingerprint emits every variant in its ball; rows that share a variant are candidates. With an even radius, any two
members of one variant are within ``radius`` of each other, so a link from each member to the smallest one carries
the same components as all pairs, and a variant has at most as many members as the ball has points (65 for
radius 2): no group grows with the data. Links are verified by their bit count before they are used.

Fingerprints of two bits miss copies with a few edited words, so ``groups`` also links texts with similar shingle sets
(``minhash``), unless ``similar`` is None.

Defined cases: a null text counts as empty; exact copies share one fingerprint and are collapsed before the
balls are formed; repeated rows are returned row by row; a null doc_id gets a fingerprint and the component of its
neighbours, but never names a component unless no other id is in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytofleet.llm import minhash
from cytofleet.llm.common import stage, texts, unstage
from cytofleet.llm.components import components


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and the blanks that separate words here
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + size]), seed) for i in range(n)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = 3, words: int | None = None) -> DataFrame:
    """The ``keep`` columns of every document and its fingerprint ``fp`` as a signed long.

    With ``words``, also the hash ``s`` of its set of ``words``-word shingles (null without words) and the ``buckets`` of the set.
    """
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    names = ["fp"] if words is None else ["fp", "s", "buckets"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = None if words is None else minhash.Shingles(words)
        for part, raw in texts(batches, "_text"):
            made = [pa.array(np.array([fingerprint(t, size) for t in raw], np.uint64).view(np.int64))]
            if of:
                sets = [of(t) for t in raw]
                made.append(pa.array([int(np.uint64(minhash.set_hash(x)).view(np.int64)) if x.size else None for x in sets], pa.int64()))
                made.append(pa.array([minhash.bands(x).view(np.int64) if x.size else None for x in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"_{i}") for i in range(len(keep))), *made], [*(f"_{i}" for i in range(len(keep))), *names])

    done = source.mapInArrow(run, f"{kinds}, fp long" + (", s long, buckets array<long>" if words is not None else ""))
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *names)


def ball(radius: int) -> list[int]:
    """XOR masks of all points at most ``radius`` bits away, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) with a < b that connect all fingerprints within ``radius`` bits; radius is even.

    ``fps`` has a column fp. The links connect what all close pairs connect; they are not all of those pairs.
    """
    if radius % 2:
        raise ValueError("an even radius is needed, so that the members of a variant are close to each other")
    distinct = fps.select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    spread = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    shared = spread.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    pairs = shared.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def similar_links(docs: DataFrame, marked: DataFrame, near: DataFrame, similar: float, words: int) -> DataFrame:
    """Links (a, b) between fingerprints of texts whose ``words``-word shingles are ``similar``, given the links ``near``.

    ``marked`` has fp, the set hash s and the buckets of each text; see ``minhash`` for the search.
    """
    sets = stage(marked.filter("s IS NOT NULL").groupBy("s").agg(F.min("fp").alias("fp"), F.first("buckets").alias("buckets")), "sets")
    # texts with one set are similar whatever their fingerprints
    same = marked.select("s", "fp").distinct().join(sets.select("s", F.col("fp").alias("a")), "s").filter("a <> fp").select("a", F.col("fp").alias("b"))
    rows = sets.select("s", F.explode("buckets").alias("k"))
    shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    met = stage(rows.join(shared, "k").select("s").distinct(), "met")
    items = stage(minhash.shingle_sets(docs, met, words), "shingles")
    places = stage(minhash.prefixes(items, similar), "places")

    def check(pairs: DataFrame) -> DataFrame:
        good = minhash.verified(pairs, items, similar)
        fp = lambda c: sets.select(F.col("s").alias(c), F.col("fp").alias(f"{c}_"))
        return good.join(fp("a"), "a").join(fp("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))

    first = stage(near.unionByName(same).unionByName(check(minhash.led_pairs(places, similar))), "links")
    roots = components(first).withColumnRenamed("node", "fp")
    placed = sets.select("s", "fp").join(roots, "fp", "left").select("s", F.coalesce("root", "fp").alias("root"))
    done = stage(first.unionByName(check(minhash.apart_pairs(places, placed, similar))), "links")
    unstage(sets, met, items, places, first)
    return done


def groups(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), radius: int = 2, size: int = 3, key: str = "doc_id",
    similar: float | None = 0.8, words: int = 5,
) -> DataFrame:
    """The ``keep`` columns, fp, ``component``: the smallest ``key`` among the documents that can be reached, and its ``root``.

    Documents are linked if their fingerprints are within ``radius`` bits, or if their sets of ``words``-word shingles have
    a Jaccard similarity of ``similar`` or more; without ``similar``, by fingerprints alone. ``root`` tells groups
    apart that have no key.
    """
    marked = stage(fingerprints(docs, tuple(dict.fromkeys((*keep, key))), size, None if similar is None else words), "fingerprints")
    lowest = stage(marked.groupBy("fp").agg(F.min(key).alias("low")), "distinct")
    near = links(lowest, radius)
    roots = components(near if similar is None else similar_links(docs, marked, near, similar, words))
    placed = lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("low").alias("component"))
    of_fp = placed.select("fp", "root").join(named, "root").select("fp", "component", "root")
    return marked.join(of_fp, "fp").select(*keep, "fp", "component", "root")
