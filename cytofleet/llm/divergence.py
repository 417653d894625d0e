"""Divergence of sources from each other and from their language.

Terms are runs of letters A-Z (lower-cased) and of bytes from 0x80 on: one ``bytes.translate`` lowers letters and blanks all
other ASCII, ``bytes.split`` cuts, and a ``Counter`` per document gives its occurrences and, by one per term, its document
frequency. A task adds documents up before it emits them. A language keeps the V terms that occur in at least
``least`` of its documents. In a group (language, source), or a language, a kept term with ``count`` occurrences has

    p = 1 + floor(SCALE (count + 2) / (N + 2 V)),   N the sum of counts over kept terms,

and two of them differ by floor((p - q)^2 / (p + q)). Null lang and source are ''.

``pair``: for a group and every other source of its language, the sum over all kept terms. Most terms are in few sources, so
with b = p for count 0 the sum is V f(b, b') plus, for the terms of one side, f(p, b') - f(b, b'), which depends on
the count alone and is summed over the counts of a group; plus, for terms on both sides, what is left of f(p, p'), summed from
one row per term that lists its sources. No pair of rows is formed: tasks add term rows up by (source, source).
``term``: the terms that a group has more often than its language, the first ``ranks`` by f, then by term.

All arithmetic is exact in 64 bits while N + 2 V stays below 9 * 10^15; beyond that an error is raised.

Defined cases: null and empty texts have no terms but their group is reported; a language with one source has no pairs; with
V = 0 pairs have value 0; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofleet.llm.common import stage, texts

SCALE = 1_000_000_000
#: Terms that a task holds before it emits them.
KNOWN = 400_000
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, term, of, df): the documents of a language with a term and its occurrences by source; one row per term."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, d) in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()),
                     pa.array(np.fromiter(n.values(), np.int64, len(n))), pa.array(np.fromiter((d[t] for t in n), np.int64, len(n)))],
                    ["lang", "source", "term", "n", "d"])
            seen.clear()

        for part, raw in texts(batches):
            for lang, source, t in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), raw, strict=True):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                c = Counter((t or b"").translate(_TERMS).split())
                n.update(c)
                d.update(c.keys())
            if sum(len(n) for n, _ in seen.values()) > KNOWN:
                yield from out()
        yield from out()

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, d long")
    # one exchange serves both aggregations
    dealt = found.repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("of"), F.sum("d").alias("df"))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total) by long division in steps of 1000, so that no product passes 64 bits."""
    out, left = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + F.call_function("div", left, total)
        left = left % total
    return F.when(total > 0, out + 1).otherwise(0)


def distance(p: Column, q: Column) -> Column:
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), F.greatest(p + q, F.lit(1)))).otherwise(0)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, v, total, of): per language V, N + 2 V, and source -> (N + 2 V of the group, p for count 0)."""
    there = docs.select("lang", "source").distinct()
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = kept.select("lang", F.explode("of").alias("o")).groupBy("lang", F.col("o.source").alias("source")).agg(F.sum("o.n").alias("n"))
    one = there.join(size, "lang", "left").join(n, ["lang", "source"], "left").fillna(0, ["v", "n"]).withColumn(
        "total", F.col("n") + 2 * F.col("v"))
    entry = F.struct("source", F.struct("total", probability(F.lit(0).cast("long"), F.col("total")).alias("b")).alias("x"))
    return one.groupBy("lang").agg(
        F.max("v").alias("v"), (F.sum("n") + 2 * F.max("v")).alias("total"), F.map_from_entries(F.collect_list(entry)).alias("of"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(lang, a, b, v) with a < b by first mention: what terms on both sides add to the sums of one-sided terms."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names: dict[str, int] = {}
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            of = batch.column("of")
            flat, size = of.flatten(), np.diff(of.offsets.to_numpy()).astype(np.int64)
            p, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "b"))
            source = flat.field("source").dictionary_encode()
            known = np.array([names.setdefault(x, len(names)) for x in source.dictionary.to_pylist()], np.int64)
            code = known[source.indices.to_numpy()] if len(source) else np.zeros(0, np.int64)
            langs = batch.column("lang").dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy(), size)
            later = np.repeat(np.cumsum(size), size) - np.arange(code.size) - 1  # entries behind this one in its row
            upto = np.cumsum(later)
            lo = 0
            while lo < code.size:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 1_000_000, "right")))
                i = np.repeat(np.arange(lo, hi), later[lo:hi])
                j = i + 1 + np.arange(i.size) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
                lo = hi
                if not i.size:
                    continue
                v = _distance(p[i], p[j]) - _distance(p[i], b[j]) - _distance(b[i], p[j]) + _distance(b[i], b[j])
                key = (lang[i].astype(np.int64) << 48) | (np.minimum(code[i], code[j]) << 24) | np.maximum(code[i], code[j])
                found, at = np.unique(key, return_inverse=True)
                total = np.zeros(found.size, np.int64)
                np.add.at(total, at, v)
                for k, t in zip(found.tolist(), total.tolist(), strict=True):
                    of_lang = sums.setdefault(langs.dictionary[k >> 48].as_py(), {})
                    k &= (1 << 48) - 1
                    of_lang[k] = of_lang.get(k, 0) + t
        text = list(names)
        for lang, part in sums.items():
            keys = list(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([text[k >> 24] for k in keys], pa.string()),
                 pa.array([text[k & 0xFFFFFF] for k in keys], pa.string()), pa.array(list(part.values()), pa.int64())], ["lang", "a", "b", "v"])

    return rows.select("lang", "of").mapInArrow(run, "lang string, a string, b string, v long")


def _one_sided(histograms: DataFrame) -> DataFrame:
    """(lang, a, b, v): V f(b, b') for both orders, and for the terms of ``a`` what f(p, b') adds to that, in both orders."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                p, n = (np.array([h[c] for h in r["hist"] or []], np.int64) for c in ("p", "k"))
                rest = [x for x in r["others"] if x["source"] != r["source"]]
                a, b, v = [], [], []
                for o in rest:
                    base = int(_distance(np.int64(r["b"]), np.int64(o["b"])))
                    more = int((n * (_distance(p, np.int64(o["b"])) - base)).sum())
                    a += [r["source"], o["source"]]
                    b += [o["source"], r["source"]]
                    v += [r["v"] * base + more, more]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["lang"]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.int64())],
                    ["lang", "a", "b", "v"])

    return histograms.mapInArrow(run, "lang string, a string, b string, v long")


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    kept = stage(counts(read).filter(F.col("df") >= least), "terms")
    langs = stage(groups(read, kept), "groups")
    bad = F.assert_true(F.col("total") < 9_000_000_000_000_000, F.lit("too many terms for exact 64-bit arithmetic"))
    langs = langs.filter(bad.isNull())
    total = F.aggregate("of", F.lit(0).cast("long"), lambda s, o: s + o["n"])
    met = kept.join(langs.select("lang", F.col("total").alias("_t"), F.col("of").alias("_g")), "lang")
    rows = stage(met.select(
        "lang", "term", probability(total, F.col("_t")).alias("q"),
        F.transform("of", lambda o: F.struct(
            o["source"].alias("source"), probability(o["n"], F.col("_g")[o["source"]]["total"]).alias("p"), F.col("_g")[o["source"]]["b"].alias("b"))).alias("of")), "rows")

    single = rows.select("lang", "term", "q", F.explode("of").alias("o")).select("lang", F.col("o.source").alias("source"), "term", "q", F.col("o.p").alias("p"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = single.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= ranks)

    bins = single.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    hist = bins.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("hist"))
    others = F.transform(F.map_entries("of"), lambda e: F.struct(e["key"].alias("source"), e["value"]["b"].alias("b")))
    every = langs.select("lang", "v", others.alias("others")).withColumn("o", F.explode("others")).select(
        "lang", "v", "others", F.col("o.source").alias("source"), F.col("o.b").alias("b"))
    edges = _one_sided(every.join(hist, ["lang", "source"], "left").select("lang", "source", "v", "b", "others", "hist"))
    both = _pairs(rows)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    pairs = edges.unionByName(both).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
