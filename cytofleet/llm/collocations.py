"""Phrase collocations by best-first branch-and-bound growth.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. All is
per language (null: ``und``): n counts all words, f(phrase) its contiguous occurrences inside pieces, overlaps included. A
candidate has 2 to ``longest`` words and a = f >= ``least``; a cut after k words gives l = f(first part), r = f(rest) and
floor(1000 a n / (l r)); its score is the lowest of its cuts, ties to the smallest k. A candidate inside a longer
candidate that occurs as often is dropped. The ``top`` best of every language are returned by score, a, phrase.

Bound: a <= r, so a cut behind a proper prefix p scores at most floor(1000 n / f(p)), and so does every phrase that grows
from p; the same holds for proper suffixes. Best first therefore means rarest first: a round with the limit ``cap`` grows
all phrases whose proper prefixes have f <= cap, and all whose proper suffixes have; a phrase in both sets gets its
exact score from the counts met on the way. What a round leaves out scores floor(1000 n / (cap + 1)) at most. A
language is settled once its ``top``-th surviving score lies above that, or nothing is left out; otherwise the limit rises to
what settles it, but at most to the next share of all occurrences (1/16, 1/4, all). So there are at most three rounds.

A round counts one length after the other over the encoded corpus (hashes of words with f >= least, zero elsewhere, written
once). Bit tables of fixed size over the open prefixes and suffixes keep most other phrases out; equi-joins
then decide exactly. Counts are combined in the tasks before they are shuffled, so a hot language or word is
no hot key. Word hashes have 64 bits; two words of a language that share one lead to another seed, so counts are exact.

Defined cases: null and empty texts have no words; fewer candidates than ``top`` are returned all; repeated rows count as
often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cytofleet.llm.common import bit_table, held, stage, texts, unstage

#: Occurrences that the first round takes in at least.
BATCH = 1_000_000
SHARES = (16, 4, 1)
#: Phrases and words that a task holds before it counts them.
HELD, KNOWN = 2_000_000, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, with ``.`` between its pieces (no word has one)."""
    return (text or b"").translate(_LOWER).replace(b"\n", b" . ").split()


def lang_hash(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode(), 1)


def chain(ids: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """At every position, the hash of the ``k`` words from there on, with their language."""
    m = max(0, ids.size - k + 1)
    return mixed([ids[i:i + m] for i in range(k)], lang[:m])


def mixed(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    out = lang.copy()
    for w in words:
        out = (out ^ w) * _BASE
        out ^= out >> np.uint64(29)
    return out * _BASE


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, g, f): every word of every language, its hash, its hash with the language, and its occurrences."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        met: dict[str, Counter] = {}

        def out():
            for lang, c in met.items():
                c.pop(b".", None)
                h = np.fromiter((digest(w, seed) or 1 for w in c), np.uint64, len(c))
                g = chain(h, np.full(h.size, lang_hash(lang), np.uint64), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(h.view(np.int64)), pa.array(list(c), pa.binary()).cast(pa.string()),
                     pa.array(g.view(np.int64)), pa.array(np.fromiter(c.values(), np.int64, len(c)))], ["lang", "h", "word", "g", "f"])
            met.clear()

        for part, raw in texts(batches):
            for lang, t in zip(part.column("lang").to_pylist(), raw, strict=True):
                met.setdefault(lang, Counter()).update(tokens(t))
            if sum(map(len, met.values())) > KNOWN:
                yield from out()
        yield from out()

    found = docs.mapInArrow(run, "lang string, h long, word string, g long, f long")
    return found.groupBy("lang", "h", "word", "g").agg(F.sum("f").alias("f"))


def encode(docs: DataFrame, frequent: DataFrame, seed: int) -> DataFrame:
    """(lang, ids): the texts as word hashes, zero for words outside ``frequent`` and between pieces and texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(frequent.select(F.col("h").alias("g"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        table, digest, known = np.frombuffer(wanted.value, np.uint8), xxhash.xxh64_intdigest, {b".": 0}
        for part, raw in texts(batches):
            lists = [[*tokens(t), b"."] for t in raw]
            met = set().union(*lists)
            if len(known) > KNOWN:
                known = {}
            new = list(met.difference(known))
            h = np.fromiter((digest(w, seed) or 1 for w in new), np.uint64, len(new))
            h[~held(table, h)] = 0
            known.update(zip(new, h.tolist(), strict=True))
            known[b"."] = 0
            size = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, int(size.sum()))
            # runs of zeros shrink to one
            stay = np.r_[True, (ids[1:] != 0) | (ids[:-1] != 0)][:ids.size]
            ends = np.cumsum(stay)[np.cumsum(size) - 1]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids[stay].view(np.int64)))],
                ["lang", "ids"])

    return docs.mapInArrow(run, "lang string, ids array<long>").filter("size(ids) > 1")


def distinct_rows(columns: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, count) of each distinct row; rows are sorted by their hash ``g``, or in full where hashes clash."""
    order = np.argsort(g, kind="stable")
    same_g = g[order][1:] == g[order][:-1]
    same = same_g.copy()
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    if (same != same_g).any():
        order = np.lexsort(columns)
        same = np.ones(max(0, g.size - 1), bool)
        for c in columns:
            same &= c[order][1:] == c[order][:-1]
    first = np.flatnonzero(np.r_[True, ~same]) if g.size else np.zeros(0, np.int64)
    return order[first], np.diff(np.r_[first, g.size])


def phrase_counts(encoded: DataFrame, k: int, prefixes: bytes, suffixes: bytes, least: int) -> DataFrame:
    """(lang, g, w, f) of phrases of ``k`` words with f >= least whose first or last k - 1 words are in the bit tables."""
    shared = encoded.sparkSession.sparkContext.broadcast((prefixes, suffixes))
    words = [f"w{i}" for i in range(k)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        before, behind = (np.frombuffer(b, np.uint8) for b in shared.value)
        codes: dict[str, int] = {}
        kept: list[tuple] = []

        def out():
            columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
            kept.clear()
            g, at = columns[0], columns[1:]
            rows, n = distinct_rows(at, g)
            names = pa.array(list(codes), pa.string())
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(at[0][rows])), pa.array(g[rows].view(np.int64)), *(pa.array(c[rows].view(np.int64)) for c in at[1:]), pa.array(n)],
                ["lang", "g", *words, "f"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                langs = part.column("lang").to_pylist()
                code = np.array([codes.setdefault(x, len(codes)) for x in langs], np.int64)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                size = np.diff(lists.offsets.to_numpy())
                seeds = np.array([lang_hash(x) for x in langs], np.uint64)
                lang = np.repeat(seeds, size)
                m = ids.size - k + 1
                if m < 1:
                    continue
                ok = np.ones(m, bool)
                for i in range(k):
                    ok &= ids[i:i + m] != 0
                shorter = chain(ids, lang, k - 1)
                at = np.flatnonzero(ok)
                at = at[held(before, shorter[at]) | held(behind, shorter[at + 1])]
                if at.size:
                    found = [ids[at + i] for i in range(k)]
                    kept.append((mixed(found, lang[at]), np.repeat(code, size)[at], *found))
                    if sum(x[0].size for x in kept) > HELD:
                        yield out()
        if kept:
            yield out()

    found = encoded.mapInArrow(run, "lang string, g long, " + ", ".join(f"{w} long" for w in words) + ", f long")
    total = found.groupBy("lang", "g", *words).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return total.select("lang", "g", F.array(*words).alias("w"), "f")


def grow(encoded: DataFrame, level: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """The levels of one round, from ``level`` (single words with their ``cap``) on.

    Rows are lang, g, w, f, cap, ``l`` (counts of the proper prefixes, shortest first; null if one is over the cap) and
    ``r`` (the same of the suffixes).
    """
    levels = [level]
    for k in range(2, longest + 1):
        open_ = levels[-1].filter("f <= cap")
        before, behind = open_.filter("l IS NOT NULL"), open_.filter("r IS NOT NULL")
        tables = bit_table(before.select("g")), bit_table(behind.select("g"))
        if not any(map(any, tables)):
            break
        found = phrase_counts(encoded, k, *tables, least).withColumns({
            "_p": F.slice("w", 1, k - 1), "_s": F.slice("w", 2, k - 1)})
        p = before.select("lang", F.col("w").alias("_p"), F.concat("l", F.array("f")).alias("l"), F.col("cap").alias("_c"))
        s = behind.select("lang", F.col("w").alias("_s"), F.concat("r", F.array("f")).alias("r"), F.col("cap").alias("_d"))
        both = found.join(p, ["lang", "_p"], "left").join(s, ["lang", "_s"], "left").filter("l IS NOT NULL OR r IS NOT NULL")
        levels.append(stage(both.select("lang", "g", "w", "f", F.coalesce("_c", "_d").alias("cap"), "l", "r"), f"phrases{k}"))
    return levels


def cut(a: int, n: int, left: list[int], right: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest cut; integers without a bound."""
    best = None
    for x, y in zip(left, reversed(right), strict=True):
        s = 1000 * a * n // (x * y)
        if best is None or s < best[0]:
            best = (s, x, y)
    return best


def scored(candidates: DataFrame) -> DataFrame:
    """(lang, w, a, n, cap, score, l, r) of candidates with both lists of counts."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            done = [cut(*x) for x in zip(*(b.column(c).to_pylist() for c in ("a", "n", "left", "right")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("lang", "w", "a", "n")), *(pa.array([d[i] for d in done], pa.int64()) for i in range(3))],
                ["lang", "w", "a", "n", "score", "l", "r"])

    return candidates.mapInArrow(run, "lang string, w array<long>, a long, n long, score long, l long, r long")


def survivors(levels: list[DataFrame], totals: DataFrame) -> DataFrame:
    """Scored candidates of a round that no longer candidate covers; every extension of one is in the next level."""
    parts = []
    for k, level in enumerate(levels[1:], 2):
        mine = level.filter("l IS NOT NULL AND r IS NOT NULL").select("lang", "w", F.col("f").alias("a"), F.col("l").alias("left"), F.col("r").alias("right"))
        if k < len(levels):
            longer = levels[k]
            over = longer.select("lang", F.slice("w", 1, k).alias("w"), "f").unionByName(longer.select("lang", F.slice("w", 2, k).alias("w"), "f"))
            most = over.groupBy("lang", "w").agg(F.max("f").alias("_m"))
            mine = mine.join(most, ["lang", "w"], "left").filter("_m IS NULL OR _m < a").drop("_m")
        parts.append(mine)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return scored(whole.join(totals.select("lang", "n"), "lang").select("lang", "w", "a", "n", "left", "right"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, batch: int = BATCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of every language."""
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for seed in range(42, 52):
        words = stage(word_counts(read, seed), "words")
        frequent = words.filter(F.col("f") >= least)
        clash = words.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("k"), F.max("f").alias("f")).filter((F.col("k") > 1) & (F.col("f") >= least))
        if clash.isEmpty():
            break
        unstage(words)
    else:
        raise RuntimeError("words share hashes under ten seeds")
    encoded = stage(encode(read, frequent, seed), "encoded")
    totals = stage(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    # occurrences of all words up to a frequency; at most about sqrt(2 n) different ones
    steps = frequent.groupBy("lang", "f").agg(F.sum("f").alias("o"))
    upto = Window.partitionBy("lang").orderBy("f")
    ladder = stage(steps.select(
        "lang", "f", F.sum("o").over(upto).alias("seen"), F.sum("o").over(Window.partitionBy("lang")).alias("all")), "ladder")

    state = totals.select("lang", "n", F.lit(None).cast("long").alias("ceiling"))
    done = []
    for share in SHARES:
        goal = F.least("all", F.greatest(F.lit(batch), F.ceil(F.col("all") / share)))
        caps = ladder.groupBy("lang").agg(F.min(F.when(F.col("seen") >= goal, F.col("f"))).alias("step"), F.max("f").alias("most"))
        state = stage(state.join(caps, "lang").withColumn("cap", F.least("step", "ceiling")), "state")
        none = F.array().cast("array<long>")
        start = frequent.join(state.select("lang", "cap"), "lang").select("lang", "g", F.array("h").alias("w"), "f", "cap", none.alias("l"), none.alias("r"))
        levels = grow(encoded, start, longest, least)
        if len(levels) == 1:
            break
        found = stage(survivors(levels, state), "survivors")
        for level in levels[1:]:
            unstage(level)
        order = Window.partitionBy("lang").orderBy(F.desc("score"))
        best = found.select("lang", "score").withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= top)
        lowest = best.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("t"))
        big = lambda c: F.col(c).cast("decimal(19,0)")
        # what the round left out scores floor(1000 n / (cap + 1)) at most
        below = (F.col("k") >= top) & (F.lit(1000).cast("decimal(4,0)") * big("n") < big("t") * (big("cap") + 1))
        now = stage(state.join(lowest, "lang", "left").withColumn("settled", (F.col("cap") >= F.col("most")) | F.coalesce(below, F.lit(False))), "now")
        ready = now.filter("settled").select("lang", F.when(F.col("k") >= top, F.col("t")).alias("_t"))
        done.append(found.join(ready, "lang").filter("_t IS NULL OR score >= _t").drop("_t"))
        state = now.filter("NOT settled").select(
            "lang", "n", F.when(F.col("k") >= top, F.floor(F.col("n") * 1000 / F.greatest(F.col("t"), F.lit(1))) + 1).cast("long").alias("ceiling"))
        if state.isEmpty():
            break
    if not done:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    named = whole.select("*", F.posexplode("w").alias("_i", "h")).join(frequent.select("lang", "h", "word"), ["lang", "h"])
    parts = F.sort_array(F.collect_list(F.struct("_i", "word")))
    told = named.groupBy("lang", "w", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
