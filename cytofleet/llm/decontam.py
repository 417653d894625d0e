"""Benchmark decontamination: spaced word pairs as seeds, then Smith-Waterman alignment.

Texts are compared as lower-case letter-digit words. Steps:

1. the seeds of an item are all its pairs of words at distance one or two; documents are scanned for pairs of the same
   words at distance one or two;
2. an item and a stretch of a document are aligned if the stretch has as many seeds within the reach of an alignment as
   any alignment over the threshold must have (below), so no such alignment is lost;
3. they are aligned locally (match 2, mismatch and gap -1). A pair is a leak if the score is ``threshold`` of the
   best possible one, or more. Substituted, inserted and dropped words lower it a little.

The bound: let an alignment of an item of L words have m matches, and let c be what lies between two neighbouring
matches at distances d and e in item and document: it costs max(d, e) - 1 or more. 2m - sum(c) >= 2tL leaves at most m - tL
gaps with c >= 2, so at least tL - 1 of the m - 1 neighbours are seeds; and it spans at most (3 - 2t)L words.

Items are taken in blocks of at most ``BLOCK`` words, each broadcast with its seeds; documents are scanned once per
block and never shuffled, only the leaks are.

Defined cases: null and empty texts match nothing; an item with fewer than ``n`` words, or one of which a single matching
word would pass, matches only where its whole text is quoted; null ids of documents and items are ids of their own; each text
of a repeated item id is an item, and the id is reported once per document; repeated rows of an id give one row
per item; of several alignments the best is kept, then the first one; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytofleet.llm.common import BITS, held, texts

#: Words of the items that are broadcast together.
BLOCK = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or b"").decode("utf-8", "replace").lower().encode("utf-8", "replace"))


def combined(h: np.ndarray, places: Iterable[int]) -> np.ndarray:
    """At every position the hash of the words at the ``places`` after it."""
    places = list(places)
    size = max(0, h.size - places[-1])
    out = h[:size].copy()
    for k in places[1:]:
        out = out * _BASE + h[k:k + size]
    return (out ^ (out >> np.uint64(32))) * _BASE


class Grams:
    """n-gram hashes of a text, with a bounded table of known words."""

    def __init__(self, n: int, limit: int = 300_000):
        import xxhash

        self.n, self.limit, self.known, self.digest = n, limit, {}, xxhash.xxh64_intdigest

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """One hash per word."""
        if len(self.known) > self.limit:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.digest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return combined(self.hashes(words), range(self.n))


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-id arrays: score, first passage word, end (exclusive)."""
    m = passage.size
    place = np.arange(m)
    score, start = np.zeros(m, np.int64), place.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = np.r_[0, score[:-1]] + np.where(passage == word, 2, -1)
        came = np.r_[0, start[:-1]]
        came[1:][score[:-1] == 0] = place[1:][score[:-1] == 0]
        up = score - 1
        take = np.maximum(np.maximum(diagonal, up), 0)
        first = np.where(take == 0, place, np.where(take == diagonal, came, start))
        lifted = take + place  # a gap of one costs one
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, place, 0))
        score, start = top - place, first[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at + 1)
    return best


class Items:
    """A block of items, their seeds, and the search for them in one document."""

    def __init__(self, words: list[list[bytes]], n: int, threshold: float):
        hashes = Grams(1).hashes
        self.threshold, self.words = threshold, [hashes(w) for w in words]
        size = np.array([len(w) for w in words], np.int64)
        whole = (size < n) | (size * threshold <= 1)
        self.least = np.array([max(1, math.ceil(threshold * k - 1 - 1e-9)) for k in size], np.int64)
        self.span = np.array([math.ceil((3 - 2 * threshold) * k + 1e-9) for k in size], np.int64)
        seeds = [np.unique(np.r_[combined(h, (0, 1)), combined(h, (0, 2))]) if not w else np.empty(0, np.uint64) for h, w in zip(self.words, whole, strict=True)]
        key, item = np.concatenate(seeds), np.repeat(np.arange(size.size), [x.size for x in seeds])
        order = np.argsort(key, kind="stable")
        self.item = item[order]
        self.key, first = np.unique(key[order], return_index=True)
        self.first = np.r_[first, key.size]
        self.table = np.zeros(1 << (BITS - 3), np.uint8)
        slot = self.key >> np.uint64(64 - BITS)
        np.bitwise_or.at(self.table, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        #: words -> hash of a whole text -> its items
        self.quoted: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(whole):
            h = self.words[i]
            self.quoted.setdefault(h.size, {}).setdefault(int(combined(h, range(h.size))[0]), []).append(int(i))

    def stretches(self, h: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of every stretch that has seeds enough, in order; words are told by their ``place``."""
        at, key = [], []
        for d in (1, 2):
            pair = combined(h, (0, d))
            hits = np.flatnonzero(held(self.table, pair))
            k = np.minimum(np.searchsorted(self.key, pair[hits]), self.key.size - 1)
            same = self.key[k] == pair[hits] if self.key.size else np.zeros(0, bool)
            at.append(hits[same])
            key.append(k[same])
        at, key = np.concatenate(at), np.concatenate(key)
        if not at.size:
            return
        many = self.first[key + 1] - self.first[key]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # a position counts once per item
        total = int(place[-1]) + 1
        code = np.unique(self.item[np.repeat(self.first[key], many) + inside] * total + np.repeat(place[at], many))
        item, at = code // total, code % total
        last = np.arange(code.size) + self.least[item] - 1
        inner = np.minimum(last, code.size - 1)
        good = np.flatnonzero((last < code.size) & (item[inner] == item) & (at[inner] - at < self.span[item]))
        open_ = None
        for i, lo, hi in zip(item[good].tolist(), (at[good] - self.span[item[good]]).tolist(), (at[inner[good]] + self.span[item[good]] + 2).tolist(), strict=True):
            if open_ and open_[0] == i and lo <= open_[2]:
                open_ = (i, open_[1], hi)
                continue
            if open_:
                yield open_
            open_ = (i, lo, hi)
        if open_:
            yield open_

    def enough(self, i: int, part: np.ndarray) -> bool:
        """Whether as many words of the item start a seed that the stretch has: every neighbour starts at another word."""
        has, h = np.r_[combined(part, (0, 1)), combined(part, (0, 2))], self.words[i]
        starts = np.isin(combined(h, (0, 1)), has)
        starts[:-1] |= np.isin(combined(h, (0, 2)), has)
        return starts.sum() >= self.least[i]

    def find(self, texts: list[np.ndarray], known: dict) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, start, end) of every stretch over the threshold; ``known`` keeps alignments."""
        for size, quoted in self.quoted.items():
            for k, h in enumerate(texts):
                seen, first = np.unique(combined(h, range(size)), return_index=True)
                for g in quoted.keys() & set(seen.tolist()):
                    at = int(first[np.searchsorted(seen, np.uint64(g))])
                    for i in quoted[g]:
                        yield k, i, 1.0, at, at + size
        # texts are searched together; a gap of two words that are in no item, and of a span in their places, keeps them apart
        gap = np.array([0, 1], np.uint64)
        sizes = np.array([h.size for h in texts], np.int64)
        begin = np.cumsum(sizes + 2) - sizes - 2
        apart = int(self.span.max(initial=0)) * 2 + 4
        h = np.concatenate([x for t in texts for x in (t, gap)])
        place = np.arange(h.size) + np.repeat(np.arange(sizes.size) * apart, sizes + 2)
        origin = begin + np.arange(sizes.size) * apart
        for i, lo, hi in self.stretches(h, place):
            # the seeds lie a span behind ``lo``, in one text
            k = int(np.searchsorted(origin, min(lo + int(self.span[i]), hi), side="right")) - 1
            lo, hi = max(0, lo - int(origin[k])), min(int(sizes[k]), hi - int(origin[k]))
            part = texts[k][lo:hi]
            key = (i, part.tobytes())
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = align(part, self.words[i]) if self.enough(i, part) else (0, 0, 0)
            score, start, end = known[key]
            if score >= 2 * self.threshold * self.words[i].size:
                yield k, i, score / (2 * self.words[i].size), lo + start, lo + end


def leaks(docs: DataFrame, items: DataFrame, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start, end) of every leaked item; start and end count words of the document.

    ``items`` has item_id and text; items with fewer than ``n`` words have to be quoted as a whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    key, label = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    kind = to_arrow_type(items.schema["item_id"].dataType)
    columns = f"doc_id {key}, item_id {label}, score double, start long, end long"

    def scan(ids: list, words: list[list[bytes]]) -> DataFrame:
        block = spark.sparkContext.broadcast((ids, words))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            ids, words = block.value
            search, hashes, known = Items(words, n, threshold), Grams(1).hashes, {}
            for part, raw in texts(batches):
                found = search.find([hashes(tokens(t)) for t in raw], known) if raw else ()
                row, item, score, start, end = zip(*rows, strict=True) if (rows := list(found)) else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array([ids[i] for i in item], kind), pa.array(score, pa.float64()),
                     pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, columns)

    found, ids, words, held = spark.createDataFrame([], columns), [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        w = tokens((r["text"] or "").encode())
        if not w:
            continue
        if ids and held + len(w) > BLOCK:
            found, ids, words, held = found.unionByName(scan(ids, words)), [], [], 0
        ids.append(r["item_id"])
        words.append(w)
        held += len(w)
    if ids:
        found = found.unionByName(scan(ids, words))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "end")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("score"), "b.start", "b.end")
