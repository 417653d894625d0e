"""Exact substring de-duplication with a sparse suffix array.

A byte goes if a string of ``window`` bytes that covers it starts at two or more places of the corpus. Sorting a suffix for every byte with ``window`` bytes of context would move hundreds of times the
corpus, so suffixes are sampled by content: every window of ``window`` bytes names one anchor, the leftmost of
its ``GRAM``-byte strings with the smallest hash. Equal windows name anchors at the same offset, with the same
leading bytes. A run of windows with one anchor is a block, about one per 170 bytes:

1. one scan emits a row per block: hash of the anchor's leading bytes, hash of the whole block, place;
2. anchors whose leading bytes occur once are done. If all blocks of an anchor are equal, they go whole;
3. of the rest, each distinct block is kept once (so a hot group of copies is one row), its bytes are fetched,
   and splitters sampled by Spark range-partition the suffixes by their leading bytes. Each bucket sorts the
   windows of its blocks by multikey quicksort: sort on one 64-byte token, and go on to the next token in runs
   of equal ones only. Equal neighbours after the last token are repeated strings;
4. the ranges are joined back to all copies of a block, merged per document, and cut out.

Comparison across bucket boundaries: a range partitioner never parts equal leading bytes, so equal
windows always share a bucket. A leading string with more than ``GROUP`` distinct blocks is not given to one
task: its windows are hashed and counted with map-side sums instead, which yields the same ranges for any size.

Strings are compared by two 64-bit hashes (blocks) or seven (windows); raw bytes decide nothing else. Two rows of
the same id and text are two documents, each a copy of the other. A null text counts as empty; a null id is an
id of its own; texts shorter than ``window`` bytes never lose anything; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cytofleet.llm.common import stage, texts

GRAM = 64
#: Distinct blocks of one leading string that a task sorts; more are counted by hash.
GROUP = 20_000
#: Window starts that are scanned at a time, which bounds the memory for very long texts.
SEGMENT = 1 << 17
#: Bytes of blocks that are sorted at a time.
CHUNK = 2 << 20
#: Windows that are sorted at a time.
AT_ONCE = 1 << 20


@functools.cache
def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes, powers of an odd base modulo 2**64, and powers of its inverse."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 64, 256, np.uint64)
    base = int(rng.integers(0, 1 << 62)) * 4 + 3
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up[1:], down[1:] = base, inverse
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return values, up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a byte array of at most ``SEGMENT`` + 2 * ``CHUNK`` bytes."""

    def __init__(self, data: np.ndarray, seed: int):
        values, up, self.down = _tables(seed, SEGMENT + 2 * CHUNK)
        self.sums = np.empty(data.size + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values[data] * up[:data.size], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        h = self.sums[length:] - self.sums[:-length]
        h *= self.down[:h.size]
        return _mix(h)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def blocks(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one text: first window start, anchor minus start, last start minus first, both hashes."""
    out = []
    span = window - GRAM + 1
    for lo in range(0, data.size - window + 1, SEGMENT):
        part = data[lo:lo + SEGMENT + window - 1]
        one, two = Rolling(part, 1), Rolling(part, 2)
        gram = one.all(GRAM)
        key = ((gram >> np.uint64(20)) << np.uint64(20)) | np.arange(gram.size, dtype=np.uint64)
        windows = part.size - window + 1
        width = -(-gram.size // span) * span
        grid = np.full(width, np.iinfo(np.uint64).max, np.uint64)
        grid[:gram.size] = key
        grid = grid.reshape(-1, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], windows] - 1
        at, length = anchor[first] - first, last - first
        whole = _mix(two.of(first, last + window) + (at * 1024 + length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((first + lo, at, length, gram[anchor[first]], whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def equal_windows(lead: np.ndarray, start: np.ndarray, token: np.ndarray, window: int) -> np.ndarray:
    """Marks the windows that equal another one, by multikey quicksort.

    ``lead`` is the first key; the next ones are ``token[start + k]`` for steps k that cover the window.
    """
    steps = [*range(0, window - GRAM, GRAM), window - GRAM]
    order = np.argsort(lead)
    run = lead[order]
    for depth in range(len(steps) + 1):
        new = np.r_[True, run[1:] != run[:-1]]
        if depth:
            new[1:] |= tok[1:] != tok[:-1]
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if number.size else np.zeros(0, bool)
        order, run = order[keep], number[keep]
        if depth == len(steps) or not order.size:
            break
        tok = token[start[order] + steps[depth]]
        by = np.lexsort((tok, run))
        order, run, tok = order[by], run[by], tok[by]
    hit = np.zeros(lead.size, bool)
    hit[order] = True
    return hit


def _ranges(hit: np.ndarray) -> np.ndarray:
    """Packed runs of marked window starts: first * 1024 + last."""
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return np.flatnonzero(edge == 1) * 1024 + np.flatnonzero(edge == -1) - 1


def _place(col: str) -> tuple[Column, Column, Column]:
    c = F.col(col)
    return F.shiftright(c, 20), F.shiftright(c, 10).bitwiseAND(1023), c.bitwiseAND(1023)


def repeated(docs: DataFrame, window: int = 400, group: int | None = None) -> DataFrame:
    """(id, th, spans) for every document with repeated strings; ``docs`` has id, th and binary ``text``.

    ``spans`` is an unordered array of struct<a, b>: byte ranges, b exclusive, that may overlap.
    """
    if not 2 * GRAM <= window <= 1000:
        raise ValueError("the window must lie between 128 and 1000 bytes")
    group = GROUP if group is None else group
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, raw in texts(batches):
            rows, found = [], []
            for k, t in enumerate(raw):
                if t is not None and len(t) >= window:
                    found.append(blocks(np.frombuffer(t, np.uint8), window))
                    rows.append(np.full(found[-1][0].size, k))
            if found:
                first, at, length, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("th").take(take),
                     pa.array(first << 20 | at << 10 | length), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    ["id", "th", "place", "h1", "h2"])

    anchors = stage(docs.mapInArrow(scan, f"id {kind}, th long, place long, h1 long, h2 long"), "anchors")
    twice = anchors.groupBy("h1").agg(
        F.count(F.lit(1)).alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("n > 1")
    # read from files, so that both sides of the join are plain exchanges and a hot string can be split
    twice = stage(twice.select("h1", (F.col("lo") != F.col("hi")).alias("mixed")), "twice")
    shared = stage(anchors.join(twice, "h1"), "shared")
    even = shared.filter("not mixed").select("id", "th", "place", F.lit(None).cast("array<long>").alias("ranges"))

    distinct = shared.filter("mixed").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id"), F.col("th"), F.col("place"))).alias("one"))
    distinct = stage(distinct, "distinct")
    sizes = stage(distinct.groupBy("h1").agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("least")), "sizes")
    wanted = stage(distinct.join(sizes, "h1"), "wanted")
    first, at, length = _place("place")
    fetch = wanted.filter("least = 1").select("one.*", "h1", "h2", "n", "blocks").withColumnsRenamed({"id": "_i", "th": "_t"})
    body = docs.join(fetch, docs["id"].eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select(
        "h1", "h2", "n", "blocks", at.cast("int").alias("at"), (length + 1).cast("int").alias("windows"),
        F.substring("text", (first + 1).cast("int"), (length + window).cast("int")).alias("block"))
    # repeated rows of one id and text fetch a block twice
    body = stage(body.dropDuplicates(["h1", "h2"]), "blocks")

    def bucket(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(held: list[tuple]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(r[5] for r in held), np.uint8)
            offset = np.cumsum([0, *(len(r[5]) for r in held)])[:-1]
            at, windows = (np.array([r[k] for r in held]) for k in (3, 4))
            number = np.cumsum([0, *(held[k][0] != held[k - 1][0] for k in range(1, len(held)))])
            token = np.empty(max(0, data.size - GRAM + 1), np.uint64)
            for lo in range(0, token.size, CHUNK):
                token[lo:lo + CHUNK] = Rolling(data[lo:lo + CHUNK + GRAM - 1], 1).all(GRAM)
            hits = [np.zeros(w, bool) for w in windows]
            # equal windows have their anchor at one offset: slices of offsets can be sorted one after the other
            slices = max(1, int(windows.sum()) // AT_ONCE)
            for s in range(slices):
                row = np.repeat(np.arange(len(held)), windows)
                inner = np.arange(row.size) - np.repeat(np.cumsum(windows) - windows, windows)
                shift = at[row] - inner
                if slices > 1:
                    mine = shift % slices == s
                    row, inner, shift = row[mine], inner[mine], shift[mine]
                hit = equal_windows(number[row] * 1024 + shift, offset[row] + inner, token, window)
                row, inner = row[hit], inner[hit]
                cut = [*np.flatnonzero(np.diff(row, prepend=-1)), row.size]
                for a, b in zip(cut, cut[1:]):
                    hits[row[a]][inner[a:b]] = True
            own = [k for k, r in enumerate(held) if r[2] == 1 and hits[k].any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in own], pa.int64()), pa.array([held[k][1] for k in own], pa.int64()),
                 pa.array([_ranges(hits[k]) for k in own], pa.list_(pa.int64()))], ["h1", "h2", "ranges"])

        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "n", "at", "windows", "block")), strict=True):
                if size > CHUNK and r[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield flush(held)

    lead = F.substring("block", F.col("at") + 1, F.lit(GRAM))
    ordered = body.filter(F.col("blocks") <= group).repartitionByRange(lead, "h1").sortWithinPartitions(lead, "h1")
    sorted_ = ordered.select("h1", "h2", "n", "at", "windows", "block").mapInArrow(bucket, "h1 long, h2 long, ranges array<long>")

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for h1, h2, n, block in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "n", "block")), strict=True):
                w = Rolling(np.frombuffer(block, np.uint8), 3).all(window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(w.size, v, np.int64)) for v in (h1, h2, n)] + [pa.array(np.arange(w.size)), pa.array(w.view(np.int64))],
                    ["h1", "h2", "n", "inner", "w"])

    spread = body.filter(F.col("blocks") > group).mapInArrow(hashed, "h1 long, h2 long, n long, inner long, w long")
    common = spread.groupBy("h1", "w").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    counted = spread.filter("n = 1").join(common, ["h1", "w"]).groupBy("h1", "h2").agg(
        F.collect_set(F.col("inner") * 1024 + F.col("inner")).alias("ranges"))

    copied = wanted.filter("n > 1").select("h1", "h2", F.lit(None).cast("array<long>").alias("ranges"))
    verdict = copied.unionByName(sorted_).unionByName(counted)
    uneven = shared.filter("mixed").join(verdict, ["h1", "h2"]).select("id", "th", "place", "ranges")
    whole = F.array(F.struct(first.alias("a"), (first + length + window).alias("b")))
    some = F.transform("ranges", lambda r: F.struct(
        (first + F.shiftright(r, 10)).alias("a"), (first + r.bitwiseAND(1023) + window).alias("b")))
    spans = even.unionByName(uneven).select("id", "th", F.coalesce(some, whole).alias("spans"))
    return spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(docs: DataFrame, window: int = 400, group: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, kept (the bytes that stay) and removed (maximal runs, array<struct<a, b>>)."""
    source = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))
    spans = repeated(source, window, group).withColumnsRenamed({"id": "_i", "th": "_t"})
    both = source.join(spans, source["id"].eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left").select("id", "text", "spans")
    kind = source.schema["id"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, raw in texts(batches):
            kept, removed = [], []
            for t, spans in zip(raw, part.column("spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                ends = [0, *(x for r in runs for x in r), len(t)]
                kept.append(b"".join(t[ends[k]:ends[k + 1]] for k in range(0, len(ends), 2)))
                removed.append([{"a": a, "b": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                ["doc_id", "n_bytes", "kept", "removed"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, removed array<struct<a:bigint,b:bigint>>")
