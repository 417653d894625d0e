"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal training, sparse scoring.

A text is cut into letter-digit runs and symbol runs. One-, two- and three-grams of those tokens are hashed
into ``2**bits`` weights; a token that repeats its predecessor enters an n-gram as a back reference, so that
loops look alike whatever the looped word is. Counts are divided by their Euclidean norm.

Training is follow-the-regularised-leader, one document at a time in hash order, over a sample of at most
``sample`` labelled rows: a bounded stream that one task can take, whatever the size of the corpus. The model
is a weight vector of fixed size, broadcast to the scoring tasks. Scoring reads every whole text once,
without a shuffle.

Defined cases: a null text counts as empty; an empty text has no features and gets the score of the bias; null
labels are ignored; several labels of one document are averaged; repeated documents are scored row by row; an
empty corpus gives no rows; without any label all weights are zero and scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytofleet.llm.common import texts

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


class Hasher:
    """Token -> 64-bit hash, with a table that is emptied when it holds ``limit`` tokens."""

    def __init__(self, limit: int = 200_000):
        import re

        import xxhash

        self.limit, self.known = limit, {}
        self.hash = xxhash.xxh64_intdigest
        self.find = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+").findall

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = self.find(text)
        known, digest = self.known, self.hash
        if len(known) > self.limit:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = digest(t)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def features(text: bytes, hasher: Hasher, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-gram slots of a text and their normalised counts."""
    h = hasher(text or b"")
    if not h.size:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    back = h.copy()
    back[1:][h[1:] == h[:-1]] = _SAME
    with np.errstate(over="ignore"):
        grams = [h * _MIX]
        two = (back[:-1] * np.uint64(3) + back[1:]) * _MIX + np.uint64(1)
        grams.append(two * _MIX)
        grams.append(((two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(5) + back[2:]) * _MIX)
    slots = np.concatenate(grams) >> np.uint64(64 - bits)
    ids, counts = np.unique(slots.astype(np.int32), return_counts=True)
    values = counts.astype(np.float32)
    return ids, values / np.sqrt((values * values).sum())


def ftrl(
    rows: list[tuple[float, np.ndarray, np.ndarray]], bits: int, alpha: float, beta: float, l1: float, l2: float,
    epochs: int,
) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, slots, values); the last coordinate is the bias, which is not regularised."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    last = 1 << bits
    bias = 0.0
    for _ in range(epochs):
        for y, ids, x in rows:
            w = weights(ids)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            sq = n[ids]
            z[ids] += g - (np.sqrt(sq + g * g) - np.sqrt(sq)) / alpha * w
            n[ids] = sq + g * g
            g0 = p - y
            z[last] += g0 - (np.sqrt(n[last] + g0 * g0) - np.sqrt(n[last])) / alpha * bias
            n[last] += g0 * g0
            bias = -z[last] / ((beta + np.sqrt(n[last])) / alpha)
    return weights(np.arange(last)).astype(np.float32), float(bias)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 8_000, bits: int = 18, alpha: float = 1.0,
    beta: float = 1.0, l1: float = 0.02, l2: float = 0.0, epochs: int = 3,
) -> Model:
    """Fit on at most ``sample`` labelled documents, taken in hash order of the id.

    ``labels`` holds doc_id and quality (0 or 1), already restricted to the rows that may be learnt from.
    """
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.avg("quality").alias("_y"))
        .select(F.col("doc_id").alias("_id"), F.col("_y"), F.xxhash64("doc_id").alias("_h"))
        .orderBy("_h", "_id").limit(sample)
    )
    # the sample is bounded by its parameter, so its ids and labels may be broadcast
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(picked), "_id")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for part, raw in texts(batches):
            out = [features(t, hasher, bits) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [part.column("_h"), part.column("_id").cast(pa.int64()), part.column("_y"),
                 pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())],
                ["_h", "_id", "_y", "ids", "values"])

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = []
        for b in batches:
            for h, y, i, v in zip(*(b.column(c).to_pylist() for c in ("_h", "_y", "ids", "values")), strict=True):
                got.append((h, y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)))
        if got:
            w, b0 = ftrl([(float(y >= 0.5), i, v) for _, y, i, v in got], bits, alpha, beta, l1, l2, epochs)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b0])], ["w", "b"])

    parts = rows.select("_h", F.col("_id").cast("long").alias("_id"), F.col("_y"), "text").mapInArrow(
        extract, "_h long, _id long, _y double, ids binary, values binary")
    model = parts.repartition(1).sortWithinPartitions("_h", "_id", "ids").mapInArrow(fit, "w binary, b double").collect()
    if not model:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)
    return Model(np.frombuffer(model[0]["w"], np.float32), model[0]["b"], bits)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The ``keep`` columns of every document and its probability of label 1."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = held.value
        hasher = Hasher()
        for part, raw in texts(batches, "_text"):
            s = np.empty(len(raw))
            for k, t in enumerate(raw):
                ids, x = features(t, hasher, m.bits)
                s[k] = m.weights[ids] @ x + m.bias
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"_{i}") for i in range(len(keep))), pa.array(p)],
                [*(f"_{i}" for i in range(len(keep))), "_score"])

    done = source.mapInArrow(run, f"{kinds}, _score double")
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_score").alias(out))
