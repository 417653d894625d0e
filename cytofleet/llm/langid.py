"""Language identification by string kernels, Nyström landmarks and one-versus-rest kernel ridge regression.

Kernel: the blended-spectrum presence kernel. A text is the set of its letter n-grams of one to ``GRAMS`` characters
(lower case; anything but a letter is one blank), and the kernel of two texts is the number of common n-grams over the
geometric mean of the two set sizes.

Landmarks are ``landmarks`` training texts per language. Their n-grams form the vocabulary; a text's kernel row is one
product of its presence vector with the landmark matrix, so texts are scored in batches by matrix products. The
Nyström map whitens the landmark kernel, and ridge regression is solved on it for each language against the rest.

Learning uses at most ``sample`` labelled texts per language, in hash order of the id (whole texts): a bounded set.
What is broadcast is the landmark matrix: languages x landmarks columns, and at most the n-grams of that many
texts as rows, cut to the ``VOCABULARY`` that most landmarks share.

Defined cases: ``und`` with score 0 for a null text, a text without letters, or if no label could be learnt; null
labels are ignored; repeated rows are predicted row by row; an empty table gives no rows; equal scores go to the first
language in alphabetical order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cytofleet.llm.common import texts

GRAMS = 3
#: Rows of the landmark matrix.
VOCABULARY = 30_000
_BATCH = 64


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    vocabulary: np.ndarray   # sorted n-gram codes
    landmarks: np.ndarray    # vocabulary x landmarks, presence over root of set size
    weights: np.ndarray      # landmarks x languages
    offset: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank; astral letters keep their own code."""
    table = np.full(0x110000, 32, np.int64)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    for c in range(0x20000, 0x34000):
        if chr(c).isalpha():
            table[c] = c
    return table


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram codes; empty if the text has no letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = codes != 32
    if not keep.any():
        return np.empty(0, np.int64)
    keep[1:] |= keep[:-1]  # one blank after each run of letters
    c = np.concatenate([[32], codes[keep]])
    # n-grams of n characters, 21 bits each, n in the top bits by construction (no code point is zero)
    out = [np.unique(c)]
    for n in range(2, GRAMS + 1):
        g = c[:c.size - n + 1].copy()
        for k in range(1, n):
            g = (g << 21) | c[k:c.size - n + 1 + k]
        out.append(np.unique(g))
    return np.concatenate(out)


def kernel_rows(sets: list[np.ndarray], vocabulary: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each set with each landmark, as one matrix product."""
    present = np.zeros((len(sets), vocabulary.size), np.float32)
    for i, s in enumerate(sets):
        if s.size and vocabulary.size:
            at = np.searchsorted(vocabulary, s)
            at[at == vocabulary.size] = 0
            present[i, at[vocabulary[at] == s]] = 1.0 / np.sqrt(s.size)
    return present @ landmarks


def solve(sets: list[np.ndarray], labels: list[str], per_language: int, ridge: float) -> Model:
    """Landmarks, Nyström map and ridge weights from training sets, in their order."""
    languages = tuple(sorted(set(labels)))
    of = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(of == k)[:per_language] for k in range(len(languages))])
    codes, holders = np.unique(np.concatenate([sets[i] for i in chosen]), return_counts=True)
    if codes.size > VOCABULARY:
        codes = np.sort(codes[np.lexsort((codes, -holders))[:VOCABULARY]])
    marks = np.zeros((codes.size, chosen.size), np.float32)
    for j, i in enumerate(chosen):
        at = np.searchsorted(codes, sets[i])
        at[at == codes.size] = 0
        marks[at[codes[at] == sets[i]], j] = 1.0 / np.sqrt(sets[i].size)
    own = kernel_rows([sets[i] for i in chosen], codes, marks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))
    k = np.concatenate([kernel_rows(sets[a:a + _BATCH], codes, marks) for a in range(0, len(sets), _BATCH)]).astype(float)
    phi = k @ root
    y = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    centre, level = phi.mean(0), y.mean(0)
    gram = (phi - centre).T @ (phi - centre) + ridge * np.eye(root.shape[1])
    w = np.linalg.solve(gram, (phi - centre).T @ (y - level))
    return Model(languages, codes, marks, (root @ w).astype(np.float32), (level - centre @ w).astype(np.float32))


def train(docs: DataFrame, sample: int = 300, landmarks: int = 40, ridge: float = 0.1) -> Model | None:
    """Fit on at most ``sample`` texts per language of ``docs`` (doc_id, text, lang); None without labels."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), "lang")
    # ids only; each task keeps the first rows per language before the shuffle
    picked = ids.select("_id", "lang", F.row_number().over(order).alias("_n")).filter(
        F.col("_n") <= sample).select("_id", F.col("lang").alias("_lang"), "_n")
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(picked), "_id").select(
        F.col("_id").cast("long").alias("_id"), "_n", "_lang", "text")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, raw in texts(batches):
            sets = [grams((t or b"").decode("utf-8", "replace")).tobytes() for t in raw]
            yield pa.RecordBatch.from_arrays(
                [part.column("_n"), part.column("_id"), part.column("_lang"), pa.array(sets, pa.binary())],
                ["_n", "_id", "_lang", "grams"])

    def fit(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        got = [(r["_lang"], np.frombuffer(r["grams"], np.int64)) for b in batches for r in b.to_pylist() if r["grams"]]
        if got:
            model = solve([g for _, g in got], [x for x, _ in got], landmarks, ridge)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.mapInArrow(extract, "_n int, _id long, _lang string, grams binary")
    out = made.repartition(1).sortWithinPartitions("_n", "_lang", "_id", "grams").mapInArrow(fit, "model binary").collect()
    if not out:
        return None
    import pickle

    return pickle.loads(out[0]["model"])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = held.value
        for part, raw in texts(batches, "_text"):
            names, scores = ["und"] * len(raw), np.zeros(len(raw))
            for lo in range(0, len(raw) if m else 0, _BATCH):
                sets = [grams((t or b"").decode("utf-8", "replace")) for t in raw[lo:lo + _BATCH]]
                margin = kernel_rows(sets, m.vocabulary, m.landmarks) @ m.weights + m.offset
                best = margin.argmax(1)
                odds = np.exp(3.0 * (margin - margin.max(1, keepdims=True)))
                for i, s in enumerate(sets):
                    if s.size:
                        names[lo + i], scores[lo + i] = m.languages[best[i]], 1.0 / odds[i].sum()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"_{i}") for i in range(len(keep))), pa.array(names), pa.array(scores)],
                [*(f"_{i}" for i in range(len(keep))), "lang_pred", "score"])

    done = source.mapInArrow(run, kinds + "lang_pred string, score double")
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
