"""Quality rules under weak supervision.

Base counts per text (words are runs of anything but space and tab to carriage return): n_words, word_chars,
n_symbols, n_dup_lines, n_repeat_words; a text fails the base if it has fewer than 20 words or if more than 30 % of
its words lie in repeated 8-word windows.

Each rule of ``RULES`` compares one ratio with its limits: it votes for bad text beyond the one, for good text below the
other, and abstains between. Rules that look for one defect never vote for good text, since a text without that defect
may have others. How often a rule votes which way on good and on bad text (its accuracy) and the share of
good text are estimated from agreements and disagreements alone, by expectation-maximisation over the
histogram of vote patterns: there are at most ``3 ** len(RULES)`` patterns, however many documents there are, so
the histogram and the model have a fixed bound.
A text is kept if it passes the base and its posterior probability of being good is ``KEEP`` or more.

Defined cases: a null text has no words; texts without words fail the base; repeated rows count as often as they
occur; a pattern without any vote gets the prior; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytofleet.llm.common import stage, texts

#: Rule -> (largest ratio that votes good, smallest ratio that votes bad); -1: it never votes good.
RULES: dict[str, tuple[float, float]] = {
    "symbols": (-1, 0.20),          # symbols per word
    "repeats": (-1, 0.30),          # share of words in repeated 8-word windows
    "dup_lines": (-1, 0.40),        # share of repeated lines
    "capitals": (-1, 0.50),         # share of letters that are upper case
    "bare": (-1, 0.25),             # share of words without a letter
    "exclaims": (-1, 0.20),         # exclamation and question marks per word
    "monotony": (-1, 0.90),         # share of words that repeat an earlier one, scaled to 200 words
    "odd": (0.10, 0.50),            # share of words that are not letters with usual punctuation behind
}
KEEP = 0.5
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) word ids that occur twice or more; exact."""
    if ids.size <= window:
        return 0
    ranks, width = ids, 1
    while width < window:  # ranks of windows of twice the width, from pairs of ranks
        pair = ranks[:-width].astype(np.int64) * (int(ranks.max()) + 1) + ranks[width:]
        _, ranks = np.unique(pair, return_inverse=True)
        width *= 2
    often = np.bincount(ranks)[ranks] > 1
    if not often.any():
        return 0
    edge = np.zeros(ids.size + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts of one text and the ratios that the rules look at."""
    raw = text or b""
    words = raw.split()  # ASCII blanks only
    n = len(words)
    if not n:
        return (0,) * 5, (0.0,) * len(RULES)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(raw.count(bytes([c])) for c in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = repeat_words(ids)
    letters = joined.translate(None, _NOT_UPPER)
    lower = joined.translate(None, _NOT_LOWER)
    often = np.bincount(ids)
    bare = int(often[[i for w, i in known.items() if w.isascii() and not _LETTERS(w)]].sum())
    odd = int(often[[i for w, i in known.items() if not _PLAIN(w)]].sum())
    ratios = (
        symbols / n, repeated / n, dup / len(lines), len(letters) / max(1, len(letters) + len(lower)),
        bare / n, (raw.count(b"!") + raw.count(b"?")) / n, 1 - min(1.0, len(known) / n * max(1.0, n / 200) ** 0.5), odd / n)
    return (n, chars, symbols, dup, repeated), ratios


_BLANKS = b" \t\n\x0b\f\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_NOT_LOWER = bytes(set(range(256)) - set(_LOWER))


_LETTERS = re.compile(rb"[A-Za-z]").search
_PLAIN = re.compile(rb"[\"'(]?[A-Za-z\x80-\xff]+(?:['-][A-Za-z\x80-\xff]+)*[\"')]?[.,;:!?]?[\"')]?").fullmatch


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the base counts, and ``votes``: one of 0 (abstains), 1 (bad), 2 (good) per rule, base 3."""
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    low, high = np.array(list(RULES.values())).T
    place = 3 ** np.arange(len(RULES))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, raw in texts(batches, "_text"):
            got = [counts(t) for t in raw]
            base = np.array([g[0] for g in got], np.int64).reshape(-1, 5)
            ratio = np.array([g[1] for g in got]).reshape(-1, len(RULES))
            votes = np.where(ratio <= low, 2, np.where(ratio >= high, 1, 0))
            votes[base[:, 0] == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"_{i}") for i in range(len(keep))), *(pa.array(base[:, k]) for k in range(5)), pa.array(votes @ place)],
                [*(f"_{i}" for i in range(len(keep))), *_COUNTS, "votes"])

    done = source.mapInArrow(run, kinds + ", ".join(f"{c} long" for c in _COUNTS) + ", votes long")
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *_COUNTS, "votes")


def fit(pattern: np.ndarray, weight: np.ndarray, steps: int = 200, prior: float = 0.8, trust: float = 0.02) -> np.ndarray:
    """Posterior probability of good text per vote pattern, by expectation-maximisation.

    Votes are independent given the class; ``rate[c, j, v]`` is how often rule j votes v on class c (0 bad, 1 good). The
    start says that a rule seldom votes against the class. It stays in the sums with the weight of a share ``trust``
    of all texts, so that the classes cannot change places and rules without votes keep their start.
    """
    votes = pattern[:, None] // 3 ** np.arange(len(RULES)) % 3
    told = np.stack([votes == v for v in range(3)], 2).astype(float)
    start = np.empty((2, len(RULES), 3))
    start[0], start[1] = (0.65, 0.30, 0.05), (0.69, 0.01, 0.30)
    share, rate = prior, start
    total = weight.sum()
    p = np.full(pattern.size, prior)
    for _ in range(steps):
        log = np.einsum("ijv,cjv->ic", told, np.log(rate))
        odds = np.log(share) - np.log1p(-share) + log[:, 1] - log[:, 0]
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        moved, p = np.abs(new - p).max(), new
        mass = np.stack([weight * (1 - p), weight * p])
        rate = np.einsum("ci,ijv->cjv", mass, told) + trust * total * start
        rate /= rate.sum(2, keepdims=True)
        share = (mass[1].sum() + trust * total * prior) / (total * (1 + trust))
        if moved < 1e-9:
            break
    return p


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, base counts, base_failed, quality (posterior) and kept."""
    seen = stage(measure(docs, keep), "votes")
    histogram = seen.filter("n_words > 0").groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    pattern = np.array([r["votes"] for r in histogram], np.int64)
    weight = np.array([r["count"] for r in histogram], float)
    order = np.argsort(pattern)
    pattern, weight = pattern[order], weight[order]
    p = fit(pattern, weight) if pattern.size else np.empty(0)
    table = docs.sparkSession.createDataFrame(
        [(int(v), float(q)) for v, q in zip(pattern, p, strict=True)], "votes long, quality double")
    out = seen.join(F.broadcast(table), "votes", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(*keep, *_COUNTS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= KEEP)).alias("kept"))
