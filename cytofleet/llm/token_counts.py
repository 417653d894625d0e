"""Token counts by trie-shared dynamic programming.

A text is cut into words (runs of anything but space and tab to carriage return); a pre-token is a word behind the
blank mark. A unigram model scores pieces, and the best segmentation of a pre-token is the one with the
highest sum. Per batch of documents, the distinct new pre-tokens are inserted in a trie, all of them one level at a
time, and forward scores are worked out for the nodes of a level together: once per node, so once for a prefix that
many pre-tokens share. The token count is stored at the terminal nodes, and the counts of a document are sums over
its words.

Each task keeps the counts of known pre-tokens in a table of at most ``KNOWN`` entries, emptied when full. Nothing is
shuffled, so hot words, sources or documents do not matter, and memory does not grow with the vocabulary.

Pieces come from a public vocabulary file (a parameter); it is read on the driver and broadcast: its size is fixed by
the vocabulary. Files give ranks, not probabilities; a piece of rank r scores -log(r + 2), the rank form of a Zipf
law, and a longer piece wins ties. A character that no piece covers costs one token per UTF-8 byte, each worse than
any piece.

Defined cases: null and empty texts have no words and no tokens; repeated rows are counted row by row; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytofleet.llm.common import texts

MARK = "▁"
KNOWN = 400_000


_BASE = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1
_POWERS = [pow(_BASE, k, 1 << 64) for k in range(257)]


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    longest: int
    missing: float
    keys: np.ndarray     # sorted hashes of the pieces
    values: np.ndarray   # their scores


def vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores.setdefault(model.id_to_piece(i), -math.log(len(scores) + 2))
    return from_scores(scores)


def from_scores(scores: dict[str, float]) -> Vocabulary:
    """A vocabulary of given log scores; pieces are at most 256 characters long."""
    longest = max(map(len, scores), default=0)
    if longest > 256:
        raise ValueError("a piece has more than 256 characters")
    keys = np.array([int(_key(np.array([_hash(p)], np.uint64), len(p))[0]) for p in scores], np.uint64)
    order = np.argsort(keys)
    values = np.array(list(scores.values()))
    return Vocabulary(scores, longest, min(scores.values(), default=0.0) - 10.0, keys[order], values[order])


def _key(h: np.ndarray, length: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(length)


def _hash(text: str) -> int:
    h = 0
    for ch in text:
        h = (h * _BASE + ord(ch) + 1) & _FULL
    return h


def _bytes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def forward(words: list[str], vocab: Vocabulary) -> np.ndarray:
    """Token count of each word, by forward scores over the trie of all words, level by level."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    start = np.cumsum(size) - size
    tokens = np.zeros(len(words), np.int64)
    live = np.flatnonzero(size > 0)
    node = np.zeros(live.size, np.int64)  # of each live word, at the current depth
    # per depth, the last ``longest`` ones: parent of each node, hash of its prefix, best score, tokens
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
    depth = 0
    while live.size:
        edge, node = np.unique(node << 21 | text[start[live] + depth], return_inverse=True)
        depth += 1
        parent, code = edge >> 21, edge & ((1 << 21) - 1)
        _, hashes, score, count = levels[-1]
        own = hashes[parent] * np.uint64(_BASE) + code.astype(np.uint64) + np.uint64(1)
        cost = _bytes(code)
        best, cut = score[parent] + vocab.missing * cost, count[parent] + cost
        back, ways = parent, []
        for k in range(1, min(vocab.longest, depth) + 1):
            up, hashes, score, count = levels[-k]
            key = _key(own - hashes[back] * np.uint64(_POWERS[k]), k)
            at = np.searchsorted(vocab.keys, key)
            at[at == vocab.keys.size] = 0
            hit = np.flatnonzero(vocab.keys[at] == key)
            if hit.size:
                ways.append((hit, score[back[hit]] + vocab.values[at[hit]], count[back[hit]] + 1))
            back = up[back]
        for hit, value, n in reversed(ways):  # the longest piece first
            win = value > best[hit]
            best[hit[win]], cut[hit[win]] = value[win], n[win]
        levels = [*levels, (parent, own, best, cut)][-max(1, vocab.longest):]
        done = size[live] == depth
        tokens[live[done]] = cut[node[done]]
        live, node = live[~done], node[~done]
    return tokens


class Counter:
    """Token counts of texts, with a bounded table of known words."""

    def __init__(self, vocab: Vocabulary, limit: int | None = None):
        self.vocab, self.limit, self.known = vocab, KNOWN if limit is None else limit, {}

    def __call__(self, batch: list[bytes | None]) -> list[tuple[int, int]]:
        """(words, tokens) per text."""
        out = []
        words = [(t or b"").split() for t in batch]  # ASCII blanks only
        if len(self.known) > self.limit:
            self.known.clear()
        fresh = list(set().union(*words).difference(self.known))
        counts = forward([MARK + w.decode("utf-8", "replace") for w in fresh], self.vocab)
        self.known.update(zip(fresh, counts.tolist(), strict=True))
        known = self.known
        for ws in words:
            out.append((len(ws), sum(map(known.__getitem__, ws))))
        return out


def count_tokens(docs: DataFrame, vocab: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words and n_tokens of every document."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kinds = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(held.value)
        for part, raw in texts(batches, "_text"):
            got = counter(raw)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"_{i}") for i in range(len(keep))), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64())],
                [*(f"_{i}" for i in range(len(keep))), "n_words", "n_tokens"])

    done = source.mapInArrow(run, kinds + "n_words long, n_tokens long")
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_tokens")
