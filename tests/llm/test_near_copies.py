"""Links of similar shingle sets on one very common passage and one large group of edited copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofleet.llm import minhash, simhash


def jaccard(a, b):
    both = np.intersect1d(a, b).size
    return both / (a.size + b.size - both)


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [f"{passage} {' '.join(word() for _ in range(rng.randint(20, 200)))}" for _ in range(150)]
    base = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(base)
        for i in rng.sample(range(120), rng.randint(0, 7)):
            copy[i] = word()
        texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_pairs_follow_the_similar_ones_and_miss_none(spark, documents, crowd):
    of = minhash.Shingles(5)
    sets = {i: of(t.encode()) for i, t in crowd}
    close = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    rows = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in sets.items()], "s long, items array<long>")
    places = minhash.prefixes(rows, 0.8).cache()
    met = places.alias("x").join(places.alias("y"), "g").filter(
        (F.col("x.s") < F.col("y.s")) & minhash.able(F.col("x.n"), F.col("x.j"), F.col("y.n"), F.col("y.j"), 0.8))
    assert close <= {(r[0], r[1]) for r in met.select("x.s", "y.s").distinct().collect()}
    # no pair of texts that share the passage alone; about one leader a member
    led = [(min(r), max(r)) for r in minhash.led_pairs(places, 0.8).collect()]
    assert len(led) < 600 and not [p for p in led if p[0] < 150]
    good = {(min(r), max(r)) for r in minhash.verified(spark.createDataFrame(led, "a long, b long"), rows, 0.8).collect()}
    assert good == set(led) & close
    places.unpersist()


def test_groups_of_the_crowd_are_those_of_brute_force(documents, crowd):
    of = minhash.Shingles(5)
    sets = {i: of(t.encode()) for i, t in crowd}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in crowd}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and (jaccard(sets[i], sets[j]) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = {r["doc_id"]: r["component"] for r in simhash.groups(documents(crowd)).collect()}
    assert got == root


def test_pairs_are_verified_without_batches_of_whole_sets(spark):
    """Arrow batches of 10,000 pairs of whole sets broke the executor's memory; the bound at 0.8 is inclusive."""
    sets = {1: range(1, 9), 2: range(1, 11), 3: range(3, 14), 4: range(50, 60), 5: range(1, 9)}
    items = spark.createDataFrame([(s, list(x)) for s, x in sets.items()], "s long, items array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    found = minhash.verified(spark.createDataFrame(pairs, "a long, b long"), items, 0.8)
    alike = lambda x, y: 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y))
    assert sorted(map(tuple, found.collect())) == [(a, b) for a, b in pairs if alike(sets[a], sets[b])]
    assert "InArrow" not in found._jdf.queryExecution().toString()
