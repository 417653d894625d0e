"""Quality classifier, language identification and quality rules: held-out accuracy, brute force, edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EDGES, SF

from pyspark.sql import functions as F

from cytofleet.llm import langid, quality_lr, quality_rules, queries

SF1 = "/root/testdata/sf0.01"


def test_quality_is_learnt_and_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op1_quality(spark, SF1).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r["score"], labels[i]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in held]) > 0.9
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert {r["predicted"] for r in rows.values()} == {0, 1}


def test_quality_sees_text_only(spark, documents):
    model = quality_lr.Model(np.random.default_rng(0).normal(size=1 << 10).astype(np.float32), 0.1, 10)
    a = quality_lr.score(documents(EDGES), model, ("doc_id", "_row", "score"), "p").collect()
    assert len(a) == len(EDGES) and all(0 <= r["p"] <= 1 for r in a)
    by_text = {}
    for r, (i, t) in zip(sorted(a, key=str), sorted(EDGES, key=str), strict=True):
        by_text.setdefault(t or "", set()).add(r["p"])
    assert len({r["p"] for r in a if r["doc_id"] in (1, 2)}) == 1
    assert len({r["p"] for r in a if r["doc_id"] in (4, 5)}) == 1


def test_quality_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_lr.train(documents(EDGES), none)
    assert {r["score"] for r in quality_lr.score(documents(EDGES), model).collect()} == {0.5}
    assert quality_lr.score(documents([]), model).collect() == []
    mixed = spark.createDataFrame([(4, 1), (4, None), (None, 1), (9, 0), (9, 0)], "doc_id long, quality int")
    assert quality_lr.train(documents(EDGES), mixed).weights.any()


def test_features_are_hashed_ngram_counts():
    ids, values = quality_lr.features(b"one two one two", quality_lr.Hasher(), 18)
    # two words, two orders of pairs, two triples
    assert ids.size == 6 and values @ values == pytest.approx(1.0)
    loop = [set(quality_lr.features(f"{w} {w} {w}".encode(), quality_lr.Hasher(), 18)[0].tolist()) for w in ("ab", "ab")]
    assert loop[0] == loop[1]
    assert quality_lr.features(None, quality_lr.Hasher(2), 18)[0].size == 0


def test_language_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    rows = queries.op7_langid(spark, SF1).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, documents):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(base, sample=20, landmarks=5)
    got = {}
    for r in langid.predict(documents(EDGES), model).collect():
        got.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    for i in (1, 2, 3, 6):
        assert got[i] == {("und", 0.0)}
    assert all(x[0] != "und" for i in (4, 5, 7, 8, 9) for x in got[i])
    assert langid.train(base.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.predict(documents(EDGES), None).collect()} == {"und"}
    assert langid.predict(documents([]), model).collect() == []


def test_kernel_is_the_blended_spectrum():
    a, b = langid.grams("Ab, ba!"), langid.grams("abba")
    sets = [{s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} for s in (" ab ba ", " abba ")]
    # the last blank run is dropped by the text's end
    assert a.size == len(sets[0]) and len(np.intersect1d(a, b)) <= len(sets[0] & sets[1])
    vocabulary = np.union1d(a, b)
    marks = np.isin(vocabulary, b).astype(np.float32)[:, None] / np.sqrt(b.size)
    k = langid.kernel_rows([a, b], vocabulary, marks)
    assert k[1, 0] == pytest.approx(1.0, abs=1e-6)
    assert k[0, 0] == pytest.approx(len(np.intersect1d(a, b)) / np.sqrt(a.size * b.size), abs=1e-6)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often, cover, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            cover.update(range(i, i + 8))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_rules_base_counts_match_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["kept"] and r["base_failed"])


def test_rules_keep_clean_and_drop_noise(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality_rules(spark, SF1).collect() if r["doc_id"] in labels and not r["base_failed"]]
    kept = [[r["kept"] for r in rows if labels[r["doc_id"]] == y] for y in (0, 1)]
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.2


def test_rules_edges(documents):
    rows = quality_rules.judge(documents(EDGES), ("doc_id", "score")).collect()
    assert len(rows) == len(EDGES)
    for r, (_, t) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["n_words"])),
                         sorted(EDGES, key=lambda x: (str(x[0]), brute_counts(x[1])[0])), strict=True):
        assert r["n_words"] == brute_counts(t)[0] and r["base_failed"]
    assert quality_rules.judge(documents([])).collect() == []


def test_label_model_recovers_planted_classes():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.zeros((good.size, len(quality_rules.RULES)), int)
    for j in range(len(quality_rules.RULES) - 1):
        votes[:, j] = rng.random(good.size) < np.where(good, 0.004, 0.35)
    votes[:, -1] = np.where(rng.random(good.size) < 0.1, 0, np.where(good == (rng.random(good.size) < 0.97), 2, 1))
    code, inverse, count = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_inverse=True, return_counts=True)
    p = quality_rules.fit(code, count.astype(float))[inverse]
    assert ((p >= 0.5) == good).mean() > 0.97
