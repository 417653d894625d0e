"""Collocations, mixing and divergence against brute force, with their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import EDGES, SF
from pyspark.sql import functions as F

from cytofleet.llm import collocations, divergence, mixing, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, h long, w string, score double")


def brute_collocations(rows, least, top, longest=5):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                inside |= {p[i:i + k] for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i:i + k]]}
        rows_ = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def zipf_rows(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(n):
        t = []
        while len(t) < rng.randint(1, 60):
            t += ["new", "york", "city"] if rng.random() < 0.03 else ["a", "a"] if rng.random() < 0.05 else rng.choices(words, weight)
            if rng.random() < 0.1:
                t[-1] += rng.choice(".,;:!?\n\r\x0b\x0c")
        rows.append((i, rng.choice([" ", "\t", "  "]).join(t).upper() if i % 3 else " ".join(t), rng.choice(["en", "en", "de", None]), f"s{i % 4}"))
    return rows


@pytest.mark.parametrize("least,top,batch", [(3, 15, 1), (3, 10_000, 1), (5, 40, 200), (3, 30, 10**6)])
def test_collocations_match_brute_force(spark, least, top, batch):
    rows = zipf_rows()
    got = collocations.collocations(table(spark, rows), least=least, top=top, batch=batch).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, least, top)


def test_collocation_edges(spark):
    rows = [(i, t, None, None) for i, t in EDGES]
    got = collocations.collocations(table(spark, rows), least=100, top=5).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, 100, 5) != []
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(1, "a b", "x", None)])).collect() == []


def test_words_that_share_a_hash_lead_to_another_seed(spark, monkeypatch):
    import xxhash

    rows, real = zipf_rows(n=60), collocations.word_counts
    seeds = []

    def clash(docs, seed):
        seeds.append(seed)
        done = real(docs, seed)
        return done.withColumn("h", F.when(F.col("word").isin("w0", "w1"), F.lit(7).cast("long")).otherwise(F.col("h"))) if seed == 42 else done

    monkeypatch.setattr(collocations, "word_counts", clash)
    got = collocations.collocations(table(spark, rows), least=3, top=50, batch=1).collect()
    assert seeds == [42, 43] and sorted(tuple(r) for r in got) == brute_collocations(rows, 3, 50)
    assert xxhash.xxh64_intdigest(b"w0", 42) != xxhash.xxh64_intdigest(b"w0", 43)


def test_cuts_are_exact_beyond_64_bits():
    a, n = 3 * 10**12, 10**15 + 7
    assert collocations.cut(a, n, [a + 1, a + 5], [a + 2, a + 9]) == min(
        (1000 * a * n // ((a + 1) * (a + 9)), a + 1, a + 9), (1000 * a * n // ((a + 5) * (a + 2)), a + 5, a + 2), key=lambda x: x[0])
    assert collocations.cut(10, 100, [10, 10], [10, 10])[1:] == (10, 10)


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    full, whole = set(), sum(sizes.values()) * total
    while True:
        rest = [s for s in order if s not in full]
        left = whole - sum(sizes[s] for s in full) * most
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > sizes[s] * most}
        if not above:
            return {**{s: sizes[s] * most for s in full}, **share}
        full |= above


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, _, s in rows:
        total[s] += size(t)
    want = brute_targets(total)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        taken[r["source"]] += r["taken"]
    return want, taken


def test_mix_reaches_targets_and_repeats(spark):
    rows = zipf_rows(n=500)
    rows = [(i, t, g, None if i % 17 == 0 else f"s{min(i % 9, rng)}") for (i, t, g, _), rng in zip(rows, [0, 3, 6, 8] * 125, strict=True)]
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    want, taken = check_mix(rows, got)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    # one document of a source is partly taken at most
    parts = Counter(r["source"] for r in got if r["size"] and r["taken"] % r["size"])
    assert max(parts.values()) == 1


def test_mix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    of = {r[0]: r[3] for r in rows}
    got = queries.op12_mixing(spark, SF).withColumn("source", F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("doc_id"))).collect()
    want, taken = check_mix(rows, got)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mix_edges(spark):
    rows = [(i, t, None, s) for i, t in EDGES for s in (None, "b", "a")]
    want, taken = check_mix(rows, mixing.mix(table(spark, rows)).collect())
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert mixing.mix(table(spark, [])).collect() == []
    none = mixing.mix(table(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0), (0.0, 0)]


def brute_audit(rows, least=10, ranks=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(terms(t)))
        n[lang, source].update(terms(t))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        own = [s for g, s in groups if g == lang]
        v = len(kept)
        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept}
        ps = {s: p(n[lang, s]) for s in own}
        q = p(sum((n[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in own if o != s]
            tops = [(-f(ps[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and ps[s][t] > q[t]]
            for part, items, k in (("pair", pairs, len(pairs)), ("term", tops, ranks)):
                out += [(lang, s, part, i.decode(), -x, r) for r, (x, i) in enumerate(sorted(items)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,known", [(1, 400_000), (10, 3), (10**6, 400_000)])
def test_divergence_matches_brute_force(spark, monkeypatch, least, known):
    monkeypatch.setattr(divergence, "KNOWN", known)
    rows = zipf_rows(n=200) + [(i, t, None, s) for i, t in EDGES for s in (None, "zé")] + [(7, None, "fr", "only")]
    got = divergence.audit(table(spark, rows), least=least).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, least)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []
