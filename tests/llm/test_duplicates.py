"""SimHash, suffix de-duplication and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cases import EDGES, SF

from cytofleet.llm import components, decontam, queries, simhash, suffix


def brute_fingerprint(t):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    want = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {i: (format(fps[i], "016x"), want[i]) for i in ids}


def test_simhash_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
            v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = roots(signed, [(a, b) for a in signed for b in signed if (((a ^ b) & (1 << 64) - 1).bit_count() <= 2)])
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    done = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    assert {v: done.get(v, v) for v in signed} == want
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_simhash_edges(documents):
    rows = simhash.groups(documents(EDGES), ("doc_id", "_row", "score")).collect()
    assert len(rows) == len(EDGES)
    of = defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add((r["fp"], r["component"]))
    assert of[1] == of[2] == of[3] == {(0, 1)}
    assert of[4] == of[5] and {c for _, c in of[5]} == {4}
    assert simhash.groups(documents([])).collect() == []


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def brute_removed(rows, window=400):
    seen = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for k in range(len(b) - window + 1):
            seen[b[k:k + window]] += 1
    out = []
    for i, b in raw:
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if seen[b[k:k + window]] > 1:
                edge[k] += 1
                edge[k + window] -= 1
        gone = np.cumsum(edge)[:len(b)] > 0
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(0)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 2500))
    rows = [(0, base), (None, base[:1200] + "é" + base[1200:]), (2, base[700:1101]), (3, base[700:1099]), (4, base), (4, base),
            (5, "a" * 1500), (6, "ab" * 500), (7, "a" * 399 + "b" + "a" * 400), (8, base[:450] * 2), (None, None), (9, "")]
    for k in range(25):
        p = int(rng.integers(0, 2400))
        rows.append((100 + k, base[:p] + "#" + base[p + 1:]))
    return rows


@pytest.mark.parametrize("group,at_once", [(None, None), (3, None), (None, 200)])
def test_suffix_matches_brute_force(spark, copies, monkeypatch, group, at_once):
    """As it is, with hot leading strings counted by hash, and with windows sorted slice by slice."""
    if at_once:
        monkeypatch.setattr(suffix, "AT_ONCE", at_once)
    got = suffix.remove(spark.createDataFrame(copies, "doc_id long, text string"), group=group).collect()
    found = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(found, key=str) == brute_removed(copies)


def test_suffix_query_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op3_suffix_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute_removed(rows)


def test_suffix_edges(documents):
    rows = {r["doc_id"]: r for r in suffix.remove(documents(EDGES)).collect()}
    assert bytes(rows[1]["kept"]) == b"" and bytes(rows[4]["kept"]) == b"a" and rows[8]["removed"] == [(0, 20_000)]
    assert suffix.remove(documents([])).collect() == []


def test_multikey_sort_marks_equal_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1600] = data[0:600]
    token = suffix.Rolling(data, 1).all(suffix.GRAM)
    start = np.arange(data.size - 400 + 1)
    hit = suffix.equal_windows(np.zeros(start.size, np.int64), start, token, 400)
    seen = defaultdict(list)
    for s in start:
        seen[data[s:s + 400].tobytes()].append(s)
    assert np.flatnonzero(hit).tolist() == sorted(s for v in seen.values() if len(v) > 1 for s in v)


def brute_align(passage, item):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        passage, item = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 12))
        score, lo, hi = decontam.align(passage, item)
        assert score == brute_align(passage, item)
        assert score == 0 or brute_align(passage[lo:hi], item) == score


def test_exact_leaks_of_the_documents(spark):
    docs = {r["doc_id"]: b" ".join(decontam.tokens((r["text"] or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: b" ".join(decontam.tokens((r["text"] or "").encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if b" " + x + b" " in b" " + t + b" "}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op2_decontam(spark, SF).collect()}
    assert want and want <= {k for k, r in got.items() if r["score"] == 1.0}
    assert all(b" ".join(docs[d].split()[r["start"]:r["end"]]) == items[i] for (d, i), r in got.items() if r["score"] == 1.0)


def test_edited_leaks_are_found_and_clean_text_is_not(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(20, 45)))) for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    docs, want = [], set()
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 200))]
        if d % 2:
            k = rng.randrange(12)
            leak = items[k][1].split()
            for _ in range(len(leak) // 8):  # substitutions, insertions, losses
                at = rng.randrange(len(leak))
                leak[at:at + 1] = rng.choice([[word()], [leak[at], word()], []])
            body[len(body) // 2:len(body) // 2] = [w.upper() + "," for w in leak]
            want.add((d, k))
        docs.append((d, " ".join(body)))
    docs += [(None, items[0][1]), (200, None), (201, ""), (202, items[1][1] + " . " + items[2][1])]
    want |= {(None, 0), (202, 1), (202, 2)}
    d = spark.createDataFrame([(i, t, "x") for i, t in docs + [docs[1]]], "doc_id long, text string, passage string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, g int")
    got = decontam.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert decontam.leaks(d.limit(0), b).collect() == [] and decontam.leaks(d, b.limit(0)).collect() == []


def test_decontamination_edges(documents, spark):
    b = spark.createDataFrame([(1, "word word word word word word")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(documents(EDGES), b).collect()} == {9}


def test_groups_hold_all_pairs_of_five_word_similarity(spark):
    """Copies with edited words, against exact similarity of every pair; fingerprints within two bits find few of them."""
    rng = random.Random(11)
    rows, n = [(None, "one two three four six"), (None, "ONE two three  four six"), (900, ""), (901, None)], 0
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        for edits in (0, 1, 2, 3, 5, 8):
            text = list(base)
            for at in rng.sample(range(len(text)), edits):
                text[at] = f"x{rng.randrange(5000)}"
            rows.append((n, " ".join(text)))
            n += 1
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]]
    bits = [(a, b) for a, b in pairs if (fps[a] ^ fps[b]).bit_count() <= 2]
    alike = [(a, b) for a, b in pairs if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(set(alike) - set(bits)) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.groups(df).collect()
    assert {r["doc_id"]: r["component"] for r in got if r["doc_id"] is not None} == roots(ids, bits + alike)
    assert len({r["root"] for r in got if r["doc_id"] is None}) == 1
    plain = {r["doc_id"]: r["component"] for r in simhash.groups(df, similar=None).collect() if r["doc_id"] is not None}
    assert plain == roots(ids, bits)


def test_all_alignments_over_the_threshold_are_found(spark, monkeypatch):
    """Copies with a fifth to a third of the words edited, in a small vocabulary, against an alignment of every pair."""
    rng = random.Random(13)
    word = lambda: f"w{int(60 * rng.random() ** 2)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([4, 5, 7, 12, 16, 30, 59])))) for k in range(30)]
    docs = []
    for d in range(120):
        copy = items[rng.randrange(30)][1].split()
        kind, every = d % 4, rng.choice([3, 4, 5])
        for at in range(len(copy) - 1, -1, -1):
            if at % every == every - 1 if kind < 3 else at:  # every few words, or a word put between all
                copy[at:at + 1] = {0: [word()], 1: [], 2: [word(), copy[at]], 3: [word(), copy[at]]}[kind]
        body = [word() for _ in range(rng.choice([0, 5, 60]))]
        docs.append((d, " ".join(body[:len(body) // 2] + copy + body[len(body) // 2:])))
    want = {}
    for d, t in docs:
        for i, x in items:
            a, b = np.array(t.split()), np.array(x.split())
            score = decontam.align(a, b)[0] / (2 * b.size)
            if score >= 0.5:
                want[d, i] = score
    monkeypatch.setattr(decontam, "BLOCK", 200)  # several blocks
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want and len(got) == len(want)


def test_short_items_match_where_they_are_quoted(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, y alpha"), (2, "beta x gamma"), (3, "a beta gamma"), (4, "one two four three"), (5, "one two three")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["start"], r["end"]) for r in decontam.leaks(docs, items).collect()}
    assert got == {(1, 1, 1.0, 1, 2), (3, 2, 1.0, 1, 3), (5, 3, 1.0, 0, 3)}


def test_null_and_repeated_item_ids_keep_all_texts(spark):
    rng = random.Random(17)
    text = lambda tag: " ".join(f"{tag}{rng.randrange(10_000)}" for _ in range(20))
    none, one, two = text("a"), text("b"), text("c")
    items = spark.createDataFrame([(None, none), (1, one), (1, two), (1, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, none), (2, one), (3, two), (4, f"{one} {two}"), (None, none)], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in decontam.leaks(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0), (None, None, 1.0)], key=str)
