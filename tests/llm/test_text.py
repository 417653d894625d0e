"""Token counts, chat formatting, packing and personal data against brute force; the pipeline stage by stage."""

import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from cases import EDGES, SF
from pyspark.sql import functions as F

from cytofleet.llm import chat, decontam, packing, pii, queries, simhash, token_counts

PIECES = {p: -0.5 * k - 1 for k, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "aba", "é", "ba", "▁the", "t", "h", "e"])}


def brute_tokens(word, v):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        cost = len(word[j - 1].encode())
        top = (best[-1][0] + v.missing * cost, best[-1][1] + cost)
        for i in range(j):
            s = v.scores.get(word[i:j])
            if s is not None and best[i][0] + s > top[0]:
                top = (best[i][0] + s, best[i][1] + 1)
        best.append(top)
    return best[-1][1]


def test_trie_counts_match_brute_force():
    v = token_counts.from_scores(PIECES)
    rng = random.Random(0)
    words = ["▁" + "".join(rng.choice("abté😀hex") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "▁", "▁" + "ab" * 500]
    assert token_counts.forward(words, v).tolist() == [brute_tokens(w, v) for w in words]
    assert token_counts.forward([], v).tolist() == []


def test_token_query_and_table_limit(spark):
    v = token_counts.vocabulary(queries.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in queries.op4_token_counts(spark, SF).collect()}
    for i, t in list(texts.items())[:25]:
        words = t.encode().split()
        assert got[i] == (len(words), sum(brute_tokens("▁" + w.decode(), v) for w in words))
    raw = [t.encode() for t in texts.values()]
    tight = token_counts.Counter(v, 5)
    assert [x for k in range(0, len(raw), 7) for x in tight(raw[k:k + 7])] == token_counts.Counter(v)(raw)


def test_token_edges(documents):
    v = token_counts.from_scores(PIECES)
    rows = token_counts.count_tokens(documents(EDGES), v, ("doc_id", "score")).collect()
    assert len(rows) == len(EDGES)
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert token_counts.count_tokens(documents([]), v).collect() == []


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["</s>", "[INST]", "[/INST]", "<", "\\", "[", "s>", "INST]", "/", "ok", " ", "é😀", "\n", "$1", "<\\/s>", "<s>"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "sys[/INST]"]),
             rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))]))
            for c in [None, *range(40)] for _ in range(rng.randint(1, 7))]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    done = chat.format_conversations(df)
    for r in chat.read_back(done).collect():
        own = sorted((t is not None, t or 0, ro or "", tx or "") for c, t, ro, tx in rows if c == r["conv_id"])
        assert [(a, b) for *_, a, b in own] == [(x["role"], x["text"]) for x in r["turns"]]
        assert "".join(b for *_, a, b in own if a == "assistant") == r["loss_text"]
    for r in done.collect():
        for m in r["loss"]:  # spans of the whole text, too
            assert r["formatted"][m["start"] + m["length"]:].startswith("</s>")
            assert r["formatted"][:m["start"]].endswith("[INST]assistant[/INST]")
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_chat_leaves_plain_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [x] \\ c"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first()["formatted"] == "[INST]user[/INST]a < b [x] \\ c</s>[INST]assistant[/INST]fine</s>"


def test_chat_query_holds_the_tricky_conversation(spark):
    rows = {r["conv_id"]: r for r in queries.op6_chat(spark, SF).collect()}
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(30, n, replace=False) + 1), rng.integers(1, 9, n)
        bounds = packing.boundaries(lengths, counts, k)
        ways = [list(s) + [lengths[-1]] for m in range(k) for s in itertools.combinations(lengths[:-1].tolist(), m)]
        assert len(bounds) <= k and padding(bounds, lengths, counts) == min(padding(w, lengths, counts) for w in ways)
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


@pytest.mark.parametrize("size", [50_000, 7])
def test_packing_holds_every_word_once(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "RANGE", size)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    rows = packing.pack(docs, max_len=200, buckets=4, budget=1000).collect()
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        assert r["length"] <= r["bucket"] <= 200
    for i, parts in covered.items():
        parts.sort()
        assert [s for s, _ in parts] == list(range(0, max(1, n[i]), 200)) and sum(c for _, c in parts) == n[i]
    assert covered.keys() == n.keys()
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    for (bucket, batch), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) * bucket <= 1000
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(places) == 1000 // bucket
    lengths, counts = np.unique([r["length"] for r in rows], return_counts=True)
    best = packing.boundaries(lengths, counts, 4)
    assert {r["bucket"] for r in rows} == set(best)


def test_packing_edges(documents):
    rows = packing.pack(documents(EDGES), keep=("doc_id", "_row", "score")).collect()
    assert len(rows) == len(EDGES) + 2  # 6,000 words make three pieces
    assert all(r["batch"] is None and r["bucket"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert packing.pack(documents([])).collect() == []


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_base(t):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force(spark, documents):
    rng = random.Random(1)
    parts = ["@", ".", "a", "1", "255", "+", " ", "-", "(", "9", "😀", "é", "\n", "4111111111111111", "a@b.c", "_", "1.2.3.4", ".."]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))) for k in range(150)] + EDGES
    rows += [(300, "a@b.c..d@e.f"), (301, "a@b.c_d@e.f"), (302, "7 " * 3000), (303, "x7 " * 3000), (304, "a@" + "b.c" * 20_000)]
    got = {}
    for r in pii.find(documents(rows), ("doc_id", "score")).collect():
        got.setdefault(r["doc_id"], []).append([tuple(s) for s in r["base"]])
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute_base(t))
    assert {i: sorted(map(str, x)) for i, x in got.items()} == {i: sorted(map(str, x)) for i, x in want.items()}
    assert pii.find(documents([])).collect() == []


def test_context_finds_identifiers_that_no_rule_knows(documents):
    rng = random.Random(4)
    def card():
        d = "".join(rng.choice("0123456789") for _ in range(15))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = [(k, f"please charge account {card()} today") for k in range(40)]
    wrong = next(c for c in iter(card, None))
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    rows += [(100, f"please charge account {wrong} today"), (101, f"serial number {wrong} printed"), (102, "room 12 and room 14")]
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in pii.find(documents(rows)).collect()}
    assert found[100] == [(22, 38)] and found[101] == [] and found[102] == []
    assert all(not found[k] for k in range(40))  # base spans are not found again


def test_induction_matches_a_plain_loop(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(30), f"i{rng.randrange(120)}") for _ in range(500)} | {(99, f"i{k}") for k in range(12)}
    seeds = {f"i{k}" for k in range(0, 12)} | {f"i{k}" for k in range(0, 120, 7)}
    df = spark.createDataFrame([(p, c, c in seeds) for p, c in edges] * 2, "pattern long, core string, seed boolean")
    got = {r["pattern"]: r["conf"] for r in pii.induce(df, support=3, sure=0.15).collect()}
    score = {c: float(c in seeds) for _, c in edges}
    before = None
    while before != score:
        of, before = {}, dict(score)
        for p, c in edges:
            of.setdefault(p, []).append(score[c])
        conf = {p: int(sum(s) / (len(s) + 1) * 1000 + 1e-6) / 1000 for p, s in of.items()}
        conf = {p: x for p, x in conf.items() if x >= 0.15 and sum(s > 0 for s in of[p]) >= 3}
        for p, c in edges:
            score[c] = max(score[c], conf.get(p, 0.0))
    assert got.keys() == conf.keys() and all(abs(got[p] - conf[p]) < 1e-9 for p in got)


def brute_mask(t, spans):
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out.append(t[end:a] + f"[{k}]")
        end = max(end, b)
    return "".join(out) + t[end:]


def test_mask_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 1, 5, 300])))
        cut = [rng.randrange(len(t)) for _ in range(rng.choice([0, 1, 3, 70, 200]) if t else 0)]
        rows.append((i, t, [(rng.choice(["x", "yy"]), a, min(len(t), a + rng.randint(1, 4))) for a in cut]))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<kind string, start long, end long>>")
    for r in pii.mask(df, "spans").collect():
        assert r["text"] == brute_mask(*rows[r["id"]][1:])


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator says about its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality", "near_duplicates", "decontaminate", "personal_data", "packing"]
    kept = named["quality"](spark, docs, SF)
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op1_quality(spark, SF).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in predicted.items() if p}

    mixed = docs.unionByName(docs.limit(3)).unionByName(
        spark.createDataFrame([(None, None, "en", "s", None), (None, "", "en", "s", 0), (None, "zz yy", None, None, 5)], docs.schema))
    unique = named["near_duplicates"](spark, mixed, SF)
    whole = {(r["component"], r["fp"]) if r["component"] is None else r["component"] for r in simhash.groups(mixed).collect()}
    rows = unique.collect()
    assert len(rows) == len(whole) and unique.columns == docs.columns
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {c for c in whole if isinstance(c, int)}

    clean = named["decontaminate"](spark, unique, SF)
    leaked = {r["doc_id"] for r in decontam.leaks(unique, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows} - leaked

    source = {r["doc_id"]: r["text"] for r in clean.collect()}
    spans = {r["doc_id"]: [tuple(s) for s in [*r["base"], *r["found"]]] for r in pii.find(clean).collect()}
    masked = named["personal_data"](spark, clean, SF)
    assert masked.columns == docs.columns
    assert {r["text"] for r in masked.filter("doc_id IS NULL").collect()} == {r["text"] for r in clean.filter("doc_id IS NULL").collect()}
    for r in masked.filter("doc_id IS NOT NULL").collect():
        assert r["text"] == brute_mask(source[r["doc_id"]] or "", spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])

    packed = named["packing"](spark, masked, SF)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).join(
        masked.select("doc_id", packing.words(F.col("text")).alias("m")), "doc_id").filter("n <> m").count() == 0


def test_pipeline_runs_as_registered(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "bucket", "batch", "place"]


def test_patterns_are_tried_on_marked_texts_only(spark):
    """Every text with a match has the mark of its pattern, and the scan tests the mark before it searches."""
    texts = ["a@b.c", "plain words", "1.2.3.4", "x1.2", "4111 1111 1111 1111", "4-1", "+49 30 1234567", "+", "@", "", "v2 of it", "a-b.c", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in {**pii.PATTERNS, "_tokens": pii.TOKEN}.items():
        seen = d.select(pii.MARKS[kind](F.col("text")).alias("m"), F.col("text").rlike(pattern).alias("r")).collect()
        assert all(r["m"] or not r["r"] for r in seen) and any(r["r"] for r in seen) and not all(r["m"] for r in seen)
    plan = pii.scan(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN regexp_extract_all") == 5
