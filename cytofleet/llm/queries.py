"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofleet.llm import chat, collocations, decontam, divergence, langid, mixing, packing, pii, quality_lr, quality_rules, simhash, suffix, token_counts
from cytofleet.llm.common import in_split, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_lr.train(docs, labels.filter(~in_split("doc_id", 5, 0)))
    return quality_lr.score(docs, model).select(
        "doc_id", in_split("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_decontam")
def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: A public vocabulary file; queries use it where it is, it is never copied.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.vocabulary(VOCABULARY))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.groups(table(spark, sf_dir, "documents"), similar=None)
    return done.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: A conversation whose texts are made of control strings.
_TRICKY = """SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES
  (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)"""

_OP6_SQL = """
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_replace(text, '([\\[<])(\\\\*)(/?INST\\]|/?s>)', '\\1\\\\\\2\\3', 'g') AS esc,
    regexp_matches(text, '</s>|[\\[<]\\\\+(/?INST\\]|/?s>)') AS dirty FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('[INST]' || role || '[/INST]' || CASE WHEN dirty THEN esc ELSE text END || '</s>')) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query("op6_chat", _OP6_SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_TRICKY))
    back = chat.read_back(chat.format_conversations(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~in_split("doc_id", 4, 2)))
    return langid.predict(docs, model).select("doc_id", in_split("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "found")).alias("spans"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 100),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
parts AS (
  SELECT lang, k, phrase, a, i, array_to_string(list_slice(w, 1, i), ' ') AS p, array_to_string(list_slice(w, i + 1, k), ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.i, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM parts c JOIN often l ON l.lang = c.lang AND l.phrase = c.p JOIN often r ON r.lang = c.lang AND r.phrase = c.q JOIN total t ON t.lang = c.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM cuts),
covers AS (
  SELECT lang, array_to_string(list_slice(w, 1, k - 1), ' ') AS phrase, a FROM cand WHERE k > 2
  UNION ALL SELECT lang, array_to_string(list_slice(w, 2, k), ' '), a FROM cand WHERE k > 2),
covered AS (SELECT lang, phrase, max(a) AS m FROM covers GROUP BY ALL),
ranked AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, low.phrase) AS rank
  FROM low LEFT JOIN covered c ON c.lang = low.lang AND c.phrase = low.phrase
  WHERE o = 1 AND (m IS NULL OR 100 * m < 100 * low.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@query("op11_collocations", _OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_OP12_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS u FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
numbered AS (
  SELECT source, s, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM src),
ratio AS (SELECT *, row_number() OVER (ORDER BY s * 2.0::DOUBLE / w, source NULLS LAST) AS o FROM numbered),
-- the sources that are capped are the first by 2 s / w
water AS (
  SELECT *, sum(s) OVER () * 1.5::DOUBLE AS whole, coalesce(sum(s) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM ratio),
firsts AS (SELECT whole, full_before, w_after FROM water WHERE (whole - full_before * 2.0::DOUBLE) * w / w_after <= s * 2.0::DOUBLE ORDER BY o LIMIT 1),
target AS (
  SELECT source, s, CASE WHEN (f.whole - f.full_before * 2.0::DOUBLE) * w / f.w_after > s * 2.0::DOUBLE THEN s * 2.0::DOUBLE
    ELSE (f.whole - f.full_before * 2.0::DOUBLE) * w / f.w_after END AS target FROM numbered, firsts f),
share AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words, CASE WHEN s > 0 THEN CAST(round(target) AS BIGINT) // s ELSE 0 END AS copies FROM target),
sums AS (SELECT source, u, sum(size) AS tie FROM sized GROUP BY source, u),
upto AS (SELECT *, sum(tie) OVER (PARTITION BY source ORDER BY u) AS e FROM sums)
SELECT d.doc_id, d.size, h.s AS source_size, h.target,
  CAST(d.size * h.copies + CASE WHEN t.e <= h.words - h.copies * h.s THEN d.size
    WHEN t.e - t.tie < h.words - h.copies * h.s THEN ((h.words - h.copies * h.s - t.e + t.tie) * d.size) // t.tie ELSE 0 END AS BIGINT) AS taken
FROM sized d JOIN share h ON h.source IS NOT DISTINCT FROM d.source JOIN upto t ON t.source IS NOT DISTINCT FROM d.source AND t.u = d.u
"""


@query("op12_mixing", _OP12_SQL)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i, {_LOWERED} AS t FROM documents),
terms AS (SELECT lang, source, i, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT i) >= 10),
n AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) + 2 * v AS total FROM g JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY g.lang, g.source, v),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // total AS p
  FROM gn JOIN kept k ON k.lang = gn.lang LEFT JOIN n ON n.lang = gn.lang AND n.source = gn.source AND n.term = k.term),
ln AS (SELECT v.lang, 2 * v + sum(c) AS total FROM v JOIN n ON n.lang = v.lang GROUP BY v.lang, v),
q AS (SELECT n.lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // total AS q FROM n JOIN ln ON ln.lang = n.lang GROUP BY n.lang, term, total),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops) QUALIFY part = 'pair' OR rank <= 10
"""


@query("op13_divergence", _OP13_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
