"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and without overlaps
per kind; matches that fail their test are dropped. They are the seeds, together with hexadecimal digests of
32, 40 or 64 digits (access tokens), which count as seeds but are not base spans.

The method then looks at every token that holds a digit or an ``@``:

* a lexical pattern is the word on the left or on the right of a token with the shape class of the token;
* instances (token strings) and patterns form a graph with one edge per distinct pair. A seed instance scores 1.
  A pattern scores the sum of its instances' scores over their number plus a prior ``doubt``, and counts only
  from ``support`` distinct positive instances on; an instance scores the best of its patterns, if that
  is ``sure`` or more. Rounds of two aggregations each spread the scores until they settle;
* tokens that match a pattern of score ``sure`` or more are found identifiers, if no base span overlaps them.

All steps are aggregations with map-side sums and equi-joins; the text is read once and never shuffled. A hot
pattern or instance is summed before the shuffle and its joins are left to the skew handling.

Defined cases: a null text counts as empty and gives no spans; a null id stays a row of its own; repeated rows are
scanned row by row and count once as instances; an empty table gives no rows. Runs of any length are
matched without backtracking.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cytofleet.llm.common import stage, unstage

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base rules: the same matches, but no recursion and no rescans of long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What a text with a match surely holds; most texts hold none of it, so the patterns are tried on the others only.
MARKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "_tokens": lambda t: t.rlike("[0-9@]"),
}
_TRIM = "\"'.,;:!?()[]{}<>#*$%&|=`"
_BLOCK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid_ip(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _valid_card(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = sum((_luhn(F.substring(d, i + 1, 1).try_cast("int"), i) for i in range(19)), F.lit(0))
    return F.length(d).between(16, 19) & (total % 10 == 0)


def _luhn(digit: Column, place: int) -> Column:
    worth = digit if place % 2 == 0 else F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
    return F.coalesce(worth, F.lit(0))


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


_TEST = {"email": lambda m: F.lit(True), "ip": _valid_ip, "card": _valid_card, "phone": _valid_phone}


def _blocks(values: Column) -> Column:
    """An array cut into arrays of ``_BLOCK`` elements."""
    n = F.size(values)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Sums (or another fold from 0) before each element of an array of longs.

    Arrays are folded in blocks, so that long ones cost no quadratic time. ``values`` must be a column of its own: an
    expression would be worked out once per block.
    """
    cut = _blocks(values)
    zero = F.lit(0).cast("bigint")

    def before(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct(
            step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    total = F.transform(cut, lambda c: F.aggregate(c, zero, lambda a, x: step(a, x)))
    return F.flatten(F.transform(F.arrays_zip(cut.alias("c"), before(total, zero).alias("s")), lambda z: before(z["c"], z["s"])))


def _matched(df: DataFrame, name: str, pattern: str, near: bool = False) -> DataFrame:
    """Adds ``name``: array<struct<start, end, text[, left, right]>> of the matches, in code points.

    Matches and the pieces between them are laid end to end, which gives the places without Python. Texts without the mark of
    ``name`` are not searched and get NULL, as those without a match do.
    """
    found = df.withColumn("_m", F.when(MARKS[name](F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    step = F.transform(F.arrays_zip(F.slice("_p", F.lit(1), F.size("_m")).alias("p"), F.col("_m").alias("m")),
                       lambda z: (F.length(z["p"]) + F.length(z["m"])).cast("bigint"))
    # columns of their own: the lambdas of running() would otherwise work the lengths out once per block
    found = found.withColumn("_n", step)
    found = found.withColumn("_s", F.when(F.size("_m") > 0, running(F.col("_n"))))

    def span(m: Column, i: Column) -> Column:
        start = F.get("_s", i) + F.length(F.get("_p", i))
        out = [start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text")]
        if near:
            flat = lambda p: F.translate(p, "\t\n\x0b\f\r", "     ")
            out += [F.substring_index(F.rtrim(flat(F.get("_p", i))), " ", -1).alias("left"),
                    F.substring_index(F.ltrim(flat(F.get("_p", i + 1))), " ", 1).alias("right")]
        return F.struct(*out)

    return found.withColumn(name, F.when(F.size("_m") > 0, F.transform("_m", span))).drop("_m", "_p", "_n", "_s")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, a row key, base (array<struct<kind, start, end>>), and cands: tokens with their context."""
    df = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    for k in KINDS:
        df = _matched(df, k, PATTERNS[k])
    df = _matched(df, "_tokens", TOKEN, near=True)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def passed(k: str) -> Column:
        good = F.filter(k, lambda m: _TEST[k](m["text"]))
        return F.coalesce(F.transform(good, lambda m: F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))), none)

    base = F.concat(*[passed(k) for k in KINDS])
    df = df.withColumn("base", base)
    core = lambda t: F.trim(t["text"], F.lit(_TRIM))
    lead = lambda t: F.length(t["text"]) - F.length(F.ltrim(t["text"], F.lit(_TRIM)))
    named = F.transform("_tokens", lambda t: F.struct(
        (t["start"] + lead(t)).alias("start"), (t["start"] + lead(t) + F.length(core(t))).alias("end"),
        F.lower(core(t)).alias("core"), F.lower(t["left"]).alias("left"), F.lower(t["right"]).alias("right")))
    df = df.withColumn("_named", F.filter(named, lambda t: t["core"].rlike("[0-9@]")))
    digest = lambda t: t["core"].rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") & t["core"].rlike("[a-f]") & t["core"].rlike("[0-9]")
    over = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    cands = F.transform("_named", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["core"].alias("core"), t["left"].alias("left"),
        t["right"].alias("right"), over(t).alias("base"), (over(t) | digest(t)).alias("seed")))
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.expr("uuid()").alias("_row"), "base",
                     F.when(F.size("_named") > 0, cands).alias("cands"))


def shape(core: Column) -> Column:
    """Shape class of a token: address, digest-like, digits with separators, or letters with digits."""
    return (F.when(core.contains("@"), "address").when(core.rlike("^[0-9a-f]{16,}$") & core.rlike("[a-f]"), "digest")
            .when(core.rlike("^[0-9+().,:/-]+$"), F.concat(F.lit("digits"), F.least(F.length(_digits(core)), F.lit(20)).cast("string")))
            .otherwise("mixed"))


def induce(cands: DataFrame, support: int = 5, sure: float = 0.8, doubt: float = 1.0, rounds: int = 1000) -> DataFrame:
    """(pattern, conf) of the patterns with a score of ``sure`` or more; ``cands`` has pattern, core, seed.

    Scores of instances only rise, and those of patterns are cut to thousandths, so they settle; the search goes on until
    no score changes. A run that has not settled after ``rounds`` raises.
    """
    edges = stage(cands.groupBy("pattern", "core").agg(F.max("seed").alias("seed")), "edges")
    # edges of one instance may be a seed in one document only; the instance counts as one then
    scores = stage(edges.groupBy("core").agg(F.max("seed").cast("double").alias("score")), "scores")
    for _ in range(rounds):
        patterns = (
            edges.join(scores, "core").groupBy("pattern")
            .agg((F.floor(F.sum("score") / (F.count(F.lit(1)) + doubt) * 1000 + 1e-6) / 1000).alias("conf"), F.sum((F.col("score") > 0).cast("long")).alias("good"))
            .filter((F.col("good") >= support) & (F.col("conf") >= sure)))
        patterns = stage(patterns.select("pattern", "conf"), "patterns")
        best = edges.join(patterns, "pattern").groupBy("core").agg(F.max("conf").alias("best"))
        step = stage(scores.join(best, "core", "left").select(
            "core", F.col("score").alias("was"), F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")), "scores")
        unstage(scores)
        scores = step.drop("was")
        scores._staged = step._staged
        if step.filter("score > was").isEmpty():
            unstage(step, edges)
            return patterns
        unstage(patterns)
    raise RuntimeError(f"pattern scores did not settle in {rounds} rounds")


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), support: int = 5, sure: float = 0.8) -> DataFrame:
    """The ``keep`` columns, base and found: arrays of struct<kind, start, end>, sorted, ends exclusive.

    ``found`` holds the spans of the method, kind ``context``; they overlap no base span.
    """
    rows = stage(scan(docs, keep), "scanned")
    token = rows.filter("cands IS NOT NULL").select("_row", F.explode("cands").alias("t")).select("_row", "t.*")
    sides = F.filter(F.array(
        F.when(F.col("left") != "", F.struct(F.lit("left").alias("side"), F.col("left").alias("word"))),
        F.when(F.col("right") != "", F.struct(F.lit("right").alias("side"), F.col("right").alias("word")))), lambda s: s.isNotNull())
    seen = token.withColumn("s", F.explode(sides)).select(
        "_row", "start", "end", "core", "base", "seed",
        F.xxhash64("s.side", "s.word", shape(F.col("core"))).alias("pattern"))
    sure_of = induce(seen, support, sure)
    hits = seen.filter("not base").join(sure_of, "pattern").groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), F.col("start"), F.col("end")))).alias("found"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(hits, "_row", "left").select(*keep, "base", F.coalesce("found", none).alias("found"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """``df`` with every run of overlapping spans in ``text`` replaced by the kind of its first span, as ``[kind]``.

    ``spans`` names an array<struct<kind, start, end>>. The text between spans is cut out block by block.
    """
    df = df.withColumn("_o", F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    df = df.withColumn("_e", F.transform("_o", lambda s: s["end"]))
    df = df.withColumn("_r", F.when(F.size("_e") > 0, running(F.col("_e"), F.greatest)))
    df = df.withColumn("_z", F.arrays_zip(F.col("_o").alias("s"), F.col("_r").alias("r")))
    df = df.withColumn("_b", F.when(F.size("_z") > 0, _blocks(F.col("_z"))))

    def block(c: Column) -> Column:
        low = F.get(c, F.lit(0))["r"]
        part = F.substring(text, (low + 1).cast("int"), F.greatest(F.element_at(c, -1)["s"]["start"] - low, F.lit(0)).cast("int"))
        one = lambda held: F.array_join(F.transform(c, lambda z: F.when(
            z["s"]["start"] >= z["r"],
            F.concat(F.substring(held, (z["r"] - low + 1).cast("int"), (z["s"]["start"] - z["r"]).cast("int")),
                     F.lit("["), z["s"]["kind"], F.lit("]"))).otherwise("")), "")
        return F.get(F.transform(F.array(part), one), F.lit(0))

    tail = F.substring(text, (F.array_max("_e") + 1).cast("int"), F.length(text))
    done = F.when(F.size("_b") > 0, F.concat(F.array_join(F.transform("_b", block), ""), tail)).otherwise(F.col(text))
    return df.withColumn(text, done).drop("_o", "_e", "_r", "_z", "_b")
