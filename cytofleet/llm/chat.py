"""Chat formatting by a grammar round trip, in DataFrame functions only.

    conversation := turn*        turn := "[INST]" role "[/INST]" text "</s>"

A turn is first rendered as it stands and read again by the parser: cut at ``</s>``, take the role between the
markers, the rest is the text, and take one backslash out of ``<\\...\\/s>``, ``[\\...\\INST]`` and the like. A turn
that does not come back identical holds conflicting content and is rendered again with one backslash more
behind the bracket of every such string, which the parser undoes. The whole conversation is then parsed and
compared with its source; if it differs, every turn is escaped, and if that still differs the query fails.
Without conflicts, nothing in a text is changed.

The loss mask covers the texts of assistant turns; spans are code points of the formatted text.

Defined cases: null texts and roles are empty strings; turns that tie are ordered by role, then text; repeated rows
are turns of their own; null turns come first; rows without a conv_id form one conversation; an empty table
gives no rows. A conversation is one output string with one digest, so its turns meet in one row; escaping and
offsets are worked out per turn before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?INST\]|/?s>)"


def escape(c: Column) -> Column:
    """One more backslash behind the bracket of every control string, escaped ones included."""
    return F.regexp_replace(c, r"([\[<])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<])\\(\\*)" + _CONTROL, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SHUT), text, F.lit(END))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, without their end marker; what follows the last marker is the last one."""
    return F.split(formatted, END, -1)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text; null if it is not derived from the grammar."""
    cut = pieces(formatted)
    turns = F.slice(cut, F.lit(1), F.size(cut) - 1)
    at = lambda p: F.instr(p, SHUT)
    good = (F.element_at(cut, -1) == "") & F.forall(turns, lambda p: p.startswith(OPEN) & (at(p) > len(OPEN)))
    read = F.transform(turns, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(p, at(p) + len(SHUT), F.length(p))).alias("text")))
    return F.when(good, read)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss: array<struct<turn, inner, start, length>>, in the order of the turns.

    ``turn`` counts from 1, ``inner`` is the offset of the masked text in its turn, ``start`` that in the whole text.
    """
    turns = rows.select(
        "conv_id", F.col("turn").alias("no"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = F.array(F.struct("role", "text"))
    # a turn alone shows every conflict of its content; nulls of a failed parse count as conflicts
    clean = parse(render(F.col("role"), F.col("text"))).eqNullSafe(own)
    turns = turns.withColumn("clean", clean)

    def build(turns: DataFrame) -> DataFrame:
        shown = turns.withColumns({
            "r": F.when(F.col("clean"), F.col("role")).otherwise(escape(F.col("role"))),
            "t": F.when(F.col("clean"), F.col("text")).otherwise(escape(F.col("text")))})
        shown = shown.withColumns({
            "piece": render(F.col("r"), F.col("t")), "inner": F.length("r") + len(OPEN) + len(SHUT), "size": F.length("t")})
        order = Window.partitionBy("conv_id").orderBy("no", "role", "text")
        shown = shown.withColumns({
            "turn": F.row_number().over(order),
            "before": F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        held = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
            "turn", "no", "piece", "role", "text", "inner", "size", "before"))).alias("all"))
        return held.select(
            "conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
            F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
            F.transform("all", lambda x: x["no"]).alias("no"),
            F.transform(F.filter("all", lambda x: x["role"] == loss_role), lambda x: F.struct(
                x["turn"].alias("turn"), x["inner"].alias("inner"), (x["before"] + x["inner"]).alias("start"),
                x["size"].alias("length"))).alias("loss"))

    first = build(turns)
    same = parse(F.col("formatted")).eqNullSafe(F.col("source"))
    checked = first.withColumn("same", same)
    # conversations whose turns influence each other, which this grammar rules out: all their turns are escaped
    again = checked.filter("not same").select("conv_id", F.posexplode(F.arrays_zip("no", "source")).alias("_p", "x")).select(
        "conv_id", F.col("x.no").alias("no"), F.col("x.source.role").alias("role"), F.col("x.source.text").alias("text"),
        F.lit(False).alias("clean"))
    second = build(again).withColumn("same", F.assert_true(same, F.lit("a formatted conversation does not parse back")).isNull())
    done = checked.filter("same").unionByName(second)
    return done.select("conv_id", "formatted", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role, text>>), loss_text, formatted_chars, all taken from the formatted text."""
    return formatted.select(
        "conv_id", parse(F.col("formatted")).alias("turns"),
        F.array_join(_masked(F.col("formatted"), F.col("loss")), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _masked(formatted: Column, loss: Column) -> Column:
    cut = pieces(formatted)
    return F.transform(loss, lambda m: unescape(F.substring(
        F.element_at(cut, m["turn"]), m["inner"] + 1, m["length"])))
