"""Chat formatting in budgeted windows, with built-in functions only.

A turn becomes `### role: text</turn>` and a new line. In texts a backslash is doubled, `##` becomes
`#\\#` and `</turn>` becomes `<\\/turn>`, so neither mark can occur inside a text and each step can be
undone; roles are percent-encoded.

Windows come from prefix sums of turn tokens. The system turn (the first turn, if its role is system)
and a window's own turns share a budget of `span` tokens, so a cell holds `span` less the system turn's
tokens. The turns that lie inside one cell form a window; a turn that crosses into the next cell is a
window of its own. Before its own turns a window repeats the system turn and the turns that start at
most `history` tokens before it. So a window has at most `span + history` tokens, by two stated rules:
a system turn of more than half a span is a window of its own and is not repeated, and turns are never
cut, so a single turn longer than its cell exceeds the budget, alone but for what it repeats. Only the
assistant texts among its own turns are under the loss mask, so each is learned once.

Prefix sums are taken inside segments of `segment` turn numbers and then over the segments' totals,
so a long conversation is not one task.

Defined results: null text and null role are empty; rows with a null conv_id are one conversation,
null turns come first; equal turns are ordered by role and text; repeated rows are turns of their
own; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, HISTORY, SEGMENT = 768, 192, 256
END = "</turn>\n"
TOKEN = r"\p{L}+|\p{N}+|[^ \t\n\u000b\f\r\p{L}\p{N}]"


def escaped(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescaped(text: Column) -> Column:
    for old, new in (("<\\/turn>", "</turn>"), ("#\\#", "##"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY, segment: int = SEGMENT,
            system: str = "system", learned: str = "assistant") -> DataFrame:
    """(conv_id, window, text, n_tokens, n_repeated, loss_spans) from (conv_id, turn, role, text).

    `n_repeated` leading turns were seen in an earlier window; `loss_spans` holds (start, length) in
    code points of `text`.
    """
    if history > span:
        raise ValueError("history reaches back one cell at most")
    marked = turns.select(
        F.col("conv_id").alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv", "turn", "role", "text", F.floor(F.col("turn") / segment).alias("seg"),
        F.concat(F.lit("### "), F.url_encode("role"), F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"),
    ).withColumn("n", F.regexp_count(F.concat("head", "body", F.lit(END)), F.lit(TOKEN)).cast("long"))
    inside = Window.partitionBy("conv", "seg").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = marked.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    by_segment = Window.partitionBy("conv").orderBy("seg")
    lead = F.max(F.when((F.col("at") == 0) & (F.col("role") == system), F.col("n")))
    totals = local.groupBy("conv", "seg").agg(F.sum("n").alias("n"), lead.alias("lead")).select(
        F.col("conv").alias("c"), F.col("seg").alias("s"),
        F.coalesce(F.sum("n").over(by_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"),
        F.first("lead").over(by_segment.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"))
    room = F.when(F.col("lead") <= span // 2, span - F.col("lead")).otherwise(span)
    placed = local.join(
        totals, local.conv.eqNullSafe(totals.c) & local.seg.eqNullSafe(totals.s)
    ).withColumn("a", F.col("at") + F.col("from")).select("conv", "a", "n", "role", "head", "body", room.alias("room"))
    is_system = (F.col("a") == 0) & (F.col("role") == system)
    first_cell = F.floor(F.col("a") / F.col("room"))
    last_cell = F.floor((F.col("a") + F.col("n") - 1) / F.col("room"))
    part = F.struct(F.col("a"), F.col("head"), F.col("body"), F.col("n"),
                    (F.col("role") == learned).alias("learn"))
    own = placed.where(~is_system).select(
        "conv", (first_cell * 2 + (first_cell != last_cell).cast("int")).alias("window"), "a", "room", part.alias("part"))
    starts = own.groupBy("conv", "window").agg(F.min("a").alias("start")).select(
        F.col("conv").alias("c"), "window", "start", F.floor(F.col("window") / 2).alias("cell"))

    reach = own.select(
        "conv", "window", "a", "part",
        F.explode(F.sequence(F.floor(F.col("a") / F.col("room")), F.floor((F.col("a") + history) / F.col("room")))).alias("cell")
    ).withColumnRenamed("window", "home")
    again = reach.join(starts, reach.conv.eqNullSafe(starts.c) & (reach.cell == starts.cell)).where(
        (F.col("home") != F.col("window")) & (F.col("a") < F.col("start"))
        & (F.col("start") <= F.col("a") + history)).select("conv", "window", "part", F.lit(False).alias("new"))

    system_turns = placed.where(is_system).select("conv", part.alias("part"), (F.col("n") <= span // 2).alias("short"))
    first = starts.groupBy("c").agg(F.min("window").alias("first"))
    leads = system_turns.join(first, system_turns.conv.eqNullSafe(first.c), "left").select(
        "conv", F.when(F.col("short"), F.coalesce("first", F.lit(0))).otherwise(-1).alias("window"), "part",
        F.lit(True).alias("new"))
    retained = system_turns.where("short").join(starts, system_turns.conv.eqNullSafe(starts.c)).join(
        first.withColumnRenamed("c", "d"), F.col("conv").eqNullSafe(F.col("d"))).where(
        F.col("window") > F.col("first")).select("conv", "window", "part", F.lit(False).alias("new"))

    gathered = (own.select("conv", "window", "part", F.lit(True).alias("new"))
                .unionByName(again).unionByName(leads).unionByName(retained)
                .groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("part.a", "part", "new"))).alias("parts")))
    return gathered.select(
        F.col("conv").alias("conv_id"), "window",
        F.expr(f"array_join(transform(parts, p -> concat(p.part.head, p.part.body, '{END[:-1]}\\n')), '')").alias("text"),
        F.expr("aggregate(parts, 0L, (s, p) -> s + p.part.n)").alias("n_tokens"),
        F.expr("size(filter(parts, p -> NOT p.new))").alias("n_repeated"),
        F.expr(f"""aggregate(parts, struct(0 AS at, CAST(array() AS array<struct<start: int, length: int>>) AS spans),
            (s, p) -> struct(
                s.at + length(p.part.head) + length(p.part.body) + {len(END)} AS at,
                CASE WHEN p.new AND p.part.learn
                     THEN concat(s.spans, array(struct(s.at + length(p.part.head) AS start, length(p.part.body) AS length)))
                     ELSE s.spans END AS spans),
            s -> s.spans)""").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, learned, n_chars): the turns that are new in each window, as
    (role, text), and the texts under its loss mask, all recovered from `text` alone."""
    new = F.filter(F.slice(F.split("text", END), F.col("n_repeated") + 1, F.length("text") + 1), lambda x: x != "")
    turns = F.transform(new, lambda x: F.struct(
        F.url_decode(F.substring_index(F.substr(x, F.lit(5)), ": ", 1)).alias("role"),
        unescaped(F.substr(x, F.locate(": ", x) + 2)).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s.start + 1, s.length)))
    return formatted.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"),
                            F.length("text").cast("long").alias("n_chars"))


def digests(windows_read: DataFrame) -> DataFrame:
    """One row per conversation: its turns and its learned texts in order, as digests.

    Windows are reduced to one string each before they meet; a digest needs the whole conversation
    as one value, which is the only thing here that a single task holds.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    each = windows_read.select(
        "conv_id", "window", F.size("turns").alias("n"), turns.alias("turns"),
        F.array_join("learned", "").alias("learned"), "n_chars")
    return each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"),
    ).select(
        "conv_id", F.col("n_turns").cast("long"),
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("w.learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("w.learned", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )
