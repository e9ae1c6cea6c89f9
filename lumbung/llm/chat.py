"""Chat logs folded into final conversations and rendered, with built-in functions only.

A log has events (conv_id, seq, kind, message, role, text):

* ``open`` begins a message with its role and first text,
* ``delta`` adds text to its end,
* ``edit`` puts another text in its place,
* ``regenerate`` empties it and voids every later message written before that event.

A message's text is what its last ``open``, ``edit`` or ``regenerate`` set, followed by the deltas
after it. A turn is written as ``<s>role[INST]text</s>``, for assistants with ``[/INST]``. Control
strings inside roles and texts get a backslash after their first character, also when they have
some already, so that taking one away gives back the original.

Defined results: null texts and roles are empty; events that are equal throughout count once (logs
may be delivered twice); a conversation without messages gives no row; null conv_id is a
conversation of its own; an empty log gives no rows; other columns are not read. Deltas are folded
per message before messages meet, in a window over one row per message. One conversation's messages meet in one row, because its text is one value; time grows in proportion to
its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.llm.common import pick

BEGIN, END, PROMPT, ANSWER = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"
CONTROL = "(/?s>|/?INST\\])"
DELTA_CHARS = 200
BLOCK = 4096  # code points


def escaped(text: Column) -> Column:
    """No control string is left; reversible."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"([<\\[])(\\\\*){CONTROL}", "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*){CONTROL}", "$1$2$3")


def folded(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    An event is void if it is older than the latest regeneration of any earlier message. That is a
    running maximum over one row per message, so events are grouped by message and never sorted by
    conversation.
    """
    events = pick(log, conv_id="conv_id", seq="seq", kind="kind", message="message", role="role",
                  text="text").dropDuplicates()
    kind = F.col("kind")
    parts = events.groupBy("conv_id", "message").agg(
        F.max("seq").alias("last"),
        F.max(F.when((kind == "regenerate") & F.col("message").isNotNull(), F.col("seq"))).alias(
            "again"),
        F.max(F.when(kind != "delta", F.struct("seq", "kind", "text"))).alias("reset"),
        F.max(F.when(kind == "open", F.struct("seq", "role"))).alias("opened"),
        F.array_sort(F.collect_list(F.when(kind == "delta", F.struct("seq", "text")))).alias(
            "deltas"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(
        Window.unboundedPreceding, -1)
    alive = parts.withColumn("void", F.max("again").over(earlier)).where(
        "void is null or last >= void")

    def lives(seq: Column) -> Column:
        return F.col("void").isNull() | (seq >= F.col("void"))

    reset = F.when(lives(F.col("reset.seq")), F.col("reset"))
    alive = alive.withColumn("reset", reset)
    after = F.filter("deltas", lambda d: lives(d["seq"]) & (
        F.col("reset").isNull() | (d["seq"] > F.col("reset.seq"))))
    start = F.when(F.col("reset.kind") == "regenerate", F.lit("")).otherwise(
        F.coalesce(F.col("reset.text"), F.lit("")))
    role = F.when(lives(F.col("opened.seq")), F.col("opened.role"))
    return alive.select("conv_id", "message", F.coalesce(role, F.lit("")).alias("role"), F.concat(
        start, F.array_join(F.transform(after, lambda d: F.coalesce(d["text"], F.lit(""))), "")
    ).alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the text and its spans (start, length) that bear the loss.

    A turn's place is a running sum of lengths, so a conversation costs time in proportion to it.
    """
    own = F.col("role") == ASSISTANT
    head = F.concat(F.lit(BEGIN), escaped(F.col("role")), F.when(own, F.lit(ANSWER)).otherwise(
        F.lit(PROMPT)))
    turns = messages.select("conv_id", "message", own.alias("own"), head.alias("head"),
                            escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(
        Window.unboundedPreceding, -1)
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.length("head")).alias("start"),
                    F.length("body").cast("long").alias("length"))
    held = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", F.concat(
            F.col("head"), F.col("body"), F.lit(END)).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("loss"))
    return held.select("conv_id", F.array_join(F.transform(
        "turns", lambda t: t["turn"]), "").alias("formatted"), "loss")


def _under(text: Column, spans: Column) -> Column:
    """The texts under spans, each looked up in the blocks it touches, not from the text's start."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias(
        "blocks"), spans.alias("spans"))

    def cut(blocks: Column, span: Column) -> Column:
        first = F.floor(span["start"] / BLOCK)
        count = F.floor((span["start"] + span["length"]) / BLOCK) - first + 1
        return F.substring(
            F.array_join(F.slice(blocks, (first + 1).cast("int"), count.cast("int")), ""),
            (span["start"] - first * BLOCK + 1).cast("int"), span["length"].cast("int"))

    # The array of one binds the blocks to a name, or they would be made again for every span.
    bound = F.transform(F.array(parts), lambda x: F.transform(
        x["spans"], lambda s: cut(x["blocks"], s)))
    return F.element_at(bound, 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), from the rendered text and spans alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.regexp_extract(p, "(?s)^<s>(.*?)\\[/?INST\\]", 1)).alias("role"),
        unescaped(F.regexp_replace(p, "(?s)^<s>.*?\\[/?INST\\]", "")).alias("text")))
    loss = F.array_join(F.transform(
        _under(F.col("formatted"), F.col("loss")), unescaped), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """Digest columns of conversations that were read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def conversation_log(turns: DataFrame, chunk: int = DELTA_CHARS) -> DataFrame:
    """The log of stored conversations (conv_id, turn, role, text), one message per row.

    Prompts are opened empty and edited to their text. Answers are first streamed as a draft (their
    first ``chunk`` characters), regenerated, and streamed again in parts of ``chunk`` characters.
    Rows of one conversation are numbered by turn, role and text.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(order).alias("message"),
                       F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    n = F.ceil(F.length("text") / chunk)

    def event(seq: Column, kind: str, text: Column) -> Column:
        return F.struct(seq.cast("long").alias("step"), F.lit(kind).alias("kind"), text.alias(
            "text"))

    empty = F.lit("")
    deltas = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: event(
        i + 2, "delta", F.substring(F.col("text"), ((i - 1) * chunk + 1).cast("int"), F.lit(chunk))))
    streamed = F.when(n > 0, deltas).otherwise(F.array().cast(
        "array<struct<step:bigint,kind:string,text:string>>"))
    answer = F.concat(F.array(
        event(F.lit(0), "open", empty), event(F.lit(1), "delta", F.substring("text", 1, chunk)),
        event(F.lit(2), "regenerate", empty)), streamed)
    prompt = F.array(event(F.lit(0), "open", F.substring("text", 1, chunk)),
                     event(F.lit(1), "edit", F.col("text")))
    steps = F.when(F.col("role") == ASSISTANT, answer).otherwise(prompt)
    return rows.select("conv_id", "message", "role", F.explode(steps).alias("e")).select(
        "conv_id", (F.col("message").cast("long") * (1 << 32) + F.col("e.step")).alias("seq"),
        F.col("e.kind").alias("kind"), "message", "role", F.col("e.text").alias("text"))
