"""Preference formatting of conversations, in DataFrame expressions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what is left
of each becomes a completion with a mask: the character spans, after the prompt, that the loss may read (the assistant's
texts and their end marks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
RESULTS = ("prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def conversation_table(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of turn rows (conv_id, turn, role, text), in order of (turn, role, text).

    Null roles read 'user', null texts ''. Rows without a conversation id belong to none and are left out; repeated
    rows are turns each. A conversation's turns meet in one row, as its rendering needs them together.
    """
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE + "\n"), t["text"], F.lit(END))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, stop) of the texts and end marks of `role` in the rendering of turns, in characters."""
    head = lambda t: F.char_length(t["role"]) + F.lit(len(OPEN + CLOSE) + 1)
    body = lambda t: F.char_length(t["text"]) + F.lit(len(END))
    sizes = F.transform(turns, lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t["role"] == role).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, s):
        begin = acc["at"] + s["head"]
        stop = begin + s["body"]
        more = F.when(s["own"], F.array(F.struct(begin.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], more).alias("spans"))

    return F.aggregate(sizes, start, step)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two conversations are equal in role and text."""
    paired = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    first = F.array_position(paired, False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise((first - 1).cast("int"))


def preference_rows(pairs: DataFrame) -> DataFrame:
    """pairs with columns chosen and rejected (arrays of (role, text)) -> prompt, completions and their masks.

    Other columns pass through, but those named as a result are replaced. Equal conversations: two empty completions. No
    common turn: an empty prompt. Null conversations count as empty. Repeated rows: a result each.
    """
    empty = F.array().cast(TURNS)
    passed = [c for c in pairs.columns if c not in RESULTS]
    rest = [F.struct(*passed).alias("rest")] if passed else []
    rows = pairs.select(*rest, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    rows = rows.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    tail = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    rest = ["rest"] if passed else []
    rows = rows.select(*rest, "prompt_turns", F.slice("chosen", F.lit(1), F.col("prompt_turns")).alias("p"), tail(F.col("chosen")).alias("c"), tail(F.col("rejected")).alias("r"))
    return rows.select(
        *(["rest.*"] if passed else []), "prompt_turns", render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), loss_spans(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"), loss_spans(F.col("r")).alias("rejected_mask"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected): a conversation against itself with another's last answer.

    The other is the next conversation that has an answer, by ascending conv_id (after the last the first).
    Conversations without an assistant's turn make no pair.
    """
    from .common import materialize, successor

    last = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant")
    rows = conversations.withColumn("at", (F.size("turns") - last + 1).cast("int")).where(F.exists("turns", lambda t: t["role"] == "assistant"))
    rows = materialize(rows.withColumn("answer", F.element_at("turns", F.col("at"))), "conversations")
    after = successor(rows.select("conv_id"), "conv_id", [])
    other = rows.select(F.col("conv_id").alias("next_conv_id"), F.col("answer").alias("other"))
    joined = rows.join(after, "conv_id").join(other, "next_conv_id")
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("at") - 1, F.col("other")).otherwise(t))
    return joined.select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


def op8_chat(spark, sf_dir):
    """Preference rows for every conversation that has an answer."""
    from .common import read_table

    return preference_rows(swapped_answers(conversation_table(read_table(spark, sf_dir, "conversations"))))
