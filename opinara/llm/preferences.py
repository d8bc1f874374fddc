"""Preference pairs: the shared beginning of two conversations as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import let, without

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED = "assistant"
COLUMNS = ["prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]


def collect_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its turns in order, as an array of (turn, role, text).

    Turns with the same number stand in the order of role and text; rows repeated in full count
    once, before the shuffle already. A null role counts as ``unknown``, a null text as empty; a null turn
    comes first. Rows with a null key belong to no conversation that is known: each different one of them is a conversation of its own, with a null key.
    """
    row = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    name = F.col(f"`{key}`")
    alone = F.when(name.isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in (turn, role, text)])).alias("__alone")
    return df.groupBy(name.alias(key), alone).agg(F.array_sort(F.collect_set(row)).alias("turns")).drop("__alone")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both conversations begin with: the same roles and texts."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    return let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False) - 1).otherwise(F.size(s))).cast("int")


def _opening(turn: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), turn["role"], F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    """The turns under the chat template."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """The parts of ``rendered(turns)`` a model is trained on, as ``start:length`` in code points, comma-joined.

    They are the texts of assistant turns with their end marker; the rest is context.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        opening, body = F.length(_opening(t)).cast("long"), F.length(_body(t)).cast("long")
        span = F.concat_ws(":", (done["at"] + opening).cast("string"), body.cast("string"))
        return F.struct(
            (done["at"] + opening + body).alias("at"),
            F.when(t["role"] == TRAINED, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    return F.array_join(F.aggregate(turns, start, step, lambda done: done["spans"]), ",")


def format_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Turns pairs of conversations into a prompt and two completions with masks.

    ``chosen`` and ``rejected`` are arrays of turns as ``collect_turns`` gives them; they are replaced by
    ``COLUMNS``, as are other columns of these names. The prompt is the longest common beginning of whole turns,
    rendered once; equal conversations have empty completions, conversations that differ at once an
    empty prompt. A null array counts as empty, so a missing partner gives an empty prompt too.
    Template marks inside a text stay as they are. No shuffle.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    c, r = (F.coalesce(F.col(f"`{x}`"), none) for x in (chosen, rejected))
    rest = without(df, chosen, rejected, *COLUMNS).columns
    cut = df.select(*[F.col(f"`{x}`") for x in rest], c.alias("__c"), r.alias("__r"), common_turns(c, r).alias("prompt_turns"))
    after = lambda turns: F.slice(turns, F.col("prompt_turns") + 1, F.size(turns))
    return cut.select(
        *[F.col(f"`{x}`") for x in rest],
        "prompt_turns",
        rendered(F.slice(F.col("__c"), F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(after(F.col("__c"))).alias("chosen"),
        mask(after(F.col("__c"))).alias("chosen_mask"),
        rendered(after(F.col("__r"))).alias("rejected"),
        mask(after(F.col("__r"))).alias("rejected_mask"),
    )


def with_earlier_reply(turns: Column) -> tuple[Column, Column]:
    """A chosen and a rejected conversation from one: up to its last reply, and with the reply before it in that place.

    Without an earlier reply the rejected one is empty; a conversation without any reply is both.
    """
    replies = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.get(turns, i - 1)["role"] == TRAINED)

    def rejected(at: Column) -> Column:
        last = F.get(at, F.size(at) - 1)
        earlier = F.when(F.size(at) > 1, F.get(turns, F.get(at, F.size(at) - 2) - 1)["text"]).otherwise("")
        reply = F.struct(F.get(turns, last - 1)["turn"].alias("turn"), F.lit(TRAINED).alias("role"), earlier.alias("text"))
        return F.when(F.size(at) > 0, F.concat(F.slice(turns, F.lit(1), last - 1), F.array(reply))).otherwise(turns)

    chosen = let(replies, lambda at: F.when(F.size(at) > 0, F.slice(turns, F.lit(1), F.get(at, F.size(at) - 1))).otherwise(turns))
    return chosen, let(replies, rejected)
