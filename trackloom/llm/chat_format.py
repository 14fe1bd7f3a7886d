"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The turns that two conversations share from the start are rendered once, as the prompt; what follows is rendered for each
side, with the spans that a loss may count: the assistant's texts and the marks that end them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def clean(text: Column) -> Column:
    """A text can't hold the template's marks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "<| im_")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of the rendered turns that count, in code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + len(OPEN) + F.char_length(t["role"]) + 1
        end = body + F.char_length(t["text"]) + len(CLOSE)
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(body.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, n_chosen_turns, n_rejected_turns.

    ``turns``: (pair_id, side, turn, role, text) with side chosen or rejected. Turns go by number, then role and text; turns
    that repeat whole count once. Null roles count as user, null texts as empty. The longest common prefix compares role and
    text. A pair whose sides are equal has two empty completions; one that lacks a side has an empty prompt. Rows without
    pair_id or of another side belong to no pair. Empty tables give no rows, and other columns don't matter. A rendered
    conversation is one value, so a pair's turns meet in one row.
    """
    of = turns.where(F.col(pair_id).isNotNull()).select(F.col(pair_id), "side", F.struct(F.col("turn").cast("long").alias("turn"), clean(F.coalesce("role", F.lit("user"))).alias("role"), clean(F.col("text")).alias("text")).alias("t"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("t")))).cast(TURNS).alias(s)
    both = of.where(F.col("side").isin("chosen", "rejected")).groupBy(pair_id).agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    place = F.array_position(same, False)
    n = F.when(place == 0, F.size(same)).otherwise(place - 1).cast("int")
    both = both.withColumn("n", n)
    rest = lambda s: F.slice(F.col(s), F.col("n") + 1, F.size(s))
    return both.select(
        pair_id, F.col("n").alias("n_prompt_turns"), _render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("chosen")).alias("chosen"), _render(rest("rejected")).alias("rejected"), _mask(rest("chosen")).alias("chosen_mask"), _mask(rest("rejected")).alias("rejected_mask"),
        (F.size("chosen") - F.col("n")).alias("n_chosen_turns"), (F.size("rejected") - F.col("n")).alias("n_rejected_turns"),
    )


def branches(conversations: DataFrame, ids_per_bucket: int = 4) -> DataFrame:
    """(pair_id, side, turn, role, text): two continuations of each conversation (conv_id, turn, role, text), as a preference table has them.

    A table of conversations has no preferences. What is chosen is the conversation up to its last answer. What is rejected
    follows it up to one of its answers, which a hash of its id picks, and goes on from there with what another conversation
    has from its own answer of that number on, or from its last one if it has fewer, up to its last answer. The sides part
    early or late, and their lengths differ. A conversation without an assistant's turn has no answer to reject: both sides are
    the whole conversation. Where there is no other conversation with an answer, the rejected side ends where they part.

    The other conversation is found by hashing, so ids may be of any type and have gaps: ids are dealt to as many buckets as give
    each some ``ids_per_bucket``, and a bucket's conversations get the smallest id of the next bucket, or of the one behind it, or else
    the largest. Null
    ids belong to no conversation. Turns go by number, then role and text; a turn that repeats whole counts once.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.get("turns", k - 1)["role"] == "assistant")
    c = stored(whole.withColumn("answers", F.when(F.size("turns") > 0, places)))
    answered = c.where(F.size("answers") > 0)
    n = max(1, answered.count() // ids_per_bucket)
    bucket = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(n)).alias("bucket")
    ends = answered.groupBy(bucket).agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    step = lambda k: ends.select(F.pmod(F.col("bucket") - k, F.lit(n)).alias("bucket"), F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}"))
    named = answered.select("conv_id", bucket).join(step(1), "bucket", "left").join(step(2), "bucket", "left")
    named = named.select("conv_id", F.coalesce(*[F.when(F.col(o) != F.col("conv_id"), F.col(o)) for o in ("low1", "low2", "high1", "high2")]).alias("other"))
    named = named.join(c.select(F.col("conv_id").alias("other"), F.col("turns").alias("o_turns"), F.col("answers").alias("o_answers")), "other", "left")
    both = c.join(named.drop("other"), "conv_id", "left")

    own = F.size("answers")
    pick = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.greatest(own, F.lit(1)).cast("long")).cast("int") + 1
    upto = lambda turns, answers: F.slice(turns, F.lit(1), F.element_at(answers, -1))
    begin = F.element_at("o_answers", F.least(pick, F.size("o_answers")))
    other = F.slice("o_turns", begin, F.element_at("o_answers", -1) - begin + 1)
    parted = F.concat(F.slice("turns", F.lit(1), F.element_at("answers", pick) - 1), F.coalesce(other, F.array().cast(TURNS)))
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.when(own > 0, upto("turns", "answers")).otherwise(F.col("turns")).alias("turns")),
        F.struct(F.lit("rejected").alias("side"), F.when(own > 0, parted).otherwise(F.col("turns")).alias("turns")),
    )
    each = both.select(F.col("conv_id").alias("pair_id"), F.explode(sides).alias("s")).select("pair_id", "s.side", F.posexplode("s.turns").alias("turn", "t"))
    return each.select("pair_id", "side", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
