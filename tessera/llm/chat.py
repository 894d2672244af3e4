"""Chat formatting: one rendering of a dialogue for each of its participants.

From a participant's perspective the own turns are the assistant's, those of others are users' turns with
their names, and turns of context roles (``system``) stay what they are for all. The mask marks the characters
of the own turns (text and end mark), which a model is to learn.

A rendering is cut into segments of up to :data:`SEGMENT` turns (one row each), so no task holds more than that of a
dialogue, however long; segments in order are the whole dialogue. Turns are ranked in three bounded steps (within a
turn number's share of checksums, within a block of turn numbers, over blocks), never all in one window.

Edge cases: order is by turn number (null first), then by MD5 of speaker and text; a null speaker is
``unknown``; a null text is empty; an empty or null conversation id is one conversation like any other; ``<|`` in texts and names becomes
``<\\|``, in names also ``|>`` becomes ``|\\>`` and a line end ``\\n``, so that marks are always the template's; a dialogue of context turns alone has no participant and
no row; repeated rows are turns each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
CONTEXT = ("system",)
END = "<|end|>\n"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def _name(c: Column) -> Column:
    """A name that stays within its mark: it can neither end the mark nor begin a line."""
    return F.replace(F.replace(_plain(c), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit("\\n"))


def ranked_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, speaker, text and the rank of each turn (from 0) in its dialogue."""
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        _name(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown"))).alias("speaker"), _plain(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    )
    sum_of = F.md5(F.concat_ws("\n", "speaker", "text"))
    rows = rows.withColumn("sum", sum_of).withColumn("share", F.substring("sum", 1, 2)).withColumn("block", F.floor(F.col("turn") / SEGMENT))
    own = Window.partitionBy("conv_id", "block", "turn", "share").orderBy("sum")
    rows = rows.withColumn("r", F.row_number().over(own) - 1)
    # counts of shares before this one in its block (at most SEGMENT turn numbers x 256 shares), of blocks before
    shares = rows.groupBy("conv_id", "block", "turn", "share").count()
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("conv_id", "block", "turn", "share", F.coalesce(F.sum("count").over(in_block), F.lit(0)).alias("before"))
    blocks = rows.groupBy("conv_id", "block").count()
    of_conv = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("count").over(of_conv), F.lit(0)).alias("base"))
    shares = _null_safe(shares, blocks, ["conv_id", "block"])
    placed = _null_safe(rows, shares, ["conv_id", "block", "turn", "share"])
    return placed.select("conv_id", "speaker", "text", (F.col("base") + F.col("before") + F.col("r")).alias("rank"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    renamed = right.select(*(F.col(k).alias(f"{k}_2") if k in keys else F.col(k) for k in right.columns))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"{k}_2"))
        on = c if on is None else on & c
    return left.join(renamed, on).drop(*(f"{k}_2" for k in keys))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: tuple[str, ...] = CONTEXT, segment: int = SEGMENT) -> DataFrame:
    """conv_id, assistant, segment, n_turns, text and spans (start, end: of the characters to learn) of each segment."""
    ranked = ranked_turns(turns, conv, turn, role, text).withColumn("segment", F.floor(F.col("rank") / segment).cast("int"))
    parts = ranked.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("rank", "speaker", "text"))).alias("turns"))
    who = turns.select(F.col(f"`{conv}`").alias("conv_id"), _name(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown"))).alias("assistant")).where(~F.col("assistant").isin(*map(str, context)) if context else F.lit(True)).distinct()
    seen = _null_safe(parts, who, ["conv_id"])
    is_context = lambda s: s.isin(*context) if context else F.lit(False)
    head = lambda t: F.when(t["speaker"] == F.col("assistant"), F.lit("<|assistant|>\n")).when(is_context(t["speaker"]), F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), t["speaker"], F.lit("|>\n")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["speaker"] == F.col("assistant")).alias("own")))
    seen = seen.select("conv_id", "assistant", "segment", F.size("turns").alias("n_turns"), pieces.alias("pieces"))
    # one pass over the pieces: the end so far, and the spans of own turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step)["spans"]
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return seen.select("conv_id", "assistant", "segment", "n_turns", whole.alias("text"), spans.alias("spans"))
