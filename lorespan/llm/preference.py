"""Preference data from chosen and rejected conversations.

The longest common turn prefix of the two is rendered once as the prompt; what follows it on either
side is rendered as a completion. A completion comes as segments with a mask: 1 where the loss counts
(the text of assistant turns and its end mark), 0 elsewhere (headers, other roles).

DataFrame operations only. Turns meet in one aggregation by conversation, so a row of the result is
as large as a conversation, and a first turn that many conversations share groups nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """How a turn is rendered: start role middle text end."""

    start: str = "<|start|>"
    middle: str = "\n"
    end: str = "<|end|>\n"
    trained: str = "assistant"

    def head(self, turn: Column) -> Column:
        return F.concat(F.lit(self.start), turn["role"], F.lit(self.middle))

    def body(self, turn: Column) -> Column:
        return F.concat(turn["text"], F.lit(self.end))

    def whole(self, turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: F.concat(self.head(t), self.body(t))), "")

    def segments(self, turns: Column) -> Column:
        """array<struct<text, mask>>: header and body of each turn."""
        return F.flatten(F.transform(turns, lambda t: F.array(F.struct(self.head(t).alias("text"), F.lit(0).alias("mask")), F.struct(self.body(t).alias("text"), F.when(t["role"] == self.trained, 1).otherwise(0).alias("mask")))))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns of rows (conv_id, turn, role, text), in order of turn.

    Null roles and texts are empty. Rows without conv_id or turn are left aside. Of several rows of one
    turn the least by role and text stays, so repeated rows change nothing. Other columns are left aside.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(row)).alias("rows"))
    one = F.filter("rows", lambda x, i: (i == 0) | (x["turn"] != F.try_element_at("rows", F.greatest(i, F.lit(1)))["turn"]))
    return rows.select("conv_id", F.transform(one, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of turns, from the first, in which a and b agree in role and text."""
    most = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(most).cast("int")


def masked(segments: Column) -> Column:
    """Character ranges (code points, end exclusive) of a completion where the loss counts."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def add(acc, s):
        end = acc["at"] + F.length(s["text"])
        return F.struct(end.alias("at"), F.when(s["mask"] == 1, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(segments, zero, add)["out"]


def format_pairs(pairs: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """pair_id, n_common, prompt and, for chosen and rejected, the completion and its masked ranges, of pairs (pair_id, chosen, rejected: arrays of turns).

    Null conversations have no turns; a null turn, role or text is an empty one, which is rendered and
    compared like others. Equal conversations have empty completions; one that is a prefix of the other
    has one. Texts may be of any length. Repeated rows come back as often; other columns are left
    aside; an empty table gives an empty one.
    """
    sides = ("chosen", "rejected")
    whole = lambda s: F.transform(F.coalesce(F.col(s), F.array().cast(_TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.select("pair_id", *(whole(s).alias(s) for s in sides))
    rows = rows.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0)))
    rows = rows.select("pair_id", "n_common", template.whole(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"), *(template.segments(rest(s)).alias(s) for s in sides))
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["text"]), "")
    return rows.select("pair_id", "n_common", "prompt", *(c for s in sides for c in (joined(s).alias(s), masked(F.col(s)).alias(f"{s}_masked"))))


def own_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """pair_id, chosen, rejected: one pair of each conversation with a turn to train on.

    Chosen is the conversation up to its last such turn. Rejected has, from the middle one of them on,
    in place of each the reply of the one before it (an answer that does not fit); of a single one it
    has none and ends before it. Where replies in a row are equal, the two part later, or never.
    """
    rows = conversations(turns)
    at = F.transform("turns", lambda t, i: F.when(t["role"] == trained, i + 1).otherwise(0))
    rows = rows.withColumn("at", F.filter(at, lambda i: i > 0)).where(F.size("at") > 0)
    chosen = F.slice("turns", F.lit(1), F.element_at("at", -1))
    middle = F.element_at("at", (F.floor(F.size("at") / 2) + 1).cast("int"))

    def earlier(t, i):
        before = F.try_element_at("at", F.greatest(F.array_position("at", i + 1) - 1, F.lit(1)).cast("int"))
        return F.when((t["role"] == trained) & (i + 1 >= middle), F.struct(t["role"].alias("role"), F.try_element_at("turns", before)["text"].alias("text"))).otherwise(t)

    without = F.slice("turns", F.lit(1), F.element_at("at", -1) - 1)
    return rows.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), F.when(F.size("at") == 1, without).otherwise(F.transform(chosen, earlier)).alias("rejected"))
