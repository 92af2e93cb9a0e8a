"""Operator 8, chat formatting by multi-party perspective rotation, with DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as named users; system turns are
kept as they are. The mask lists the ranges of characters to learn from: what the assistant says, with the mark that ends it.

Conversations are taken in parts of up to PART turn numbers, so that no row or group holds more than that of a conversation that never ends; part p of a
perspective follows part p - 1, and their texts, one after the other, are the whole. Turns without a number are one part, and so are all that share a number.

Defined cases: a null or empty speaker is called "unknown", a null text is empty, turns without a number come first; equal turn numbers are ordered by
speaker, then text. Rows without a conversation id are one conversation. Conversations of system turns alone have no perspective. An empty table gives
an empty result. Marks inside a text are broken up, so that they can't end a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"
PART = 1024


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, perspective, n_turns, rendered, mask (array of start and length in characters of what is learned)."""
    tmp = Scratch(turns.sparkSession, "chat")
    name = F.when(F.trim(speaker) == "", None).otherwise(F.trim(speaker))
    said = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |")
    one = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.regexp_replace(F.coalesce(name, F.lit("unknown")), r"<\||\n", "_").alias("speaker"), said.alias("text")
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long"))
    people = one.where("speaker <> 'system'").groupBy("conv_id", "speaker").agg(F.lit(1).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("speaker")).alias("people"))
    line = F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("lines")
    parts = one.groupBy("conv_id", "part").agg(line)
    seen = _with(parts, tmp.cut(people, "people")).select("conv_id", "part", "lines", F.explode("people").alias("perspective"))
    head = lambda x: (
        F.when(x["speaker"] == F.col("perspective"), F.lit(f"{START}assistant\n"))
        .when(x["speaker"] == "system", F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), x["speaker"], F.lit("\n")))
    )
    pieces = F.transform("lines", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (x["speaker"] == F.col("perspective")).alias("own")))
    seen = seen.withColumn("pieces", pieces)
    none = F.expr("named_struct('at', 0L, 'mask', cast(array() AS array<struct<start: bigint, length: bigint>>))")
    walk = F.aggregate(
        "pieces",
        none,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    text_of = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "")
    return seen.select("conv_id", "part", "perspective", F.size("pieces").cast("long").alias("n_turns"), text_of.alias("rendered"), walk.alias("mask"))


def _with(parts: DataFrame, people: DataFrame) -> DataFrame:
    """The parts with the people of their conversation; a null id equals itself."""
    other = people.withColumnRenamed("conv_id", "of")
    return parts.join(other.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


#: The digest that the query returns, in DuckDB.
SQL = r"""
WITH o AS (SELECT conv_id, turn, coalesce(floor(turn / 1024), -1)::BIGINT AS part, regexp_replace(coalesce(nullif(trim(role), ''), 'unknown'), '<\||\n', '_', 'g') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM o WHERE speaker <> 'system'),
l AS (SELECT o.conv_id, part, perspective, turn, speaker, text,
        CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head,
        text || '<|im_end|>' || chr(10) AS body FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, part, perspective, count(*) AS n_turns, md5(string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, text)) AS rendered_md5,
       coalesce(sum(length(body)) FILTER (speaker = perspective), 0)::BIGINT AS learned_chars
FROM l GROUP BY conv_id, part, perspective
"""
