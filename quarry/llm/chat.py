"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once more: that speaker's turns as the assistant's, all others' as turns of
named users, system turns as they are. The loss mask covers the assistant's texts and their end marks. A rendering is returned by
segments, one for each turn, with their offsets in the whole; dialogues() joins them to one text with its mask. Segments, offsets and masks
are made by DataFrame operations. Offsets are distributed prefix sums over the segments' lengths, so a conversation of any length never has to
fit into one task, and texts are shuffled once, not once for each perspective.

Names. A role is a name as it is, but for blanks, `%` and `<`, which are written as `%` and two hexadecimal digits: different roles have different
names, and no name opens a mark.

Defined results. Null text: an empty turn. Null role: a user without a name, who is no participant. Turns sort by turn (null first), then name (null
first), then the text's MD5; repeated rows are turns of their own. System turns alone: no participant, so no rendering. Null conv_id: one conversation. The
marks' opening "<|" inside a text is written "< |", so a text can't open or close a turn. Very long texts: a turn is a row and has to fit into a
task. Empty table: no rows. Other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pick, prefix_sums

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def speaker_name(role: Column) -> Column:
    """The role as a name: blanks, `%` and `<` escaped, so that names differ as roles do."""
    for c in ("%", " ", "\t", "\n", "\x0b", "\f", "\r", "<"):
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def _head(role: Column, name: Column) -> Column:
    return F.concat(F.lit(START), role, F.when((role == "user") & name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, end, mask_start, mask_end; offsets in code points from 0, end exclusive, and a null mask where nothing is learnt."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").eqNullSafe(SYSTEM).alias("system"), speaker_name(F.col("role")).alias("speaker"), text.alias("text"))
    # Written once, so that a turn's number stays the same in both uses.
    turns = materialize(turns.withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    people = turns.where(F.col("speaker").isNotNull() & ~F.col("system")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    short = turns.select("conv_id", "turn", "system", "speaker", "row", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_text"))
    seen = short.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("system"), SYSTEM).when(F.col("speaker").eqNullSafe(F.col("perspective")), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("h", F.length(_head(F.col("role"), F.col("speaker"))).cast("long"))
    seen = seen.withColumn("n", F.col("h") + F.col("n_text") + len(END) + 1).drop("system", "n_text")
    placed = prefix_sums(seen, ["conv_id", "perspective"], ["turn", "speaker", "digest", "row"], "n", "end", "chat")
    learnt, start = F.col("role") == "assistant", F.col("end") - F.col("n")
    placed = placed.select("row", "perspective", "role", start.alias("start"), "end", F.when(learnt, start + F.col("h")).alias("mask_start"), F.when(learnt, F.col("end") - 1).alias("mask_end"))
    own = turns.select(F.col("row").alias("_row"), "conv_id", "turn", "speaker", "text")
    segment = F.concat(_head(F.col("role"), F.col("speaker")), "text", F.lit(END + "\n"))
    return own.join(placed, F.col("_row") == F.col("row")).select("conv_id", "perspective", "turn", "speaker", "role", segment.alias("segment"), "start", "end", "mask_start", "mask_end")


def dialogues(segmented: DataFrame, most_chars: int = 1 << 24) -> DataFrame:
    """conv_id, perspective, part, text and mask (array of start and end in the text) for training records.

    A rendering of more than `most_chars` is split between turns into parts of about that length, numbered from 0, so that a record has a bounded size; no turn is lost.
    """
    part = F.floor(F.col("start") / most_chars)
    parts = segmented.withColumn("part", part).groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("s"))
    first = F.col("s")[0]["start"]
    mask = F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct((x["mask_start"] - first).alias("start"), (x["mask_end"] - first).alias("end")))
    return parts.select("conv_id", "perspective", "part", F.array_join("s.segment", "").alias("text"), mask.alias("mask"))


_NAME_SQL = "role"
for _c in ("%", " ", "\t", "\n", "\x0b", "\f", "\r", "<"):
    _NAME_SQL = f"replace({_NAME_SQL}, chr({ord(_c)}), '%{ord(_c):02X}')"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role IS NOT DISTINCT FROM 'system' AS system, {_NAME_SQL} AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND NOT system
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, CASE WHEN system THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role, text
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' AND speaker IS NOT NULL THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM s
), g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
), e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, md5(text) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g)
SELECT conv_id, perspective, turn, speaker, role, segment, CAST("end" - length(segment) AS BIGINT) AS start, "end",
  CASE WHEN role = 'assistant' THEN CAST("end" - length(segment) + length(head) AS BIGINT) END AS mask_start, CASE WHEN role = 'assistant' THEN CAST("end" - 1 AS BIGINT) END AS mask_end
FROM e
"""
