"""Chat formatting by perspective rotation: each participant of a dialogue in turn is the assistant.

For every participant, every turn of the dialogue is rendered once: the participant's own turns as
the assistant's, turns of others as a user's with their name, system turns as they are. The loss mask
of a turn covers the text and end mark of own turns and nothing of others. Turns are put in order by
a range sort, and places and offsets come from sums over the sorted ranges, so that a dialogue of any
length is spread over tasks; the rows of a rendering, by position, are its text. Ranges are cut by
the first characters of the texts at the finest, and sorted by whole texts within.

Defined results: rows with a null conv_id take no part; a null role is the participant ``unknown``, a
null text is empty; turns of one number are ordered by role and text, nulls of turn first; repeated
rows are turns each; dialogues with system turns alone have no participant and no row; other columns
are ignored; an empty table gives an empty table. Marks of the template inside a text or a name stay as
they are: start, stop and masks, not the marks, say where a turn begins and what is trained.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written


#: Characters of a text that may cut a range.
RANGE_CHARS = 64


@dataclass(frozen=True)
class Template:
    """What stands around a turn; ``{name}`` is the speaker."""

    assistant: str = "<|im_start|>assistant\n"
    user: str = "<|im_start|>user name={name}\n"
    system: str = "<|im_start|>system\n"
    end: str = "<|im_end|>\n"
    system_role: str = "system"


def render(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, position (from 0), turn, speaker, segment, start and stop (characters of
    the rendering), mask_start and mask_stop (characters of the segment; null if nothing is trained)."""
    given = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.repartitionByRange(n, "conv_id", "turn", "speaker", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("conv_id", "turn", "speaker", "text")
    ordered = written(ordered.select("*", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("range")), "turns")
    people = ordered.where(F.col("speaker") != template.system_role).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    named = F.concat(F.lit(template.user.split("{name}")[0]), F.col("speaker"), F.lit(template.user.split("{name}")[1])) if "{name}" in template.user else F.lit(template.user)
    head = F.when(F.col("speaker") == template.system_role, template.system).when(own, template.assistant).otherwise(named)
    turned = ordered.join(people, "conv_id").withColumn("head", head).withColumn("length", F.length("head") + F.length("text") + len(template.end))
    keys = ["conv_id", "perspective", "range"]
    sums = turned.groupBy(*keys).agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = turned.join(offsets, keys).withColumn("stop", F.col("chars") + F.sum("length").over(upto)).withColumn("position", F.col("turns") + F.row_number().over(upto) - 1)
    return placed.select(
        "conv_id",
        "perspective",
        F.col("position").cast("long").alias("position"),
        "turn",
        "speaker",
        F.concat("head", "text", F.lit(template.end)).alias("segment"),
        (F.col("stop") - F.col("length")).cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"),
        F.when(own, F.length("head")).cast("long").alias("mask_start"),
        F.when(own, F.col("length")).cast("long").alias("mask_stop"),
    )
