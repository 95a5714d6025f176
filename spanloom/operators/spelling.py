"""Names that are nearly what was asked for, by an index of deletions.

Two names are at most two edits apart only if some way of taking up to two characters from the first
``PREFIX`` of each leaves the same. Those variants are the index: names meet by equality and are then
compared in full. A variant that many names have is dealt over as many shares as it needs, and pairs over as
many tasks as there are pairs for.

What is left of two such names without their digits is no more than two edits apart either. So these stems,
of which there are few where names are numbered, are compared first, and only names of near stems get variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.shared import cut

#: Characters of which variants are made, and edits that a name may be away.
PREFIX, EDITS = 24, 2
#: Names of one variant in a share, and pairs that a task compares.
SHARE, TASK_PAIRS = 1_000, 2_000_000


def deletions(name: Column) -> Column:
    """The first characters of a name with up to two of them taken out, in lower case."""
    less = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.overlay(x, F.lit(""), i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    start = F.left(F.lower(name), F.lit(PREFIX))
    one = less(start)
    return F.array_distinct(F.concat(F.array(start), one, F.flatten(F.transform(one, less))))


def _met(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked, name, edits of ``asked`` (asked) and ``names`` (name), both distinct, that are near; pairs can come repeatedly."""
    wanted = cut(asked.select("asked", F.explode(deletions(F.col("asked"))).alias("key")))
    known = names.select("name", F.explode(deletions(F.col("name"))).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    known = cut(known.select("key", "name"))
    count = lambda df, n: df.groupBy("key").agg(F.count(F.lit(1)).alias(n))
    keys = cut(count(known, "n").join(count(wanted, "m"), "key").select("key", "n", "m", F.ceil(F.col("n") / SHARE).cast("long").alias("shares")))
    pairs = keys.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
    dealt = known.join(keys, "key").select("key", "name", F.pmod(F.xxhash64("name"), "shares").alias("share"))
    copied = wanted.join(keys, "key").select("key", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    met = copied.repartition(tasks, "key", "share").join(dealt.repartition(tasks, "key", "share"), ["key", "share"])
    return met.select("asked", "name", F.levenshtein(F.lower("asked"), F.lower("name"), EDITS).alias("edits")).where("edits >= 0")


def stem(name: Column) -> Column:
    """A name without its digits."""
    return F.regexp_replace(F.lower(name), "[0-9]", "")


def near_names(asked: DataFrame, names: DataFrame, best: int = 3) -> DataFrame:
    """asked, name, edits, rank: the ``best`` of ``names`` (name) for each of ``asked`` (name), up to two
    edits away whatever the case; fewer edits first, then shorter and earlier names."""
    wanted = asked.select(F.col("name").alias("asked")).where("asked is not null").distinct()
    known = names.select("name").where("name is not null")
    stems = _met(wanted.select(stem(F.col("asked")).alias("asked")).distinct(), known.select(stem(F.col("name")).alias("name")).distinct())
    close = known.withColumn("stem", stem(F.col("name"))).join(cut(stems.select(F.col("name").alias("stem")).distinct()), "stem", "left_semi")
    order = Window.partitionBy("asked").orderBy("edits", F.length("name"), "name")
    ranked = _met(wanted, close.select("name").distinct()).withColumn("rank", F.dense_rank().over(order))  # a pair met by several variants has one rank
    return ranked.where(F.col("rank") <= best).distinct()
