"""Files that change together, and what fuses evidence of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commits with more files say nothing about pairs.
MOST_FILES = 50
#: Days in which a commit's weight falls to 1/e.
DECAY_DAYS = 90.0
#: The largest fused confidence of three sources or more.
CAP = 0.95

# Confidences of evidence by source.
CONFIDENCES = {"test_call": 0.95, "test_import": 0.7, "test_naming": 0.6, "test_proximity": 0.4}


def mine_pairs(changes: DataFrame, now: Column) -> DataFrame:
    """Pairs of files by their weighted common commits. ``changes``: sha, ts (timestamp), file.

    A commit of n files gives n(n-1)/2 pairs, 1225 at most, so work grows with the commits. The
    age of a commit is taken in whole days before ``now``. A commit's pairs are made and first summed where its
    files are: a large table of ``changes`` is to be dealt out by sha (``shared.dealt``).
    """
    distinct = changes.select("sha", "ts", "file").distinct()
    sizes = distinct.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_FILES)
    weight = F.exp(-F.greatest(F.date_diff(now, F.col("ts")), F.lit(0)).cast("double") / DECAY_DAYS)
    kept = distinct.join(sizes.select("sha"), "sha").withColumn("weight", weight)
    totals = kept.groupBy("file").agg(F.sum("weight").alias("total"))
    commits = kept.groupBy("sha", "ts", "weight").agg(F.array_sort(F.collect_list("file")).alias("files"))  # MOST_FILES at most
    pairs = commits.where("size(files) > 1").select("sha", "ts", "weight", F.posexplode("files").alias("i", "file_a"), "files").select("sha", "ts", "weight", "file_a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("file_b"))
    summed = pairs.groupBy("file_a", "file_b").agg(F.sum("weight").alias("together"), F.max(F.struct("ts", "sha")).alias("last"))
    named = summed.join(totals.select(F.col("file").alias("file_a"), F.col("total").alias("total_a")), "file_a").join(totals.select(F.col("file").alias("file_b"), F.col("total").alias("total_b")), "file_b")
    confidence = F.least(F.lit(1.0), F.col("together") / F.least("total_a", "total_b"))
    return named.select("file_a", "file_b", F.round("together", 6).alias("together"), F.round("total_a", 6).alias("total_a"), F.round("total_b", 6).alias("total_b"), F.round(confidence, 6).alias("confidence"), F.col("last.sha").alias("last_sha"))


def hotspots(pairs: DataFrame, limit: int, min_confidence: float) -> DataFrame:
    return pairs.where(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "file_a", "file_b").limit(limit)


def for_files(pairs: DataFrame, files: list, limit: int, min_confidence: float) -> DataFrame:
    """Partners of the files on either side, most confident first."""
    near = pairs.where((F.col("file_a").isin(*files) | F.col("file_b").isin(*files)) & (F.col("confidence") >= min_confidence))
    return near.orderBy(F.desc("confidence"), "file_a", "file_b").limit(limit)


def symbol_pairs(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of the one file by symbols of the other: from_id, to_id, confidence."""
    side = lambda name, file: symbols.select(F.col("id").alias(name), F.col("file_id").alias(file))
    return pairs.select("file_a", "file_b", "confidence").join(side("from_id", "file_a"), "file_a").join(side("to_id", "file_b"), "file_b").select("from_id", "to_id", "confidence")


def evidence_confidence(source: Column, distance: Column, frequency: Column) -> Column:
    """Direct evidence fades with distance, tests by strategy, co-changes count by frequency."""
    out = F.when(source == "direct", F.lit(0.95) * F.pow(F.lit(0.9), distance)).when(source == "cochange", frequency)
    for name, value in CONFIDENCES.items():
        out = out.when(source == name, value)
    return out.otherwise(0.5)


def noisy_or(evidence: DataFrame, key: str = "id") -> DataFrame:
    """confidence of each key by 1 - prod(1 - c), capped where three sources or more agree."""
    joint = 1 - F.product(1 - F.col("confidence"))
    return evidence.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), joint.alias("c")).select(key, "sources", F.round(F.when(F.col("sources") >= 3, F.least(F.col("c"), F.lit(CAP))).otherwise(F.col("c")), 6).alias("confidence"))
