"""Change streams: debounce by session gaps, urgency by last edits, batches, incremental upkeep.

Every function takes batch or streaming DataFrames unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.shared import cut

# Quiet times before a flush, the time within which a further edit is urgent, and when
# so much is pending that everything is built anew.
QUIET_URGENT, QUIET_NORMAL, URGENT_SECONDS, OVERFLOW = "50 milliseconds", "300 milliseconds", 60, 1_000
# Rows and bytes at which a batch is written, and how long one may wait.
BATCH_ROWS, BATCH_BYTES, BATCH_WAIT, BATCH_MS = 100, 10 << 20, "500 milliseconds", 500


def events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream of change events from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def debounced(changes: DataFrame, gap: str | Column = QUIET_NORMAL, late: str | None = None) -> DataFrame:
    """key, start, stop, events: runs of changes of a key with no longer pause than ``gap`` between.

    A stream needs ``late``: how long a change may be overdue. A gap of exactly the length still joins.
    """
    rows = changes.withWatermark("ts", late) if late else changes
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def dynamic_gap(urgent: Column) -> Column:
    """The quiet time by urgency, for ``debounced``."""
    return F.when(urgent, QUIET_URGENT).otherwise(QUIET_NORMAL)


def urgent(changes: DataFrame, seconds: int = URGENT_SECONDS) -> DataFrame:
    """Changes with ``urgent``: whether the same key was changed less than so long before (batch)."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return changes.withColumn("urgent", F.coalesce(F.unix_micros("ts") - F.unix_micros(before) < seconds * 1_000_000, F.lit(False)))


def urgent_stream(changes: DataFrame, seconds: int = URGENT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The streaming form of ``urgent``: the last edit of each key is state, dropped after twice the time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for batch in batches:
            rows = batch.sort_values(["ts", "event_id"])
            stamps = rows["ts"].astype("int64") // 1_000 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].astype("datetime64[us]").astype("int64")
            before = stamps.shift(1)
            if last is not None:
                before.iloc[0] = last
            yield pd.DataFrame({"event_id": rows["event_id"], "key": key[0], "urgent": ((stamps - before) < seconds * 1_000_000) & before.notna()})
            last = int(stamps.iloc[-1])
        if last is not None:
            state.update((last,))
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(mark + 1, last // 1_000 + 2_000 * seconds))

    return changes.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "event_id long, key long, urgent boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def batches(changes: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """batch, changes, bytes of the queue in order, ``most`` to a batch (batch).

    Numbers come from a range sort and counts of its partitions, so no task holds the queue. The sorted table is
    written once: run twice, partitions can be put together differently.
    """
    ranged = cut(changes.select(*order, size).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offset = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    numbered = ranged.withColumn("at", at).join(offset, "part").withColumn("batch", F.floor((F.col("before") + F.col("at")) / most).cast("long"))
    return numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("changes"), F.sum(size).alias("bytes"))


def flushes(changes: DataFrame, order: list[str], ts: str, size: str, most: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES, most_ms: int = BATCH_MS) -> DataFrame:
    """first, changes, bytes of the batches into which a queue is cut: one ends with the change that makes it
    ``most`` changes, or ``most_bytes``, or that comes ``most_ms`` or more after its first, whichever is first.

    ``first`` is the number in the queue of the batch's first change. Where a batch ends follows from where
    it begins: each change points to the first one of the batch after a batch that it would begin. That one
    is at most ``most`` changes ahead, so windows over stretches of ``most`` find it. The cuts that are really
    made are those reached from the beginning; pointers of twice the length reach twice as many each round.
    No task holds the queue.
    """
    c = F.col
    ranged = changes.select(*order, F.unix_micros(c(ts)).alias("\0us"), F.coalesce(c(size), F.lit(0)).cast("long").alias("\0size")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("\0size").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = counts.select("part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("n", "size")))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)).alias("at"), F.coalesce(F.sum("\0size").over(inside), F.lit(0)).alias("upto")).join(offset, "part")
    queue = cut(placed.select((c("n_before") + c("at")).alias("n"), (c("size_before") + c("upto")).alias("bytes"), c("\0us").alias("us")))
    total, all_bytes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()

    stretch = queue.withColumn("stretch", F.expr(f"n div {most}"))
    both = stretch.withColumn("own", F.lit(True)).union(stretch.where("stretch > 0").withColumn("stretch", c("stretch") - 1).withColumn("own", F.lit(False)))
    ahead = lambda by, far: F.min("n").over(Window.partitionBy("stretch").orderBy(by).rangeBetween(far, Window.unboundedFollowing))
    ends = both.select("*", ahead("bytes", most_bytes).alias("by_bytes"), (ahead("us", most_ms * 1_000) + 1).alias("by_time")).where("own")
    pointers = cut(ends.select("n", F.least(c("n") + most, "by_bytes", "by_time", F.lit(total)).alias("next")))
    made, far = cut(pointers.where("n = 0").select("n")), pointers
    while True:
        reached = cut(made.join(far, "n").where(c("next") < total).select(c("next").alias("n")))
        if reached.isEmpty():
            break
        made = cut(made.union(reached))
        far = cut(far.join(far.select(c("n").alias("next"), c("next").alias("beyond")), "next").select("n", c("beyond").alias("next")))
    spans = made.join(pointers, "n").join(queue.select("n", "bytes"), "n")
    after = queue.select(c("n").alias("next"), c("bytes").alias("after"))
    return spans.join(after, "next", "left").select(c("n").alias("first"), (c("next") - c("n")).alias("changes"), (F.coalesce("after", F.lit(all_bytes)) - c("bytes")).alias("bytes"))


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], rebuild: Callable[[], None], checkpoint: str, overflow: int = OVERFLOW, every: str | None = None) -> StreamingQuery:
    """Runs ``apply`` on each micro-batch's last change of every path, or ``rebuild`` on an overflow.

    ``every`` keeps the stream running, with a batch after each such time (as ``BATCH_WAIT``); without it
    what is there is done and the stream ends.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.limit(overflow).count() >= overflow:
            rebuild()
        else:
            last = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event"))
            apply(batch.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n"), number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def polled(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, event of what changed between two scans (path, hash): the fallback where no events come.

    Against an empty scan everything is created, which is how a stream begins.
    """
    old, new = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    event = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full").select("path", event.alias("event")).where("event is not null")


def next_batch(pending: DataFrame, most: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """What is to be done next: urgent changes (event_id, ts, urgent, size) first, then the oldest, up to
    ``most`` rows and until ``most_bytes`` are reached, one row at least."""
    first = pending.orderBy(F.desc("urgent"), "ts", "event_id").limit(most)  # few rows from here on
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("urgent"), "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("\0before", before).where(F.col("\0before") < most_bytes).drop("\0before")
