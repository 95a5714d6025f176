"""Results within byte budgets: prefixes, sections, regions, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a budget by section: source, callers, callees, tests, implementations.
SECTIONS = {"source": 30, "callers": 20, "callees": 20, "tests": 10, "implements": 20}


def byte_prefix(items: DataFrame, keys: list[str], order: list[str | Column], text: str, most: int) -> DataFrame:
    """Items of each key in order until ``most`` bytes are reached; the last one is cut to what is left.

    ``used`` is the bytes before an item.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0))
    kept = items.withColumn("used", used).where(F.col("used") < most)
    # a cut has ``most`` as its bound, so short texts stay as they are
    fits = F.octet_length(text) + F.col("used") <= most
    return kept.withColumn(text, F.when(fits, F.col(text)).otherwise(_cut(F.col(text), F.lit(most) - F.col("used"), most)))


def _cut(text: Column, room: Column, most: int) -> Column:
    """The longest prefix of whole characters in ``room`` bytes."""
    state = lambda size, n: F.struct(size.cast("long").alias("size"), n.cast("int").alias("n"))
    kept = F.aggregate(F.split(F.left(text, F.lit(most)), ""), state(F.lit(0), F.lit(0)), lambda a, c: F.when(a.size + F.octet_length(c) <= room, state(a.size + F.octet_length(c), a.n + F.length(c))).otherwise(state(room, a.n)))
    return F.left(text, kept.n)


def sections(items: DataFrame, keys: list[str], section: str, order: list[str | Column], text: str, most: int) -> DataFrame:
    """``byte_prefix`` within each section's part of the budget, whole items alone."""
    share = F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))
    upto = Window.partitionBy(*keys, section).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(F.octet_length(text)).over(upto)).where(F.col("used") <= F.coalesce(F.try_element_at(share, F.col(section)), F.lit(0)) * most / 100)


def outer_regions(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions (start, stop) that no other one of the key contains; of equal ones the first."""
    before = Window.partitionBy(*keys).orderBy("start", F.desc("stop"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("reach", F.max("stop").over(before)).where("reach is null or stop > reach").drop("reach")


def response_prefix(items: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], most: int) -> DataFrame:
    """The longest beginning of each key's items whose JSON array has ``most`` bytes at most."""
    json = F.to_json(F.struct(*columns))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.octet_length(json) + 1).over(upto) + 1  # brackets and commas
    return items.withColumn("bytes", size).where(F.col("bytes") <= most)




def shared_prefix(items: DataFrame, keys: list[str], part: str, order: list[str | Column], size: str, most: int) -> DataFrame:
    """Of each key's arrays (``part``) the longest beginnings that ``most`` bytes have room for, shared fairly.

    What small arrays leave of an even share goes to the others, as water fills a vessel: with totals in rising
    order, the level is the greatest of (what is left after smaller totals) / (arrays that are left). So the
    level comes of a row for each array, and only beginnings within it are read from sums in order. ``level``
    and ``used`` (the bytes up to an item) are added.
    """
    totals = items.groupBy(*keys, part).agg(F.sum(size).alias("\0total"))
    rising = Window.partitionBy(*keys).orderBy("\0total", part)
    smaller = F.coalesce(F.sum("\0total").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(rising) + 1
    levels = totals.select(*keys, ((F.lit(most) - smaller) / left).alias("\0level")).groupBy(*keys).agg(F.floor(F.max("\0level")).alias("level"))
    upto = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(upto)).join(levels, keys).where(F.col("used") <= F.col("level"))
