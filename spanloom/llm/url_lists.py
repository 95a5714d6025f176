"""URL filters by a temporal list join: each capture is judged by the list as of its fetch.

Dated list entries (add or remove a pattern) become validity intervals: an entry rules its pattern
from its date until the pattern's next entry. A capture asks for its host, the host's parent
domains and its path's directories; an equality join on the pattern with the fetch time inside the
interval is the as-of join. Intervals of one pattern do not overlap, so a capture meets at most one
for each name it asks for. Everything is DataFrame operations.

The join is left to Spark: the list is broadcast where it is below the session's threshold, else both
sides are shuffled by pattern and the partitions of common hosts are split at run time.

Defined results: captures are distinct rows of key, url and time, so repeated rows count once; a null
or relative url has no host and matches nothing; a null time matches nothing; entries without a
pattern, date or action take no part; entries of one pattern and date follow each other by id, so the
last one rules; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def names_of(url: Column) -> Column:
    """Patterns that may cover a url: its host, parent domains and host with directories."""
    host, path = host_of(url), F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/")
    folders = F.when(F.size(steps) > 2, F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, folders))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, valid_from, valid_to (null: still valid) of the times at which a pattern is listed.

    ``entries``: entry_id, list, pattern, action (add or remove), dated.
    """
    sound = entries.where(F.col("pattern").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin("add", "remove"))
    after = F.lead("dated").over(Window.partitionBy("list", "pattern").orderBy("dated", "entry_id"))
    return sound.withColumn("valid_to", after).where("action = 'add' and (valid_to is null or valid_to > dated)").select("list", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, url, fetched, blocked, matches, patterns: a row for each distinct capture.

    ``captures``: page_id, url, fetched. ``listed``: what ``intervals`` gives.
    """
    distinct = captures.select("page_id", "url", "fetched").distinct()
    asked = distinct.select("page_id", "url", "fetched", F.explode(names_of(F.col("url"))).alias("pattern")).where(F.col("fetched").isNotNull())
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = asked.join(listed, "pattern").where(active).select("page_id", "url", "fetched", F.concat_ws(":", "list", "pattern").alias("found"))
    none = distinct.select("page_id", "url", "fetched", F.lit(None).cast("string").alias("found"))
    return (
        met.unionByName(none)
        .groupBy("page_id", "url", "fetched")
        .agg(F.array_join(F.array_sort(F.collect_list("found")), ",").alias("patterns"), F.count("found").alias("matches"))
        .select("page_id", "url", "fetched", (F.col("matches") > 0).alias("blocked"), "matches", "patterns")
    )
