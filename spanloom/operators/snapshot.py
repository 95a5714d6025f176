"""Differences of snapshots, and upserts by rebuilding what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.shared import dealt


def diff(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, state: added, deleted, modified or unchanged; null-safe in the compared columns."""
    old = before.select(key, F.struct(*compared).alias("old"))
    new = after.select(key, F.struct(*compared).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return old.join(new, key, "full").select(key, state.alias("state"))


def compare_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """state, n: how many ids are new, removed and stable. One pass over both sides."""
    sides = before.select("id", F.lit(1).alias("side")).union(after.select("id", F.lit(2).alias("side"))).groupBy("id").agg(F.bit_or("side").alias("sides"))
    counted = sides.agg(F.count_if(F.col("sides") == 2).alias("new"), F.count_if(F.col("sides") == 1).alias("removed"), F.count_if(F.col("sides") == 3).alias("stable"))
    return counted.select(F.stack(F.lit(3), F.lit("new"), "new", F.lit("removed"), "removed", F.lit("stable"), "stable").alias("state", "n"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The current rows with the last change of each key in their place."""
    last = Window.partitionBy(*keys).orderBy(*order)
    final = changes.withColumn("\0n", F.row_number().over(last)).where("`\0n` = 1").drop("\0n")
    return current.join(final.select(*keys), keys, "left_anti").unionByName(final.select(*current.columns))


def soft_delete(files: DataFrame, gone: DataFrame, version: int) -> DataFrame:
    """Marks files (path) as deleted; an earlier deletion stays."""
    marked = files.join(gone.select("path", F.lit(True).alias("\0gone")).distinct(), "path", "left")
    return marked.withColumn("deleted_version", F.when(F.col("\0gone"), F.least(F.coalesce("deleted_version", F.lit(version)), F.lit(version))).otherwise(F.col("deleted_version")).cast("long")).drop("\0gone")


def apply_diff(symbols: DataFrame, edges: DataFrame, states: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols after a diff (key id), and edges whose ends are gone set to null.

    Unchanged rows stay, modified and added ones come from ``new_rows``.
    """
    kept = symbols.join(states.where("state = 'unchanged'").select("id"), "id", "left_semi")
    fresh = new_rows.join(states.where("state in ('added', 'modified')").select("id"), "id", "left_semi")
    gone = states.where("state = 'deleted'").select("id")
    out = edges
    for end in ("source", "target"):
        out = out.join(gone.select(F.col("id").alias("\0gone")), F.col(end) == F.col("\0gone"), "left").withColumn(end, F.when(F.col("\0gone").isNull(), F.col(end))).drop("\0gone")
    return kept.unionByName(fresh.select(*symbols.columns)), out


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, qualname, before, after of symbols whose signature is another than in an earlier snapshot.

    Symbols of one qualified name and kind are the same; of several earlier ones the smallest id counts.
    """
    was = before.groupBy("qualname", "kind").agg(F.min_by(F.struct("signature"), "id").alias("was"))
    met = after.select("id", "qualname", "kind", "signature").join(was, ["qualname", "kind"])
    return met.where(~F.col("was.signature").eqNullSafe(F.col("signature"))).select("id", "qualname", F.col("was.signature").alias("before"), F.col("signature").alias("after"))


def validity(rows: DataFrame, keys: list[str], version: str = "graph_version") -> DataFrame:
    """keys, since, until: runs of consecutive versions that have a row of these keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(version))
    runs = dealt(rows.select(*keys, version), rows.count(), *keys).distinct().withColumn("\0run", F.col(version) - place)
    return runs.groupBy(*keys, "\0run").agg(F.min(version).alias("since"), F.max(version).alias("until")).drop("\0run")


def neighbours_between(runs: DataFrame, before: int, after: int) -> DataFrame:
    """source, target, state: the neighbours of each source at two versions, new, removed or stable.

    ``runs``: source, target, since, until of its edges. Both versions are read in one pass.
    """
    at = lambda v: F.lit(v).between(F.col("since"), F.col("until"))
    held = runs.where("source is not null and target is not null").select("source", "target", at(before).alias("a"), at(after).alias("b")).where("a or b")
    sides = held.groupBy("source", "target").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return sides.select("source", "target", F.when(F.col("a") & F.col("b"), "stable").when(F.col("b"), "new").otherwise("removed").alias("state"))
