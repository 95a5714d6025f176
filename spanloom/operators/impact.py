"""Impact analysis: direct traversal, tests and co-changes, fused into one confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import test_target
from spanloom.functions.paths import is_test_file
from spanloom.operators.cochange import evidence_confidence, noisy_or
from spanloom.operators.filters import sure
from spanloom.operators.shared import dealt
from spanloom.operators.traverse import UP, bfs, ways

NOISE = ("module", "namespace", "package")


def direct(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int, way: str = UP, kinds: tuple[str, ...] | None = None, include_tests: bool = True) -> DataFrame:
    """id, distance, parent, kind, via, solid of what a change of the seeds reaches, by all kinds of edges
    or by ``kinds``. Unresolved calls and settings count upwards by their target's name."""
    used = edges if include_tests else edges.where(~is_test_file(F.col("path")))
    return bfs(seeds, ways(symbols, used, way, kinds), depth)


#: Symbols that each of several seeds may reach at least, whatever the bound on all of them.
LEAST_EACH = 50


def batch(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int, way: str = UP, kinds: tuple[str, ...] | None = None, limit: int = 10_000, asked: int = 1, bridges: bool = True) -> DataFrame:
    """query, id, qualname, path, distance of what each query's seeds (query, id) reach, nearest first: as many
    for each of the ``asked`` queries as an even share of ``limit`` is, ``LEAST_EACH`` at least."""
    reached = bfs(seeds, ways(symbols, edges, way, kinds, with_bridges=bridges), depth, most=max(LEAST_EACH, limit // max(asked, 1)), keys=("query",))
    return reached.select("query", "id", "distance").join(symbols.select("id", "qualname", "path"), "id").select("query", "id", "qualname", "path", "distance")


def tests(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """id, source: tests of the seeds by call, import, name and place."""
    found = symbols.where(is_test).select("id", "name", "path", "language")
    own = seeds.join(symbols.select("id", F.col("name").alias("seed_name"), F.col("path").alias("seed_path"), F.col("language").alias("seed_language")), "id").select(F.col("id").alias("seed"), "seed_name", "seed_path", "seed_language")
    used = edges.where("source is not null and target is not null").select(F.col("source").alias("id"), F.col("target").alias("seed"), "kind").join(own.select("seed"), "seed", "left_semi").join(found.select("id"), "id", "left_semi")
    by_edge = used.where("kind in ('CALLS', 'IMPORTS', 'XREF')").select("id", F.when(F.col("kind") == "IMPORTS", "test_import").otherwise("test_call").alias("source"))
    named = found.withColumn("about", F.lower(test_target(F.col("name")))).join(own, (F.col("about") == F.lower("seed_name")) & (F.col("language") == F.col("seed_language"))).select("id", F.lit("test_naming").alias("source"))
    parts = lambda path: F.filter(F.split(F.lower(path), r"[/._]"), lambda p: (p != "") & ~p.isin("test", "tests", "spec", "src"))
    files = lambda df, path, language: df.select(F.col(language).alias("language"), F.col(path).alias(path)).distinct().withColumn("part", F.explode(F.array_distinct(parts(F.col(path)))))
    close = files(found, "path", "language").join(files(own, "seed_path", "seed_language"), ["language", "part"])  # files meet, not their symbols
    near = close.groupBy("language", "path", "seed_path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("language", "path").distinct()
    placed = found.join(near, ["language", "path"], "left_semi").select("id", F.lit("test_proximity").alias("source"))
    return by_edge.union(named).union(placed).distinct()


def historical(seeds: DataFrame, symbols: DataFrame, pairs: DataFrame, min_count: float = 3.0) -> DataFrame:
    """id, frequency: symbols of files that change with the seeds' files, on either side of a pair."""
    files = seeds.join(symbols.select("id", "file_id"), "id").select("file_id").distinct()
    kept = pairs.where(F.col("together") >= min_count)
    other = kept.join(files.select(F.col("file_id").alias("file_a")), "file_a", "left_semi").select(F.col("file_b").alias("file_id"), "confidence").union(kept.join(files.select(F.col("file_id").alias("file_b")), "file_b", "left_semi").select(F.col("file_a").alias("file_id"), "confidence"))
    return symbols.select("id", "file_id").join(other.groupBy("file_id").agg(F.max("confidence").alias("frequency")), "file_id").join(seeds.select("id").distinct(), "id", "left_anti").select("id", "frequency")


def fuse(reached: DataFrame, by_test: DataFrame, by_history: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, sources, confidence, distance, relationship of everything that any layer found.

    History may find nearly all symbols, so evidence is dealt out by the number of these."""
    nothing = F.lit(None)
    evidence = (
        reached.select("id", F.lit("direct").alias("source"), "distance", nothing.cast("double").alias("frequency"))
        .union(by_test.select("id", "source", nothing.cast("int"), nothing.cast("double")))
        .union(by_history.select("id", F.lit("cochange"), nothing.cast("int"), "frequency"))
    )
    weighed = dealt(evidence, symbols.count(), "id").withColumn("confidence", evidence_confidence(F.col("source"), F.col("distance"), F.col("frequency")))
    fused = noisy_or(weighed)
    nearest = weighed.groupBy("id").agg(F.min("distance").alias("near"), F.max(F.col("source").startswith("test_")).alias("tested"))
    label = F.when(F.col("near") == 0, "SEED").when(F.col("near") == 1, "DIRECT").when(F.col("near") > 1, F.concat(F.lit("INDIRECT_"), F.col("near").cast("string"))).when(F.col("tested"), "TEST").otherwise("COCHANGE")
    shown = symbols.where(~F.col("kind").isin(*NOISE)).select("id", F.col("kind"), "qualname", "path")
    return fused.join(nearest, "id").join(shown, "id").select("id", "kind", "qualname", "path", "sources", "confidence", F.coalesce("near", F.lit(1)).alias("distance"), label.alias("relationship"))


def summary(fused: DataFrame) -> DataFrame:
    """What, which, n: how many symbols by file, relationship and distance, and in all."""
    sets = fused.groupingSets([[F.col("path")], [F.col("relationship")], [F.col("distance")], []], "path", "relationship", "distance").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "file").when(F.col("g") == 5, "relationship").when(F.col("g") == 6, "distance").otherwise("total").alias("what"), F.coalesce("path", "relationship", F.col("distance").cast("string"), F.lit("all")).alias("which"), "n")


def ranked(fused: DataFrame, min_confidence: float = 0.0, limit: int | None = None) -> DataFrame:
    """Fused impact sure enough, by distance and name, at most ``limit`` rows."""
    out = sure(fused, min_confidence).orderBy("distance", "qualname", "id")
    return out if limit is None else out.limit(limit)


#: Callers of a change where only the first are asked for.
MOST = 50


def diff_downstream(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Callers of changed symbols by steps, all of them or the first ``most`` by distance and id; confidence 0.9, less
    a fifth for each further step, and less a fifth for a caller that is known by the name it calls alone."""
    reached = bfs(seeds, ways(symbols, edges, UP, ("CALLS",), with_bridges=False), depth).where("distance > 0")
    confidence = 0.9 * F.pow(F.lit(0.8), F.col("distance") - 1) * F.when(F.col("solid"), 1.0).otherwise(0.8)
    label = F.when(F.col("distance") == 1, "caller").otherwise(F.concat(F.lit("caller_depth_"), F.col("distance").cast("string")))
    out = reached.withColumn("confidence", F.round(confidence, 6)).withColumn("relationship", label)
    return out if most is None else out.orderBy("distance", "id").limit(most)
