"""Counts, coupling, duplication, module structure, digests and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.names import trailing_name
from spanloom.functions.paths import first_segment, module_prefix
from spanloom.operators.shared import dealt


def overview(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: files, symbols and edges of a snapshot."""
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return counted(files, "files").union(counted(symbols, "symbols")).union(counted(edges, "edges"))


# Kinds whose fan-in a module's list shows.
LISTED_KINDS = ("function", "method", "class", "struct", "interface", "service")


def coupling(symbols: DataFrame, edges: DataFrame, end: str, limit: int, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """The symbols with the most calls at one end (target: fan-in, source: fan-out)."""
    used = edges.where(F.col(end).isNotNull() & F.col("kind").isin(*kinds))
    counts = used.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return counts.join(symbols.select("id", "kind", "qualname", "path"), "id").orderBy(F.desc("edges"), "id").limit(limit)


def fan_in_by_module(symbols: DataFrame, edges: DataFrame, per_module: int) -> DataFrame:
    """The most called symbols of each top directory."""
    counts = edges.where("kind = 'CALLS' and target is not null").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    called = symbols.where(F.col("kind").isin(*LISTED_KINDS)).select("id", "qualname", first_segment(F.col("path")).alias("module")).join(counts, "id")
    order = Window.partitionBy("module").orderBy(F.desc("calls"), "id")
    return called.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_module)


def by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def duplicate_groups(symbols: DataFrame, metrics: DataFrame, limit: int, min_count: int = 2, min_loc: int = 1, per_group: int = 5) -> DataFrame:
    """The largest groups of symbols with one body, and the first members of each."""
    bodies = metrics.where(F.col("duplication_hash").isNotNull() & (F.col("loc") >= min_loc)).select(F.col("symbol_id").alias("id"), "loc", "duplication_hash")
    known = symbols.join(bodies, "id").select("id", "path", "start_line", "qualname", "duplication_hash")
    groups = known.groupBy("duplication_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "duplication_hash").limit(limit)
    order = Window.partitionBy("duplication_hash").orderBy("path", "start_line", "id")
    return known.join(groups, "duplication_hash").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_group)


def top_complexity(symbols: DataFrame, metrics: DataFrame, limit: int, min_complexity: int = 1) -> DataFrame:
    kept = metrics.where(F.col("complexity") >= min_complexity).select(F.col("symbol_id").alias("id"), "complexity", "loc")
    return symbols.join(kept, "id").orderBy(F.desc("complexity"), F.desc("loc"), "id").limit(limit)


def module_summary(files: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """module, files, symbols, languages. Symbols are counted per file before modules meet."""
    per_file = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        files.join(per_file, "file_id", "left")
        .groupBy(module_prefix(F.col("path"), depth).alias("module"))
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    )


def module_edges(symbols: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """from_module, to_module, calls, imports between different modules."""
    place = lambda side: symbols.select(F.col("id").alias(side), module_prefix(F.col("path"), depth).alias(f"{side}_module"))
    counts = edges.where("kind in ('CALLS', 'XREF', 'IMPORTS') and source is not null and target is not null").groupBy("source", "target").agg(F.count_if(F.col("kind").isin("CALLS", "XREF")).alias("calls"), F.count_if(F.col("kind") == "IMPORTS").alias("imports"))
    joined = counts.join(place("source"), "source").join(place("target"), "target").where("source_module <> target_module")
    return joined.groupBy(F.col("source_module").alias("from_module"), F.col("target_module").alias("to_module")).agg(F.sum("calls").alias("calls"), F.sum("imports").alias("imports"))


def module_coupling(symbols: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """module, incoming, outgoing, instability (outgoing part) over the edges between modules."""
    between = module_edges(symbols, edges, depth)
    ends = between.select(F.col("from_module").alias("module"), F.lit(0).alias("i"), (F.col("calls") + F.col("imports")).alias("o")).union(between.select("to_module", F.col("calls") + F.col("imports"), F.lit(0)))
    return ends.groupBy("module").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing")).withColumn("instability", F.round(F.col("outgoing") / (F.col("incoming") + F.col("outgoing")), 6))


def kinds_text(symbols: DataFrame) -> DataFrame:
    """file_id, summary: how many symbols of which kinds a file has, in words."""
    counts = symbols.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), lambda p: F.concat((-p.n).cast("string"), F.lit(" "), p.kind))
    return counts.groupBy("file_id").agg(F.concat(F.sum("n").cast("string"), F.lit(" symbols: "), F.array_join(parts, ", ")).alias("summary"))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and a digest that does not depend on their order; equal rows count each."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))), 1, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row % 1_000_000_007), F.lit(0)).alias("digest"))


def multiset_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and a digest of a table as a bag of rows: two sums modulo 2^64 of 60 bits each of a row's MD5.

    Fields are put together with their lengths, so no two rows look alike. Sums do not depend on order or
    split, and those of two parts add up to that of both (``merged_digests``).
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    row = df.select(F.md5(F.concat(*(field(F.col(c)) for c in columns)).cast("binary")).alias("row"))
    part = lambda at: F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)")
    return merged_digests(row.select(F.lit(1).cast("long").alias("rows"), part(1).alias("first"), part(16).alias("second")))


def merged_digests(parts: DataFrame) -> DataFrame:
    """rows, first, second of all parts (rows, first, second) together."""
    total = lambda name: F.coalesce((F.sum(name) % F.lit(str(2**64)).cast("decimal(20,0)")), F.lit(0)).cast("decimal(20,0)").alias(name)
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), total("first"), total("second"))


#: What of each table a digest covers. Edges have the names of both ends, as far as these are symbols.
DIGESTED = {
    "files": ["path", "language", "deleted_version"],
    "symbols": ["id", "kind", "qualname", "path", "start_line", "end_line", "signature"],
    "edges": ["kind", "source_name", "target_name", "target_qualname", "path", "line", "sure", "event_ts", "trace_id", "detail"],
    "metrics": ["symbol_id", "loc", "complexity", "duplication_hash"],
}


def graph_digests(files: DataFrame, symbols: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """name, rows, digest of each table of a snapshot. Confidences count to four places."""
    named = edges.withColumn("sure", F.round(F.col("confidence") * 10_000).cast("long"))
    rows = edges.count()
    for end in ("source", "target"):
        spread = F.when(F.col(end).isNull(), F.xxhash64("source", "target_qualname", "line")).otherwise(0)  # edges without this end meet no symbol, in no task of their own
        ends = symbols.select(F.col("id").alias(end), F.lit(0).cast("long").alias("spread"), F.col("qualname").alias(f"{end}_name"))
        named = dealt(named.withColumn("spread", spread), rows, end, "spread").join(ends, [end, "spread"], "left").drop("spread")
    tables = {"files": files, "symbols": symbols, "edges": named, "metrics": metrics}
    return reduce(DataFrame.union, (multiset_digest(df, DIGESTED[name]).select(F.lit(name).alias("name"), "rows", F.concat_ws("-", "first", "second").alias("digest")) for name, df in tables.items()))


def staleness(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """state, n: files added, modified, deleted and unchanged since the index (path, hash on both sides)."""
    old, new = indexed.select("path", F.col("hash").alias("old")), scanned.select("path", F.col("hash").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return old.join(new, "path", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# How many callers and files make a change risky, kinds that are contracts, and severities by rank.
MANY_CALLERS, MANY_FILES = 10, 3
CONTRACT_KINDS = ("interface", "trait", "abstract_class")
SEVERITIES = ("low", "medium", "high", "critical")


def risk_factors(changed: DataFrame, downstream: DataFrame, coverage: DataFrame) -> DataFrame:
    """factor, severity, subject, n of a change: what makes it risky, of which symbol if of one, how many.

    ``changed``: id, change (signature_changed, added, modified), kind, qualname, language.
    ``downstream``: callers as ``impact.diff_downstream`` finds them, with path and language.
    ``coverage``: id and status as ``test_coverage`` gives them.
    """
    signed = changed.where("change = 'signature_changed'")
    reach = downstream.agg(F.count(F.lit(1)).alias("callers"), F.count_distinct("path").alias("files"))
    foreign = downstream.join(changed.select("language").distinct(), "language", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    bare = coverage.where("status = 'uncovered'").agg(F.count(F.lit(1)).alias("n"))

    def rows(of: DataFrame, name: Column | str, severity: Column | str, n: Column, subject: Column | None = None) -> DataFrame:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return of.select(text(name).alias("factor"), text(severity).alias("severity"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"), n.alias("n"))

    callers, qualname, n = F.col("callers"), F.col("qualname"), F.col("n")
    busy = callers > MANY_CALLERS
    called = signed.select("qualname").join(F.broadcast(reach.where("callers > 0")))  # one row
    return (
        rows(called, F.when(busy, "Signature changed on high-traffic symbol").otherwise("Signature change"), F.when(busy, "critical").otherwise("high"), callers, qualname)
        .union(rows(foreign.where("n > 0"), "Cross-language impact", "high", n))
        .union(rows(signed.where(F.col("kind").isin(*CONTRACT_KINDS)), "Interface/contract change", "high", F.lit(1).cast("long"), qualname))
        .union(rows(reach.where(busy), "High fan-in", "high", callers))
        .union(rows(reach.where(F.col("files") > MANY_FILES), "Wide blast radius", "medium", F.col("files")))
        .union(rows(bare.where("n > 0"), "Missing test coverage", "medium", n))
    )


def risk_level(factors: DataFrame) -> DataFrame:
    """level, factors: the most severe of the factors (low without any) and how many there are."""
    names = F.array(*map(F.lit, SEVERITIES))
    rank = F.array_position(names, F.col("severity"))
    return factors.agg(F.element_at(names, F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("level"), F.count(F.lit(1)).alias("factors"))


def test_coverage(changed: DataFrame, symbols: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """id, tests, status of changed symbols: the qualnames of the tests that call each, by edge or by name."""
    tests = symbols.where(is_test).select(F.col("id").alias("source"), F.col("qualname").alias("test"))
    calls = edges.where("kind = 'CALLS' and source is not null").join(tests, "source").select("test", "target", "target_qualname")
    own = changed.select("id").join(symbols.select("id", "name"), "id")
    by_edge = calls.select("test", F.col("target").alias("id")).join(own.select("id"), "id").select("id", "test")
    by_name = calls.where("target is null").select("test", trailing_name(F.col("target_qualname")).alias("name")).join(own, "name").select("id", "test")
    found = by_edge.union(by_name).groupBy("id").agg(F.array_sort(F.collect_set("test")).alias("tests"))
    listed = F.coalesce("tests", F.array().cast("array<string>"))
    return changed.select("id").join(found, "id", "left").select("id", listed.alias("tests"), F.when(F.size(listed) > 0, "covered").otherwise("uncovered").alias("status"))
