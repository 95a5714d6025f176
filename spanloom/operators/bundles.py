"""Answers that combine operators: orientation, explanations, contexts, diffs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.names import short_name
from spanloom.functions.paths import is_test_path
from spanloom.operators import analytics, budget, filters, impact, resolve, search, snapshot, spelling, traverse
from spanloom.operators.shared import cut

#: Bytes of an answer.
ANSWER_BYTES = 30_000
# Kinds of edges that contexts follow.
CONTEXT_KINDS = ("CALLS", "CONTAINS", "IMPLEMENTS", "EXTENDS", "IMPORTS", "RPC_IMPL")
Bundle = dict[str, DataFrame]


def orient(files: DataFrame, symbols: DataFrame, edges: DataFrame, metrics: DataFrame, depth: int = 1, top: int = 10) -> Bundle:
    """What a repository is made of: counts, modules, kinds, the most used and most complex symbols."""
    return {
        "counts": analytics.overview(files, symbols, edges),
        "modules": analytics.module_summary(files, symbols, depth),
        "module_edges": analytics.module_edges(symbols, edges, depth),
        "kinds": analytics.by_kind(symbols),
        "most_used": analytics.coupling(symbols, edges, "target", top),
        "most_complex": analytics.top_complexity(symbols, metrics, top),
    }


def repository_map(files: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 1, per_module: int = 5, most: int = 8_000) -> DataFrame:
    """position, content of a map in words: modules, their most called symbols, edges between them;
    what does not fit into ``most`` bytes is left out, later parts first."""
    modules = analytics.module_summary(files, symbols, depth).select(F.lit(1).alias("part"), F.col("module").alias("k1"), F.lit(0).cast("long").alias("k2"), F.format_string("%s: %d files, %d symbols (%s)", "module", "files", "symbols", "languages").alias("content"))
    called = analytics.fan_in_by_module(symbols, edges, per_module).select(F.lit(2), "module", F.col("place").cast("long"), F.format_string("%s (%d calls)", "qualname", "calls"))
    between = analytics.module_edges(symbols, edges, depth).select(F.lit(3), "from_module", -(F.col("calls") + F.col("imports")), F.format_string("%s -> %s: %d calls, %d imports", "from_module", "to_module", "calls", "imports"))
    rows = modules.union(called).union(between).withColumn("answer", F.lit(1))
    kept = budget.byte_prefix(rows, ["answer"], ["part", "k1", "k2", "content"], "content", max(1_000, min(most, 50_000)))
    return kept.select(F.row_number().over(Window.partitionBy("answer").orderBy("part", "k1", "k2", "content")).alias("position"), "content")


def explain_symbol(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = ANSWER_BYTES) -> DataFrame:
    """section, id, qualname, path: the symbols themselves, callers, callees, tests, implementations,
    each section within its part of the bytes. Containers count with their members."""
    own = symbols.join(seeds.select("id").distinct(), "id", "left_semi")
    inside = resolve.members(own.where("kind in ('class', 'struct', 'interface', 'module', 'resource')"), symbols).select("id")
    ids = own.select("id").union(inside).distinct()
    solid = edges.where("source is not null and target is not null").select("source", "target", "kind").distinct()
    end = lambda near, far: solid.join(ids.select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id"), "kind")
    callers, callees = end("target", "source"), end("source", "target")
    tests = callers.join(symbols.where(is_test_path(F.col("path")) | F.col("name").startswith("test_")).select("id"), "id", "left_semi")
    parts = {"source": own.select("id"), "callers": callers.where("kind in ('CALLS', 'XREF')"), "callees": callees.where("kind in ('CALLS', 'XREF')"), "tests": tests, "implements": callees.where("kind in ('EXTENDS', 'IMPLEMENTS')")}
    rows = None
    for name, found in parts.items():
        part = found.select("id").distinct().select(F.lit(name).alias("section"), "id")
        rows = part if rows is None else rows.union(part)
    shown = rows.join(symbols.select("id", "kind", "qualname", "path", "start_line"), "id").withColumn("answer", F.lit(1)).withColumn("text", F.to_json(F.struct("id", "kind", "qualname", "path", "start_line")))
    return budget.sections(shown, ["answer"], "section", ["path", "start_line", "id"], "text", most).select("section", "id", "qualname", "path")


def file_context(path: str, symbols: DataFrame, edges: DataFrame, each: int = 15) -> DataFrame:
    """section, id, name, path of what a file has to do with other files: callers, callees, references."""
    own = symbols.where(F.col("path") == path).select("id")
    other = symbols.where(F.col("path") != path).select("id", short_name(F.col("qualname")).alias("name"), "path")
    out = edges.join(own.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.when(F.col("kind") == "XREF", "references").otherwise("callees").alias("section"))
    into = edges.join(own.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.lit("callers").alias("section"))
    met = out.union(into).where("id is not null").distinct().join(other, "id")
    place = F.row_number().over(Window.partitionBy("section").orderBy("path", "name", "id"))
    return met.withColumn("place", place).where(F.col("place") <= each).select("section", "id", "name", "path")


def gather_context(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, lines: DataFrame, depth: int = 1, most: int = ANSWER_BYTES) -> DataFrame:
    """position, id, path, start_line, content: the seeds' source and that of their neighbours, nearest
    first, regions inside others once, cut where ``most`` bytes are reached."""
    near = traverse.bfs(seeds, traverse.ways(symbols, edges, traverse.BOTH, CONTEXT_KINDS, with_bridges=False), depth)
    spans = near.join(symbols.where(~F.col("kind").isin(*filters.MODULE_KINDS)), "id").select("id", "distance", "path", "start_line", "end_line")
    kept = budget.outer_regions(spans.withColumnsRenamed({"start_line": "start", "end_line": "stop"}), ["path"])
    body = kept.join(lines.withColumnRenamed("path", "file"), (F.col("path") == F.col("file")) & F.col("line").between(F.col("start"), F.col("stop")))
    texts = body.groupBy("id", "distance", "path", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda r: r.content), "\n").alias("content")).withColumn("answer", F.lit(1))
    order = ["distance", "path", "start", "id"]
    cut = budget.byte_prefix(texts, ["answer"], order, "content", most)
    return cut.select(F.row_number().over(Window.partitionBy("answer").orderBy(*order)).alias("position"), "id", "path", F.col("start").alias("start_line"), "content")


def analyze_diff(hunks: DataFrame, symbols: DataFrame, edges: DataFrame, before: DataFrame | None = None, depth: int = 2) -> Bundle:
    """Changed symbols of a diff's hunks (path, hunk_start, hunk_end), what they reach, tests and risk.

    ``before``: symbols of an earlier snapshot, against which signatures are compared.
    """
    by_file = hunks.join(symbols.select("path", "file_id").distinct(), "path").select("file_id", "hunk_start", "hunk_end")
    touched = resolve.overlapping(by_file, symbols)
    inner = resolve.innermost_only(symbols.join(touched.select("id"), "id", "left_semi")).select("id")
    changed = touched.join(inner, "id").join(symbols.select("id", "kind", "qualname", "path", "language"), "id").select("id", "kind", "qualname", "path", "language", "change")
    if before is not None:
        signed = snapshot.signature_changes(before, symbols).select("id", F.lit(True).alias("signed"))
        changed = changed.join(signed, "id", "left").withColumn("change", F.when(F.col("signed"), "signature_changed").otherwise(F.col("change"))).drop("signed")
    changed = cut(changed)
    tests = analytics.test_coverage(changed, symbols, edges, is_test_path(F.col("path")) | F.col("name").startswith("test_"))
    downstream = cut(impact.diff_downstream(changed.select("id"), symbols, edges, depth).join(symbols.select("id", "qualname", "path", "language"), "id"))
    factors = analytics.risk_factors(changed, downstream, tests)
    return {"changed": changed, "downstream": downstream, "tests": tests, "factors": factors, "risk": analytics.risk_level(factors), "next_hops": next_hops(changed)}


def resolve_seeds(query: str, symbols: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """id of what a query names: an id, a qualname, a setting's address, else the best search hits."""
    if query.isdigit():
        return symbols.where(F.col("id") == int(query)).select("id")
    if query.startswith(("env://", "secret://")):
        return edges.where((F.col("target_qualname") == query) & F.col("kind").isin("CONFIG_READ", "CONFIG_BIND", "CONFIG_SOURCE") & F.col("source").isNotNull()).select(F.col("source").alias("id")).distinct()
    exact = symbols.where(F.col("qualname") == query).select("id", F.lit(0).alias("rank"))
    hits = filters.find_symbols(symbols, query, limit).select("id", F.lit(1).alias("rank"))
    both = exact.union(hits)
    return both.join(both.agg(F.min("rank").alias("best")), F.col("rank") == F.col("best")).select("id").distinct()


def suggestions(query: str, symbols: DataFrame, most: int = 3) -> list[str]:
    """Qualified names that may have been meant: of the names that are nearest to the query or its last part."""
    spark = symbols.sparkSession
    last = re.split(r"\.|::", query)[-1]
    asked = spark.createDataFrame([(n,) for n in {query, last} if n], "name string")
    names = symbols.select(F.explode(F.array("name", "qualname")).alias("name"), "qualname")
    near = spelling.near_names(asked, names, most)
    meant = near.join(names, "name").groupBy("qualname").agg(F.min("edits").alias("edits"))
    return [r.qualname for r in meant.orderBy("edits", F.length("qualname"), "qualname").limit(most).collect()]


def next_hops(found: DataFrame) -> DataFrame:
    """method, id, direction, description: what to ask next about symbols (id, kind, qualname)."""
    first = found.orderBy("id").limit(1).select(F.lit("explain_symbol").alias("method"), "id", F.lit(None).cast("string").alias("direction"), F.concat(F.lit("Explain "), "qualname").alias("description"))
    callers = found.where("kind in ('method', 'function')").orderBy("id").limit(1).select(F.lit("analyze_impact"), "id", F.lit("upstream"), F.concat(F.lit("Callers of "), "qualname"))
    return first.union(callers)


def dead_code(symbols: DataFrame, edges: DataFrame) -> Bundle:
    return {"symbols": resolve.dead_symbols(symbols, edges), "imports": resolve.unused_imports(edges), "tests": resolve.orphan_tests(symbols)}


def search_text(sources: DataFrame, symbols: DataFrame, pattern: str, context: int = 0, limit: int = 100) -> DataFrame:
    """path, line, content, before, after, symbol: matches and the innermost symbol around each."""
    hits = search.regex(sources, pattern, min(context, 50)).orderBy("path", "line").limit(min(limit, 500))
    points = hits.join(symbols.select("path", "file_id").distinct(), "path").select("path", "file_id", F.col("line").alias("at"))
    around = resolve.enclosing(points, symbols, ["path", "at"]).select("path", F.col("at").alias("line"), F.col("id").alias("symbol"))
    return hits.join(around, ["path", "line"], "left")
