"""The thirteen methods over a graph of source code, as calls and as JSON requests.

``Engine(files, symbols, edges, metrics, sources).call(method, params)`` gives DataFrames; ``answer``
takes one JSON line and gives one, within a bound of bytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.paths import escapes, under
from spanloom.operators import analytics, bundles, filters, impact, index, search, traverse
from spanloom.operators.shared import cut
from spanloom.plans.model import VERSION, alive, as_of
from spanloom.sources import repository

Result = DataFrame | dict[str, DataFrame]


def checked(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


class Engine:
    """A snapshot of a graph. ``sources`` has path and text for what reads lines, ``pairs`` the mined
    co-changes (file_a, file_b, together, confidence; file ids) for what reads history."""

    def __init__(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, metrics: DataFrame, sources: DataFrame | None = None, pairs: DataFrame | None = None):
        self.files, self.symbols, self.edges, self.metrics, self.sources, self.pairs = files, symbols, edges, metrics, sources, pairs
        self.tables: index.Tables | None = None
        self.latest = VERSION

    def use(self, tables: index.Tables) -> None:
        """Answers from tables of the write path, by default from their last version."""
        self.tables, self.latest = tables, index.next_version(tables.versions) - 1
        self.files, self.metrics = index.files_at(tables, self.latest), index.rows_at(tables, "metrics", self.latest)

    def rows(self, version: int, languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Symbols and edges of a version with path and language."""
        if self.tables is None:
            return as_of(self.symbols, self.files, version, languages), as_of(self.edges, self.files, version, languages)
        found = index.snapshot(self.tables, version)
        return tuple(df.where(F.col("language").isin(*languages)) for df in found) if languages else found

    def call(self, method: str, params: dict | None = None) -> Result:
        if method not in METHODS:
            raise ValueError(f"no such method: {method}")
        p = dict(params or {})
        version = p.pop("graph_version", p.pop("as_of", p.pop("version", self.latest)))
        languages = repository.language_filter(p.pop("languages")) if p.get("languages") else None
        prefixes, chosen, short = p.pop("paths", []) or [], p.pop("fields", []) or [], p.pop("compact", False)
        if away := [x for x in prefixes if escapes(x)]:
            raise ValueError(f"outside of the repository: {', '.join(away)}")
        found = METHODS[method](View(self, version, languages, prefixes), **p)
        shown = lambda rows: filters.projected(filters.compact(rows) if short else rows, [f for f in chosen if f in rows.columns])
        return {name: shown(rows) for name, rows in found.items()} if isinstance(found, dict) else shown(found)

    def answer(self, line: str, most: int = bundles.ANSWER_BYTES) -> str:
        """The JSON answer to a request with ``method`` and ``params``; rows beyond ``most`` bytes are
        left out and ``truncated`` says so."""
        try:
            request = json.loads(line)
            found = self.call(request["method"], request.get("params"))
            parts = found if isinstance(found, dict) else {"rows": found}
            room, out, cut = most // len(parts), {}, False
            for name, df in parts.items():
                used, rows = 0, []
                for (text,) in df.select(F.to_json(F.struct("*"))).toLocalIterator():
                    used += len(text.encode()) + 1
                    if used > room:
                        cut = True
                        break
                    rows.append(json.loads(text))
                out[name] = rows
            return json.dumps({"id": request.get("id"), "result": out, "truncated": cut})
        except (ValueError, KeyError, TypeError) as e:
            return json.dumps({"error": f"{type(e).__name__}: {e}"})

    def serve(self, requests: Iterable[str]) -> Iterator[str]:
        """An answer for each line that is not blank, in order: ``serve(sys.stdin)`` is the JSON-lines loop."""
        for line in requests:
            if line.strip():
                yield self.answer(line)


class View:
    """The files, symbols and edges that one call sees."""

    def __init__(self, engine: Engine, version: int, languages: list[str] | None, prefixes: list[str]):
        below = under(F.col("path"), prefixes)
        self.engine, self.version, self.languages, self.below = engine, version, languages, below
        files = engine.files if engine.tables is None else index.files_at(engine.tables, version)
        self.files = files.where(alive(version)).where(below)
        if languages:
            self.files = self.files.where(F.col("language").isin(*languages))
        self.symbols, self.edges = (rows.where(below) for rows in engine.rows(version, languages))
        self.metrics = engine.metrics if engine.tables is None else index.rows_at(engine.tables, "metrics", version)

    def sources(self) -> DataFrame:
        if self.engine.sources is None:
            raise ValueError("no sources are given")
        return self.engine.sources

    def lines(self) -> DataFrame:
        return search.lines(self.sources())

    def seeds(self, query: str | int) -> DataFrame:
        """What a query names, in the languages asked for or else in any. Where nothing fits, the error says
        what may have been meant."""
        found = cut(bundles.resolve_seeds(str(query), self.symbols, self.edges))
        if found.isEmpty() and self.languages:
            found = cut(bundles.resolve_seeds(str(query), *(rows.where(self.below) for rows in self.engine.rows(self.version))))
        if found.isEmpty():
            near = bundles.suggestions(str(query), self.symbols)
            raise ValueError(f"no such symbol: {query}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return found


def trace_flow(v: View, start: str, end: str | None = None, direction: str = "downstream", max_hops: int = 5, kinds: list[str] | None = None, max_bytes: int = traverse.TRACE_BYTES, offset: int = 0) -> dict[str, DataFrame]:
    """The hops of a trace from a symbol, to ``end`` if it is given, and how many paths there are."""
    goal = None
    if end is not None:
        first = v.seeds(end).orderBy("id").first()
        if first is None:
            raise ValueError(f"no such symbol: {end}")
        goal = first["id"]
    hops = cut(traverse.trace_flow(v.seeds(start), v.symbols, v.edges, traverse.direction(direction), tuple(kinds) if kinds else traverse.TRACE_KINDS, checked("max_hops", max_hops, 0, 10), goal, max_bytes, checked("offset", offset, 0, 1_000_000)))
    return {"hops": hops, "paths": traverse.paths_found(hops, goal)}


def batch_impact(v: View, queries: list[str], depth: int, way: str, kinds: tuple[str, ...] | None, limit: int) -> dict[str, DataFrame]:
    """What each of several queries reaches, and why those failed that name nothing."""
    spark, found, errors = v.symbols.sparkSession, [], []
    for query in dict.fromkeys(map(str, queries)):
        try:
            found.append(v.seeds(query).select(F.lit(query).alias("query"), "id"))
        except ValueError as e:
            errors.append((query, str(e)))
    seeds = reduce(DataFrame.union, found, spark.createDataFrame([], "query string, id long"))
    rows = impact.batch(cut(seeds), v.symbols, v.edges, depth, way, kinds, limit, len(found) + len(errors))
    return {"rows": rows.orderBy("query", "distance", "qualname", "id"), "errors": spark.createDataFrame(errors, "query string, error string")}


def analyze_impact(
    v: View,
    query: str | list[str],
    max_depth: int = 3,
    direction: str = "both",
    kinds: list[str] | None = None,
    include_tests: bool = True,
    layers: tuple[str, ...] | list[str] = ("direct", "test", "historical"),
    min_confidence: float = 0.0,
    limit: int = 10_000,
) -> Result:
    """Impact of a change by the layers asked for, sure enough, nearest first. Several queries are answered by the
    direct layer alone, each within its share of the limit."""
    if isinstance(query, list):
        return batch_impact(v, query, checked("max_depth", max_depth, 0, 10), traverse.direction(direction), tuple(kinds) if kinds else None, checked("limit", limit, 1, 1_000_000))
    if unknown := set(layers) - {"direct", "test", "historical"}:
        raise ValueError(f"no such layer: {', '.join(sorted(unknown))}")
    seeds = cut(v.seeds(query))
    depth = checked("max_depth", max_depth, 0, 10) if "direct" in layers else 0
    reached = impact.direct(seeds, v.symbols, v.edges, depth, traverse.direction(direction), tuple(kinds) if kinds else None, include_tests)
    nothing, pairs = reached.where("false"), v.engine.pairs
    tests = impact.tests(seeds, v.symbols, v.edges, F.col("name").startswith("test_")) if "test" in layers else nothing.select("id", F.lit("").alias("source"))
    history = impact.historical(seeds, v.symbols, pairs) if "historical" in layers and pairs is not None else nothing.select("id", F.lit(0.0).alias("frequency"))
    return impact.ranked(impact.fuse(reached, tests, history, v.symbols), min_confidence, checked("limit", limit, 1, 1_000_000))


def analyze_diff(v: View, diff: str, max_depth: int = 2) -> dict[str, DataFrame]:
    """What a unified diff changes and reaches; signatures are compared with the version before."""
    given = v.symbols.sparkSession.createDataFrame([(0, diff)], "diff_id long, text string")
    before, _ = v.engine.rows(v.version - 1)
    return bundles.analyze_diff(repository.hunks(given), v.symbols, v.edges, before, checked("max_depth", max_depth, 0, 10))


def reindex(v: View, root: str, languages: list[str] | None = None, commit_sha: str | None = None) -> dict[str, DataFrame]:
    """A new version of the engine's tables from a tree of files: what it counts, and its symbols and edges."""
    spark, engine = v.symbols.sparkSession, v.engine
    scanned = cut(repository.scan(spark, root, languages=languages))
    made = index.reindex(engine.tables or index.empty(spark), scanned, commit_sha)
    engine.use(made)
    symbols, edges = index.snapshot(made, engine.latest)
    alive_files = engine.files.where(alive(engine.latest))
    return {"counts": analytics.overview(alive_files, symbols, edges), "symbols": symbols, "edges": edges}


METHODS: dict[str, Callable[..., Result]] = {
    "search": lambda v, query, context=0, limit=100: bundles.search_text(v.sources(), v.symbols, query, context, checked("limit", limit, 1, 500)),
    "explain_symbol": lambda v, query, max_bytes=bundles.ANSWER_BYTES: bundles.explain_symbol(v.seeds(query), v.symbols, v.edges, max_bytes),
    "trace_flow": trace_flow,
    "analyze_impact": analyze_impact,
    "analyze_diff": analyze_diff,
    "gather_context": lambda v, query, depth=1, max_bytes=bundles.ANSWER_BYTES: bundles.gather_context(v.seeds(query), v.symbols, v.edges, v.lines(), checked("depth", depth, 0, 5), max_bytes),
    "context": lambda v, path: bundles.file_context(path, v.symbols, v.edges),
    "orient": lambda v, depth=1: bundles.orient(v.files, v.symbols, v.edges, v.metrics, depth),
    "onboard": lambda v, depth=1: bundles.orient(v.files, v.symbols, v.edges, v.metrics, depth) | {"map": bundles.repository_map(v.files, v.symbols, v.edges, depth)},
    "reindex": reindex,
    "top_complexity": lambda v, limit=20, min_complexity=1: analytics.top_complexity(v.symbols, v.metrics, checked("limit", limit, 1, 500), min_complexity),
    "repo_map": lambda v, depth=1, max_bytes=8_000: bundles.repository_map(v.files, v.symbols, v.edges, depth, most=max_bytes),
    "dead_symbols": lambda v: bundles.dead_code(v.symbols, v.edges),
}
