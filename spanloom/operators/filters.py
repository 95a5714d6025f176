"""Scans with predicates, listings and ranked symbol lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import paths

# Kinds by the class in which symbol search ranks them.
CODE_KINDS = ("class", "function", "method", "struct", "interface", "enum", "trait", "service")
MODULE_KINDS = ("module", "namespace", "package")
HEADING_KINDS = ("heading", "section")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def find_symbols(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols that hold every word of the query in name or qualname, best first.

    ``%`` and ``_`` in a word are wildcards. The order is total: it ends with the id.
    """
    words = query.split()
    if not words:
        return symbols.limit(0)
    longest = max(words, key=len).lower()
    kind = F.when(F.col("kind").isin(*CODE_KINDS), 0).when(F.col("kind").isin(*MODULE_KINDS), 1).when(F.col("kind").isin(*HEADING_KINDS), 3).otherwise(2)
    hit = all_of([F.col("name").ilike(f"%{w}%") | F.col("qualname").ilike(f"%{w}%") for w in words])
    return symbols.where(hit).orderBy(F.when(F.lower("name") == longest, 0).otherwise(1), kind, F.when(F.lower("path").rlike("changelog|migration"), 1).otherwise(0), F.length("qualname"), "name", "id").limit(limit)


def find_by_prefix(symbols: DataFrame, prefix: str, limit: int) -> DataFrame:
    return symbols.where(F.lower("name").startswith(prefix.lower())).orderBy("name", "id").limit(limit)


def list_edges(
    edges: DataFrame,
    kinds: list[str] | None = None,
    path_prefixes: list[str] | None = None,
    min_confidence: float | None = None,
    source: int | None = None,
    target: int | None = None,
    target_qualname: str | None = None,
    languages: list[str] | None = None,
    trace_id: str | None = None,
    since: int | None = None,
    until: int | None = None,
    resolved_only: bool = False,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Edges by path, line and ends. An empty list of kinds gives nothing, no list gives all."""
    wanted = []
    if kinds is not None:
        wanted.append(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    if path_prefixes:
        wanted.append(paths.under(F.col("path"), path_prefixes))
    if min_confidence is not None:
        wanted.append(F.col("confidence") >= min_confidence)
    for name, value in (("source", source), ("target", target), ("target_qualname", target_qualname)):
        if value is not None:
            wanted.append(F.col(name) == value)
    if languages is not None:
        wanted.append(F.col("language").isin(*languages) if languages else F.lit(False))
    if trace_id is not None:
        wanted.append(F.col("trace_id") == trace_id)
    if since is not None:
        wanted.append(F.col("event_ts") >= since)
    if until is not None:
        wanted.append(F.col("event_ts") <= until)
    if resolved_only:
        wanted.append(F.col("source").isNotNull() & F.col("target").isNotNull())
    order = ["path", F.coalesce("line", F.lit(0)), "source", F.coalesce("target", F.lit(0)), "kind", "target_qualname", "confidence", "event_ts"]
    return edges.where(all_of(wanted)).orderBy(*order).offset(offset).limit(limit)


def filter_edges(edges: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, resolved_only: bool = False, drop_tests: bool = False) -> DataFrame:
    """Edges that a traversal may use."""
    wanted = []
    if include is not None:
        wanted.append(F.col("kind").isin(*include) if include else F.lit(False))
    if exclude:
        wanted.append(~F.col("kind").isin(*exclude))
    if resolved_only:
        wanted.append(F.col("source").isNotNull() & F.col("target").isNotNull())
    if drop_tests:
        wanted.append(~paths.is_test_file(F.col("path")))
    return edges.where(all_of(wanted))


# The order of kinds in lists of edges; others come after them.
EDGE_RANKS = {"CONTAINS": 0, "MODULE_FILE": 1, "EXTENDS": 2, "IMPLEMENTS": 3, "IMPORTS_FILE": 4, "IMPORTS": 5, "CALLS": 6, "XREF": 7}
OTHER_RANK = 10


def edge_order(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges by rank of kind, name of source, name of target and detail, with these names and the rank."""
    named = lambda end: symbols.select(F.col("id").alias(end), F.col("qualname").alias(f"{end}_name"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in EDGE_RANKS.items() for x in kv)), F.col("kind")), F.lit(OTHER_RANK))
    both = edges.join(named("source"), "source", "left").join(named("target"), "target", "left")
    shown = both.select(*edges.columns, F.coalesce("source_name", F.lit("")).alias("source_name"), F.coalesce("target_name", "target_qualname", F.lit("")).alias("target_name"), rank.alias("rank"))
    detail = F.coalesce("detail", F.lit("")) if "detail" in edges.columns else F.lit("")
    return shown.orderBy("rank", "source_name", "target_name", detail, "kind", "line")


def projected(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields asked for, in the order of the rows' own; unknown ones are an error, none asks for all."""
    if unknown := [f for f in fields if f not in rows.columns]:
        raise ValueError(f"no such field: {', '.join(unknown)}")
    return rows.select(*(c for c in rows.columns if c in fields)) if fields else rows


#: Fields of a compact answer.
COMPACT = ("id", "kind", "name", "qualname", "path", "start_line", "end_line", "distance", "confidence", "relationship", "edge_kind", "score", "line")


def compact(rows: DataFrame) -> DataFrame:
    """Rows without what a reader can look up: signatures, texts, hashes and versions."""
    return rows.select(*(c for c in rows.columns if c in COMPACT)) if any(c in COMPACT for c in rows.columns) else rows


def sure(rows: DataFrame, least: float) -> DataFrame:
    """Rows of a confidence of ``least`` or more; without a bound above zero, all. No confidence is full confidence."""
    return rows.where(F.coalesce("confidence", F.lit(1.0)) >= least) if least > 0 else rows
