"""The write path: scanned files become files, symbols and edges of a new version of the graph.

A version is a change to the one before. ``files`` says for each file since when it is as it is and in
which versions its symbols and its edges were written; rows of unchanged files are not written again.

``reindex`` keeps the join of names up to date as a view. Files that changed are extracted and their names
looked up among all symbols. Of the other files, those are looked up again that have an edge or a string
literal whose name meets a name that came, went or moved; the names that edges were made of stay in their
rows. So the result is that of a full index, and the work follows the change. Ids are hashes of what a row
is, so they do not depend on the order of files or on the way that led to a version.

``save`` appends what a version adds, under new names, and then one small file of a log that names them;
``load`` follows the log. A writer that fails leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.names import stable_id, trailing_name
from spanloom.functions.text import complexity, duplication_hash, slice_lines
from spanloom.operators import xref
from spanloom.operators.resolve import crosses, resolve_by_suffix
from spanloom.operators.shared import cut
from spanloom.sources import extract

FILES = "file_id long, path string, language string, hash string, deleted_version long, graph_version long, symbols_at long, edges_at long"
SYMBOLS = "id long, stable_id string, file_id long, kind string, name string, qualname string, start_line long, end_line long, signature string, graph_version long"
EDGES = "source long, target long, kind string, target_qualname string, file_id long, line long, confidence double, event_ts long, trace_id string, detail string, graph_version long, source_qualname string"
METRICS = "symbol_id long, loc long, complexity long, duplication_hash string, graph_version long, file_id long"
TOKENS = "file_id long, source long, language string, token string, line long, graph_version long"
VERSIONS = "version long, commit_sha string, created timestamp"


@dataclass(frozen=True)
class Tables:
    """A graph in all its versions. ``graph_version`` is the version that wrote a row: ``rows_at`` tells what
    a version holds. ``delta`` is what the last version added, table by table."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    metrics: DataFrame
    tokens: DataFrame
    versions: DataFrame
    delta: dict[str, DataFrame] | None = None


SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "metrics": METRICS, "tokens": TOKENS, "versions": VERSIONS}
#: Which of a file's two numbers tells the rows of a table.
WRITTEN_AT = {"symbols": "symbols_at", "metrics": "symbols_at", "tokens": "symbols_at", "edges": "edges_at"}


def empty(spark: SparkSession) -> Tables:
    return Tables(*(spark.createDataFrame([], schema) for schema in SCHEMAS.values()))


def new_id(*parts: Column) -> Column:
    """A positive id that follows from what a row is."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 62) - 1))


def next_version(versions: DataFrame) -> int:
    return (versions.agg(F.max("version")).first()[0] or 0) + 1


def files_at(tables: Tables, version: int) -> DataFrame:
    """Files as a version has them, those that are deleted by then too."""
    row = F.struct(*(c for c in tables.files.columns if c != "file_id"))
    return tables.files.where(F.col("graph_version") <= version).groupBy("file_id").agg(F.max_by(row, "graph_version").alias("row")).select("file_id", "row.*").select(*tables.files.columns)


def rows_at(tables: Tables, name: str, version: int) -> DataFrame:
    """Symbols, edges, metrics or tokens of a version, with that version as graph_version."""
    live = files_at(tables, version).where("deleted_version is null").select("file_id", F.col(WRITTEN_AT[name]).alias("graph_version"))
    table: DataFrame = getattr(tables, name)
    return table.join(live, ["file_id", "graph_version"], "left_semi").select(*table.columns).withColumn("graph_version", F.lit(version).cast("long"))


def snapshot(tables: Tables, version: int) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of a version with path and language."""
    named = files_at(tables, version).select("file_id", "path", "language")
    return rows_at(tables, "symbols", version).join(named, "file_id"), rows_at(tables, "edges", version).join(named, "file_id")


def symbol_map(symbols: DataFrame) -> DataFrame:
    """file_id, qualname, local_id: the first symbol of each name in each file."""
    return symbols.groupBy("file_id", "qualname").agg(F.min_by("id", F.struct("start_line", "id")).alias("local_id"))


def symbol_rows(items: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """Symbols of extracted items.

    Of items with one name, kind and signature in a file those after the first are told apart by their place.
    """
    rows = items.where("item = 'symbol'").join(files.select("path", "file_id"), "path").select("file_id", "kind", "name", "qualname", "start_line", "end_line", "signature").distinct()
    identity = stable_id(F.col("qualname"), F.col("signature"), F.col("kind"))
    nth = F.row_number().over(Window.partitionBy("file_id", "stable_id").orderBy("start_line", "end_line", "name"))
    numbered = rows.withColumn("stable_id", identity).withColumn("nth", nth)
    return _shaped(numbered.withColumn("id", new_id(F.col("file_id"), F.col("stable_id"), F.col("nth"))).withColumn("graph_version", F.lit(version)), SYMBOLS)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    have = set(df.columns)
    return df.select(*((F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))))


def resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges by name (source_qualname, target_qualname, kind, file_id, language) with source and target.

    A name is looked up among its file's symbols first, then among all; a target that is still open is the
    best symbol by the last part of its name.
    """
    local, everywhere = symbol_map(symbols), symbols.groupBy("qualname").agg(F.min("id").alias("any_id"))
    out = edges
    for end in ("source", "target"):
        name = f"{end}_qualname"
        near = local.select("file_id", F.col("qualname").alias(name), F.col("local_id").alias("near"))
        far = everywhere.select(F.col("qualname").alias(name), F.col("any_id").alias("far"))
        out = out.join(near, ["file_id", name], "left").join(far, name, "left").withColumn(end, F.coalesce("near", "far")).drop("near", "far")
    best = resolve_by_suffix(out.where("target is null and target_qualname is not null"), symbols)
    out = out.withColumn("may_cross", crosses(F.col("kind"))).join(best, ["target_qualname", "language", "may_cross"], "left")
    return out.withColumn("target", F.coalesce("target", "resolved_id")).drop("resolved_id", "may_cross")


def named_edges(items: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of extracted items by the names of their ends."""
    given = items.where("item = 'edge'").join(files.select("path", "file_id"), "path")
    return given.select("kind", "source_qualname", "target_qualname", "file_id", "language", F.col("start_line").cast("long").alias("line"), "detail").distinct()


def metric_rows(scanned: DataFrame, files: DataFrame, symbols: DataFrame, version: int) -> DataFrame:
    """symbol_id, loc, complexity, duplication_hash of functions and methods, from their lines."""
    bodies = symbols.where(F.col("kind").isin("function", "method")).select("id", "file_id", "start_line", "end_line").join(files.select("file_id", "path"), "file_id").join(scanned.select("path", "language", "text"), "path")
    body = bodies.withColumn("body", slice_lines(F.col("text"), F.col("start_line"), F.col("end_line")))
    loc = (F.col("end_line") - F.col("start_line") + 1).alias("loc")
    return _shaped(body.select("file_id", F.col("id").alias("symbol_id"), loc, complexity(F.col("body"), F.col("language")).alias("complexity"), duplication_hash(F.col("body")).alias("duplication_hash"), F.lit(version).alias("graph_version")), METRICS)


def moved_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """qualname, name of the symbols (id, kind, name, qualname, language) that only one side has."""
    what = ["id", "kind", "name", "qualname", "language"]
    sides = before.select(*what, F.lit(1).alias("side")).union(after.select(*what, F.lit(2).alias("side")))
    return sides.groupBy(*what).agg(F.bit_or("side").alias("sides")).where("sides <> 3").select("qualname", "name").distinct()


def met_by(edges: DataFrame, moved: DataFrame, ends: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """The edges by name that may lead elsewhere since symbols of ``moved`` names came, went or moved: one
    end's name is such a name, or the last part of the target's name is the last part of one."""
    c, names = F.col, moved.select("qualname").distinct()
    key = lambda name, kind: F.struct(F.lit(kind).alias("by"), name.alias("value"))
    asked = edges.withColumn("key", F.explode(F.array(*(key(c(f"{end}_qualname"), "whole") for end in ends), key(trailing_name(c("target_qualname")), "last"))))
    keys = names.select(F.explode(F.array(key(c("qualname"), "whole"), key(trailing_name(c("qualname")), "last"))).alias("key")).distinct()
    return asked.join(keys, "key", "left_semi").select(*edges.columns).distinct()


def _delta(tables: Tables, current: DataFrame, gone: DataFrame, source: DataFrame, version: int, commit_sha: str | None) -> dict[str, DataFrame]:
    """What a version adds. ``current`` has the files that changed, ``gone`` those that are no more (file_id),
    ``source`` the texts of the former. What is read more than once is a table of its own."""
    spark, last = tables.files.sparkSession, version - 1
    known = cut(files_at(tables, last).where("deleted_version is null"))
    current, gone = cut(current), cut(gone)
    away = current.select("file_id").union(gone.select("file_id"))
    kept = cut(known.join(away, "file_id", "left_anti"))
    named = kept.select("file_id", "path", "language").union(current.select("file_id", "path", "language"))

    items = cut(extract.extract(source))
    before = cut(rows_at(tables, "symbols", last))
    made = cut(symbol_rows(items, current, version))
    symbols = before.join(kept.select("file_id"), "file_id", "left_semi").select(*made.columns).union(made)
    spoken = cut(symbols.join(named, "file_id"))
    lost = before.join(away, "file_id", "left_semi").join(known.select("file_id", "language"), "file_id")
    moved = cut(moved_names(lost, made.join(current.select("file_id", "language"), "file_id")))

    carried = cut(rows_at(tables, "edges", last).join(kept.select("file_id", "language"), "file_id"))
    tokens = cut(rows_at(tables, "tokens", last).join(kept.select("file_id"), "file_id", "left_semi").select(*(c.split()[0] for c in TOKENS.split(", "))))
    by_name = carried.where(~F.col("kind").isin(*xref.KINDS))
    again = cut(met_by(by_name, moved).select("file_id").union(xref.naming(tokens, moved).select("file_id")).distinct())

    literals = cut(xref.owned_literals(source, spoken))
    own_tokens = cut(_shaped(xref.tokens(literals).withColumn("graph_version", F.lit(version)), TOKENS))
    fresh = named_edges(items, current)
    asked = cut(fresh.union(by_name.join(again, "file_id", "left_semi").select(*fresh.columns)))
    linked = resolved(asked, spoken).withColumn("confidence", F.lit(1.0))
    from_names = xref.by_token(own_tokens.union(tokens.join(again, "file_id", "left_semi").select(*own_tokens.columns)), spoken)
    stay = carried.where(F.col("kind") == xref.ROUTE).join(again, "file_id", "left_semi")
    parts = [linked, from_names, xref.by_route(literals), stay]
    edges = reduce(DataFrame.union, (_shaped(p.withColumn("graph_version", F.lit(version)), EDGES) for p in parts))

    at = F.lit(version).cast("long")
    entries = [
        current.withColumns({"deleted_version": F.lit(None).cast("long"), "symbols_at": at, "edges_at": at}),
        known.join(gone.select("file_id"), "file_id", "left_semi").withColumns({"deleted_version": at, "symbols_at": F.lit(None).cast("long"), "edges_at": F.lit(None).cast("long")}),
        kept.join(again, "file_id", "left_semi").withColumn("edges_at", at),
    ]
    return {
        "files": reduce(DataFrame.union, (_shaped(e.withColumn("graph_version", at), FILES) for e in entries)),
        "symbols": made,
        "edges": edges,
        "metrics": metric_rows(source, current, made, version),
        "tokens": own_tokens,
        "versions": spark.range(1).select(at.alias("version"), F.lit(commit_sha).cast("string").alias("commit_sha"), F.current_timestamp().alias("created")),
    }


def _grown(tables: Tables, delta: dict[str, DataFrame]) -> Tables:
    delta = {name: cut(df) for name, df in delta.items()}
    return Tables(*(getattr(tables, name).unionByName(df) for name, df in delta.items()), delta)


def reindex(tables: Tables, scanned: DataFrame, commit_sha: str | None = None) -> Tables:
    """``tables`` and a further version of them, as ``scanned`` (path, language, hash, text) has it."""
    version = next_version(tables.versions)
    known = files_at(tables, version - 1)
    seen = scanned.select("path", "language", "hash")
    met = seen.join(known.select("path", "file_id", F.col("hash").alias("was"), "deleted_version"), "path", "left")
    changed = met.where(F.col("file_id").isNull() | F.col("deleted_version").isNotNull() | ~F.col("hash").eqNullSafe(F.col("was")))
    current = changed.select(F.coalesce("file_id", new_id(F.col("path"))).alias("file_id"), "path", "language", "hash")
    gone = known.where("deleted_version is null").join(seen.select("path"), "path", "left_anti")
    return _grown(tables, _delta(tables, current, gone, scanned.join(current.select("path"), "path", "left_semi"), version, commit_sha))


def delete_files(tables: Tables, gone: DataFrame) -> Tables:
    """``tables`` and a further version without the files ``gone`` (file_id) and all they hold.

    Edges that led there lead to what their names mean now, or nowhere.
    """
    version, spark = next_version(tables.versions), tables.files.sparkSession
    none = spark.createDataFrame([], "file_id long, path string, language string, hash string")
    return _grown(tables, _delta(tables, none, gone, spark.createDataFrame([], "path string, language string, hash string, text string"), version, None))


def pruned(tables: Tables, versions: list[int]) -> Tables:
    """What some versions need, and no rows beside that."""
    later = F.lead("graph_version").over(Window.partitionBy("file_id").orderBy("graph_version"))
    used = F.exists(F.array(*(F.lit(v).cast("long") for v in versions)), lambda v: (v >= F.col("graph_version")) & (F.col("later").isNull() | (v < F.col("later"))))
    files = tables.files.withColumn("later", later).where(used).drop("later")
    live = lambda name: files.select("file_id", F.col(WRITTEN_AT[name]).alias("graph_version")).distinct()
    rows = {name: getattr(tables, name).join(live(name), ["file_id", "graph_version"], "left_semi").select(*getattr(tables, name).columns) for name in WRITTEN_AT}
    return Tables(files=files, versions=tables.versions.where(F.col("version").isin(*versions)), **rows)


def drop_version(tables: Tables, version: int) -> Tables:
    """Without a version, and without the rows that only this one has. The last version stays."""
    rest = sorted(r.version for r in tables.versions.select("version").collect())
    if version == rest[-1]:
        raise ValueError("the last version is what the next one starts from")
    return pruned(tables, [v for v in rest if v != version])


class Log:
    """The commits of a folder: numbered JSON files, each with the paths that it adds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.at = folder.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def entries(self) -> list[dict]:
        where = self.at(f"{self.folder}/_log")
        if not self.fs.exists(where):
            return []
        found = []
        for path in sorted(str(s.getPath()) for s in self.fs.listStatus(where) if s.getPath().getName().endswith(".json")):
            stream = self.fs.open(self.at(path))
            try:
                found.append(json.loads(self.text.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return found

    def commit(self, number: int, entry: dict) -> None:
        """Makes an entry visible as a whole, or fails if another has its number."""
        draft, final = (self.at(f"{self.folder}/_log/{name}") for name in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise ValueError(f"another writer has made commit {number}")

    def keep_only(self, table: str, paths: set[str]) -> None:
        """Removes what a table's folder holds beside ``paths``: what the log names no more, or never did."""
        for status in self.fs.listStatus(self.at(f"{self.folder}/{table}")):
            if f"{table}/{status.getPath().getName()}" not in paths:
                self.fs.delete(status.getPath(), True)


def _state(entries: list[dict]) -> tuple[dict[str, list[str]], int, set[int]]:
    """Paths of each table, the last version, and dropped versions."""
    parts: dict[str, list[str]] = {name: [] for name in SCHEMAS}
    version, dropped = 0, set()
    for entry in entries:
        if entry.get("base"):
            parts = {name: [] for name in SCHEMAS}
        for name, path in entry.get("parts", {}).items():
            parts[name].append(path)
        version = max(version, entry.get("version", 0))
        dropped |= set(entry.get("dropped", ()))
    return parts, version, dropped


def _written(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    paths = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{folder.rstrip('/')}/{paths[name]}")
    return paths


def save(tables: Tables, folder: str) -> None:
    """Appends the last version to a folder that has the one before, or puts all of it into a new one."""
    log, version = Log(tables.files.sparkSession, folder), next_version(tables.versions) - 1
    entries = log.entries()
    _, there, _ = _state(entries)
    if there and (there != version - 1 or tables.delta is None):
        raise ValueError(f"the folder has version {there}, so version {version} does not follow")
    whole = {name: getattr(tables, name) for name in SCHEMAS}
    paths = _written(tables.delta if there else whole, folder)
    log.commit(len(entries) + 1, {"version": version, "parts": paths})


def load(spark: SparkSession, folder: str) -> Tables:
    """All versions of a folder that are not dropped."""
    parts, _, dropped = _state(Log(spark, folder).entries())
    read = lambda name: spark.read.schema(SCHEMAS[name]).parquet(*(f"{folder.rstrip('/')}/{p}" for p in parts[name])) if parts[name] else spark.createDataFrame([], SCHEMAS[name])
    tables = {name: read(name) for name in SCHEMAS}
    return Tables(**tables | {"versions": tables["versions"].where(~F.col("version").isin(*dropped)) if dropped else tables["versions"]})


def forget(spark: SparkSession, folder: str, version: int) -> None:
    """Drops a version by the log alone; ``vacuum`` takes its rows away."""
    log = Log(spark, folder)
    entries = log.entries()
    _, last, dropped = _state(entries)
    if not 0 < version < last or version in dropped:
        raise ValueError(f"version {version} cannot be dropped")
    log.commit(len(entries) + 1, {"dropped": [version]})


def vacuum(spark: SparkSession, folder: str) -> None:
    """Rewrites a folder to what its versions need, and then removes the files that the log does not name.
    Those who read or write meanwhile may need some of them: run it when there are none."""
    log, tables = Log(spark, folder), load(spark, folder)
    entries = log.entries()
    _, version, dropped = _state(entries)
    kept = pruned(tables, [r.version for r in tables.versions.select("version").collect()])
    paths = _written({name: getattr(kept, name) for name in SCHEMAS}, folder)
    log.commit(len(entries) + 1, {"base": True, "version": version, "dropped": sorted(dropped), "parts": paths})
    for name, path in paths.items():
        log.keep_only(name, {path})
