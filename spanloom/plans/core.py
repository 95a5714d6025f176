"""Queries over the property graph: filters, joins by name, analytics, traversals, impact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import paths
from spanloom.functions.names import test_target
from spanloom.operators import analytics, budget, cochange, filters, impact, resolve, snapshot, traverse
from spanloom.operators.shared import dealt
from spanloom.plans.model import PREFIX, VERSION, Graph, alive, as_of, graph, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Snapshot:
    """The graph at the queries' version: f(iles), s(ymbols) and e(dges) with path and language."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self.all: Graph = graph(spark, sf_dir)
        self.f = self.all.files.where(alive())
        self.s = as_of(self.all.symbols, self.all.files)
        self.e = as_of(self.all.edges, self.all.files)
        self.m = self.all.metrics


def over_graph(name: str, sql: str | None = None, queries: dict[str, Callable] | None = None, oracles: dict[str, str] | None = None) -> Callable:
    """Registers a query on a snapshot and, with the shared prefix, its oracle."""
    queries, oracles = QUERIES if queries is None else queries, ORACLE_SQL if oracles is None else oracles

    def add(query: Callable[[Snapshot], DataFrame]) -> Callable:
        if name in queries:
            raise ValueError(f"two queries have the name {name}")
        queries[name] = lambda spark, sf_dir: query(Snapshot(spark, sf_dir))
        if sql:
            oracles[name] = PREFIX + sql
        return query

    return add


def test_symbol() -> Column:
    return F.col("name").startswith("test_")


@over_graph("alive_filter", "SELECT file_id, path, language FROM f")
def _(g: Snapshot) -> DataFrame:
    return g.f.select("file_id", "path", "language")


@over_graph("as_of_versions", "SELECT v, count(*) AS files FROM g_files, (SELECT unnest([1, 2, 3]) AS v) WHERE deleted_version IS NULL OR deleted_version > v GROUP BY v")
def _(g: Snapshot) -> DataFrame:
    counts = [g.all.files.where(alive(v)).agg(F.count(F.lit(1)).alias("files")).select(F.lit(v).alias("v"), "files") for v in (1, 2, 3)]
    return counts[0].union(counts[1]).union(counts[2])


@over_graph("language_filter", "SELECT id, qualname, language FROM s WHERE language IN ('ASIA', 'EUROPE')")
def _(g: Snapshot) -> DataFrame:
    return as_of(g.all.symbols, g.all.files, VERSION, ["ASIA", "EUROPE"]).select("id", "qualname", "language")


@over_graph("path_prefix_filter", "SELECT id, path FROM s WHERE path = 'ASIA/NATION_2' OR path LIKE 'ASIA/NATION\\_2/%' ESCAPE '\\' OR path LIKE 'EUROPE/%'")
def _(g: Snapshot) -> DataFrame:
    return g.s.where(paths.under(F.col("path"), ["ASIA/NATION_2/", "EUROPE"])).select("id", "path")


@over_graph("symbol_search", "SELECT id, name, qualname FROM s WHERE (name ILIKE '%part%' OR qualname ILIKE '%part%') AND (name ILIKE '%brand1%' OR qualname ILIKE '%brand1%') ORDER BY CASE WHEN lower(name) = 'brand1' THEN 0 ELSE 1 END, CASE WHEN kind IN ('class','function','method','struct','interface','enum','trait','service') THEN 0 WHEN kind IN ('module','namespace','package') THEN 1 WHEN kind IN ('heading','section') THEN 3 ELSE 2 END, length(qualname), name, id LIMIT 50")
def _(g: Snapshot) -> DataFrame:
    return filters.find_symbols(g.s, "part Brand1", 50).select("id", "name", "qualname")


@over_graph("prefix_search", "SELECT id, name FROM s WHERE name ILIKE 'order\\_1%' ESCAPE '\\' ORDER BY name, id LIMIT 100")
def _(g: Snapshot) -> DataFrame:
    return filters.find_by_prefix(g.s, "order_1", 100).select("id", "name")


@over_graph("point_lookup", "SELECT id, qualname, path FROM s WHERE qualname = 'supply.supplier_7' ORDER BY id LIMIT 1")
def _(g: Snapshot) -> DataFrame:
    return g.s.where("qualname = 'supply.supplier_7'").orderBy("id").limit(1).select("id", "qualname", "path")


@over_graph("file_symbols", "SELECT id, name, start_line FROM s WHERE path = 'ASIA/NATION_2/core.py'")
def _(g: Snapshot) -> DataFrame:
    return g.s.where("path = 'ASIA/NATION_2/core.py'").orderBy("start_line", "id").select("id", "name", "start_line")


@over_graph("distinct_languages", "SELECT DISTINCT language FROM f")
def _(g: Snapshot) -> DataFrame:
    return g.f.select("language").distinct().orderBy("language")


EDGE_SQL = "SELECT path, line, source, target, kind, confidence, event_ts FROM e WHERE kind IN ('CALLS', 'XREF') AND (path LIKE 'ASIA/%' OR path LIKE 'EUROPE/%') AND confidence >= 0.5 AND event_ts BETWEEN 788918400 AND 946684800 AND target IS NOT NULL ORDER BY path, line, source, target, kind, target_qualname, confidence, event_ts LIMIT 200 OFFSET 50"


@over_graph("edge_listing", EDGE_SQL)
def _(g: Snapshot) -> DataFrame:
    found = filters.list_edges(g.e, kinds=["CALLS", "XREF"], path_prefixes=["ASIA", "EUROPE"], min_confidence=0.5, since=788_918_400, until=946_684_800, resolved_only=True, limit=200, offset=50)
    return found.select("path", "line", "source", "target", "kind", "confidence", "event_ts")


@over_graph("edge_filter", "SELECT kind, count(*) AS n FROM e WHERE kind <> 'IMPORTS' AND target IS NOT NULL AND path NOT LIKE '%/tests/%' GROUP BY kind")
def _(g: Snapshot) -> DataFrame:
    return filters.filter_edges(g.e, exclude=["IMPORTS"], resolved_only=True, drop_tests=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@over_graph("edges_of_symbols", "SELECT source, target, kind, line FROM e WHERE source BETWEEN 20000000 AND 20000019 OR target BETWEEN 1000000 AND 1000009")
def _(g: Snapshot) -> DataFrame:
    return g.e.where("source between 20000000 and 20000019 or target between 1000000 and 1000009").select("source", "target", "kind", "line")


# joins by name

RESOLVED = """, asked AS (
  SELECT DISTINCT target_qualname, language, kind IN ('RPC_IMPL','RPC_CALL','RPC_ROUTE','HTTP_ROUTE','HTTP_CALL','CHANNEL_PUBLISH','CHANNEL_SUBSCRIBE','CONFIG_SOURCE','CONFIG_READ','CONFIG_BIND','XREF') AS may_cross FROM e WHERE target IS NULL AND target_qualname IS NOT NULL
), ranked AS (
  SELECT a.*, id, row_number() OVER (PARTITION BY target_qualname, a.language, may_cross ORDER BY CASE WHEN s.language = a.language THEN 0 ELSE 1 END, CASE WHEN qualname = target_qualname THEN 0 ELSE 1 END, length(qualname), qualname, id) AS place
  FROM asked a JOIN s ON regexp_extract(qualname, '([^.:]*)$', 1) = regexp_extract(target_qualname, '([^.:]*)$', 1)
  WHERE (s.language = a.language OR may_cross) AND s.kind IN ('method','function','class','interface','struct','property','enum','trait','type','record','service')
), resolved AS (SELECT target_qualname, language, may_cross, id AS resolved_id FROM ranked WHERE place = 1)"""


@over_graph("fuzzy_suffix_resolve", RESOLVED + " SELECT * FROM resolved")
def _(g: Snapshot) -> DataFrame:
    return resolve.resolve_by_suffix(g.e.where("target is null and target_qualname is not null"), g.s)


@over_graph("exact_resolve", "SELECT n.target_qualname, min(s.id) AS resolved_id FROM (SELECT DISTINCT 'supply.supplier_' || (source % 200) AS target_qualname FROM e) n LEFT JOIN s ON s.qualname = n.target_qualname GROUP BY 1")
def _(g: Snapshot) -> DataFrame:
    names = g.e.select(F.concat(F.lit("supply.supplier_"), (F.col("source") % 200).cast("string")).alias("target_qualname"))
    return resolve.resolve_exact(names, g.s)


@over_graph("dangling_repair", "SELECT kind, count(*) AS edges, count(ls.id) AS sources, count(lt.id) AS targets FROM e LEFT JOIN (SELECT DISTINCT id FROM s) ls ON e.source = ls.id LEFT JOIN (SELECT DISTINCT id FROM s) lt ON e.target = lt.id GROUP BY kind")
def _(g: Snapshot) -> DataFrame:
    return resolve.repair_dangling(g.e, g.s).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count("source").alias("sources"), F.count("target").alias("targets"))


@over_graph(
    "dead_symbols",
    """, used AS (SELECT DISTINCT target AS id FROM e WHERE kind IN ('CALLS', 'IMPORTS', 'RPC_IMPL', 'IMPLEMENTS', 'EXTENDS') AND target IS NOT NULL), entries AS (SELECT DISTINCT source AS id FROM e WHERE kind IN ('HTTP_ROUTE', 'RPC_IMPL', 'CHANNEL_SUBSCRIBE') AND source IS NOT NULL)
SELECT id, qualname, path FROM s WHERE kind IN ('function', 'method', 'class', 'struct') AND name NOT IN ('main', '__init__', 'setup', 'teardown', 'configure', 'register') AND id NOT IN (SELECT id FROM used) AND id NOT IN (SELECT id FROM entries)""",
)
def _(g: Snapshot) -> DataFrame:
    return resolve.dead_symbols(g.s, g.e).select("id", "qualname", "path")


@over_graph("unused_imports", ", used AS (SELECT DISTINCT file_id, target_qualname, true AS called FROM e WHERE kind = 'CALLS' AND target_qualname IS NOT NULL) SELECT file_id, target_qualname, source, line FROM e LEFT JOIN used USING (file_id, target_qualname) WHERE kind = 'IMPORTS' AND target_qualname IS NOT NULL AND called IS NULL")
def _(g: Snapshot) -> DataFrame:
    return resolve.unused_imports(g.e).select("file_id", "target_qualname", "source", "line")


@over_graph("orphan_tests", "SELECT id, name, wanted FROM (SELECT *, CASE WHEN starts_with(name, 'test_') THEN substr(name, 6) ELSE name END AS wanted FROM s WHERE kind IN ('function', 'method') AND (name ILIKE 'test%' OR path ILIKE '%test%' OR path ILIKE '%spec%')) WHERE wanted <> '' AND wanted NOT IN (SELECT name FROM s)")
def _(g: Snapshot) -> DataFrame:
    return resolve.orphan_tests(g.s).select("id", "name", "wanted")


@over_graph("incoming_by_name", "SELECT * FROM (SELECT s.id, s.name, e.source, e.line, e.target_qualname, row_number() OVER (PARTITION BY s.id ORDER BY e.source, e.line, e.target_qualname) AS place FROM s JOIN e ON regexp_extract(e.target_qualname, '([^.:]*)$', 1) = s.name WHERE e.kind = 'CALLS' AND e.source IS NOT NULL) WHERE place <= 100")
def _(g: Snapshot) -> DataFrame:
    return resolve.incoming_by_name(g.e, g.s, "CALLS")


BRIDGE_SQL = "SELECT DISTINCT a.target_qualname, a.kind, b.kind AS other_kind, a.source AS from_id, b.source AS to_id FROM e a JOIN e b USING (target_qualname) WHERE (a.kind, b.kind) IN (('HTTP_CALL','HTTP_ROUTE'), ('HTTP_ROUTE','HTTP_CALL'), ('RPC_CALL','RPC_IMPL'), ('RPC_IMPL','RPC_CALL')) AND a.source <> b.source"


@over_graph("bridge_join", BRIDGE_SQL)
def _(g: Snapshot) -> DataFrame:
    return resolve.bridges(g.e)


@over_graph("config_uri_sources", "SELECT DISTINCT source AS id FROM e WHERE target_qualname = 'env://S7' AND kind IN ('CONFIG_BIND', 'CONFIG_READ') AND source IS NOT NULL")
def _(g: Snapshot) -> DataFrame:
    return g.e.where("target_qualname = 'env://S7' and kind in ('CONFIG_BIND', 'CONFIG_READ') and source is not null").select(F.col("source").alias("id")).distinct()


@over_graph("enclosing_symbol", "SELECT file_id, spot, id FROM (SELECT p.file_id, p.spot, s.id, row_number() OVER (PARTITION BY p.file_id, p.spot ORDER BY CASE WHEN kind = 'module' THEN 1 ELSE 0 END, end_line - start_line, start_line DESC, s.id) AS place FROM (SELECT DISTINCT file_id, line * 17 AS spot FROM e) p JOIN s ON s.file_id = p.file_id AND p.spot BETWEEN s.start_line AND s.end_line) WHERE place = 1")
def _(g: Snapshot) -> DataFrame:
    points = g.e.select("file_id", (F.col("line") * 17).alias("at")).distinct()
    return resolve.enclosing(points, g.s, ["file_id", "at"]).select("file_id", F.col("at").alias("spot"), "id")


HUNKS = "hunks AS (SELECT file_id, file_id % 40 * 10 AS hunk_start, file_id % 40 * 10 + 25 AS hunk_end FROM f)"


@over_graph("hunk_overlap", f", {HUNKS} SELECT s.file_id, id, CASE WHEN bool_or(start_line >= hunk_start AND end_line <= hunk_end) THEN 'added' ELSE 'modified' END AS change, count(*) AS hunks FROM s JOIN hunks h ON s.file_id = h.file_id AND start_line <= hunk_end AND end_line >= hunk_start GROUP BY s.file_id, id")
def _(g: Snapshot) -> DataFrame:
    return resolve.overlapping(_hunks(g), g.s)


def _hunks(g: Snapshot) -> DataFrame:
    start = F.col("file_id") % 40 * 10
    return g.f.select("file_id", start.alias("hunk_start"), (start + 25).alias("hunk_end"))


@over_graph("strict_containment", "SELECT id FROM s WHERE kind IN ('class', 'struct') AND NOT EXISTS (SELECT 1 FROM s i WHERE i.kind IN ('class', 'struct') AND i.file_id = s.file_id AND i.start_line >= s.start_line AND i.end_line <= s.end_line AND (i.start_line > s.start_line OR i.end_line < s.end_line))")
def _(g: Snapshot) -> DataFrame:
    return resolve.innermost_only(g.s.where("kind in ('class', 'struct')")).select("id")


@over_graph("container_members", "SELECT c.id AS container_id, s.id FROM s c JOIN s ON s.file_id = c.file_id AND s.start_line >= c.start_line AND s.end_line <= c.end_line AND s.id <> c.id WHERE c.kind = 'class'")
def _(g: Snapshot) -> DataFrame:
    return resolve.members(g.s.where("kind = 'class'"), g.s)


BEFORE = f", old AS (SELECT g_symbols.* FROM g_symbols JOIN g_files USING (file_id) WHERE graph_version = {VERSION - 1} AND (deleted_version IS NULL OR deleted_version > {VERSION - 1})), was AS (SELECT qualname, kind, arg_min(struct_pack(sig := signature), id).sig AS before FROM old GROUP BY qualname, kind), sig AS (SELECT s.id, s.qualname, before, signature AS after FROM s JOIN was USING (qualname, kind) WHERE before IS DISTINCT FROM signature)"


@over_graph("version_signature_change", BEFORE + " SELECT * FROM sig")
def _(g: Snapshot) -> DataFrame:
    return snapshot.signature_changes(as_of(g.all.symbols, g.all.files, VERSION - 1), g.s)


# analytics

@over_graph("overview_counts", "SELECT 'files' AS name, count(*) AS n FROM f UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'edges', count(*) FROM e")
def _(g: Snapshot) -> DataFrame:
    return analytics.overview(g.f, g.s, g.e)


@over_graph("call_edge_count", "SELECT count(*) AS n FROM e WHERE kind = 'CALLS' AND path LIKE 'ASIA/%'")
def _(g: Snapshot) -> DataFrame:
    return g.e.where((F.col("kind") == "CALLS") & paths.under(F.col("path"), ["ASIA"])).agg(F.count(F.lit(1)).alias("n"))


@over_graph("fan_in", "SELECT s.id, kind, qualname, path, edges FROM (SELECT target AS id, count(*) AS edges FROM e WHERE target IS NOT NULL AND kind = 'CALLS' GROUP BY target) c JOIN s USING (id) ORDER BY edges DESC, id LIMIT 20")
def _(g: Snapshot) -> DataFrame:
    return analytics.coupling(g.s, g.e, "target", 20)


@over_graph("fan_out", "SELECT s.id, kind, qualname, path, edges FROM (SELECT source AS id, count(*) AS edges FROM e WHERE source IS NOT NULL AND kind = 'CALLS' GROUP BY source) c JOIN s USING (id) ORDER BY edges DESC, id LIMIT 20")
def _(g: Snapshot) -> DataFrame:
    return analytics.coupling(g.s, g.e, "source", 20)


@over_graph("fan_in_by_module", "SELECT * FROM (SELECT s.id, qualname, split_part(path, '/', 1) AS module, calls, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY calls DESC, s.id) AS place FROM s JOIN (SELECT target AS id, count(*) AS calls FROM e WHERE kind = 'CALLS' AND target IS NOT NULL GROUP BY 1) c USING (id) WHERE s.kind IN ('function', 'method', 'class', 'struct', 'interface', 'service')) WHERE place <= 5")
def _(g: Snapshot) -> DataFrame:
    return analytics.fan_in_by_module(g.s, g.e, 5).select("id", "qualname", "module", "calls", "place")


@over_graph("count_by_kind", "SELECT kind, count(*) AS n FROM s GROUP BY kind")
def _(g: Snapshot) -> DataFrame:
    return analytics.by_kind(g.s)


@over_graph("duplicate_groups", ", k AS (SELECT s.id, path, start_line, qualname, duplication_hash FROM s JOIN g_metrics m ON m.symbol_id = s.id WHERE loc >= 5), g AS (SELECT duplication_hash, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, duplication_hash LIMIT 25) SELECT * FROM (SELECT duplication_hash, n, id, qualname, row_number() OVER (PARTITION BY duplication_hash ORDER BY path, start_line, id) AS place FROM k JOIN g USING (duplication_hash)) WHERE place <= 5")
def _(g: Snapshot) -> DataFrame:
    return analytics.duplicate_groups(g.s, g.m, 25, min_loc=5).select("duplication_hash", "n", "id", "qualname", "place")


@over_graph("top_complexity", "SELECT s.id, qualname, complexity, loc FROM s JOIN g_metrics m ON m.symbol_id = s.id WHERE complexity >= 10 ORDER BY complexity DESC, loc DESC, s.id LIMIT 50")
def _(g: Snapshot) -> DataFrame:
    return analytics.top_complexity(g.s, g.m, 50, 10).select("id", "qualname", "complexity", "loc")


MODULE = "split_part(path, '/', 1) || '/'"


@over_graph("module_summary", f"SELECT {MODULE} AS module, count(*) AS files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS symbols, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM f LEFT JOIN (SELECT file_id, count(*) AS n FROM s GROUP BY 1) USING (file_id) GROUP BY 1")
def _(g: Snapshot) -> DataFrame:
    return analytics.module_summary(g.f, g.s, 1)


MODULE_EDGES = ", m AS (SELECT a.path AS ap, b.path AS bp, e.kind FROM e JOIN s a ON a.id = e.source JOIN s b ON b.id = e.target WHERE e.kind IN ('CALLS', 'XREF', 'IMPORTS')), me AS (SELECT split_part(ap, '/', 1) || '/' || split_part(ap, '/', 2) || '/' AS from_module, split_part(bp, '/', 1) || '/' || split_part(bp, '/', 2) || '/' AS to_module, CAST(count(*) FILTER (kind IN ('CALLS', 'XREF')) AS BIGINT) AS calls, CAST(count(*) FILTER (kind = 'IMPORTS') AS BIGINT) AS imports FROM m GROUP BY 1, 2)"


@over_graph("module_edges", MODULE_EDGES + " SELECT * FROM me WHERE from_module <> to_module")
def _(g: Snapshot) -> DataFrame:
    return analytics.module_edges(g.s, g.e, 2)


@over_graph("module_coupling", MODULE_EDGES + ", ends AS (SELECT from_module AS module, 0 AS i, calls + imports AS o FROM me WHERE from_module <> to_module UNION ALL SELECT to_module, calls + imports, 0 FROM me WHERE from_module <> to_module) SELECT module, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, round(CAST(sum(o) AS DOUBLE) / CAST(sum(i) + sum(o) AS DOUBLE), 6) AS instability FROM ends GROUP BY module")
def _(g: Snapshot) -> DataFrame:
    return analytics.module_coupling(g.s, g.e, 2)


@over_graph("symbol_summary_text", "SELECT file_id, sum(n) || ' symbols: ' || string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, kind) AS summary FROM (SELECT file_id, kind, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY file_id")
def _(g: Snapshot) -> DataFrame:
    return analytics.kinds_text(g.s)


@over_graph("table_digest", "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|' || kind || '|' || qualname || '|' || coalesce(signature, '~')), 1, 12) AS BIGINT) % 1000000007) AS BIGINT) AS digest FROM s")
def _(g: Snapshot) -> DataFrame:
    return analytics.digest(g.s, ["id", "kind", "qualname", "signature"])


@over_graph("staleness", ", o AS (SELECT path, md5(path) AS hash FROM g_files WHERE file_id % 5 <> 0), n AS (SELECT path, CASE WHEN file_id % 4 = 0 THEN 'x' ELSE md5(path) END AS hash FROM g_files WHERE file_id % 6 <> 0) SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS state, count(*) AS n FROM o FULL JOIN n ON o.path = n.path GROUP BY 1")
def _(g: Snapshot) -> DataFrame:
    files = g.all.files
    old = files.where("file_id % 5 <> 0").select("path", F.md5("path").alias("hash"))
    new = files.where("file_id % 6 <> 0").select("path", F.when(F.col("file_id") % 4 == 0, "x").otherwise(F.md5("path")).alias("hash"))
    return analytics.staleness(old, new)


CHANGED = f"{BEFORE}, {HUNKS}, ch AS (SELECT id, CASE WHEN bool_or(sig.id IS NOT NULL) THEN 'signature_changed' WHEN bool_or(start_line >= hunk_start AND end_line <= hunk_end) THEN 'added' ELSE 'modified' END AS change FROM s JOIN hunks h ON s.file_id = h.file_id AND start_line <= hunk_end AND end_line >= hunk_start LEFT JOIN sig USING (id) GROUP BY id), called AS (SELECT source, target AS id FROM e WHERE kind = 'CALLS' AND source IS NOT NULL AND target IS NOT NULL UNION SELECT e.source, s.id FROM e JOIN s ON regexp_extract(target_qualname, '([^.:]*)$', 1) = s.name WHERE e.kind = 'CALLS' AND e.source IS NOT NULL AND e.target IS NULL), tc AS (SELECT called.id, string_agg(DISTINCT t.qualname, ',' ORDER BY t.qualname) AS tests FROM called JOIN s t ON t.id = source AND starts_with(t.name, 'test_') JOIN ch ON ch.id = called.id GROUP BY 1)"


def changed(g: Snapshot) -> DataFrame:
    """Symbols that the hunks touch, with how: by signature, whole or in part."""
    touched = resolve.overlapping(_hunks(g), g.s).select("id", "change")
    signed = snapshot.signature_changes(as_of(g.all.symbols, g.all.files, VERSION - 1), g.s).select("id", F.lit(True).alias("signed"))
    how = F.when(F.max("signed"), "signature_changed").when(F.max(F.col("change") == "added"), "added").otherwise("modified")
    return touched.join(signed, "id", "left").groupBy("id").agg(how.alias("change"))  # symbols of several tables may share an id


@over_graph("test_coverage", CHANGED + " SELECT id, coalesce(tests, '') AS tests, CASE WHEN tests IS NULL THEN 'uncovered' ELSE 'covered' END AS status FROM ch LEFT JOIN tc USING (id)")
def _(g: Snapshot) -> DataFrame:
    return analytics.test_coverage(changed(g), g.s, g.e, test_symbol()).select("id", F.array_join("tests", ",").alias("tests"), "status")


def risk_sql(first: str = "") -> str:
    """The table factors of a change: by all its callers, or by the first of them alone."""
    return CHANGED + f""", near1 AS (SELECT source AS id, max(solid) AS solid FROM (SELECT source, target AS id, 1 AS solid FROM e WHERE kind = 'CALLS' AND source IS NOT NULL UNION ALL SELECT e.source, s.id, 0 FROM e JOIN s ON regexp_extract(target_qualname, '([^.:]*)$', 1) = s.name WHERE e.kind = 'CALLS' AND e.source IS NOT NULL AND e.target IS NULL) JOIN ch USING (id) GROUP BY source
), down AS (SELECT s.id, path, language FROM near1 JOIN s USING (id) WHERE id NOT IN (SELECT id FROM ch){first}
), c AS (SELECT ch.id, change, s.kind, s.qualname, s.language FROM ch JOIN s USING (id)), n AS (SELECT count(*) AS callers, count(DISTINCT path) AS files, count(*) FILTER (language NOT IN (SELECT language FROM c)) AS cross_ FROM down
), factors AS (
  SELECT CASE WHEN callers > 10 THEN 'Signature changed on high-traffic symbol' ELSE 'Signature change' END AS factor, CASE WHEN callers > 10 THEN 'critical' ELSE 'high' END AS severity, qualname AS subject, callers AS n FROM c, n WHERE change = 'signature_changed' AND callers > 0
  UNION ALL SELECT 'Cross-language impact', 'high', NULL, cross_ FROM n WHERE cross_ > 0
  UNION ALL SELECT 'Interface/contract change', 'high', qualname, 1 FROM c WHERE change = 'signature_changed' AND kind IN ('interface', 'trait', 'abstract_class')
  UNION ALL SELECT 'High fan-in', 'high', NULL, callers FROM n WHERE callers > 10
  UNION ALL SELECT 'Wide blast radius', 'medium', NULL, files FROM n WHERE files > 3
  UNION ALL SELECT 'Missing test coverage', 'medium', NULL, count(*) FROM c WHERE id NOT IN (SELECT id FROM tc) HAVING count(*) > 0)"""


def risk_factors(g: Snapshot, most: int | None = None) -> DataFrame:
    touched = traverse.cut(changed(g).join(g.s.select("id", "kind", "qualname", "path", "language"), "id"))
    down = impact.diff_downstream(touched.select("id"), g.s, g.e, 1, most).join(g.s.select("id", "path", "language"), "id")
    down = traverse.cut(down.select("id", "path", "language")) if most is None else down.orderBy("id").limit(most)
    return analytics.risk_factors(touched, down, analytics.test_coverage(touched, g.s, g.e, test_symbol()))


@over_graph("risk_rules", risk_sql(" ORDER BY id LIMIT 50") + " SELECT factor, severity, subject, n FROM factors")
def _(g: Snapshot) -> DataFrame:
    return risk_factors(g, impact.MOST)


@over_graph("risk_level", risk_sql() + " SELECT CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, count(*) AS factors FROM factors")
def _(g: Snapshot) -> DataFrame:
    return analytics.risk_level(risk_factors(g))


# co-changes and fusion

def changes(spark: SparkSession, sf_dir: str, file: str = "l_partkey") -> DataFrame:
    """Commits (orders), their days and the files (by default parts) that they touch."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("date").alias("ts"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.expr(file).alias("file"))
    return dealt(lines, lines.count(), "sha").join(orders, "sha").select("sha", "ts", "file")


def mined(spark: SparkSession, sf_dir: str, file: str = "l_partkey") -> DataFrame:
    """Pairs as of the last day of the orders."""
    return cochange.mine_pairs(changes(spark, sf_dir, file), F.lit("2001-08-01").cast("date"))


def mined_sql(file: str = "l_partkey") -> str:
    return f"""d AS (
  SELECT DISTINCT l_orderkey AS sha, CAST(o_orderdate AS DATE) AS ts, {file} AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), k AS (
  SELECT d.*, exp(-greatest(date_diff('day', ts, DATE '2001-08-01'), 0) / CAST(90 AS DOUBLE)) AS w FROM d WHERE sha IN (SELECT sha FROM d GROUP BY sha HAVING count(*) <= 50)
), t AS (SELECT file, sum(w) AS total FROM k GROUP BY file), p AS (
  SELECT a.file AS file_a, b.file AS file_b, sum(a.w) AS together, max(struct_pack(ts := a.ts, sha := a.sha)) AS last FROM k a JOIN k b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2
), mined AS (
  SELECT file_a, file_b, round(together, 6) AS together, round(ta.total, 6) AS total_a, round(tb.total, 6) AS total_b, round(least(1.0, together / least(ta.total, tb.total)), 6) AS confidence, last.sha AS last_sha
  FROM p JOIN t ta ON ta.file = file_a JOIN t tb ON tb.file = file_b)
"""


MINED = "WITH " + mined_sql()
QUERIES["cochange_mining"] = mined
ORACLE_SQL["cochange_mining"] = MINED + "SELECT * FROM mined"
QUERIES["coupling_hotspots"] = lambda spark, d: cochange.hotspots(mined(spark, d), 50, 0.05)
ORACLE_SQL["coupling_hotspots"] = MINED + "SELECT * FROM mined WHERE confidence >= 0.05 ORDER BY confidence DESC, file_a, file_b LIMIT 50"
QUERIES["cochange_for_files"] = lambda spark, d: cochange.for_files(mined(spark, d), [3, 14, 15], 40, 0.0)
ORACLE_SQL["cochange_for_files"] = MINED + "SELECT * FROM mined WHERE file_a IN (3, 14, 15) OR file_b IN (3, 14, 15) ORDER BY confidence DESC, file_a, file_b LIMIT 40"


@over_graph("file_pair_expansion", ", p AS (SELECT a.file_id AS file_a, b.file_id AS file_b, round(CAST(1 AS DOUBLE) / (b.file_id - a.file_id), 6) AS confidence FROM f a JOIN f b ON b.file_id - a.file_id BETWEEN 1 AND 2) SELECT x.id AS from_id, y.id AS to_id, confidence FROM p JOIN s x ON x.file_id = file_a AND x.kind = 'interface' JOIN s y ON y.file_id = file_b AND y.kind = 'interface'")
def _(g: Snapshot) -> DataFrame:
    files = g.f.select("file_id")
    pairs = files.select(F.col("file_id").alias("file_a"), F.explode(F.array(F.col("file_id") + 1, F.col("file_id") + 2)).alias("file_b")).join(files.withColumnRenamed("file_id", "file_b"), "file_b", "left_semi")
    return cochange.symbol_pairs(pairs.withColumn("confidence", F.round(1.0 / (F.col("file_b") - F.col("file_a")), 6)), g.s.where("kind = 'interface'"))


@over_graph("noisy_or_fusion", ", n AS (SELECT target AS id, count(*) AS sources, 1 - product(1 - confidence) AS c FROM e WHERE target IS NOT NULL AND kind = 'CALLS' GROUP BY 1) SELECT id, sources, round(CASE WHEN sources >= 3 THEN least(c, 0.95) ELSE c END, 6) AS confidence FROM n")
def _(g: Snapshot) -> DataFrame:
    return cochange.noisy_or(g.e.where("target is not null and kind = 'CALLS'").select(F.col("target").alias("id"), "confidence"))


# traversals; every bound on depth is the feature's own

def _seeds(g: Snapshot) -> DataFrame:
    return g.s.where("kind = 'service' and qualname like 'machinery.customer_%9'").select("id")


SEEDS = "SELECT id FROM s WHERE kind = 'service' AND qualname LIKE 'machinery.customer\\_%9' ESCAPE '\\'"
TRACED = str(traverse.TRACE_KINDS)
COMPLEMENT = "CASE {} WHEN 'HTTP_CALL' THEN 'HTTP_ROUTE' WHEN 'HTTP_ROUTE' THEN 'HTTP_CALL' WHEN 'RPC_CALL' THEN 'RPC_IMPL' WHEN 'RPC_IMPL' THEN 'RPC_CALL' END"


def near_sql(way: str, kinds: str | None = TRACED, named: str | None = "('CALLS', 'CONFIG_BIND')", bridges: bool = True) -> str:
    """The table near (node, next, kind, via) of all steps that a traversal may take."""
    used = f"kind IN {kinds}" if kinds else "true"
    by_name = f"kind IN {named}" if named else "true"
    parts = []
    if way != "up":
        parts.append("SELECT source, target, kind, 'edge' FROM used WHERE source IS NOT NULL AND target IS NOT NULL")
        parts.append("SELECT u.source, resolved_id, u.kind, 'name' FROM used u JOIN resolved r ON r.target_qualname = u.target_qualname AND r.language = u.language AND r.may_cross = (u.kind IN ('RPC_IMPL','RPC_CALL','RPC_ROUTE','HTTP_ROUTE','HTTP_CALL','CHANNEL_PUBLISH','CHANNEL_SUBSCRIBE','CONFIG_SOURCE','CONFIG_READ','CONFIG_BIND','XREF')) WHERE u.source IS NOT NULL AND u.target IS NULL")
    if way != "down":
        parts.append("SELECT target, source, kind, 'edge' FROM used WHERE source IS NOT NULL AND target IS NOT NULL")
        parts.append(f"SELECT s.id, u.source, u.kind, 'name' FROM used u JOIN s ON regexp_extract(u.target_qualname, '([^.:]*)$', 1) = s.name WHERE u.target IS NULL AND u.source IS NOT NULL AND u.target_qualname IS NOT NULL AND u.{by_name}" if named else "SELECT s.id, u.source, u.kind, 'name' FROM used u JOIN s ON regexp_extract(u.target_qualname, '([^.:]*)$', 1) = s.name WHERE u.target IS NULL AND u.source IS NOT NULL AND u.target_qualname IS NOT NULL")
    if bridges:
        parts.append(f"SELECT a.source, b.source, a.kind, 'bridge' FROM used a JOIN used b ON a.target_qualname = b.target_qualname AND b.kind = {COMPLEMENT.format('a.kind')} WHERE a.source IS NOT NULL AND b.source IS NOT NULL")
    return (RESOLVED if way != "up" else "") + f", used AS (SELECT source, target, kind, target_qualname, language FROM e WHERE {used}), all_steps(node, next, kind, via) AS ({' UNION '.join(parts)}), near AS MATERIALIZED (SELECT * FROM all_steps WHERE node <> next AND next IN (SELECT id FROM s))"


def reached_sql(near: str, seeds: str, depth: int) -> str:
    """The traversal as levels of a query: least distances, then the smallest way into each node."""
    return f"""{near}, seeds AS ({seeds}), walk AS (
  SELECT id, 0 AS distance FROM seeds UNION SELECT next, distance + 1 FROM walk JOIN near ON node = id WHERE distance < {depth}
), least_ AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id), reached AS (
  SELECT l.id, l.distance, min(CASE WHEN p.id IS NOT NULL THEN struct_pack(parent := p.id, kind := n.kind, via := n.via) END) AS way, coalesce(bool_or(CASE WHEN p.id IS NOT NULL THEN n.via <> 'name' END), true) AS solid
  FROM least_ l LEFT JOIN near n ON n.next = l.id LEFT JOIN least_ p ON p.id = n.node AND p.distance = l.distance - 1 GROUP BY 1, 2)"""


REACHED = " SELECT id, CAST(distance AS INTEGER) AS distance, way.parent AS parent, way.kind AS kind FROM reached"
WAY = ("id", "distance", "parent", "kind")


@over_graph("trace_downstream", reached_sql(near_sql("down", named=None), SEEDS, 3) + REACHED)
def _(g: Snapshot) -> DataFrame:
    return traverse.bfs(_seeds(g), traverse.ways(g.s, g.e, traverse.DOWN, by_name=None), 3).select(*WAY)


PART_SEEDS = "SELECT id FROM s WHERE id IN (1000001, 1000002, 1000005)"


def _parts(g: Snapshot) -> DataFrame:
    return g.s.where("id in (1000001, 1000002, 1000005)").select("id")


@over_graph("trace_upstream", reached_sql(near_sql("up", named=None), PART_SEEDS, 2) + REACHED)
def _(g: Snapshot) -> DataFrame:
    return traverse.bfs(_parts(g), traverse.ways(g.s, g.e, traverse.UP, by_name=None), 2).select(*WAY)


HOPS = """, shown AS (
  SELECT r.id, s.qualname, s.path, CASE WHEN via = 'bridge' THEN """ + COMPLEMENT.format("way.kind") + """ ELSE way.kind END AS edge_kind, CAST(distance AS INTEGER) AS distance, s.language, via = 'bridge' OR s.language <> p.language AS cross_language, p.language AS came, CASE WHEN via = 'bridge' THEN r.id ELSE way.parent END AS owner
  FROM (SELECT *, way.via AS via FROM reached WHERE distance > 0) r JOIN s ON s.id = r.id JOIN s p ON p.id = way.parent
), told AS (SELECT source, kind, min(detail) AS detail FROM e WHERE detail IS NOT NULL GROUP BY 1, 2), typed AS (
  SELECT h.*, detail, CASE WHEN cross_language THEN CASE WHEN edge_kind IN ('RPC_IMPL', 'RPC_CALL', 'RPC_ROUTE') THEN 'grpc' WHEN edge_kind IN ('HTTP_CALL', 'HTTP_ROUTE') THEN 'http' WHEN edge_kind = 'XREF' THEN 'xref' ELSE 'other' END END AS boundary_type
  FROM shown h LEFT JOIN told t ON t.source = owner AND t.kind = edge_kind
), hops AS (SELECT id, qualname, path, edge_kind, distance, language, cross_language, boundary_type,
  CASE WHEN cross_language THEN came || ' → ' || language || CASE boundary_type WHEN 'grpc' THEN ' via gRPC' WHEN 'http' THEN ' via HTTP' WHEN 'xref' THEN ' via cross-reference' ELSE '' END END AS boundary_detail,
  CASE WHEN cross_language AND detail IS NOT NULL THEN CASE boundary_type WHEN 'http' THEN '{"framework":"' || json_extract_string(detail, '$.framework') || '","method":"' || json_extract_string(detail, '$.method') || '","path":"' || json_extract_string(detail, '$.path') || '"}'
    WHEN 'grpc' THEN '{"framework":"grpc","service":"' || json_extract_string(detail, '$.service') || '","rpc":"' || json_extract_string(detail, '$.rpc') || '"}' END END AS protocol FROM typed
), sized AS (SELECT *, strlen('{"id":' || id || ',"qualname":"' || qualname || '","path":"' || path || '","edge_kind":"' || edge_kind || '","distance":' || distance || ',"language":"' || language || '","cross_language":' || cross_language
  || CASE WHEN boundary_type IS NULL THEN '' ELSE ',"boundary_type":"' || boundary_type || '","boundary_detail":"' || boundary_detail || '"' END || CASE WHEN protocol IS NULL THEN '' ELSE ',"protocol":"' || replace(protocol, '"', '\\"') || '"' END || '}') AS size, row_number() OVER (ORDER BY distance, id) - 1 AS position FROM hops
), summed AS (SELECT *, CAST(sum(size) OVER (ORDER BY position) AS BIGINT) AS used_bytes FROM sized WHERE position >= 10)"""
FLOW = reached_sql(near_sql("down", named=None), SEEDS, 3) + HOPS


@over_graph("trace_flow", FLOW + " SELECT id, qualname, path, edge_kind, distance, language, cross_language, boundary_type, boundary_detail, protocol, position, used_bytes FROM summed WHERE used_bytes - size < 30000")
def _(g: Snapshot) -> DataFrame:
    return traverse.trace_flow(_seeds(g), g.s, g.e, max_hops=3, offset=10)


@over_graph("paths_found", FLOW + ", kept AS (SELECT * FROM summed WHERE used_bytes - size < 30000) SELECT count(*) AS hops, count(*) FILTER (distance = (SELECT max(distance) FROM kept)) AS paths, false AS reached FROM kept")
def _(g: Snapshot) -> DataFrame:
    return traverse.paths_found(traverse.trace_flow(_seeds(g), g.s, g.e, max_hops=3, offset=10))


@over_graph("impact_paths", reached_sql(near_sql("up", named=None), PART_SEEDS, 2) + ", tree AS (SELECT id, way.parent AS parent FROM reached), steps AS (SELECT id, parent AS upper_, CAST(id AS VARCHAR) AS steps FROM tree UNION ALL SELECT p.id, t.parent, CAST(t.id AS VARCHAR) || '>' || steps FROM steps p JOIN tree t ON t.id = p.upper_) SELECT id, steps FROM steps WHERE upper_ IS NULL")
def _(g: Snapshot) -> DataFrame:
    reached = traverse.bfs(_parts(g), traverse.ways(g.s, g.e, traverse.UP, by_name=None), 2)
    return traverse.paths(reached, 2).select("id", F.array_join(F.transform("steps", lambda x: x.cast("string")), ">").alias("steps"))


@over_graph("impact_both", reached_sql(near_sql("both", kinds=None), "SELECT id FROM s WHERE id = 1000004", 2) + REACHED)
def _(g: Snapshot) -> DataFrame:
    return impact.direct(g.s.where("id = 1000004").select("id"), g.s, g.e, 2, traverse.BOTH).select(*WAY)


@over_graph("subgraph", reached_sql(near_sql("down", named=None), SEEDS, 2) + " SELECT DISTINCT source, target, kind FROM e WHERE source IN (SELECT id FROM reached) AND target IN (SELECT id FROM reached)")
def _(g: Snapshot) -> DataFrame:
    return traverse.subgraph(traverse.bfs(_seeds(g), traverse.ways(g.s, g.e, traverse.DOWN, by_name=None), 2), g.e)


CALLED_UP = near_sql("up", "('CALLS')", "('CALLS')", bridges=False)


@over_graph("diff_downstream", reached_sql(CALLED_UP, PART_SEEDS, 3) + " SELECT id, CAST(distance AS INTEGER) AS distance, round(0.9 * pow(0.8, distance - 1) * CASE WHEN solid THEN 1.0 ELSE 0.8 END, 6) AS confidence, CASE WHEN distance = 1 THEN 'caller' ELSE 'caller_depth_' || distance END AS relationship FROM reached WHERE distance > 0 ORDER BY distance, id LIMIT 50")
def _(g: Snapshot) -> DataFrame:
    return impact.diff_downstream(_parts(g), g.s, g.e, 3, impact.MOST).select("id", "distance", "confidence", "relationship")


@over_graph("batch_impact", near_sql("up", "('CALLS', 'HTTP_CALL')", bridges=False) + ", walk AS (SELECT id AS seed, id, 0 AS distance FROM s WHERE id BETWEEN 1000010 AND 1000019 UNION SELECT seed, next, distance + 1 FROM walk JOIN near ON node = id WHERE distance < 2) SELECT seed, count(DISTINCT id) - 1 AS affected, count(DISTINCT f2.file_id) AS files FROM walk LEFT JOIN s f2 USING (id) GROUP BY seed")
def _(g: Snapshot) -> DataFrame:
    seeds = g.s.where("id between 1000010 and 1000019").select(F.col("id").alias("seed"), "id")
    reached = traverse.bfs(seeds, traverse.ways(g.s, g.e, traverse.UP, ("CALLS", "HTTP_CALL"), with_bridges=False), 2, keys=("seed",))
    return reached.join(g.s.select("id", "file_id"), "id", "left").groupBy("seed").agg((F.count_distinct("id") - 1).alias("affected"), F.count_distinct("file_id").alias("files"))


@over_graph("seed_expansion", "SELECT s.id AS seed, p.id AS parent FROM s JOIN s p ON p.qualname = regexp_extract(s.qualname, '^(.*)[.][^.]*$', 1) WHERE s.kind IN ('property', 'field', 'attribute', 'const')")
def _(g: Snapshot) -> DataFrame:
    return resolve.parents(g.s.select("id"), g.s)


#: The file of the graph that a line of an order touches.
TOUCHED = "l_suppkey % 25 + 1000"


def analyze_impact(g: Snapshot) -> DataFrame:
    """Direct, test and co-change layers of a change of three parts, fused."""
    seeds = _parts(g)
    reached = impact.direct(seeds, g.s, g.e, 2)
    tests = impact.tests(seeds, g.s, g.e, test_symbol())
    pairs = mined(g.spark, g.folder, TOUCHED)
    return impact.fuse(reached, tests, impact.historical(seeds, g.s, pairs), g.s)


IMPACT = (
    reached_sql(near_sql("up", kinds=None), PART_SEEDS, 2)
    + """, tests_ AS (SELECT * FROM s WHERE starts_with(name, 'test_')), own AS (SELECT s.* FROM s JOIN seeds USING (id)), by_test AS (
  SELECT e.source AS id, CASE WHEN e.kind = 'IMPORTS' THEN 'test_import' ELSE 'test_call' END AS source FROM e JOIN seeds ON e.target = seeds.id JOIN tests_ ON tests_.id = e.source WHERE e.kind IN ('CALLS', 'IMPORTS', 'XREF')
  UNION SELECT t.id, 'test_naming' FROM tests_ t JOIN own ON lower(substr(t.name, 6)) = lower(own.name) AND t.language = own.language
  UNION SELECT t.id, 'test_proximity' FROM tests_ t JOIN own ON t.language = own.language
    WHERE len(list_intersect(list_distinct([x FOR x IN regexp_split_to_array(lower(t.path), '[/._]') IF x NOT IN ('', 'test', 'tests', 'spec', 'src')]), list_distinct([x FOR x IN regexp_split_to_array(lower(own.path), '[/._]') IF x NOT IN ('', 'test', 'tests', 'spec', 'src')]))) >= 2
), """
    + mined_sql("l_suppkey % 25 + 1000")
    + """, own_files AS (SELECT DISTINCT file_id FROM own), other AS (
  SELECT file_b AS file_id, confidence FROM mined WHERE together >= 3 AND file_a IN (SELECT file_id FROM own_files) UNION ALL SELECT file_a, confidence FROM mined WHERE together >= 3 AND file_b IN (SELECT file_id FROM own_files)
), by_history AS (SELECT s.id, max(confidence) AS frequency FROM s JOIN other USING (file_id) WHERE s.id NOT IN (SELECT id FROM seeds) GROUP BY 1), evidence AS (
  SELECT id, 'direct' AS source, distance, 0.95 * pow(0.9, distance) AS confidence FROM reached
  UNION ALL SELECT id, source, NULL, CASE source WHEN 'test_call' THEN 0.95 WHEN 'test_import' THEN 0.7 WHEN 'test_naming' THEN 0.6 ELSE 0.4 END FROM by_test
  UNION ALL SELECT id, 'cochange', NULL, frequency FROM by_history
), fused AS (SELECT id, count(*) AS sources, 1 - product(1 - CAST(confidence AS DOUBLE)) AS c, min(distance) AS near, bool_or(starts_with(source, 'test_')) AS tested FROM evidence GROUP BY id), shown AS (
  SELECT id, s.kind, qualname, path, sources, round(CASE WHEN sources >= 3 THEN least(c, 0.95) ELSE c END, 6) AS confidence, CAST(coalesce(near, 1) AS INTEGER) AS distance,
    CASE WHEN near = 0 THEN 'SEED' WHEN near = 1 THEN 'DIRECT' WHEN near > 1 THEN 'INDIRECT_' || near WHEN tested THEN 'TEST' ELSE 'COCHANGE' END AS relationship
  FROM fused JOIN s USING (id) WHERE s.kind NOT IN ('module', 'namespace', 'package'))"""
)


@over_graph("impact_ranked", IMPACT + " SELECT id, qualname, confidence, distance, relationship FROM shown WHERE confidence >= 0.5 ORDER BY distance, qualname, id LIMIT 100")
def _(g: Snapshot) -> DataFrame:
    return impact.ranked(analyze_impact(g), 0.5, 100).select("id", "qualname", "confidence", "distance", "relationship")


@over_graph("analyze_impact", IMPACT + " SELECT * FROM shown")
def _(g: Snapshot) -> DataFrame:
    return analyze_impact(g)


@over_graph("impact_summary", IMPACT + " SELECT 'file' AS what, path AS which, count(*) AS n FROM shown GROUP BY path UNION ALL SELECT 'relationship', relationship, count(*) FROM shown GROUP BY relationship UNION ALL SELECT 'distance', CAST(distance AS VARCHAR), count(*) FROM shown GROUP BY distance UNION ALL SELECT 'total', 'all', count(*) FROM shown")
def _(g: Snapshot) -> DataFrame:
    return impact.summary(analyze_impact(g))


# budgets and sets

@over_graph("context_sort", "SELECT path, start_line, id, row_number() OVER (ORDER BY path, start_line, id) AS place FROM s WHERE kind = 'interface'")
def _(g: Snapshot) -> DataFrame:
    from pyspark.sql import Window

    return g.s.where("kind = 'interface'").select("path", "start_line", "id", F.row_number().over(Window.orderBy("path", "start_line", "id")).alias("place"))


@over_graph("region_dedup", "SELECT id FROM (SELECT id, end_line, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE kind IN ('class', 'method', 'interface')) WHERE reach IS NULL OR end_line > reach")
def _(g: Snapshot) -> DataFrame:
    spans = g.s.where("kind in ('class', 'method', 'interface')").select("file_id", "id", F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    return budget.outer_regions(spans, ["file_id"]).select("id")


@over_graph("response_truncation", "SELECT id, file_id, CAST(bytes AS BIGINT) AS bytes FROM (SELECT id, file_id, 1 + sum(strlen('{\"id\":' || id || ',\"qualname\":\"' || qualname || '\"}') + 1) OVER (PARTITION BY file_id ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS bytes FROM s) WHERE bytes <= 2000")
def _(g: Snapshot) -> DataFrame:
    return budget.response_prefix(g.s, ["file_id"], ["start_line", "id"], ["id", "qualname"], 2_000).select("id", "file_id", "bytes")


@over_graph("version_compare", ", a AS (SELECT DISTINCT target AS id FROM e WHERE source IS NOT NULL AND event_ts < 883612800 AND target IS NOT NULL), b AS (SELECT DISTINCT target AS id FROM e WHERE event_ts >= 883612800 AND target IS NOT NULL) SELECT 'new' AS state, count(*) AS n FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed', count(*) FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'stable', count(*) FROM a WHERE id IN (SELECT id FROM b)")
def _(g: Snapshot) -> DataFrame:
    found = g.e.where("target is not null").select(F.col("target").alias("id"), "event_ts")
    return snapshot.compare_sets(found.where("event_ts < 883612800").select("id"), found.where("event_ts >= 883612800").select("id"))


PREFIXED = "starts_with(lower(name), 'test_')"
TEST_SQL = f"(path LIKE '%.py' AND ({PREFIXED} OR regexp_matches(lower(path), '/tests/') AND kind IN ('function', 'method', 'class')))"
TYPE_SQL = "CASE WHEN path LIKE '%/e2e/%' THEN 'e2e' WHEN path LIKE '%/integration/%' THEN 'integration' ELSE 'unit' END"


@over_graph("test_symbol_classify", f"SELECT id, {TEST_SQL} AS is_test, CASE WHEN {PREFIXED} THEN substr(lower(name), 6) END AS about, {TYPE_SQL} AS test_type FROM s")
def _(g: Snapshot) -> DataFrame:
    c = F.col
    return g.s.select("id", paths.is_test_symbol(c("kind"), c("name"), c("path"), c("signature"), c("qualname")).alias("is_test"), test_target(c("name")).alias("about"), paths.test_type(c("path"), c("name")).alias("test_type"))
