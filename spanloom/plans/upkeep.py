"""Queries over versions of the graph, names that are kept up to date, bounded neighbourhoods, digests, queues."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import analytics, budget, impact, index, resolve, snapshot, spelling, traverse
from spanloom.plans import core
from spanloom.plans.core import RESOLVED, SEEDS, Snapshot
from spanloom.plans.model import PREFIX, read
from spanloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
over_graph = partial(core.over_graph, queries=QUERIES, oracles=ORACLE_SQL)

# Two states of the graph: one lacks a fourth of the files, the other another fourth.
AFTER = RESOLVED.replace("JOIN s ON", "JOIN (SELECT * FROM s WHERE file_id % 4 <> 2) s ON")


@over_graph("delta_resolution", AFTER + " SELECT * FROM resolved")
def _(g: Snapshot) -> DataFrame:
    """Names resolved before files came and went, brought up to date by what moved alone."""
    before, after = g.s.where("file_id % 4 <> 1"), g.s.where("file_id % 4 <> 2")
    names = g.e.where("target is null and target_qualname is not null")
    known = resolve.resolve_by_suffix(names, before)
    return resolve.re_resolved(known, names, index.moved_names(before, after), after)


RANK = "CASE kind WHEN 'CONTAINS' THEN 0 WHEN 'MODULE_FILE' THEN 1 WHEN 'EXTENDS' THEN 2 WHEN 'IMPLEMENTS' THEN 3 WHEN 'IMPORTS_FILE' THEN 4 WHEN 'IMPORTS' THEN 5 WHEN 'CALLS' THEN 6 WHEN 'XREF' THEN 7 ELSE 10 END"
PLACE = "place, rank, sn, tn, dt, kind"


def bounded_sql(depth: int, most: int) -> str:
    """The tables nodes_<depth> and edges_<depth> of a neighbourhood, level by level."""
    out = f"""{RESOLVED}, ed AS MATERIALIZED (
  SELECT DISTINCT source, target AS given, coalesce(target, CASE WHEN kind IN ('MODULE_FILE', 'IMPORTS_FILE') THEN (SELECT min(id) FROM s WHERE qualname = target_qualname) WHEN kind = 'CALLS' THEN resolved_id END) AS target, kind, target_qualname, detail
  FROM e LEFT JOIN (SELECT target_qualname, language, resolved_id FROM resolved WHERE NOT may_cross) USING (target_qualname, language)
), nodes_0 AS (SELECT id, 0 AS distance, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM ({SEEDS}))), last_0 AS (SELECT id, place FROM nodes_0)"""
    for n in range(1, depth + 1):
        m = n - 1
        out += f""", touched_{n} AS (
  SELECT l.id AS node, place, ed.* FROM last_{m} l JOIN ed ON ed.source = l.id UNION SELECT l.id, place, ed.* FROM last_{m} l JOIN ed ON ed.given = l.id
), near_{n} AS MATERIALIZED (
  SELECT node, place, source, t.target, t.kind, target_qualname, detail, {RANK.replace('kind', 't.kind')} AS rank, coalesce(a.qualname, '') AS sn, coalesce(b.qualname, target_qualname, '') AS tn, coalesce(detail, '') AS dt, CASE WHEN source = node THEN t.target ELSE source END AS other
  FROM touched_{n} t LEFT JOIN s a ON a.id = source LEFT JOIN s b ON b.id = t.target
  WHERE (source IS NULL OR a.id IS NOT NULL) AND (t.target IS NULL OR b.id IS NOT NULL)
), first_{n} AS (
  SELECT other AS id, {PLACE} FROM near_{n} WHERE other IS NOT NULL AND other NOT IN (SELECT id FROM nodes_{m})
  QUALIFY row_number() OVER (PARTITION BY other ORDER BY {PLACE}) = 1
), last_{n} AS MATERIALIZED (
  SELECT id, place AS after, row_number() OVER (ORDER BY {PLACE}, id) AS place FROM first_{n}
  QUALIFY row_number() OVER (ORDER BY {PLACE}, id) <= {most} - (SELECT count(*) FROM nodes_{m})
), nodes_{n} AS MATERIALIZED (SELECT * FROM nodes_{m} UNION ALL SELECT id, {n}, place FROM last_{n}
), edges_{n} AS (
  {f'SELECT * FROM edges_{m} UNION ' if m else ''}SELECT source, target, kind, target_qualname, detail FROM near_{n}
  WHERE (SELECT count(*) FROM nodes_{m}) < {most if m else 10**9} AND ((SELECT count(*) FROM nodes_{n}) < {most} OR place <= coalesce((SELECT max(after) FROM last_{n}), 1))
)"""
    return out


for most in (50, 500):

    @over_graph(f"subgraph_nodes_{most}", bounded_sql(2, most) + " SELECT id, distance, place FROM nodes_2")
    def _(g: Snapshot, most: int = most) -> DataFrame:
        return traverse.bounded_subgraph(core._seeds(g), g.s, g.e, 2, most)[0]

    @over_graph(f"subgraph_edges_{most}", bounded_sql(2, most) + " SELECT DISTINCT * FROM edges_2")
    def _(g: Snapshot, most: int = most) -> DataFrame:
        return traverse.bounded_subgraph(core._seeds(g), g.s, g.e, 2, most)[1]


@over_graph(
    "batch_impact_shares",
    core.near_sql("up", "('CALLS', 'HTTP_CALL')", bridges=False) + """, walk AS (SELECT CAST(id AS VARCHAR) AS query, id, 0 AS distance FROM s WHERE id BETWEEN 1000010 AND 1000029 UNION SELECT query, next, distance + 1 FROM walk JOIN near ON node = id WHERE distance < 3), least AS (SELECT query, id, min(distance) AS distance FROM walk GROUP BY ALL)
SELECT query, id, qualname, path, distance FROM (SELECT * FROM least QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, id) <= 50) JOIN s USING (id)""",
)
def _(g: Snapshot) -> DataFrame:
    """What each of twenty symbols reaches upwards, fifty for each at most."""
    seeds = g.s.where("id between 1000010 and 1000029").select(F.col("id").cast("string").alias("query"), "id")
    return impact.batch(seeds, g.s, g.e, 3, traverse.UP, ("CALLS", "HTTP_CALL"), 100, 20, bridges=False)


ASKED = "CASE id % 3 WHEN 0 THEN substr(name, 2) WHEN 1 THEN name || 'X' ELSE replace(name, 'pp', 'qp') END"


@over_graph(
    "near_names",
    f""", asked AS (SELECT DISTINCT {ASKED} AS asked FROM s WHERE kind = 'interface'), names AS (SELECT DISTINCT name FROM s WHERE name IS NOT NULL), met AS (
  SELECT asked, name, CAST(levenshtein(lower(asked), lower(name)) AS INTEGER) AS edits FROM asked, names WHERE abs(length(asked) - length(name)) <= 2
)
SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY edits, length(name), name) AS INTEGER) AS rank FROM met WHERE edits <= 2
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY edits, length(name), name) <= 3""",
)
def _(g: Snapshot) -> DataFrame:
    """Names of suppliers with a slip in each, and what they may have meant."""
    asked = g.s.where("kind = 'interface'").selectExpr(f"{ASKED} AS name")
    return spelling.near_names(asked, g.s)


def digest_sql(name: str, rows: str, columns: list[str]) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')"
    part = lambda at: f"CAST(sum(CAST(CAST('0x' || substr(h, {at}, 15) AS BIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)"
    return f"SELECT '{name}' AS name, count(*) AS rows, {part(1)} || '-' || {part(16)} AS digest FROM (SELECT md5({' || '.join(map(field, columns))}) AS h FROM {rows})"


NAMED = "(SELECT e.*, a.qualname AS source_name, b.qualname AS target_name, CAST(round(confidence * 10000) AS BIGINT) AS sure FROM e LEFT JOIN s a ON a.id = source LEFT JOIN s b ON b.id = e.target)"


@over_graph("graph_digests", " UNION ALL ".join(digest_sql(name, {"files": "f", "symbols": "s", "edges": NAMED, "metrics": "g_metrics"}[name], columns) for name, columns in analytics.DIGESTED.items()))
def _(g: Snapshot) -> DataFrame:
    return analytics.graph_digests(g.f, g.s, g.e, g.m)


YEAR = "year(DATE '1970-01-01' + CAST(event_ts // 86400 AS INTEGER))"


@over_graph(
    "neighbours_in_time",
    f""", h AS (SELECT DISTINCT source, target, {YEAR} AS v FROM e WHERE event_ts IS NOT NULL), a AS (SELECT source, target FROM h WHERE v = 1995 AND source IS NOT NULL AND target IS NOT NULL), b AS (SELECT source, target FROM h WHERE v = 1997 AND source IS NOT NULL AND target IS NOT NULL)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.source IS NULL THEN 'new' WHEN b.source IS NULL THEN 'removed' ELSE 'stable' END AS state FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target""",
)
def _(g: Snapshot) -> DataFrame:
    """Edges by the year in which they were seen as versions; what each symbol leads to in two of them."""
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(event_ts div 86400 as int)"))).cast("long")
    history = g.e.where("event_ts is not null").select("source", "target", year.alias("graph_version"))
    return snapshot.neighbours_between(snapshot.validity(history, ["source", "target"]), 1995, 1997)


@over_graph(
    "shared_budget",
    """, i AS (SELECT file_id, kind, id, strlen(qualname) AS size FROM s), t AS (SELECT file_id, kind, sum(size) AS total FROM i GROUP BY ALL), l AS (
  SELECT file_id, (2000 - coalesce(sum(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(count(*) OVER (PARTITION BY file_id) - row_number() OVER w + 1 AS DOUBLE) AS level FROM t WINDOW w AS (PARTITION BY file_id ORDER BY total, kind)
), m AS (SELECT file_id, CAST(floor(max(level)) AS BIGINT) AS level FROM l GROUP BY file_id)
SELECT file_id, kind, id, CAST(used AS BIGINT) AS used, level FROM (SELECT *, sum(size) OVER (PARTITION BY file_id, kind ORDER BY id) AS used FROM i) JOIN m USING (file_id) WHERE used <= level""",
)
def _(g: Snapshot) -> DataFrame:
    """What 2000 bytes of each file's symbols hold, an array for each kind."""
    items = g.s.select("file_id", "kind", "id", F.octet_length("qualname").cast("long").alias("size"))
    return budget.shared_prefix(items, ["file_id"], "kind", ["id"], "size", 2_000).select("file_id", "kind", "id", "used", "level")


ROWS, BYTES, MS = 60, 530, 15_000_000
QUEUE = f"""
WITH RECURSIVE q AS (
  SELECT row_number() OVER o - 1 AS n, coalesce(sum(length(props)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes, epoch_us(ts) AS us, length(props) AS size FROM events WINDOW o AS (ORDER BY ts, event_id)
), nx AS MATERIALIZED (
  SELECT n, bytes, least(n + {ROWS}, coalesce(min(n) OVER (ORDER BY bytes RANGE BETWEEN {BYTES} FOLLOWING AND UNBOUNDED FOLLOWING), n + {ROWS}), coalesce(1 + min(n) OVER (ORDER BY us RANGE BETWEEN {MS * 1000} FOLLOWING AND UNBOUNDED FOLLOWING), n + {ROWS}), (SELECT count(*) FROM q)) AS next FROM q
), made AS (
  SELECT CAST(0 AS BIGINT) AS n UNION ALL SELECT next FROM made JOIN nx USING (n) WHERE next < (SELECT count(*) FROM q)
)
SELECT made.n AS first, next - made.n AS changes, CAST(coalesce((SELECT bytes FROM nx z WHERE z.n = nx.next), (SELECT sum(size) FROM q)) - bytes AS BIGINT) AS bytes FROM made JOIN nx USING (n)
"""


def flush_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The queue of events in batches of rows, bytes or time, whichever is full first."""
    events = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("size"))
    return watch.flushes(events, ["ts", "event_id"], "ts", "size", ROWS, BYTES, MS)


QUERIES["flush_cuts"], ORACLE_SQL["flush_cuts"] = flush_cuts, QUEUE
