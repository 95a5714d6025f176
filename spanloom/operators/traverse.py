"""Breadth-first traversals as loops of joins with a visited set.

Each level joins the frontier to the edges, keeps one way into each new node and anti-joins what has
been visited. Edges whose target is a name alone are followed too: downwards to the best symbol of that
name, upwards from every symbol of the name. Names and bridges are hubs: the frontier's nodes meet at a
name or address first, and what leaves it is joined to that, so a name that many share costs the sum
of both sides, not their product. Levels are written to the shared folder, so plans stay short and a
lost executor costs one level. The bound on depth ends the loop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.boundary import boundary_detail, boundary_type, plain_language, protocol_context
from spanloom.functions.names import trailing_name
from spanloom.operators.filters import EDGE_RANKS, OTHER_RANK
from spanloom.operators.resolve import crosses, resolve_by_suffix
from spanloom.operators.shared import cut
from spanloom.plans.model import COMPLEMENTS

# Kinds that a trace follows by default.
TRACE_KINDS = ("CALLS", "RPC_IMPL", "RPC_CALL", "XREF", "CHANNEL_PUBLISH", "CHANNEL_SUBSCRIBE", "HTTP_CALL", "HTTP_ROUTE", "CONFIG_SOURCE", "CONFIG_READ", "CONFIG_BIND")
# Kinds whose unresolved edges an impact analysis follows upwards by name.
NAMED_KINDS = ("CALLS", "CONFIG_BIND")
DOWN, UP, BOTH = "downstream", "upstream", "both"
DIRECTIONS = {"up": UP, "upstream": UP, "callers": UP, "in": UP, "incoming": UP, "down": DOWN, "downstream": DOWN, "callees": DOWN, "out": DOWN, "outgoing": DOWN}
#: Bytes that a hop's JSON has at least, and a trace's bytes by default.
LEAST_HOP, TRACE_BYTES = 64, 30_000


def direction(name: str) -> str:
    return DIRECTIONS.get(name.lower(), BOTH)


@dataclass(frozen=True)
class Ways:
    """How a traversal goes on: slim edges of the kinds followed, symbols, direction, and which kinds
    are followed by name (None: all) and whether by bridges."""

    edges: DataFrame
    symbols: DataFrame
    way: str
    by_name: tuple[str, ...] | None = NAMED_KINDS
    bridges: bool = True

    def steps(self, frontier: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """keys, id, parent, kind, via (edge, bridge or name) of everything one step from the frontier (keys, node)."""
        edges, out = self.edges, []
        last = trailing_name(F.col("target_qualname"))
        open_ = F.col("target").isNull() & F.col("target_qualname").isNotNull()
        named = F.lit(True) if self.by_name is None else F.col("kind").isin(*self.by_name)
        if self.way != UP:
            ahead = frontier.join(edges.where("source is not null").withColumnRenamed("source", "node"), "node")
            out.append(ahead.where("target is not null").select(*keys, F.col("target").alias("id"), F.col("node").alias("parent"), "kind", F.lit("edge").alias("via")))
            loose = cut(ahead.where(open_).select(*keys, "node", "kind", "target_qualname", "language"))
            found = resolve_by_suffix(loose, self.symbols).withColumnRenamed("resolved_id", "id")
            match = loose.withColumn("may_cross", crosses(F.col("kind"))).join(found, ["target_qualname", "language", "may_cross"])
            out.append(match.select(*keys, "id", F.col("node").alias("parent"), "kind", F.lit("name").alias("via")))
        if self.way != DOWN:
            back = frontier.join(edges.where("source is not null").select(F.col("target").alias("node"), F.col("source").alias("id"), "kind"), "node")
            out.append(back.select(*keys, "id", F.col("node").alias("parent"), "kind", F.lit("edge").alias("via")))
            hubs = frontier.join(self.symbols.select(F.col("id").alias("node"), F.col("name").alias("hub")), "node").groupBy(*keys, "hub").agg(F.min("node").alias("parent"))
            loose = edges.where(open_ & named & F.col("source").isNotNull()).select(last.alias("hub"), F.col("source").alias("id"), "kind")
            out.append(hubs.join(loose, "hub").select(*keys, "id", "parent", "kind", F.lit("name").alias("via")))
        if self.bridges:
            bridged = edges.where(F.col("source").isNotNull() & F.col("target_qualname").isNotNull() & F.col("kind").isin(*COMPLEMENTS)).select("source", "kind", F.col("target_qualname").alias("hub"))
            hubs = frontier.join(bridged.withColumn("other", complement(F.col("kind"))).withColumnRenamed("source", "node"), "node").groupBy(*keys, "hub", "kind", "other").agg(F.min("node").alias("parent"))
            far = bridged.select("hub", F.col("kind").alias("other"), F.col("source").alias("id"))
            out.append(hubs.join(far, ["hub", "other"]).select(*keys, "id", "parent", "kind", F.lit("bridge").alias("via")))
        steps = out[0]
        for more in out[1:]:
            steps = steps.union(more)
        return steps


def complement(kind: Column) -> Column:
    """The kind at the other end of a bridge, null for kinds that build none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPLEMENTS.items() for x in kv)), kind)


def ways(symbols: DataFrame, edges: DataFrame, way: str, kinds: tuple[str, ...] | None = TRACE_KINDS, by_name: tuple[str, ...] | None = NAMED_KINDS, with_bridges: bool = True) -> Ways:
    """Cuts the edges that a traversal may use, once for all levels. ``kinds``: None for all."""
    used = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    slim = used.where(F.col("source").isNotNull() | F.col("target").isNotNull()).select("source", "target", "kind", "target_qualname", "language")
    return Ways(cut(slim), symbols.select("id", "name", "qualname", "kind", "language"), way, by_name, with_bridges)


def bfs(seeds: DataFrame, near: Ways, depth: int, most: int | None = None, keys: tuple[str, ...] = (), end: int | None = None, enough: int | None = None) -> DataFrame:
    """id, distance, parent, kind, via, solid (and ``keys``) of what the seeds reach within ``depth`` steps.

    Of several ways into a node at its least distance, the one of the smallest (parent, kind, via) counts;
    ``solid``: one of them is not by a name alone. ``keys`` are further columns of the seeds, each value
    of which is a traversal of its own. ``most`` bounds the result by (distance, id), for each value of
    the keys. The walk ends with the level that reaches ``end``; of that level only it is kept. It also ends
    with the level by which ``enough`` nodes beside the seeds are reached, for callers that want the nearest alone.
    """
    start = seeds.select(*keys, "id").distinct().select(*keys, "id", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("via"), F.lit(True).alias("solid"))
    visited = frontier = cut(start)
    found = 0
    for level in range(1, depth + 1):
        step = near.steps(frontier.select(*keys, F.col("id").alias("node")), keys).groupBy(*keys, "id").agg(F.min(F.struct("parent", "kind", "via")).alias("way"), F.max(F.col("via") != "name").alias("solid"))
        seen = step.join(near.symbols.select("id"), "id", "left_semi")  # ends that are no symbol of the snapshot lead nowhere
        fresh = seen.join(visited.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, "id", F.lit(level).alias("distance"), "way.parent", "way.kind", "way.via", "solid")
        frontier = cut(fresh)
        if end is not None and not frontier.where(F.col("id") == end).isEmpty():
            visited = visited.union(frontier.where(F.col("id") == end))
            break
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if enough is not None and (found := found + frontier.count()) >= enough:
            break
    if most is None:
        return visited
    if not keys:
        return visited.orderBy("distance", "id").limit(most)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "id"))
    return visited.withColumn("place", place).where(F.col("place") <= most).drop("place")


def paths(reached: DataFrame, depth: int) -> DataFrame:
    """id, steps: the nodes from a seed to each node, by following parents."""
    out = reached.select("id", F.col("parent").alias("at"), F.array(F.col("id")).alias("steps"))
    parents = reached.select(F.col("id").alias("at"), F.col("parent").alias("above"))
    for _ in range(depth):
        out = out.join(parents, "at", "left").select("id", F.col("above").alias("at"), F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "steps")).otherwise(F.col("steps")).alias("steps"))
    return out.select("id", "steps")


def subgraph(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between reached nodes."""
    ids = reached.select("id").distinct()
    return edges.where("source is not null and target is not null").select("source", "target", "kind").distinct().join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


# Kinds of edges whose open names are whole names of files' modules.
FILE_KINDS = ("MODULE_FILE", "IMPORTS_FILE")


def bounded_subgraph(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, distance, place) and edges (source, target, kind, target_qualname, detail) around the seeds,
    along edges of both directions, ``max_nodes`` nodes at most beside the seeds' own.

    Nodes are taken in the order of a queue: a level's nodes in their order, the neighbours of each in the order
    of the edges that lead there (rank of kind, names of both ends, detail). So a level is a join, the first
    edge into each new node, and the first nodes that there is still room for. Edges are those of all nodes
    up to the one whose neighbours filled the room. Open names of files are looked up whole, those of calls by
    their last part; edges with an end that is no symbol are left out.
    """
    c, names = F.col, symbols.select("id", "qualname")
    used = cut(edges.select("source", "target", "kind", "target_qualname", "detail", "language").distinct())
    order = Window.orderBy("way", "id")  # over ``max_nodes`` rows at most
    start = seeds.select("id").distinct().join(names, "id", "left_semi")
    visited = frontier = cut(start.select("id", F.lit(0).alias("distance"), F.row_number().over(Window.orderBy("id")).cast("long").alias("place")))
    count, kept = visited.count(), []
    for level in range(1, depth + 1):
        at = frontier.select(c("id").alias("node"), "place")
        near = at.join(used.where("source is not null"), c("node") == c("source")).union(at.join(used.where("target is not null"), c("node") == c("target"))).distinct()
        open_ = c("target").isNull() & c("target_qualname").isNotNull()
        whole = symbols.join(near.where(open_ & c("kind").isin(*FILE_KINDS)).select(c("target_qualname").alias("qualname")).distinct(), "qualname", "left_semi").groupBy(c("qualname").alias("target_qualname")).agg(F.min("id").alias("whole_id"))
        best = resolve_by_suffix(near.where(open_ & (c("kind") == "CALLS")), symbols).where("not may_cross").select("target_qualname", "language", "resolved_id")
        near = near.join(whole, "target_qualname", "left").join(best, ["target_qualname", "language"], "left")
        near = near.withColumn("target", F.coalesce("target", F.when(c("kind").isin(*FILE_KINDS), c("whole_id")), F.when(c("kind") == "CALLS", c("resolved_id"))))
        for end in ("source", "target"):
            near = near.join(names.select(c("id").alias(end), c("qualname").alias(f"{end}_name")), end, "left")
        sound = (c("source").isNull() | c("source_name").isNotNull()) & (c("target").isNull() | c("target_name").isNotNull())
        rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in EDGE_RANKS.items() for x in kv)), c("kind")), F.lit(OTHER_RANK))
        empty = F.lit("")
        way = F.struct("place", rank.alias("rank"), F.coalesce("source_name", empty).alias("s"), F.coalesce("target_name", "target_qualname", empty).alias("t"), F.coalesce("detail", empty).alias("d"), "kind")
        near = cut(near.where(sound).withColumns({"way": way, "other": F.when(c("source") == c("node"), c("target")).otherwise(c("source"))}))
        fresh = near.where("other is not null").groupBy(c("other").alias("id")).agg(F.min("way").alias("way")).join(visited.select("id"), "id", "left_anti")
        chosen = fresh.orderBy("way", "id").limit(max(0, max_nodes - count))
        frontier = cut(chosen.select("id", F.lit(level).alias("distance"), F.row_number().over(order).cast("long").alias("place"), c("way.place").alias("after")))
        found, last = frontier.agg(F.count(F.lit(1)), F.max("after")).first()
        count += found
        full = count >= max_nodes
        kept.append(near.where(c("place") <= (last or 1)) if full else near)
        frontier = frontier.drop("after")
        visited = visited.union(frontier)
        if full or not found:
            break
    columns = ["source", "target", "kind", "target_qualname", "detail"]
    out = reduce(DataFrame.union, (df.select(*columns) for df in kept)).distinct() if kept else used.where("false").select(*columns)
    return visited, out


def trace_flow(
    seeds: DataFrame,
    symbols: DataFrame,
    edges: DataFrame,
    way: str = DOWN,
    kinds: tuple[str, ...] = TRACE_KINDS,
    max_hops: int = 5,
    end: int | None = None,
    max_bytes: int = TRACE_BYTES,
    offset: int = 0,
) -> DataFrame:
    """The hops of a trace in order: position, id, qualname, path, edge_kind, distance, language,
    cross_language, boundary_type, boundary_detail, protocol, used_bytes.

    Hops come by distance and id. Those from ``offset`` on are in until their JSON fills ``max_bytes``,
    the one that does included. Only as many hops as can fit are put in one order.
    """
    room = offset + -(-max_bytes // LEAST_HOP) + 1
    reached = bfs(seeds, ways(symbols, edges, way, kinds, by_name=None), max_hops, end=end, enough=room).where("distance > 0")
    first = cut(reached.orderBy("distance", "id").limit(room))
    place = symbols.select("id", "qualname", "path", plain_language(F.col("language")).alias("language"))
    came = place.select(F.col("id").alias("parent"), F.col("language").alias("from_language"))
    over = F.col("via") == "bridge"
    hops = first.join(place, "id").join(came, "parent", "left").withColumn("edge_kind", F.when(over, complement(F.col("kind"))).otherwise(F.col("kind")))
    hops = hops.withColumn("source", F.col("id") if way == UP else F.when(over, F.col("id")).otherwise(F.col("parent")))
    if "detail" in edges.columns:
        told = edges.where("detail is not null").select("source", F.col("kind").alias("edge_kind"), "detail").join(hops.select("source", "edge_kind").distinct(), ["source", "edge_kind"], "left_semi")
        hops = hops.join(told.groupBy("source", "edge_kind").agg(F.min("detail").alias("detail")), ["source", "edge_kind"], "left")
    else:
        hops = hops.withColumn("detail", F.lit(None).cast("string"))
    cross = over | F.coalesce(F.col("language") != F.col("from_language"), F.lit(False))
    kind_of = boundary_type(F.col("edge_kind"), F.col("from_language"), F.col("language"))
    shown = hops.select(
        "id", "qualname", "path", "edge_kind", "distance", "language", cross.alias("cross_language"),
        F.when(cross, kind_of).alias("boundary_type"),
        F.when(cross, boundary_detail(kind_of, F.col("from_language"), F.col("language"))).alias("boundary_detail"),
        F.when(cross, protocol_context(F.col("edge_kind"), F.col("detail"))).alias("protocol"),
    )
    order = Window.orderBy("distance", "id")
    sized = shown.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") >= offset)
    size = F.octet_length(F.to_json(F.struct("id", "qualname", "path", "edge_kind", "distance", "language", "cross_language", "boundary_type", "boundary_detail", "protocol"))).cast("long")
    return sized.withColumn("size", size).withColumn("used_bytes", F.sum("size").over(order)).where(F.col("used_bytes") - F.col("size") < max_bytes).drop("size")


def paths_found(hops: DataFrame, end: int | None = None) -> DataFrame:
    """hops, paths, reached: with a target 0 or 1 paths, else as many as there are hops at the largest distance."""
    far = hops.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == F.lit(end)).alias("hit"))
    all_ = far.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hops"), F.max(F.struct("distance", "n")).alias("last"), (F.coalesce(F.sum("hit"), F.lit(0)) > 0).alias("reached"))
    paths = F.coalesce(F.col("last.n"), F.lit(0)) if end is None else F.col("reached").cast("long")
    return all_.select("hops", paths.alias("paths"), "reached")
