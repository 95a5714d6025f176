"""Joins by name: resolution of unresolved targets, bridges, repairs, anti-joins, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.names import orphan_target, trailing_name
from spanloom.operators.shared import cut
from spanloom.plans.model import BRIDGE_KINDS, COMPLEMENTS

# Kinds that an unresolved name may stand for.
TARGET_KINDS = ("method", "function", "class", "interface", "struct", "property", "enum", "trait", "type", "record", "service")
# What may be dead, names that are entry points, edges that are a use and edges that make an entry point.
DEAD_KINDS = ("function", "method", "class", "struct")
ENTRY_NAMES = ("main", "__init__", "setup", "teardown", "configure", "register")
USE_KINDS = ("CALLS", "IMPORTS", "RPC_IMPL", "IMPLEMENTS", "EXTENDS")
ENTRY_KINDS = ("HTTP_ROUTE", "RPC_IMPL", "CHANNEL_SUBSCRIBE")


def crosses(kind: Column) -> Column:
    """Whether edges of a kind may lead to symbols of another language."""
    return kind.isin(*BRIDGE_KINDS)


def resolve_by_suffix(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``names`` (target_qualname, language, kind) with resolved_id of the best symbol that matches.

    A symbol matches if its qualname is the name or ends with its last part after ``.`` or ``::``. Best is:
    same language, exact, shortest, first. Symbols of another language count for bridge kinds alone.

    So the best is the first that there is of four: the first symbol of that name in the language, the
    shortest with that last part in the language, and both of these anywhere. Each is an aggregation of
    symbols and an equality join of distinct names with it: however many names and symbols share a last
    part, no pairs are formed.
    """
    asked = names.select("target_qualname", "language", crosses(F.col("kind")).alias("may_cross")).distinct().withColumn("last", trailing_name(F.col("target_qualname")))
    known = symbols.where(F.col("kind").isin(*TARGET_KINDS)).select("id", "qualname", "language", trailing_name(F.col("qualname")).alias("last"))
    shortest = F.min_by("id", F.struct(F.length("qualname"), "qualname", "id"))
    exact = known.withColumnRenamed("qualname", "target_qualname").where("last is not null")
    steps = [
        (exact.groupBy("target_qualname", "language").agg(F.min("id").alias("same_exact")), ["target_qualname", "language"]),
        (known.groupBy("last", "language").agg(shortest.alias("same_last")), ["last", "language"]),
        (exact.groupBy("target_qualname").agg(F.min("id").alias("any_exact")), ["target_qualname"]),
        (known.groupBy("last").agg(shortest.alias("any_last")), ["last"]),
    ]
    for found, keys in steps:
        asked = asked.join(found, keys, "left")
    best = F.coalesce("same_exact", "same_last", F.when(F.col("may_cross"), F.coalesce("any_exact", "any_last")))
    return asked.select("target_qualname", "language", "may_cross", best.alias("resolved_id")).where("resolved_id is not null")


def re_resolved(known: DataFrame, names: DataFrame, moved: DataFrame, symbols: DataFrame) -> DataFrame:
    """What ``resolve_by_suffix`` gives for ``names`` and ``symbols``, from what it gave before (``known``).

    ``moved`` (qualname) are the names of symbols that came, went or changed since. Names whose last part is
    none of theirs stay as they were; only the others, and those not asked before, are looked up.
    """
    keys = ["target_qualname", "language", "may_cross"]
    lasts = moved.select(trailing_name(F.col("qualname")).alias("last")).distinct()
    touched = lambda df: df.withColumn("last", trailing_name(F.col("target_qualname"))).join(lasts, "last", "left_semi").drop("last")
    again = resolve_by_suffix(touched(names), symbols.withColumn("last", trailing_name(F.col("qualname"))).join(lasts, "last", "left_semi").drop("last"))
    asked = names.select("target_qualname", "language", crosses(F.col("kind")).alias("may_cross")).distinct()
    still = known.withColumn("last", trailing_name(F.col("target_qualname"))).join(lasts, "last", "left_anti").drop("last")
    return still.join(asked, keys, "left_semi").select(*again.columns).union(again)


def resolve_exact(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct target_qualname with the smallest id of the symbols of that qualname, null if none."""
    first = symbols.groupBy(F.col("qualname").alias("target_qualname")).agg(F.min("id").alias("resolved_id"))
    return names.select("target_qualname").distinct().join(first, "target_qualname", "left")


# Kinds of symbols that stand for their owner too where a search starts.
OWNED_KINDS = ("property", "field", "attribute", "const")


def parents(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """seed, parent of the properties and the like among seeds (id): the symbols that their names are inside of."""
    owner = F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1)
    owned = symbols.where(F.col("kind").isin(*OWNED_KINDS)).join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("seed"), owner.alias("qualname")).where("qualname <> ''")
    return owned.join(symbols.select("qualname", F.col("id").alias("parent")), "qualname").select("seed", "parent")


def repair_dangling(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose ends that are no symbol are null."""
    live = symbols.select("id").distinct()
    out = edges
    for end in ("source", "target"):
        out = out.join(live.withColumnRenamed("id", f"live_{end}"), F.col(end) == F.col(f"live_{end}"), "left").withColumn(end, F.col(f"live_{end}")).drop(f"live_{end}")
    return out


def dead_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that nothing calls, imports, implements or extends, and that are no entry point themselves."""
    used = edges.where(F.col("kind").isin(*USE_KINDS) & F.col("target").isNotNull()).select(F.col("target").alias("id"))
    entries = edges.where(F.col("kind").isin(*ENTRY_KINDS) & F.col("source").isNotNull()).select(F.col("source").alias("id"))
    candidates = symbols.where(F.col("kind").isin(*DEAD_KINDS) & ~F.col("name").isin(*ENTRY_NAMES))
    return candidates.join(used.union(entries).distinct(), "id", "left_anti")


def unused_imports(edges: DataFrame) -> DataFrame:
    """Imports whose name no call of the same file uses."""
    used = edges.where("kind = 'CALLS' and target_qualname is not null").select("file_id", "target_qualname").distinct()
    return edges.where("kind = 'IMPORTS' and target_qualname is not null").join(used, ["file_id", "target_qualname"], "left_anti")


def orphan_tests(symbols: DataFrame) -> DataFrame:
    """Test functions, by name or path, whose target's name no symbol has, with that name."""
    named = F.col("name").ilike("test%") | F.lower("path").contains("test") | F.lower("path").contains("spec")
    tests = symbols.where(F.col("kind").isin("function", "method") & named).withColumn("wanted", orphan_target(F.col("name"))).where("wanted <> ''")
    return tests.join(symbols.select(F.col("name").alias("wanted")).distinct(), "wanted", "left_anti")


def incoming_by_name(edges: DataFrame, symbols: DataFrame, kind: str, most: int = 100) -> DataFrame:
    """Edges of a kind whose target name ends with a symbol's name, ``most`` for each symbol.

    The first edges of a name are the same for all its symbols, so they are chosen before the join.
    """
    named = edges.where((F.col("kind") == kind) & F.col("source").isNotNull()).select("source", "line", "target_qualname", trailing_name(F.col("target_qualname")).alias("name"))
    order = Window.partitionBy("name").orderBy("source", "line", "target_qualname")
    first = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return symbols.select("id", "name").join(first, "name").select("id", "name", "source", "line", "target_qualname", "place")


#: Sources of one name in a share, and pairs that a task makes.
SHARE, TASK_PAIRS = 1_000, 20_000_000


def bridges(edges: DataFrame) -> DataFrame:
    """Pairs of sources whose edges have one target name and complementary kinds.

    A source meets the other side's shares, each a row with its ids, and pairs are made of such rows as they
    leave: only those are shuffled and joined, a thousandth of the pairs where names are common.
    """
    met = meetings(edges).select("target_qualname", "kind", "other_kind", "from_id", F.explode("to_ids").alias("to_id"))
    return met.where("from_id <> to_id")


def meetings(edges: DataFrame) -> DataFrame:
    """target_qualname, kind, other_kind, from_id, to_ids: each source with every share of those at a name's other side.

    Both sides of a name are dealt over shares; each share of the one meets each of the other in a cell of its
    own, and there are as many tasks as there are pairs for. So a name that many share is no task of its own.
    """
    c = F.col
    pairs = F.create_map(*(F.lit(x) for kv in COMPLEMENTS.items() for x in kv))
    left = edges.where(F.col("source").isNotNull() & F.col("target_qualname").isNotNull() & F.col("kind").isin(*COMPLEMENTS)).select("target_qualname", "kind", F.col("source").alias("from_id")).distinct()
    left = cut(left)
    sizes = left.groupBy("target_qualname", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("other_kind", F.try_element_at(pairs, c("kind")))
    other = sizes.select("target_qualname", c("kind").alias("other_kind"), c("n").alias("m"))
    share = lambda n: F.ceil(c(n) / SHARE).cast("long")
    met = cut(sizes.join(other, ["target_qualname", "other_kind"]).select("target_qualname", "kind", "other_kind", "n", "m", share("n").alias("a"), share("m").alias("b")))
    tasks = -(-(met.agg(F.coalesce(F.sum(c("n") * c("m")), F.lit(0))).first()[0]) // TASK_PAIRS)
    keys = ["target_qualname", "kind", "other_kind", "i", "j"]
    every, own = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), c(n) - 1)), lambda x, n: F.pmod(F.xxhash64(x), c(n))
    one = left.join(met, ["target_qualname", "kind"]).select("target_qualname", "kind", "other_kind", "from_id", own("from_id", "a").alias("i"), every("b").alias("j"))
    two = left.select("target_qualname", c("kind").alias("other_kind"), c("from_id").alias("to_id")).join(met, ["target_qualname", "other_kind"]).select("target_qualname", "kind", "other_kind", "to_id", own("to_id", "b").alias("j"), "a")
    two = two.groupBy("target_qualname", "kind", "other_kind", "j", "a").agg(F.collect_list("to_id").alias("to_ids")).select("target_qualname", "kind", "other_kind", "to_ids", "j", every("a").alias("i"))
    n = max(left.sparkSession.sparkContext.defaultParallelism, tasks)
    return one.repartition(n, *keys).join(two.repartition(n, *keys), keys).select("target_qualname", "kind", "other_kind", "from_id", "to_ids")


#: Lines of a stretch. Intervals are joined by the stretches of a file that they touch.
STRETCH = 64


def _stretches(start: str, stop: str) -> Column:
    return F.explode(F.sequence(F.expr(f"{start} div {STRETCH}"), F.expr(f"greatest({start}, {stop}) div {STRETCH}")))


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (file_id, at) with the innermost symbol around each: modules last, then shortest.

    Of symbols with the same lines one is compared; points meet the symbols of their stretch of lines alone.
    """
    last = F.when(F.col("kind") == "module", 1).otherwise(0).alias("last")
    spans = symbols.groupBy("file_id", last, "start_line", "end_line").agg(F.min("id").alias("id"))
    spans = spans.where("end_line >= start_line").select("*", _stretches("start_line", "end_line").alias("stretch"))
    order = Window.partitionBy(*keys).orderBy("last", F.col("end_line") - F.col("start_line"), F.desc("start_line"), "id")
    met = points.withColumn("stretch", F.expr(f"at div {STRETCH}")).join(spans, ["file_id", "stretch"]).where("at between start_line and end_line")
    return met.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "stretch", "last")


def overlapping(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a change touches: added if a hunk covers one whole, else modified.

    A hunk and a symbol meet in the stretch in which their common lines begin.
    """
    own = symbols.select("file_id", "id", "start_line", "end_line", _stretches("start_line", "end_line").alias("stretch"))
    given = hunks.select("file_id", "hunk_start", "hunk_end", _stretches("hunk_start", "hunk_end").alias("stretch"))
    met = given.join(own, ["file_id", "stretch"]).where(f"start_line <= hunk_end and end_line >= hunk_start and greatest(start_line, hunk_start) div {STRETCH} = stretch")
    inside = F.max((F.col("start_line") >= F.col("hunk_start")) & (F.col("end_line") <= F.col("hunk_end")))
    return met.groupBy("file_id", "id").agg(F.when(inside, "added").otherwise("modified").alias("change"), F.count(F.lit(1)).alias("hunks"))


def innermost_only(symbols: DataFrame) -> DataFrame:
    """Symbols without another one of the same file strictly inside them.

    One is inside if it begins on the same line and ends earlier, or begins later and ends no later: the
    least end of each line, and of all lines after it, decide. No pairs are formed.
    """
    ends = symbols.groupBy("file_id", "start_line").agg(F.min("end_line").alias("least"))
    after = Window.partitionBy("file_id").orderBy("start_line").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("later", F.min("least").over(after))
    kept = (F.col("least") >= F.col("end_line")) & (F.col("later").isNull() | (F.col("later") > F.col("end_line")))
    return symbols.join(ends, ["file_id", "start_line"]).where(kept).select(*symbols.columns)


def members(containers: DataFrame, symbols: DataFrame) -> DataFrame:
    """container_id, id of the symbols inside each container's lines."""
    outer = containers.select("file_id", F.col("id").alias("container_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b")).select("*", _stretches("a", "b").alias("stretch"))
    inner = symbols.select("file_id", "id", "start_line", "end_line", F.expr(f"start_line div {STRETCH}").alias("stretch"))
    return inner.join(outer, ["file_id", "stretch"]).where("start_line >= a and end_line <= b and id <> container_id").select("container_id", "id")
