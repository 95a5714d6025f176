"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns of the documents (domain, language, source). The root's token budget
is passed down: a node's children share it by their weights, and none gets more than its subtree can
supply (its tokens times ``max_epochs``). What a child cannot take goes to its siblings by their
weights; only if a whole subtree is short does the shortage reach the siblings of its ancestor. A
leaf's budget is spent on whole epochs and on a prefix, in tokens, of the next epoch's own seeded
order; a document is in if its last token is within the prefix.

The prefix is found without sorting a leaf: token sums of 256 ranges of the hash order show in which
range the prefix ends, that one is cut in 256 again, and once more, and what is left, a part in 16
million of a leaf, is summed document by document. The plan has a row for each leaf; a document's
share follows from it and the document's own hash, so texts are not shuffled.

Defined results: null levels are the empty name; documents without a token are never drawn; documents
of one key have one place in the order and are in or out together; weights that are not given
are 1, and nodes of weight 0 get nothing; other columns stay as they are; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

#: Hexadecimal digits of the hash that orders an epoch, those of them that name a range, and how often ranges are cut.
DIGITS, RANGE_DIGITS, CUTS = 15, 2, 3
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters: integer weights of each level's nodes by name, the budget as a share of all tokens
    (or in tokens), how often a document may be drawn, and the seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    share: float = 0.5
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 1


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch of a leaf."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _shared(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Gives the children their parts of ``budget`` (the parent's), at most ``supply`` each."""
    order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("supply") / F.col("weight"), child)
    level = (F.col("budget") - F.sum("supply").over(order) + F.col("supply")) / (F.sum("weight").over(Window.partitionBy(*parent, F.lit(0))) - F.sum("weight").over(order) + F.col("weight"))
    reached = nodes.where("weight > 0").withColumn("level", level)
    highest = F.max("level").over(Window.partitionBy(*parent, F.lit(0)))
    return reached.withColumn("highest", highest).withColumn("budget", F.least("supply", F.floor(F.col("highest") * F.col("weight")))).drop("level", "highest")


def budgets(leaves: DataFrame, levels: list[str], mix: Mix) -> DataFrame:
    """levels, tokens, budget: what each leaf shall give. ``leaves`` has levels and tokens."""
    supplied = leaves.withColumn("supply", F.col("tokens") * mix.max_epochs)
    total = F.floor(F.sum("tokens") * F.lit(mix.share)) if mix.tokens is None else F.lit(mix.tokens)
    above = supplied.agg(F.coalesce(total, F.lit(0)).cast("long").alias("budget"))
    for depth, level in enumerate(levels):
        parent, path = levels[:depth], levels[: depth + 1]
        nodes = supplied.groupBy(*path).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        given = mix.weights.get(level, {})
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in kv)), F.col(level)), F.lit(1)) if given else F.lit(1)
        below = nodes.join(above, parent) if parent else nodes.join(above, F.lit(True))
        above = _shared(below.withColumn("weight", weight.cast("long")), parent, level).select(*path, "tokens", "budget")
        if depth + 1 < len(levels):
            above = above.drop("tokens")
    return above


def plan(docs: DataFrame, levels: list[str], mix: Mix, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """levels, epochs (whole ones), cut: documents at or before the place ``cut`` are drawn once more.

    ``docs`` has the key, the levels (not null) and the number of tokens: a slim table.
    """
    leaves = docs.groupBy(*levels).agg(F.sum(tokens).alias("tokens")).where("tokens > 0")
    shares = written(
        budgets(leaves, levels, mix).select(*levels, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")),
        "shares",
    )
    placed = docs.where(F.col(tokens) > 0).join(shares, levels).select(*levels, "rest", F.col(tokens).alias("n"), place(mix.seed, F.col("epochs"), F.col(key)).alias("place"))
    inside = placed.withColumn("before", F.lit(0).cast("long"))
    by_range = Window.partitionBy(*levels).orderBy("range")
    for depth in range(1, CUTS + 1):
        width = 16 ** (DIGITS - RANGE_DIGITS * depth)
        ranged = inside.withColumn("range", F.expr(f"place div {width}"))
        sums = ranged.groupBy(*levels, "range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before")).withColumn("upto", F.col("before") + F.sum("n").over(by_range))
        last = sums.where("rest < upto and rest >= upto - n").select(*levels, "range", (F.col("upto") - F.col("n")).alias("start"))
        inside = written(ranged.join(last, [*levels, "range"]).select(*levels, "rest", "n", "place", F.col("start").alias("before"), (F.col("range") * width).alias("first")), "range")
    within = Window.partitionBy(*levels).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    summed = inside.withColumn("upto", F.col("before") + F.sum("n").over(within))
    cuts = summed.groupBy(*levels).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))), F.first("first") - 1).alias("cut"))
    return written(shares.join(cuts, levels).select(*levels, "epochs", "cut"), "plan")


def copies(docs: DataFrame, chosen: DataFrame, levels: list[str], mix: Mix, has_token: Column, key: str = "doc_id", name: str = "copies") -> DataFrame:
    """``docs`` with how often each is drawn as the column ``name``, in the place of one that has this name;
    other columns stay. The plan is joined on the levels: broadcast where Spark
    finds it below its threshold, else by a shuffle whose hot leaves are split at run time."""
    at = place(mix.seed, F.col("\0epochs"), F.col(key))
    drawn = F.when(has_token & F.col("\0epochs").isNotNull(), F.col("\0epochs") + F.when(at <= F.col("\0cut"), 1).otherwise(0)).otherwise(0).cast("long")
    renamed = chosen.select(*levels, F.col("epochs").alias("\0epochs"), F.col("cut").alias("\0cut"))
    return docs.join(renamed, levels, "left").withColumn(name, drawn).drop("\0epochs", "\0cut")
