"""Hard negatives by dual-tree search: the highest inner products of other labels inside a band.

An anchor's positives are its best rows of the same label. For each of them a band of scores is set, from
``low`` to ``high`` hundredths of the positive's score, and the best rows of other labels in that band are the
negatives. Both steps are one search: requests (an anchor, a band) against candidates.

Anchors and candidates of a cell are trees of balls. For a pair of nodes, centres and radii give an interval
that holds every inner product between their rows. The pair is dropped with all of its anchors at once if the
interval meets no request's band above the worst score that this request would still take, or if labels
forbid it; else the wider node is split, higher intervals first. Pairs of small nodes are scored exactly by one
product of matrices, of which only scores in a request's band and above its worst are looked at, with ties kept until
ids decide.

Anchors and rows meet in cells (block x shard, for the positives within a label), so no task holds more than
one shard and one block, a label of any size is dealt over many, and every cell gives its best for each request.

Defined results: rows take no part whose id, label or vector is null or whose vector is empty or holds null or
non-finite components; only vectors of one length meet; ties go to the smaller id; an anchor does not meet rows
of its own id; repeated rows of one id are candidates each, of several anchor rows of one id the least (label,
vector) asks; fewer rows than asked for give all; a positive whose band is empty (its score is below zero)
gives no row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written
from spanloom.llm.topk import integer_vectors

#: Rows of a shard and anchors of a block, on average.
SHARD_ROWS = 8_192
BLOCK_ROWS = 8_192
#: Parts of a group in which its rows learn how many shards and blocks there are.
SPREAD = 64
#: Rows of a leaf.
LEAF_ROWS = 48
#: Rows of a node that is not split: a pair of such nodes is scored by one product.
BLOCK = 512
#: Scored rows that a cell holds before it lets go of those that are surely not among the best.
HELD = 200_000


@dataclass
class Tree:
    """Balls over the rows of ``vectors``: node i has rows order[low[i]:high[i]] and children kids[i], or -1."""

    order: np.ndarray
    low: list[int]
    high: list[int]
    kids: list[tuple[int, int] | None]
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    label: list[int | None]

    @classmethod
    def over(cls, vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        x = vectors.astype(np.float64)
        order = np.arange(len(x))
        low, high, kids, centres, radii, common = [0], [len(x)], [], [], [], []
        for node in iter(range(2 * len(x) + 1)):
            if node == len(low):
                break
            rows = order[low[node] : high[node]]
            centre = x[rows].mean(axis=0)
            away = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            common.append(int(labels[rows[0]]) if (labels[rows] == labels[rows[0]]).all() else None)
            if len(rows) <= leaf:
                kids.append(None)
                continue
            one = x[rows[away.argmax()]]
            other = x[rows[((x[rows] - one) ** 2).sum(axis=1).argmax()]]
            order[low[node] : high[node]] = rows[np.argsort(x[rows] @ (other - one), kind="stable")]
            middle = (low[node] + high[node]) // 2
            kids.append((len(low), len(low) + 1))
            low += [low[node], middle]
            high += [middle, high[node]]
        centre = np.stack(centres)
        return cls(order, low, high, kids, centre, np.sqrt((centre**2).sum(axis=1)), np.array(radii), common)


class Best:
    """The best scores of each request so far, and the rows that may have them."""

    def __init__(self, requests: int, k: int):
        self.k = k
        self.scores = np.full((requests, k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.kept = 0

    def least(self) -> np.ndarray:
        """What a score must reach at least."""
        return self.scores[:, 0]

    def add(self, first: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores (requests from ``first`` on x candidates) of which those count that ``fits`` marks."""
        request, place = np.nonzero(fits)
        self.take(request + first, scores[request, place], ids[place])

    def take(self, request: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates, each for its request; what the requests hold grows no wider than k."""
        if not len(request):
            return
        order = np.lexsort((-score, request))
        of, high = request[order], score[order]
        fresh = np.concatenate([[True], of[1:] != of[:-1]])
        number = np.cumsum(fresh) - 1
        rank = np.arange(len(of)) - np.flatnonzero(fresh)[number]
        few = rank < self.k
        among = of[fresh]
        new = np.full((len(among), self.k), -np.inf)
        new[number[few], rank[few]] = high[few]
        self.scores[among] = np.sort(np.concatenate([self.scores[among], new], axis=1), axis=1)[:, self.k :]
        enough = score >= self.scores[request, 0]
        self.held.append((request[enough], score[enough], ids[enough]))
        self.rows += int(enough.sum())
        if self.rows > max(HELD, 2 * self.kept):  # requests may keep more than HELD rows: these are not sorted at each step
            self.held = [self.ranked()]
            self.rows = self.kept = len(self.held[0][0])

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Requests, scores and ids: at most k for each request, best first, ties by id."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        request, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, request))
        request, score, ids = request[order], score[order], ids[order]
        fresh = np.concatenate([[True], request[1:] != request[:-1]])
        rank = np.arange(len(request)) - np.maximum.accumulate(np.where(fresh, np.arange(len(request)), 0))
        keep = rank < self.k
        return request[keep], score[keep], ids[keep]


@dataclass
class Side:
    """Rows of a cell in their tree's order."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: Tree

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Side:
        tree = Tree.over(vectors, labels)
        return cls(ids[tree.order], labels[tree.order], vectors[tree.order], tree)


def exact(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats of 32 or 64 bits, in which sums of products stay exact up to 2^24 or 2^53; beyond that they are refused."""
    a, c = anchors.astype(np.float64), rows.astype(np.float64)
    most = np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * c.shape[1]
    if most >= 2.0**52:
        raise ValueError("components are too large for exact inner products in doubles")
    return (a.astype(np.float32), c.astype(np.float32)) if most < 2.0**23 else (a, c)


def dual_search(anchors: Side, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, rows: Side, k: int, same: bool) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The k best candidates of each request, as ``Best.ranked`` has them, and how many pairs of nodes were scored.

    Anchor i has the requests offsets[i] to offsets[i + 1], with bands from ``low`` to ``high``. ``same`` asks
    for candidates of the anchor's label, else for those of other labels.
    """
    a, c = exact(anchors.vectors, rows.vectors)
    one, two, best, scored = anchors.tree, rows.tree, Best(len(low), k), 0

    def interval(i: int, j: int) -> tuple[float, float]:
        middle = float(one.centre[i] @ two.centre[j])
        wide = one.norm[i] * two.radius[j] + two.norm[j] * one.radius[i] + one.radius[i] * two.radius[j]
        slack = 1 + 1e-9 * (one.norm[i] + one.radius[i]) * (two.norm[j] + two.radius[j])
        return middle - wide - slack, middle + wide + slack

    def alive(i: int, least: float, most: float) -> bool:
        first, stop = offsets[one.low[i]], offsets[one.high[i]]
        floor = np.maximum(low[first:stop], best.least()[first:stop])
        return bool(((floor <= most) & (high[first:stop] >= least)).any())

    stack = [(0, 0, *interval(0, 0))]
    while stack:
        i, j, least, most = stack.pop()
        known = one.label[i] is not None and two.label[j] is not None
        if known and (one.label[i] == two.label[j]) != same or not alive(i, least, most):
            continue
        done_i, done_j = (side.high[n] - side.low[n] <= BLOCK or side.kids[n] is None for side, n in ((one, i), (two, j)))
        if done_i and done_j:
            rows_i, rows_j = slice(one.low[i], one.high[i]), slice(two.low[j], two.high[j])
            first, stop = offsets[one.low[i]], offsets[one.high[i]]
            counts = np.diff(offsets[one.low[i] : one.high[i] + 1])
            asks = np.flatnonzero(counts)
            starts = (offsets[one.low[i] : one.high[i]] - first)[asks]
            floor = np.maximum(low[first:stop], best.least()[first:stop])
            scores = a[rows_i] @ c[rows_j].T if len(asks) == len(counts) else a[rows_i][asks] @ c[rows_j].T
            # what lies in the widest band of an anchor's requests; few scores do once the best are known
            wide = (scores >= np.minimum.reduceat(floor, starts)[:, None]) & (scores <= np.maximum.reduceat(high[first:stop], starts)[:, None])
            which, place = np.nonzero(wide)
            anchor = asks[which] + one.low[i]
            fits = ((anchors.labels[anchor] == rows.labels[rows_j][place]) == same) & (anchors.ids[anchor] != rows.ids[rows_j][place])
            which, place, value = which[fits], place[fits], scores[which[fits], place[fits]].astype(np.float64)
            each = counts[asks][which]
            request = np.repeat(starts[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            place, value = np.repeat(place, each), np.repeat(value, each)
            fits = (value >= floor[request]) & (value <= high[first:stop][request])
            best.take(request[fits] + first, value[fits], rows.ids[rows_j][place[fits]])
            scored += 1
            continue
        split = done_j or (not done_i and one.radius[i] > two.radius[j])
        pairs = [(child, j) for child in one.kids[i]] if split else [(i, child) for child in two.kids[j]]
        stack += sorted(((p, q, *interval(p, q)) for p, q in pairs), key=lambda t: t[3])  # the highest is next
    return best.ranked(), scored


def labelled_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, terms (floor(scale * x) of every component) of the rows that take part."""
    given = df.select(F.struct(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")).alias("row"), F.col(vector).alias("vector"))
    kept = given.where("row.vec_id is not null and row.label is not null").select("row.*", "vector")
    return integer_vectors(kept, "vec_id", "vector", scale, carry=["label"])


FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("terms").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _cell(k: int, same: bool):
    def cell(candidates: pa.Table, block: pa.Table) -> pa.Table:
        if not candidates.num_rows or not block.num_rows:
            return FOUND.empty_table()
        rows = Side.of(candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy(), _matrix(candidates))
        anchors = Side.of(block.column("vec_id").to_numpy(), block.column("label").to_numpy(), _matrix(block))
        bands = block.column("bands").combine_chunks()
        counts = np.diff(bands.offsets.to_numpy())
        order = anchors.tree.order
        starts = (np.cumsum(counts) - counts)[order]
        offsets = np.concatenate([[0], np.cumsum(counts[order])])
        place = np.repeat(starts - offsets[:-1], counts[order]) + np.arange(offsets[-1])  # requests in the tree's order
        low, high, which = (bands.flatten().field(n).to_numpy(zero_copy_only=False)[place] for n in ("low", "high", "place"))
        (request, score, ids), _ = dual_search(anchors, offsets, low.astype(np.float64), high.astype(np.float64), rows, k, same)
        of = np.repeat(anchors.ids, np.diff(offsets))
        return pa.table([of[request], which[request], ids, score.astype(np.int64)], schema=FOUND)

    return cell


def _numbers(upto: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), upto - 1))


def search(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, place, rank, vec_id, score: the k best rows of each band of each anchor.

    ``rows`` has vec_id, label, terms; ``anchors`` also bands, an array of place, low and high (all long).
    With ``same`` only rows of the anchor's label count, and only they meet; else only rows of other labels.
    """
    groups = ["length", "label"] if same else ["length"]
    place = F.xxhash64("vec_id")
    sized = lambda df, most, name: df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias(name))
    left, right = (df.withColumn("length", F.size("terms")) for df in (rows, anchors))
    sizes = sized(left, SHARD_ROWS, "shards").join(sized(right, BLOCK_ROWS, "blocks"), groups)
    spread = F.pmod(F.xxhash64("vec_id", F.lit("spread")), F.lit(SPREAD)).alias("spread")  # else a group's rows meet its sizes in one task
    sizes = sizes.withColumn("spread", _numbers(F.lit(SPREAD).cast("long")))
    left, right = (df.withColumn("spread", spread) for df in (left, right))
    left = left.join(sizes, [*groups, "spread"]).withColumns({"shard": F.pmod(place, "shards"), "block": _numbers(F.col("blocks"))})
    right = right.join(sizes, [*groups, "spread"]).withColumns({"shard": _numbers(F.col("shards")), "block": F.pmod(place, "blocks")})
    keys = [*groups, "shard", "block"]
    own = lambda df, *names: df.select(*(F.col(n).alias(n) for n in names))  # noqa: E731  both sides may come of one table
    left = own(left, "vec_id", "terms", "length", "label", "shard", "block")
    right = own(right, "vec_id", "terms", "length", "label", "shard", "block", "bands")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell(k, same), "anchor_id long, place long, vec_id long, score long")
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("anchor_id", "place", "rank", "vec_id", "score")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both sides have vec_id, label and terms, as ``labelled_vectors`` gives them. Negatives of a positive with
    score p have scores s with low * p <= 100 * s <= high * p, the best ``negatives`` of them, rank from 1 on.
    """
    everything = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(-(2**53)).cast("long").alias("low"), F.lit(2**53).cast("long").alias("high")))
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "terms")).alias("row")).select("vec_id", "row.*")
    near = search(rows, asked.withColumn("bands", everything), positives, same=True)
    floor = lambda x: f"({x} - pmod({x}, 100)) div 100"  # noqa: E731  of a hundredth, in whole numbers
    band = near.withColumns({"low": -F.expr(floor(f"(score * {-low}L)")), "high": F.expr(floor(f"(score * {high}L)"))})
    chosen = band.select("anchor_id", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "low", "high")
    chosen = written(chosen.where("low <= high"), "positives")
    bands = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("place", "low", "high")).alias("bands"))  # ``positives`` at most
    far = search(rows, asked.join(bands, "vec_id"), negatives, same=False)
    return far.join(chosen, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
