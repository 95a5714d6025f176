"""Exact top-k inner products by MaxScore over sharded postings.

The dimensions of a vector are its terms. A shard keeps one posting list per dimension, in the order
of vec_id, with the list's least and greatest component. A query gives each posting an impact: weight
times component, less the least value this has in the list, so that impacts are never negative and a
list's score bound is its greatest impact. Terms are taken by falling bounds. The non-essential ones
are the longest tail whose bounds together stay below the k-th best score so far: a vector without
impact on the essential terms cannot be among the best. Essential postings are traversed; the tail is
probed only for vectors that are still competitive, while the threshold rises. Every shard gives its
k best for each query, and the shards' lists are merged.

Vectors and queries meet in cells (query block x shard), so no task holds more than one shard and
one block, and neither side is broadcast or collected.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor
does a null vec_id; only vectors of one length meet; ties go to the smaller vec_id; repeated rows of
one vec_id are candidates each, and of several query rows with one vec_id the smallest vector asks;
fewer candidates than k give all; components are held as 64-bit integers; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS = 8_192
BLOCK_ROWS = 8_192
#: Vectors scored fully to set out with a threshold, and terms probed at a time.
SEED_ROWS = 256
PROBE_TERMS = 8


class Shard:
    """Postings of one shard: a row for each dimension, columns by rising vec_id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        # sums of products stay exact in doubles up to 2^53; beyond that Python's integers take over
        self.kind = np.float64 if largest * reach * vectors.shape[1] < 2.0**51 else object
        self.postings = np.ascontiguousarray(vectors[order].T.astype(self.kind))
        self.low = self.postings.min(axis=1)
        self.high = self.postings.max(axis=1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best candidates, ties to the smaller vec_id."""
        weights = query.astype(self.kind)
        ends = np.stack([weights * self.low, weights * self.high])
        floor, bound = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        base = floor.sum()
        order = np.argsort(-bound.astype(np.float64), kind="stable")
        tail = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from a place on can add
        alive = np.flatnonzero(self.ids != own)
        if not len(alive):
            return alive, alive
        seed = alive[:SEED_ROWS]
        least = np.sort(weights @ self.postings[:, seed])[-k] - base if len(seed) >= k else 0
        split = int(np.argmax(tail < least)) if least > 0 else len(order)
        terms = order[:split]
        scores = (weights[terms] @ self.postings[terms] - floor[terms].sum())[alive]
        while split < len(order):
            if len(scores) > k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
            keep = scores + tail[split] >= least
            alive, scores, terms = alive[keep], scores[keep], order[split : split + PROBE_TERMS]
            scores = scores + (weights[terms] @ self.postings[np.ix_(terms, alive)] - floor[terms].sum())
            split += len(terms)
        if len(scores) > k:  # ties of the k-th score stay until vec_id decides
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[keep], scores[keep]
        first = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[first]], (scores[first] + base).astype(np.int64)


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: Column | str = "embedding", scale: int = 256, carry: list[str] | None = None) -> DataFrame:
    """vec_id, ``carry``'s columns, terms: floor(scale * x) of every component, for the vectors that take part."""
    carry = carry or []
    source = F.col(vector) if isinstance(vector, str) else vector
    given = df.select(F.col(key).cast("long").alias("vec_id"), *carry, source.cast("array<double>").alias("terms"))
    sound = F.forall("terms", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return given.where(F.col("vec_id").isNotNull() & (F.size("terms") > 0) & sound).select("vec_id", *carry, F.transform("terms", lambda x: F.floor(x * scale)).alias("terms"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    terms = rows.column("terms").combine_chunks()
    return rows.column("vec_id").to_numpy(), terms.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query's integer vector.

    Both sides have vec_id and terms, as ``integer_vectors`` gives them; a query does not find itself.
    """
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    asked = queries.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    place = F.xxhash64("vec_id")
    left = vectors.select("vec_id", "terms", F.size("terms").alias("length"), F.pmod(place, F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = asked.select("vec_id", "terms", F.size("terms").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(place, F.lit(blocks).cast("long")).alias("block"))

    def cell(candidates: pa.Table, block: pa.Table) -> pa.Table:
        if not candidates.num_rows or not block.num_rows:
            return out.empty_table()
        asking, weights = _matrix(block)
        shard = Shard(*_matrix(candidates), float(np.abs(weights.astype(np.float64)).max()))
        found = [shard.best(w, q, k) for q, w in zip(asking.tolist(), weights, strict=True)]
        return pa.table([np.repeat(asking, [len(i) for i, _ in found]), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])], schema=out)

    keys = ("length", "shard", "block")
    merged = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
