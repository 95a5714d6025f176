"""Near-duplicates by the Jaccard similarity of five-word shingles, 0.8 at least, exact.

Shingles are hashed and every text's distinct hashes are put in order, frequent ones last. Two texts of
similarity 0.8 or more share one of the first ``size - ceil(0.8 size) + 1`` hashes of both, so those are
the index; sizes and places at the shared hash rule out most other pairs, and what is left is verified
on whole sets. Any order common to all texts is exact. This one goes by counts of all shingles in 2^20
classes of hashes, so passages that many texts share are in the index of those texts alone that have
little else; the table of counts has one size whatever the corpus is.

Pairs in the square of a family's size are not verified: first each text is compared with a few others,
those it shares the most prefix hashes with among the first, last and two drawn texts of its hashes. Then
all pairs that are in different components still are compared, met at few of the hashes that they share:
first a sixteenth of them, which joins most of what is to be joined, then all that are apart even so. So no bucket is capped and no link between
components is lost; only texts that share a hash and are yet unlike cost pairs in the square. Most of
these go by a sketch, the parity of hashes per bit: it differs in no more bits than the sets in members.

A hash of 64 bits stands for a shingle and for a whole text; texts are cut into words as in
``simhash``. A text of fewer than five words is one shingle, a text without words is in op6's class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.common import chunks, discard, merged, written

WIDTH = 5
#: Two sets are linked if 9 x overlap >= 4 x (sum of sizes), which is a similarity of 4/5.
OVERLAP, SIZES = 9, 4
#: Bits of the sketch that all texts get, and of the finer one of texts whose whole sets are compared.
SKETCH, FINE = 1024, 16384
#: Others that a text is compared with at first. More save later pairs; the result is the same.
HUBS = 8
#: The part of the remaining pairs that is compared before the rest is: one in so many.
SHARE = 16
#: Earlier hashes that each posting knows: texts that share one of them have met there.
EARLIER = 4
#: Classes of hashes by which shingles are counted.
CLASSES = 1 << 20


def text_id(text: Column) -> Column:
    """64 bits, which keep the many joins on it small. ``shared_ids`` tells where two texts have one."""
    return F.xxhash64(text)


def second_id(text: Column) -> Column:
    """128 bits of SHA-256: no two texts have them in common, by chance or by design."""
    return F.coalesce(F.substring(F.sha2(text.cast("binary"), 256), 1, 32), F.lit("null"))


def shared_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """text_id, main: the ids that several texts of ``df`` have, and the ``second_id`` of the one that keeps it."""
    ids = df.select(text_id(F.col(text)).alias("text_id"), second_id(F.col(text)).alias("second"))
    return ids.groupBy("text_id").agg(F.min("second").alias("main"), F.max("second").alias("other")).where("main <> other").select("text_id", "main")


def distinct_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.unique(simhash.shingle_hashes(words, WIDTH)) if words else np.empty(0, np.uint64)


def _given(df: DataFrame, text: str) -> DataFrame:
    return df.select(text_id(F.col(text)).alias("text_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("text"))


def sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits, bit b set if an odd number of the hashes fall to it."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """One row for each row of ``df``: doc_id, text_id, bits (op6's fingerprint), size and sketch of the set."""
    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("doc_id"), text_id(F.col(text)).alias("text_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                bits = pa.array(np.array([simhash.fingerprint(t.lower().split(), width) for t in texts], np.uint64).view(np.int64))
                found = [distinct_hashes(t) for t in texts]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(np.concatenate([sketch(x, SKETCH) for x in found])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), bits, pa.array([len(x) for x in found], pa.int32()), rows], ["doc_id", "text_id", "bits", "size", "sketch"])

    return given.mapInArrow(run, f"doc_id {kind}, text_id long, bits long, size int, sketch array<long>")


def _class(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.int64)


def frequencies(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many shingles of all rows fall to each class of hashes. CLASSES rows come to the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                counts += np.bincount(np.concatenate([_class(distinct_hashes(t)) for t in part.column("text").to_pylist()]), minlength=CLASSES)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["class", "n"])

    counted = _given(df, text).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES, np.float32)
    out[counted.column("class").to_numpy()] = counted.column("n").to_numpy()
    return out


def postings(df: DataFrame, text: str = "text") -> DataFrame:
    """h, text_id, at, size: the hashes of each text's prefix with their places from 0.

    A text that a task meets again gives no second postings; other tasks may give the same.
    """
    shipped = df.sparkSession.sparkContext.broadcast(frequencies(df, text))  # four bytes for each of CLASSES

    def ordered(hashes: np.ndarray) -> np.ndarray:
        return hashes[np.argsort(shipped.value[_class(hashes)], kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                first = [i for i, t in enumerate(part.column("text_id").to_pylist()) if t not in met and not met.add(t)]
                part = part.take(pa.array(first, pa.int64()))
                found = [ordered(distinct_hashes(t)) for t in part.column("text").to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                most = np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)
                of = np.repeat(np.arange(len(found)), most)
                h = np.concatenate([np.empty(0, np.uint64), *(x[:n] for x, n in zip(found, most.tolist(), strict=True))])
                at = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most)
                ids = part.column("text_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[of]), pa.array(at.astype(np.int32)), pa.array(sizes[of].astype(np.int32))], ["h", "text_id", "at", "size"])

    return _given(df, text).mapInArrow(run, "h long, text_id long, at int, size int")


def sets(df: DataFrame, text: str = "text") -> DataFrame:
    """text_id, size, sketch (the finer one), hashes: the distinct hashes of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [distinct_hashes(t) for t in part.column("text").to_pylist()]
                sizes = [len(x) for x in found]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
                fine = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (FINE // 64)), pa.array(np.concatenate([sketch(x, FINE) for x in found])))
                yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array(sizes, pa.int32()), fine, lists], ["text_id", "size", "sketch", "hashes"])

    return _given(df, text).mapInArrow(run, "text_id long, size int, sketch array<long>, hashes array<long>")


def _near(a: str, b: str) -> Column:
    """Sketches differ in no more bits than two sets of these sizes may differ in members."""
    differ = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    return differ * OVERLAP <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (OVERLAP - 2 * SIZES)


def _possible(x: str, y: str) -> Column:
    """Sizes and places of the shared hash leave room for the overlap that is needed."""
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at"))
    return (F.col(f"{x}.text_id") != F.col(f"{y}.text_id")) & (left * OVERLAP >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * SIZES)


def _named(pairs: DataFrame) -> DataFrame:
    x, y = F.col("x.text_id"), F.col("y.text_id")
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def verified(pairs: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """Those of ``pairs`` (a, b: text_id) that are similar enough."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct(), "wanted")
    have = df.select(text).withColumn("text_id", text_id(F.col(text))).join(wanted, "text_id", "left_semi").groupBy("text_id").agg(F.first(text).alias(text))
    known = written(sets(have, text), "sets")

    def with_ends(pairs: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(merged(known.select(F.col("text_id").alias(end), F.struct(*columns).alias(f"of_{end}"))), end)
        return pairs

    close = written(with_ends(pairs, "size", "sketch").where(_near("of_a", "of_b")).select("a", "b"), "close")
    overlap = F.size(F.array_intersect("of_a.hashes", "of_b.hashes"))
    same = written(with_ends(close, "size", "hashes").where(overlap * OVERLAP >= (F.col("of_a.size") + F.col("of_b.size")) * SIZES).select("a", "b"), "similar")
    for table in (wanted, known, close):
        discard(table)
    return same


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``df``: doc_id, text_id, root (the class) and component_id (its smallest doc_id).

    Classes are the components of op6's links of ``width``-word fingerprints and of the Jaccard links.
    """
    full = written(sketches(df, key, text, width), "sketches")
    docs = full.select("doc_id", "text_id", "bits")
    texts = written(full.groupBy("text_id").agg(F.min(F.struct("bits", "size", "sketch")).alias("s")).select("text_id", "s.*"), "texts")
    edges = simhash.links(docs.select("bits").distinct())

    def between(pairs: DataFrame) -> DataFrame:
        """Verified pairs as links of fingerprints; texts of one fingerprint are together anyway."""
        for end in ("a", "b"):
            pairs = pairs.join(merged(texts.select(F.col("text_id").alias(end), F.struct("bits", "size", "sketch").alias(f"of_{end}"))), end)
        near = (F.col("of_a.bits") != F.col("of_b.bits")) & _near("of_a", "of_b")
        close = written(pairs.where(near).select("a", "b", F.col("of_a.bits").alias("p"), F.col("of_b.bits").alias("q")), "pairs")
        same = verified(close.select("a", "b"), df, text)
        return written(close.join(merged(same), ["a", "b"]).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "jaccard-links")

    index = written(postings(df, text), "postings")
    shared = index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    before = F.collect_list("h").over(Window.partitionBy("text_id").orderBy("at").rowsBetween(-EARLIER, -1)).alias("before")
    met = index.join(merged(shared), "h", "left_semi").distinct().select("h", "text_id", "at", "size", before)
    met = written(met.select("h", F.struct("text_id", "at", "size", "before").alias("x")), "prefixes")
    discard(index)

    def apart(roots: DataFrame | None) -> DataFrame:
        """h, x, root of the hashes that texts of several classes share. At first each text is one."""
        if roots is None:
            rooted = met.select("h", "x", F.col("x.text_id").alias("root"))
        else:
            placed = texts.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("text_id", F.coalesce("root", "bits").alias("root"))
            rooted = met.select("h", "x", F.col("x.text_id").alias("text_id")).join(placed, "text_id", "left").select("h", "x", "root")
        mixed = rooted.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("h")
        return written(rooted.join(merged(mixed), "h", "left_semi"), "apart")

    def hubs(rooted: DataFrame) -> DataFrame:
        """Each text with a few of other classes: those it meets most often as the first or last class of a
        hash, or as one drawn for the hash."""
        here, drawn = F.struct("root", "x"), F.struct(F.xxhash64("h", "x.text_id"), "root", "x")
        ends = rooted.groupBy("h").agg(F.min(here).alias("low"), F.max(here).alias("high"), F.min(drawn).alias("one"), F.max(drawn).alias("two"))
        few = F.explode(F.array("low", "high", *(F.struct(f"{name}.root", f"{name}.x") for name in ("one", "two")))).alias("hub")
        met = rooted.join(merged(ends), "h").select("root", "x", few).select("root", "x", F.col("hub.root").alias("other"), F.col("hub.x").alias("y")).where((F.col("root") != F.col("other")) & _possible("x", "y"))
        most = met.groupBy(F.col("x.text_id").alias("x"), F.col("y.text_id").alias("y")).count().groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "y")), asc=False), 1, HUBS).alias("y")).select("x", F.explode("y").alias("y"))
        return most.select(F.least("x", "y.y").alias("a"), F.greatest("x", "y.y").alias("b")).distinct()

    edges = edges.union(between(hubs(apart(None))))
    roots = simhash.components(edges)
    first = ~F.arrays_overlap("x.before", "y.before")  # else an earlier hash makes the pair
    for share in (SHARE, 1):
        rest = apart(roots)
        other = rest.select("h", F.col("x").alias("y"), F.col("root").alias("other"))
        drawn = F.pmod(F.xxhash64("x.text_id", "y.text_id"), F.lit(share)) == 0
        found = between(_named(rest.join(merged(other), "h").where((F.col("root") < F.col("other")) & drawn & first & _possible("x", "y"))).distinct())
        if not found.isEmpty():
            edges = edges.union(found)
            roots = simhash.components(edges)

    placed = docs.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("doc_id", "text_id", F.coalesce("root", "bits").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root").select("doc_id", "text_id", "root", "component_id")
