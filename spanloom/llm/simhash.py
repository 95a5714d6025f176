"""SimHash near-duplicates at a distance of at most two bits, by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Fingerprints two bits apart agree on one segment but
for one bit at most, so they share one of its 32 one-wildcard variants. Variants are the index:
fingerprints that share one are candidates by an equality join and are verified on all 64 bits.

Only distinct fingerprints are compared; documents of one fingerprint are one class from the start.
A variant that many fingerprints share (families of near copies) would give pairs in the square of
its size. Its members are linked through balls of radius one instead: two fingerprints are at most
two bits apart exactly if some 64-bit value is at most one bit from both. Each member names its 65
such values, 65 members at most meet at a value, all of them linked, and a star joins them. So no
link is lost, no bucket is capped, and work stays in proportion to the fingerprints.

Components come from minimum labels over the links with pointer jumping, a table per round.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated
rows give repeated rows; rows whose key is null are left out of the choice of the smallest key but
get their class's component; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks, discard, merged, written

#: Members of a variant up to which its pairs are formed by the join.
PAIRS_UP_TO = 16
#: Bits by which linked fingerprints differ at most. Two segments suffice up to three.
DISTANCE = 2
SEGMENT = 32


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of one word or more; fewer words than that are one shingle."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    shingles = [text[s:e] for s, e in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def fingerprint(words: list[bytes], width: int) -> int:
    """SimHash of the ``width``-word shingles: bit b is set if over half their hashes have it."""
    return majority(shingle_hashes(words, width)) if words else 0


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded however long the text is
        counts += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: Column | str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``df``: doc_id, bits (the fingerprint as a signed long).

    Texts are cut into words at ASCII white space after A-Z become lower case.
    """
    source = F.col(text) if isinstance(text, str) else text
    given = df.select(F.col(key).alias("doc_id"), F.coalesce(source.cast("binary"), F.lit(b"").cast("binary")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [fingerprint(t.lower().split(), width) for t in part.column("text").to_pylist()]
                bits = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), bits], ["doc_id", "bits"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, bits long")


def variants(prints: DataFrame) -> DataFrame:
    """bits and each of its 64 one-wildcard segment variants, packed with place and segment."""
    place = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("place")
    segment = F.expr(f"shiftrightunsigned(bits, cast(place div {SEGMENT} as int) * {SEGMENT}) & 4294967295L")
    rest = F.expr(f"segment & ~shiftleft(1L, cast(place % {SEGMENT} as int))")
    return prints.select("bits", place).withColumn("segment", segment).select("bits", F.expr("place").alias("place"), rest.alias("rest")).select("bits", F.expr("shiftleft(cast(place as long), 32) | rest").alias("variant"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join what is at most two bits apart: distinct ``bits`` in, written.

    Pairs of small variants are all there; members of larger ones are joined by stars.
    """
    index = variants(prints)
    shared = index.groupBy("variant").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = written(index.join(merged(shared), "variant"), "variants")
    small = met.where(F.col("members") <= PAIRS_UP_TO)
    pairs = (
        small.select("variant", F.col("bits").alias("a"))
        .join(merged(small.select("variant", F.col("bits").alias("b"))), "variant")
        .where(f"a < b and bit_count(a ^ b) <= {DISTANCE}")
        .select("a", "b")
    )
    large = met.where(F.col("members") > PAIRS_UP_TO).select("bits").distinct()
    centre = F.explode(F.concat(F.array(F.col("bits")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("centre")
    stars = (
        large.select("bits", centre)
        .groupBy("centre")
        .agg(F.collect_set("bits").alias("ball"))  # 65 at most: distinct values at most one bit from the centre
        .where("size(ball) > 1")
        .select(F.array_min("ball").alias("a"), F.explode("ball").alias("b"))
        .where("a < b")
    )
    found = written(pairs.union(stars).distinct(), "links")
    discard(met)
    return found


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of the links (a, b).

    Each round takes the least label among neighbours and then the label of that label.
    """
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"), F.lit(True).alias("moved")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        near = written(near, "near")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        last, labels = labels, written(near.join(jump, "root").select("node", F.least("root", "beyond").alias("root"), (F.col("was") != F.least("root", "beyond")).alias("moved")), "labels")
        discard(near)
        discard(last)
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("node", "root")
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: Column | str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``df``: doc_id, bits, component_id (smallest doc_id of the class)."""
    docs = written(fingerprints(df, key, text, width), "fingerprints")
    classes = written(docs.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("bits")))
    placed = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("bits", "component_id")
    return docs.join(named, "bits", "left").select("doc_id", "bits", "component_id")
