"""Removal of every byte that a long enough repeated string covers, by a family of suffix arrays.

**Anchors.** A string of ``least`` bytes is kept by the suffix that begins at its anchor: the first place in it
where the hash of the next 64 bytes is smallest. Equal strings have their anchors at equal offsets, so two equal
strings meet as two suffixes that agree on 64 bytes, and about one suffix in 170 bytes is enough.

**Levels.** Texts come in batches. A batch's suffix array holds its anchored suffixes up to 64 bytes: their
first eight bytes, in the order of which it is sorted, then a hash of all 64, and how often they occur. It is
scanned against itself and merged with each existing level, by equality joins of sorted sides, for prefixes that
both have. Then it becomes a level of size one, and as long as two levels have one size, they merge into one of
twice the size. n batches make log n levels at most and a suffix is merged log n times.

**Strings.** Suffixes whose prefix occurs elsewhere are compared around it. The strings of an anchor are dealt
into blocks of 32 neighbouring offsets. What all strings of a block share is its core, what they cover is its
whole. A block with a core that no other has holds no repeated string, one whose whole occurs twice holds
nothing else; of the others, which lie at an end of a match, one for each whole goes on, string by string.
All of that is counting by 128-bit hashes: no group of copies is ever held by a task, no pairs are formed.

Texts are compared once however often they occur, by half of their SHA-256, and what a text repeats in itself around
one anchor is found on the spot. Tables of texts are bucketed by text, so they are shuffled once.

Defined results: a null or empty text has no bytes; texts shorter than ``least`` lose nothing; a text of
``least`` bytes or more that occurs in two rows loses everything; rows are occurrences, so repeated rows with
one key do too; null keys stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import chunks, discard, release, scratch, written

#: Bytes by which suffixes are told apart first.
PREFIX = 64
#: Offsets of a block.
BLOCK = 32
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
#: Batches that a corpus comes in, where the caller has none.
BATCHES = 4

_TABLE = np.random.default_rng(13).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on."""
    hashes, power, size = _TABLE[body], _BASE, 1
    while size < PREFIX:
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        power, size = power * power % 2**64, 2 * size
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _anchors_of_piece(body: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = prefix_hashes(body)
    width = least - PREFIX + 1
    n = len(hashes) - width + 1
    padded = np.concatenate([hashes, np.full(-len(hashes) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[width - 1 : width - 1 + n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    smallest = np.minimum(ahead, behind)
    turns = np.flatnonzero(smallest[1:] != smallest[:-1]) + 1
    found = []
    for first, stop in zip([0, *turns.tolist()], [*turns.tolist(), n], strict=True):
        places = np.flatnonzero(hashes[first : stop + width - 1] == smallest[first]) + first
        last = np.minimum(places, stop - 1)  # the last string whose first smallest place this is
        begin = np.concatenate([[first], last[:-1] + 1])
        fine = begin <= last
        found.append(np.stack([places[fine], begin[fine], last[fine]]))
    places, begin, last = np.concatenate(found, axis=1)
    return places, begin, last, hashes[places]


def anchors(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, first and last start of the strings it keeps, prefix hash of each anchor, by first start.

    Long texts are cut into pieces that overlap, so memory follows the piece; an anchor at a cut may come in
    two parts, which is no harm.
    """
    body = np.frombuffer(text, np.uint8)
    parts = []
    for at in range(0, max(0, len(body) - least + 1), PIECE):
        place, first, last, keys = _anchors_of_piece(body[at : at + PIECE + least - 1], least)
        parts.append((place + at, first + at, last + at, keys))
    if not parts:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))  # type: ignore[return-value]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last] of neighbouring numbers as few ranges."""
    found: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if found and first <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


def index_entries(text: bytes, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int]]]:
    """Starts of strings that this text alone shows to be repeated, as ranges, and the anchors that remain:
    head (the first eight bytes, signed so that its order is theirs), key, place, first and last start.

    Of anchors with the same surroundings in one text the first remains, all are repeated.
    """
    place, first, last, keys = anchors(text, least)
    order = np.argsort(keys, kind="stable")
    shared = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][shared]] = twice[order[:-1][shared]] = True
    seen: dict[tuple, list] = {}
    repeated, entries = [], []
    for p, a, z, k, t in zip(place.tolist(), first.tolist(), last.tolist(), keys.astype(np.int64).tolist(), twice.tolist(), strict=True):
        if t:
            known = seen.setdefault((p - a, p - z, text[a : z + least]), [(a, z)])
            if known[-1] != (a, z):
                if len(known) == 1:
                    repeated += known
                    known.append(())
                known[-1] = (a, z)
                repeated.append((a, z))
                continue
        entries.append((int.from_bytes(text[p : p + 8].ljust(8, b"\0"), "big") - 2**63, k, p, a, z))
    return joined(repeated), entries


ENTRY = pa.struct([("head", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
RANGE = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """A list of structs for each of ``rows``."""
    fields = [kind.field(i) for i in range(kind.num_fields)]
    flat = [r for row in rows for r in row]
    columns = zip(*flat, strict=True) if flat else ([] for _ in fields)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


def _ranges(column: pa.Array, i: int) -> list[tuple[int, int]]:
    value = column[i].values
    return [] if value is None else list(zip(value.field("first").to_pylist(), value.field("last").to_pylist(), strict=True))


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """A table in the shared folder whose files are the hash partitions of ``df`` by ``by``: joins on it move
    the other side alone."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, own = scratch(spark, name), f"spanloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).sortBy(by).option("path", path).format("parquet").saveAsTable(own)
    return spark.table(own)


def to_buckets(df: DataFrame, by: str) -> DataFrame:
    """The other side of a join with a ``bucketed`` table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def texts_with_entries(docs: DataFrame, least: int) -> DataFrame:
    """tid, copies, n_bytes, text, repeated, entries of each distinct text of ``docs`` (tid, text), bucketed by tid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                bodies = part.column("text").to_pylist()
                found = [index_entries(b, least) for b in bodies]
                columns = [part.column("tid"), part.column("copies"), pa.array(map(len, bodies), pa.int64()), part.column("text"), _structs([r for r, _ in found], RANGE), _structs([e for _, e in found], ENTRY)]
                yield pa.RecordBatch.from_arrays(columns, ["tid", "copies", "n_bytes", "text", "repeated", "entries"])
            release()

    distinct = docs.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    span = "struct<first: int, last: int>"
    schema = f"tid binary, copies long, n_bytes long, text binary, repeated array<{span}>, entries array<struct<head: bigint, key: bigint, place: int, first: int, last: int>>"
    return bucketed(distinct.mapInArrow(run, schema), "texts", "tid")


SUFFIX = ["head", "key"]


@dataclass
class Levels:
    """Suffix arrays of sizes one, two, four and so on: tables of head, key, n, each partition sorted."""

    levels: list[tuple[int, DataFrame]] = field(default_factory=list)

    def add(self, entries: DataFrame) -> DataFrame:
        """Takes a batch in; head and key of the suffixes of which the batch or a level and the batch have two."""
        array = self._level(entries.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("n")))
        met = [array.where("n > 1").select(*SUFFIX)]
        met += [array.select(*SUFFIX).join(level.select(*SUFFIX), SUFFIX) for _, level in self.levels]
        found = written(reduce(DataFrame.union, met).distinct(), "matches")
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            merged = self._level(array.union(level).groupBy(*SUFFIX).agg(F.sum("n").alias("n")))
            discard(array)
            discard(level)
            array, size = merged, 2 * size
        self.levels.append((size, array))
        return found

    @staticmethod
    def _level(df: DataFrame) -> DataFrame:
        return written(df.sortWithinPartitions(*SUFFIX), "level")


def _digest(part: bytes, mark: int) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(part, seed=mark)


def block_rows(text: bytes, place: int, first: int, last: int, least: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """First and last start, core and whole of each block of offsets that an anchor's strings reach."""
    final = len(text) - least
    for block in range((place - last) // BLOCK, (place - first) // BLOCK + 1):
        a, z = place - BLOCK * block - BLOCK + 1, place - BLOCK * block
        core = _digest(text[z : a + least], block)  # lies inside the text as one of the block's strings does
        a, z = max(a, 0), min(z, final)
        yield a, z, core, _digest(text[a : z + least], ((place - a) << 32) | (place - z))


def _matched_blocks(texts: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """tid, place, first, last, core, whole of the blocks of ``members`` (tid, place, first, last)."""
    asked = to_buckets(members, "tid").groupBy("tid").agg(F.collect_list(F.struct("place", "first", "last")).alias("asked"))
    out = pa.schema([("tid", pa.binary()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("core", pa.binary()), ("whole", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for tid, text, asked in zip(*(part.column(c).to_pylist() for c in ("tid", "text", "asked")), strict=True):
                    done = set()
                    for m in asked:
                        for a, z, core, whole in block_rows(text, m["place"], m["first"], m["last"], least):
                            if (m["place"], a) not in done:  # an anchor that a cut of a long text has parted
                                done.add((m["place"], a))
                                rows.append((tid, m["place"], a, z, core, whole))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, out.types, strict=True)], schema=out)
            release()

    return texts.select("tid", "text").join(asked, "tid").mapInArrow(run, "tid binary, place int, first int, last int, core binary, whole binary")


def _strings(texts: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """tid, start, place less start and hash of every string of ``blocks`` (tid, place, first, last)."""
    asked = to_buckets(blocks, "tid").groupBy("tid").agg(F.collect_list(F.struct("place", "first", "last")).alias("asked"))
    out = pa.schema([("tid", pa.binary()), ("start", pa.int32()), ("offset", pa.int32()), ("string", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for tid, text, asked in zip(*(part.column(c).to_pylist() for c in ("tid", "text", "asked")), strict=True):
                    for at in range(0, len(asked), 256):
                        rows = [(tid, i, m["place"] - i, _digest(text[i : i + least], m["place"] - i)) for m in asked[at : at + 256] for i in range(m["first"], m["last"] + 1)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
            release()

    return texts.select("tid", "text").join(asked, "tid").mapInArrow(run, "tid binary, start int, offset int, string binary")


def repeated_starts(texts: DataFrame, matches: DataFrame, least: int) -> DataFrame:
    """tid, first, last: ranges of starts of strings that stand at two places of ``texts`` at least, written."""
    members = texts.select("tid", F.inline("entries")).join(matches, SUFFIX, "left_semi").select("tid", "place", "first", "last")
    blocks = written(_matched_blocks(texts, members, least), "blocks")
    wholes = written(blocks.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "place", "first", "last")).alias("one")), "wholes")
    split = wholes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    strings = written(_strings(texts, wholes.join(split, "core", "left_semi").select("one.*"), least), "strings")
    twice = strings.groupBy("offset", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("offset", "string")
    single = strings.join(twice, ["offset", "string"], "left_semi").select("tid", F.col("start").alias("first"), F.col("start").alias("last"))
    settled = blocks.join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("tid", "first", "last")
    starts = written(texts.where("size(repeated) > 0").select("tid", F.inline("repeated")).union(settled).union(single), "starts")
    for table in (blocks, wholes, strings):
        discard(table)
    return starts


def _without(texts: DataFrame, starts: DataFrame, least: int) -> DataFrame:
    """tid, removed (ranges [first, last] of bytes), kept_sha256 of texts that lose something."""
    marked = to_buckets(starts, "tid").groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                removed, kept = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    spans = joined([(a, z + least - 1) for a, z in _ranges(part.column("starts"), i)])
                    edges = [0, *(e for a, z in spans for e in (a, z + 1)), len(text)]
                    rest = sha256()
                    for a, z in zip(edges[::2], edges[1::2], strict=True):
                        rest.update(text[a:z])
                    removed.append(spans)
                    kept.append(rest.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("tid"), _structs(removed, RANGE), pa.array(kept, pa.string())], ["tid", "removed", "kept_sha256"])
            release()

    return texts.select("tid", "text").join(marked, "tid").mapInArrow(run, "tid binary, removed array<struct<first: int, last: int>>, kept_sha256 string")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, removed (ranges [first, last] of bytes), kept_sha256.

    Removed is every byte of a string of ``least`` bytes that also starts at another place of any text.
    """
    if least < PREFIX + BLOCK:
        raise ValueError(f"strings of fewer than {PREFIX + BLOCK} bytes have no anchors")
    spark: SparkSession = df.sparkSession
    given = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("text"))
    digest = F.sha2("text", 256)
    tid = F.substring(F.unhex(digest), 1, 16)
    texts = texts_with_entries(given.where(F.length("text") >= least).select(tid.alias("tid"), "text"), least)
    index = Levels()
    part = F.pmod(F.xxhash64("tid"), F.lit(batches))
    found = [index.add(texts.where(part == b).select(F.inline(F.transform("entries", lambda e: F.struct(e["head"].alias("head"), e["key"].alias("key")))))) for b in range(batches)]
    matches = written(reduce(DataFrame.union, found).distinct(), "matches")
    starts = repeated_starts(texts.where("size(entries) > 0"), matches, least)
    for table in (matches, *found, *(level for _, level in index.levels)):
        discard(table)
    partly = _without(texts.where("copies = 1"), starts, least)
    whole = texts.where("copies > 1").select("tid", F.array(F.struct(F.lit(0).alias("first"), (F.col("n_bytes") - 1).cast("int").alias("last"))).alias("removed"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"))
    changed = written(partly.union(whole), "changed")
    rows = given.select("doc_id", F.length("text").cast("long").alias("n_bytes"), digest.alias("sha256")).withColumn("tid", F.substring(F.unhex("sha256"), 1, 16))
    none = F.array().cast("array<struct<first: int, last: int>>")
    return rows.join(changed, "tid", "left").select("doc_id", "n_bytes", F.coalesce("removed", none).alias("removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
