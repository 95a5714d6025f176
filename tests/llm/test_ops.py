"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, gif, jaccard, language_crf, mixing, perspectives, queries, segmentations, simhash, token_counts, topk, url_lists, warc
from tests.oracle import DATA, agree

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"


def docs(spark, *texts, first=0):
    rows = [(i, t, "en", f"src{i % 3}", None, "clash") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOC)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name: str) -> None:
    assert agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


# 1

def test_topk_by_brute_force() -> None:
    r = np.random.default_rng(1)
    for _ in range(150):
        n, dim, k, high = int(r.integers(1, 500)), int(r.integers(1, 20)), int(r.integers(1, 8)), int(r.choice([2, 9, 300, 2**28]))
        ids, x, q = r.permutation(n * 3)[:n], r.integers(-high, high + 1, (n, dim)), r.integers(-high, high + 1, dim)
        if r.random() < 0.3:
            x[: n // 2] = x[0]
        own = int(ids[0])
        found, scores = topk.Shard(ids, x, float(np.abs(q).max(initial=1))).best(q, own, k)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(v, q, strict=True)), int(i)) for v, i in zip(x, ids, strict=True) if i != own)[:k]
        assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want


def test_topk_leaves_out_unusable_vectors(spark) -> None:
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(v, v.where("vec_id % 50 = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 9, -32768)]
    assert topk.search(v.where("false"), v.where("false"), 5).count() == 0


def test_topk_in_several_shards_and_blocks(spark, monkeypatch) -> None:
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    r = np.random.default_rng(2)
    vectors = r.integers(-40, 40, (400, 6)) / 64.0
    vectors[50:200] = vectors[50]  # one very common vector
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)]
    rows += [(10, vectors[10].tolist(), "again"), (10, vectors[11].tolist(), "other"), (399, vectors[399].tolist(), "query twice")]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    got = {}
    for row in topk.search(v, v.where("vec_id % 19 = 0 or vec_id = 10"), 5).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    whole = [(i, np.floor(256 * np.array(x, np.float64)).astype(int)) for i, x, _ in rows]
    asked = {}
    for i, x in whole:
        if i % 19 == 0 or i == 10:
            asked[i] = min(asked.get(i, x.tolist()), x.tolist())
    for i, q in asked.items():
        best = sorted((-int(x @ np.array(q)), j) for j, x in whole if j != i)[:5]
        assert sorted(got[i]) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]


# 2

@pytest.fixture(scope="module")
def bpe():
    return token_counts.RankMerger(queries.tokenizer_file("byte_bpe_50k.json"))


def test_token_counts_agree_with_the_library(bpe) -> None:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    r = random.Random(2)
    parts = ["a", "aaa", " ", "  ", "\n", "the", "<|endoftext|>", "'s", "9", "é", "--", "==", "\t", "漢字", "\U0001f600", "​", "\x00", "X" * 50]
    texts = ["", "".join(map(chr, range(1, 0xD7FF, 7))), "ab" * 20_000] + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(400)]
    assert bpe.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_a_table(spark) -> None:
    got = token_counts.count_tokens(docs(spark, None, "", "word " * 2000, "word " * 2000), queries.tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(0, 0, False), (0, 0, False), (10_000, 2001, True), (10_000, 2001, True)]
    assert token_counts.count_tokens(docs(spark).where("false"), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0


# 3

def test_shortages_go_to_siblings_first(spark) -> None:
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000), ("c", "x", 5)], "d string, l string, tokens long")
    mix = mixing.Mix(tokens=600, max_epochs=1)
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ["d", "l"], mix).collect()}
    # c gives 5, so a and b share 595; a's x gives 10, so a's y takes the rest of a's part
    assert got == {("a", "x"): 10, ("a", "y"): 287, ("b", "x"): 148, ("b", "y"): 148, ("c", "x"): 5}


def test_a_mix_keeps_to_its_budgets(spark) -> None:
    r = random.Random(3)
    rows = [(i, "ab"[i % 2], r.randint(0, 40)) for i in range(600)] + [(0, "a", 7), (None, "b", 3)]
    table = spark.createDataFrame(rows, "doc_id long, leaf string, n_tokens long")
    mix = mixing.Mix(weights={"leaf": {"a": 3, "b": 1}}, share=0.9, max_epochs=2, seed=5)
    got = mixing.copies(table, mixing.plan(table, ["leaf"], mix), ["leaf"], mix, F.col("n_tokens") > 0).collect()
    assert len(got) == len(rows) and all(g.copies == 0 for g in got if g.n_tokens == 0)
    total = sum(n for *_, n in rows)
    drawn = {leaf: sum(g.copies * g.n_tokens for g in got if g.leaf == leaf) for leaf in "ab"}
    for leaf, weight in (("a", 3), ("b", 1)):
        assert 0 <= total * 9 // 10 * weight // 4 - drawn[leaf] <= 80
    assert len({g.copies for g in got if g.doc_id == 0 and g.n_tokens}) == 1
    assert mixing.copies(table.where("false"), mixing.plan(table.where("false"), ["leaf"], mix), ["leaf"], mix, F.lit(True)).count() == 0


# 4

def test_lzw_round_trips() -> None:
    r = random.Random(3)
    for n in (0, 1, 2, 255, 257, 3000, 5000, 20_000):
        for data in (bytes(r.randrange(256) for _ in range(n)), bytes(n), bytes(r.choice(b"ab ") for _ in range(n))):
            assert gif.unlzw(gif.pack(gif.lzw_codes(data)), 8, len(data)) == data


def deferred_lzw(data: bytes) -> bytes:
    """Another encoder: one clear code at first, and a full table that is kept to the end."""
    table, bits, width, last = {bytes([i]): i for i in range(256)}, [], 9, b""
    put = lambda code: bits.append(format(code, f"0{width}b")[::-1])
    put(256)
    n = 258
    for byte in data:
        if last + bytes([byte]) in table:
            last += bytes([byte])
            continue
        put(table[last])
        if n < 4096:
            table[last + bytes([byte])] = n
            n += 1
            if n > 1 << width and width < 12:
                width += 1
        last = bytes([byte])
    if last:
        put(table[last])
        if n < 4096 and n + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    stream = "".join(bits)
    return bytes(int(stream[i : i + 8][::-1], 2) for i in range(0, len(stream), 8))


def test_another_encoders_full_table_is_read() -> None:
    r = random.Random(9)
    for n in (1, 700, 20_000, 60_000):
        for signs in (b"ab ", bytes(range(256))):
            data = bytes(r.choice(signs) for _ in range(n))
            assert gif.unlzw(deferred_lzw(data), 8, len(data)) == data


@needs_data
def test_media_digests_of_the_query(spark) -> None:
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    media = {r.doc_id: bytes(r.media) for r in gif.encode_payloads(common.table(spark, DATA, "documents")).collect()}
    got = queries.op4_gif_media(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4)
        frames = -(-len(payload) // (96 * 96))
        assert r.feature.startswith(f"frames={frames};ms={frames * 40};grey=") and sum(map(int, r.feature.split("grey=")[1].split(","))) >= grey.sum()


def hand_made(frames, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff", size=(2, 2)):
    """A 4-colour GIF from (indices, left, top, width, height, disposal, transparent, flags)."""
    out = [b"GIF89a", bytes((size[0], 0, size[1], 0, 0x81, 0, 0)), palette]
    for pixels, left, top, width, height, disposal, clear, flags in frames:
        out.append(bytes((0x21, 0xF9, 4, disposal << 2 | (clear is not None), 10, 0, clear or 0, 0)))
        out.append(bytes((0x2C, left, 0, top, 0, width, 0, height, 0, flags)))
        codes = [4, *itertools.chain.from_iterable((p, 4) for p in pixels), 5]
        bits = "".join(format(c, "03b")[::-1] for c in codes)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += [b"\x02", gif.sub_blocks(data)]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_interlacing() -> None:
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    full = (1, 1, 1, 1)

    def shown(*frames):
        return [[tuple(map(int, p)) for p in f.canvas.reshape(-1, 4)] for f in (gif.Frame(**{**vars(f), "canvas": f.canvas.copy()}) for f in gif.read_gif(hand_made(frames)))]

    assert shown((full, 0, 0, 2, 2, 1, None, 0), ((2, 3), 0, 0, 2, 1, 1, 2, 0))[1] == [red, blue, red, red]
    assert shown((full, 0, 0, 2, 2, 1, None, 0), ((2,), 0, 0, 1, 1, 2, None, 0), ((3,), 1, 1, 1, 1, 1, None, 0))[2] == [clear, red, red, blue]
    assert shown((full, 0, 0, 2, 2, 1, None, 0), ((2,), 0, 0, 1, 1, 3, None, 0), ((3,), 1, 1, 1, 1, 1, None, 0))[2] == [red, red, red, blue]
    rows = [f for f in gif.read_gif(hand_made([((0, 1, 2, 3, 0), 0, 0, 1, 5, 1, None, 0x40)], size=(1, 5)))]
    assert rows[0].indices.ravel().tolist() == [0, 3, 2, 0, 1]
    assert [(f.start_ms, f.delay_ms) for f in gif.read_gif(hand_made([(full, 0, 0, 2, 2, 1, None, 0)] * 2))] == [(0, 100), (100, 100)]
    with pytest.raises(gif.BrokenMedia):
        list(gif.read_gif(b"GIF89a" + bytes(3)))
    assert green not in shown((full, 0, 0, 2, 2, 1, None, 0))[0]


def test_payloads_come_back(spark) -> None:
    texts = [None, "", "x" * 576, "é" * 30_000, "twice", "twice"]
    got = gif.decode_media(gif.encode_payloads(docs(spark, *texts)), carry=("n_bytes",)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        assert row.n_bytes == len(raw) and row.samples == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert sum(f.width * f.height for f in row.frames) == len(row.samples) and all(sum(f.histogram) == 96 * min(96, len(row.samples) // 96) for f in row.frames)
    assert got[4].media == got[5].media
    broken = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert all(r.error and r.frames == [] and r.samples is None for r in gif.decode_media(broken).collect())


def one_frame(wide: int, high: int, width: int, height: int, data: bytes) -> bytes:
    head = b"GIF89a" + struct.pack("<HHBBB", wide, high, 0xF7, 0, 0) + bytes(768)
    return head + struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0) + b"\x08" + gif.sub_blocks(data) + b"\x3b"


def test_headers_and_streams_are_not_trusted_with_memory(spark) -> None:
    small = gif.pack(gif.lzw_codes(bytes(16)))
    codes = [[0, *range(258, 4096), *[4095] * 100_000]]  # each code is longer by one byte than the one before
    bits = "".join(format(c, "b").zfill(int(w))[::-1] for c, w in zip([256, *codes[0]], [9, *gif.WIDTHS[:3839], *[12] * 100_000]))
    bomb = np.packbits(np.array([*bits], np.uint8), bitorder="little").tobytes()
    assert len(gif.unlzw(bomb, 8, 100)) < 10_000_000 < 3_800 * 100_000
    media = [one_frame(65_535, 65_535, 4, 4, small), one_frame(4, 4, 65_535, 65_535, small), one_frame(4, 4, 4, 4, bomb), one_frame(4, 4, 4, 4, small)]
    given = spark.createDataFrame([(i, bytearray(m), "x", "y") for i, m in enumerate(media)], "`a.key` long, media binary, frames string, `o``dd` string")
    found = {r.doc_id: r for r in gif.decode_media(given, key="a.key", carry=("o`dd",)).collect()}
    assert [found[i].error for i in range(4)] == ["more pixels than the bound"] * 2 + [None] * 2
    assert [len(found[i].frames) for i in range(4)] == [0, 0, 1, 1] and found[0].samples is None and found[3].samples == bytearray(16) and found[1]["o`dd"] == "y"
    assert gif.decode_media(given, key="a.key", most_pixels=15).where("error is null").count() == 0


# 5

def test_archives_roll_and_revisit(spark) -> None:
    big = "b" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", "small"), (3, "http://a/3", big), (4, "http://a/4", "small"), (5, None, None), (6, "http://a\r\nX: y", big), (6, "http://a/6", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def build():
        uri = common.scratch(spark, "warc-test")
        manifest = warc.write_archives(pages, uri, most_bytes=600, shards=2)
        return uri, manifest, sorted((r.file, r.records, r.sha256) for r in manifest.collect())

    uri, manifest, files = build()
    assert len(files) > 2 and sum(f[1] for f in files) == len(rows) and files == build()[2]
    got = sorted(((r.key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, manifest, uri).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == sorted([(k, "revisit" if t == big and k in (1, 3) else "response", 6 if t == big and k in (1, 3) else None, len(t or ""), sha(t)) for k, _, t in rows], key=str)
    payloads = {r.key: r.payload for r in warc.read_archives(spark, manifest, uri).collect()}
    assert bytes(payloads[6]).decode() == big and payloads[1] is None
    assert warc.write_archives(pages.where("false"), common.scratch(spark, "warc-test")).count() == 0


def test_a_changed_archive_is_noticed(spark) -> None:
    data = warc.member(warc.info(), 6) + warc.member(warc.record(1, "u", b"payload", None), 6)
    first, second = list(warc.members(iter([data[:50], data[50:]])))
    headers, body = warc.parse(second)
    assert warc.verified(headers, body)["payload"] == b"payload" and warc.parse(first)[0]["warc-type"] == "warcinfo"
    with pytest.raises(warc.BrokenArchive):
        warc.verified(headers, body.replace(b"payload", b"pAyload"))
    with pytest.raises(warc.BrokenArchive):
        list(warc.members(iter([data[:-9]])))


# 6

def slow_fingerprint(text, width=3):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("pairs_up_to", [16, 1])
def test_links_by_brute_force(spark, monkeypatch, pairs_up_to: int) -> None:
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << r.randrange(64) for _ in range(r.choice([0, 1, 2, 2, 3, 5]))) for b in base for _ in range(8)} | {0, 3, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "bits long")
    roots = {row.node & (1 << 64) - 1: row.root & (1 << 64) - 1 for row in simhash.components(simhash.links(table)).collect()}
    want = slow_components(prints)
    classes = lambda of: {frozenset(p for p in prints if of(p) == c) for c in {of(p) for p in prints}}
    assert classes(lambda p: roots.get(p, p)) == classes(want.get)


@pytest.fixture
def little_to_broadcast(spark):
    """A broadcast of more than 4 MB fails, as it does where the driver has little memory."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "4m"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name in limits:
        spark.conf.unset(name)


def test_variants_are_not_broadcast(spark, little_to_broadcast) -> None:
    r = random.Random(62)
    base = [r.getrandbits(63) for _ in range(5000)]
    table = common.written(spark.createDataFrame([(b ^ c,) for b in base for c in (0, 5)], "bits long"), "prints")
    got = {(row.a, row.b) for row in simhash.links(table).collect()}
    assert got >= {tuple(sorted((b, b ^ 5))) for b in base}


def test_near_duplicates_of_a_table(spark) -> None:
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, "", " \t\n", "One two THREE four", "one TWO three\x0bfour", "é É", long, long + " more", "only one", "One two THREE four"]
    got = simhash.near_duplicates(docs(spark, *texts, first=5)).orderBy("doc_id").collect()
    prints = [slow_fingerprint(t) for t in texts]
    roots = slow_components(set(prints))
    for row, p in zip(got, prints, strict=True):
        assert row.bits & (1 << 64) - 1 == p
        assert row.component_id == min(5 + i for i, q in enumerate(prints) if roots[q] == roots[p])
    assert simhash.near_duplicates(docs(spark).where("false")).count() == 0


# 7

@pytest.fixture(scope="module")
def pieces():
    return segmentations.Pieces(queries.tokenizer_file("piece_bpe_32k.model"), 1 / 2_000)


def all_segmentations(pieces, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    vocab = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    marked, found = segmentations.BLANK + text.replace(" ", segmentations.BLANK), {}

    def go(at, ids, score):
        if at == len(marked):
            found[tuple(ids)] = score
        for end in range(at + 1, min(len(marked), at + 16) + 1):
            piece = vocab.get(marked[at:end])
            if piece is not None:
                go(end, [*ids, piece], score + max(sp.get_score(piece) / 2_000, pieces.least))
            elif end == at + 1:
                raw = marked[at:end].encode()
                go(end, [*ids, *(sp.piece_to_id(f"<0x{b:02X}>") for b in raw)], score + pieces.least * len(raw))

    go(0, [], 0.0)
    total = np.log(sum(np.exp(s) for s in found.values()))
    return {k: s - total for k, s in found.items()}


@pytest.mark.parametrize("text", ["the cat", "a漢b", "ab\nc", "  x", "é"])
def test_samples_are_distinct_and_fair(pieces, text: str) -> None:
    want = all_segmentations(pieces, text)
    found = segmentations.Sampler(pieces, 3, 5).sample([text] * 3000, [i * 7919 + 3 for i in range(3000)])
    first: dict = {}
    estimate = 0.0
    for samples in found:
        ids = [tuple(s["ids"].tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(3, len(want))
        assert all(abs(s["log_prob"] - want[i]) < 1e-9 and pieces.decode(s["ids"]) == text.encode() for s, i in zip(samples, ids, strict=True))
        assert all(a["perturbed"] >= b["perturbed"] for a, b in itertools.pairwise(samples))
        first[ids[0]] = first.get(ids[0], 0) + 1
        estimate += sum(np.exp(s["log_prob"] - s["log_inclusion"]) * len(i) for s, i in zip(samples, ids, strict=True))
    for ids, score in want.items():
        p = np.exp(score)
        assert abs(first.get(ids, 0) / 3000 - p) < 5 * np.sqrt(p * (1 - p) / 3000) + 1e-3
    assert abs(estimate / 3000 - sum(np.exp(s) * len(i) for i, s in want.items())) < 0.1


def test_samples_of_a_table_do_not_depend_on_partitions(spark) -> None:
    table = docs(spark, None, "", "Hello  world\n\tfoo é漢 ", "x" * 5000, "same text", "same text")
    model = queries.tokenizer_file("piece_bpe_32k.model")
    rows = lambda df: sorted((r.doc_id, r.rank, r.ids, round(r.perturbed, 9), r.round_trip) for r in segmentations.sample_segmentations(df, model, k=2).collect())
    got = rows(table.coalesce(1))
    assert got == rows(table.repartition(5)) and all(r[4] for r in got)
    assert [r[:3] for r in got if r[0] < 2] == [(0, 1, []), (1, 1, [])]
    decoded = segmentations.decode(segmentations.sample_segmentations(table, model, k=1), model).orderBy("doc_id").collect()
    assert [r.decoded for r in decoded] == ["", *[r.text for r in table.where("doc_id > 0").orderBy("doc_id").collect()]]
    assert segmentations.sample_segmentations(table.where("false"), model).count() == 0


def test_units_are_those_of_the_expression() -> None:
    mark = segmentations.BLANK
    by_expression = re.compile(rf"\n|{mark}*[^\W\d_¹²³]+|{mark}*(?:[^\w{mark}\n]|[\d_¹²³])+|{mark}+").findall
    signs = np.array([*"ab ▁\n\t1_²é漢١.!𝐀😀\x00"])
    r = np.random.default_rng(3)
    texts = [mark + "".join(signs[r.integers(0, len(signs), n)]).replace(" ", mark) for n in (0, 1, 2, 40, 3000)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    begins = segmentations._units(codes, np.cumsum(lengths) - lengths)
    want = [u for t in texts for u in by_expression(t)]
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in itertools.pairwise([*begins.tolist(), len(codes)])] == want
    number, like = segmentations.distinct(codes, begins)
    assert len(like) == len(set(want)) and [want[like[n]] for n in number] == want


def test_unlike_units_of_one_hash_stay_apart(pieces) -> None:
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))  # any polynomial modulo 2^64 takes them for one
    sums, back = segmentations._sums(np.frombuffer((one + other).encode("utf-32-le"), np.uint32))
    assert (sums[2048:2049] == (sums[4096:] - sums[2048:2049]) * back[2048:2049]).all()
    texts = [f"{one} {other}", f"{other} {one}", one]
    for samples, text in zip(segmentations.Sampler(pieces, 2, 5).sample(texts, [1, 2, 3]), texts, strict=True):
        assert [pieces.decode(s["ids"]) for s in samples] == [text.encode()] * 2


def test_a_batch_of_texts_takes_a_bounded_lattice(spark, tmp_path, monkeypatch) -> None:
    """What a worker holds follows the texts of a lattice, not those of an Arrow batch."""
    seen = f"{tmp_path}/seen"
    sample = segmentations.Sampler.sample

    def marked(self, texts, keys):
        with open(seen, "a") as f:
            f.write(f"{sum(len(t) for t in texts)}\n")
        return sample(self, texts, keys)

    monkeypatch.setattr(segmentations.Sampler, "sample", marked)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(2_000))) for i in range(60)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "place": i, "text": t} for i, t in texts])
    frame = spark.createDataFrame([], "doc_id long, text string")
    runs = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: runs.append(run))
    segmentations.sample_segmentations(frame, queries.tokenizer_file("piece_bpe_32k.model"))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in runs[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sizes = [int(x) for x in open(seen)]
    assert rows == 120 and sum(sizes) == sum(len(t) for _, t in texts) and peak < 90 << 20, (rows, sizes, peak)


def test_repeated_words_reach_the_lattice_once(pieces, monkeypatch) -> None:
    """However often a word stands in the texts of a chunk, one lattice is built for it."""
    built: list[int] = []
    build = segmentations.Lattice.__init__

    def counted(self, codes, sizes, pieces) -> None:
        built.append(len(sizes))
        build(self, codes, sizes, pieces)

    monkeypatch.setattr(segmentations.Lattice, "__init__", counted)
    words = [f"word{c}" for c in "abcdefg"]
    texts = [" ".join(words * n) for n in (1, 50, 500)]
    sampled = segmentations.Sampler(pieces, 2, 11).sample(texts, [1, 2, 3])
    assert built == [len(words)]
    assert [pieces.decode(s["ids"]) for row in sampled for s in row] == [t.encode() for t in texts for _ in range(2)]


# 8

def test_forward_backward_by_brute_force() -> None:
    r = np.random.default_rng(8)
    emit, moves = r.random((6, 3)), r.random((3, 3))
    weights = {}
    for labels in itertools.product(range(3), repeat=6):
        w = emit[0, labels[0]]
        for i in range(1, 6):
            w *= moves[labels[i - 1], labels[i]] * emit[i, labels[i]]
        weights[labels] = w
    total = sum(weights.values())
    want = [[sum(w for y, w in weights.items() if y[i] == label) / total for label in range(3)] for i in range(6)]
    assert np.allclose(language_crf.forward_backward(emit, np.array([6]), moves), want)
    many = r.random((303, 3))
    sizes = np.array([70, 0, 1, 32, 200])
    parts = [language_crf.forward_backward(many[a : a + n], np.array([n]), moves) for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True)]
    assert np.allclose(language_crf.forward_backward(many, sizes, moves), np.concatenate(parts))


def test_gradients_by_finite_differences() -> None:
    r = np.random.default_rng(4)
    sizes, labels = np.array([3, 1, 4]), 3
    scores, transitions = r.normal(size=(8, labels)), r.normal(size=(labels, labels))
    pairs = np.array([1, 2, 5, 6, 7])

    def log_sum(scores, transitions) -> float:
        total = 0.0
        for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            every = [sum(scores[a + i, y[i]] for i in range(n)) + sum(transitions[y[i - 1], y[i]] for i in range(1, n)) for y in itertools.product(range(labels), repeat=int(n))]
            total += np.log(np.exp(every).sum())
        return total

    margin, joint = language_crf.expected(np.exp(scores), sizes, np.exp(transitions), pairs)
    step = 1e-5
    for grad, at in ((margin, 0), (joint, 1)):
        for place in itertools.product(*map(range, grad.shape)):
            up, down = [scores.copy(), transitions.copy()], [scores.copy(), transitions.copy()]
            up[at][place] += step
            down[at][place] -= step
            assert abs((log_sum(*up) - log_sum(*down)) / (2 * step) - grad[place]) < 1e-5


def test_the_training_sample_is_bounded_and_fair(spark) -> None:
    rows = [(i, f"word{i} of lang{i % 7}", f"l{i % 7}") for i in range(700)] + [(1000, "x" * 50, "long"), (1001, None, "empty"), (1002, "no label", None)] + [(5, "same", "l0")] * 30
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_crf.training_rows(table, per_language=10, most_chars=20)
    assert got == language_crf.training_rows(table.repartition(7).orderBy("text"), per_language=10, most_chars=20)
    assert {k: len(list(v)) for k, v in itertools.groupby(sorted(lang for _, lang in got))} == {**{f"l{i}": 10 for i in range(7)}, "long": 1} and ("x" * 20, "long") in got
    few = language_crf.training_rows(table, per_language=10, documents=4)
    assert sorted(lang for _, lang in few) == [*(f"l{i}" for i in range(7)), "long"]


@needs_data
def test_the_query_predicts_languages(spark) -> None:
    import zlib

    given = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op8_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(given)
    langs = {d.lang for d in given.values()} - {None}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, given[r.doc_id].text or ""))
        assert r.lang_pred in langs if letters else (r.lang_pred, r.score) == ("und", 0.0)
    sure = [r for r in got if r.held_out and given[r.doc_id].lang]
    assert sum(r.lang_pred == given[r.doc_id].lang for r in sure) >= 0.95 * len(sure)


@needs_data
def test_held_out_accuracy_and_spans(spark) -> None:
    folder = DATA.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.language_model(table)
    rows = language_crf.identify(table.where(queries.held_out()), model, keep=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    mixed = language_crf.spans(model, "the of and with that nicht und der für auf des la ciónes para con los españ")
    assert [s["lang"] for s in mixed] == ["en", "de", "es"]
    odd = language_crf.identify(docs(spark, None, "", "12 34!", "the and of").select("doc_id", "text", F.lit(1).alias("score")), model, names=("pred", "p"), with_spans=True).orderBy("doc_id").collect()
    assert [(r.pred, r.p) for r in odd[:3]] == [("und", 0.0)] * 3 and odd[3].pred == "en" and odd[3].score == 1


def test_nothing_to_learn_from(spark) -> None:
    table = docs(spark, "words", None).withColumn("lang", F.lit(None).cast("string"))
    model = queries.language_model(table)
    assert [r.lang_pred for r in language_crf.identify(table, model, keep=["doc_id"]).collect()] == ["und", "und"]
    assert language_crf.identify(table.where("false"), model, keep=["doc_id"]).count() == 0


# 9

def test_every_participant_is_the_assistant_once(spark) -> None:
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "twice"), (1, 2, "bob", "twice"), (1, None, None, "odd"), (2, 0, "system", "alone"), (None, 0, "ann", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit("clash"))
    got = perspectives.render(turns).collect()
    assert {r.conv_id for r in got} == {1} and {r.perspective for r in got} == {"ann", "bob", "unknown"} and len(got) == 18
    mine = sorted((r for r in got if r.perspective == "bob"), key=lambda r: r.position)
    text = "".join(r.segment for r in mine)
    assert text == "<|im_start|>user name=unknown\nodd<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" + "<|im_start|>assistant\ntwice<|im_end|>\n" * 2
    assert all(text[r.start : r.stop] == r.segment for r in mine)
    assert [r.segment[r.mask_start : r.mask_stop] for r in mine if r.mask_start is not None] == ["<|im_end|>\n", "twice<|im_end|>\n", "twice<|im_end|>\n"]
    assert perspectives.render(turns.where("false")).count() == 0


def test_turns_of_one_number_and_speaker_are_ordered_by_text(spark) -> None:
    texts = ["b", "a", "f", "c", "e", "d", "x" * 100 + "2", "x" * 100 + "1"]
    turns = spark.createDataFrame([(1, 1, "ann", t) for t in texts] + [(1, 1, "bob", "z")], "conv_id long, turn long, role string, text string")
    got = sorted((r.position, r.segment) for r in perspectives.render(turns).where("perspective = 'bob'").collect())
    assert [s.split("\n")[1].removesuffix("<|im_end|>") for _, s in got] == [*sorted(texts), "z"]


# 10

def test_lists_rule_from_their_dates(spark) -> None:
    day = lambda n: f"2024-01-{n:02d}"
    entries = [(1, "b", "x.org", "add", day(5)), (2, "b", "x.org", "remove", day(10)), (3, "b", "x.org", "add", day(10)), (4, "b", "x.org", "remove", day(12)), (5, "b", "a.x.org/p/", "add", day(1)), (6, "b", None, "add", day(1)), (7, "b", "y.org", "add", None), (8, "b", "y.org", "drop", day(1))]
    listed = url_lists.intervals(spark.createDataFrame(entries, "entry_id long, list string, pattern string, action string, dated string").withColumn("dated", F.col("dated").cast("date")))
    rows = [(1, "http://a.x.org/q", day(4)), (2, "http://u@A.X.org:80/q", day(5)), (3, "http://x.org", day(10)), (4, "http://x.org", day(12)), (5, "https://a.x.org/p/z?q=/r/", day(12)), (6, None, day(5)), (7, "/relative", day(5)), (8, "http://x.org", None), (9, "http://notx.org/", day(6)), (2, "http://u@A.X.org:80/q", day(5))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("matches", F.lit("clash"))
    got = {r.page_id: (r.blocked, r.matches, r.patterns) for r in url_lists.evaluate(captures, listed).collect()}
    no = (False, 0, "")
    assert got == {1: no, 2: (True, 1, "b:x.org"), 3: (True, 1, "b:x.org"), 4: no, 5: (True, 1, "b:a.x.org/p/"), 6: no, 7: no, 8: no, 9: no}
    assert url_lists.evaluate(captures.where("false"), listed).count() == 0 and url_lists.evaluate(captures, listed.where("false")).count() == 9


def test_url_lists_stay_in_the_engine(spark) -> None:
    captures = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string").withColumn("fetched", F.lit("2024-01-01").cast("date"))
    plan = url_lists.evaluate(captures, url_lists.intervals(queries.list_entries(captures)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# the pipeline

def five_word_classes(texts) -> list[int]:
    """For each text the first text of its class: links of op6 and five-word Jaccard links, all pairs."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        either = sets[a] | sets[b]
        if (prints[a] ^ prints[b]).bit_count() <= 2 or either and 5 * len(sets[a] & sets[b]) >= 4 * len(either):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return root


def test_five_word_classes_by_brute_force(spark) -> None:
    r = random.Random(5)
    texts = [None, "", "one two", "ONE  two", "one two three four five"]
    for size in (8, 40, 120, 300):
        for _ in range(4):
            base = [f"v{r.randrange(5000)}" for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 4, 6):
                copy = list(base)
                for _ in range(changes):
                    copy[r.randrange(size)] = f"n{r.randrange(10**6)}"
                texts.append(" ".join(copy))
    want = five_word_classes(texts)
    got = sorted(jaccard.near_duplicates(docs(spark, *texts, first=3)).collect())
    assert [row.component_id - 3 for row in got] == want
    assert jaccard.near_duplicates(docs(spark).where("false")).count() == 0


def test_sketches_of_short_texts_are_not_broadcast(spark, little_to_broadcast) -> None:
    texts = [" ".join(f"v{i}w{k}" for k in range(n)) for i in range(1500) for n in (9, 10)]
    got = jaccard.near_duplicates(docs(spark, *texts), width=3).collect()
    assert {(row.doc_id, row.component_id) for row in got} == {(i, i - i % 2) for i in range(3000)}


def test_the_near_dedup_stage_links_what_simhash_does_not(spark) -> None:
    import corpus_pipeline

    words = [f"word{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "other", *words[51:]]), " ".join(reversed(words))]
    assert (slow_fingerprint(texts[0]) ^ slow_fingerprint(texts[1])).bit_count() > 2
    assert {d.doc_id for d in corpus_pipeline.near_dedup(spark, docs(spark, *texts), "").collect()} == {0, 2}


def test_the_near_dedup_stage_keeps_one_row_of_each_class(spark) -> None:
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    given = [(None, "a", 1), (None, "a", 2), (None, "b", 1), (4, "b", 1), (5, "c", 2), (5, "c", 1), (5, "d", 1), (6, "c", 1), (None, "e", 1)]
    table = spark.createDataFrame([(i, text(c), n) for i, c, n in given], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, table, "")
    assert got.columns == table.columns
    assert {(r.doc_id, r.text[0], r.n_chars) for r in got.collect()} == {(None, "a", 1), (4, "b", 1), (5, "c", 1), (5, "d", 1), (None, "e", 1)} and got.count() == 5


def test_texts_that_share_64_bits_are_not_taken_for_copies(spark, monkeypatch) -> None:
    """Made to collide: all texts of one length have one id."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "text_id", lambda text: F.length(text).cast("long"))
    one, two = (" ".join(f"{letter}{i:02d}" for i in range(40)) for letter in "ab")
    given = docs(spark, two, one, one, two, two, "quite another text")
    kept = corpus_pipeline.near_dedup(spark, given, "")
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 5]


def test_stages_leave_other_columns_alone(spark) -> None:
    import corpus_pipeline

    good = [(i, f"the of and with that nothing number{i} is for words on this page of text {i * 7}", "en", f"src{i % 2}", 1) for i in range(12)]
    extra = {"domain": "MINE", "language": "LANG", "origin": "ORI", "copies": "99", "a.b": "dot", "lang_pred": "x", "score": "y", "root": "r", "text_id": "t", "we`ird": "w"}
    table = spark.createDataFrame([*good, good[2]], "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in extra.items():
        table = table.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, table, "")
        assert out.columns == table.columns, name
        rows = [r.asDict() for r in out.collect()]
        assert rows and all({k: r[k] for k in extra} == extra for r in rows), name
        assert stage(spark, table.where("false"), "").count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, table, "").count() == 26


@needs_data
def test_queries_run_over_a_whole_table(spark) -> None:
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.op2_token_counts(spark, DATA).count() == n
    prints = queries.op6_simhash(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(prints) == n and all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id]) for r in prints)
    assert queries.op7_segmentations(spark, DATA).where("not round_trip").count() == 0


@needs_data
def test_the_pipeline_runs_over_a_whole_table(spark) -> None:
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).select("doc_id", "round_trip").collect()
    assert rows and all(r.round_trip for r in rows)


@needs_data
def test_the_pipeline_keeps_what_it_should(spark) -> None:
    import corpus_pipeline

    good = [(i, f"the of and with that nothing number{i} is for words on this page of text {i * 7}", "en", f"src{i % 2}", 1) for i in range(12)]
    table = spark.createDataFrame([*good, (20, None, "en", "src0", 1), (21, "12 34", "en", "src0", 1), (22, good[3][1], "en", "src1", 1), (23, good[3][1], None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        table = common.written(stage(spark, table, ""), "stage")
        assert table.columns == columns
        ids = {r.doc_id for r in table.collect()}
        if name == "language ID":
            assert ids == {*range(12), 22, 23}
        elif name == "SimHash near-dedup":
            assert ids == set(range(12))
    out = corpus_pipeline.STAGES[3][1](spark, table, "").collect()
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} == ids
