"""Periodic runs, hard negatives and suffix-array dedup against brute force, and their defined results."""

from __future__ import annotations

import binascii
import hashlib
import os
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from spanloom.llm import hard_negatives, queries, suffix_levels, topk, word_runs
from tests.oracle import DATA, duck

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
DOC = "doc_id long, text string, lang string, n_bytes string, removed string, tid string, key string, runs string, period string"


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(i, t, *["clash"] * 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


# 11

def runs_by_force(words: list, least_length: int = 24, least_exponent: int = 3) -> list[word_runs.Run]:
    n, found = len(words), {}
    for p in range(1, n // least_exponent + 1):
        same = np.array([a == b for a, b in zip(words, words[p:])] + [False], bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(int)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + p >= max(least_length, least_exponent * p):
                found.setdefault((a, b + p), p)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def text_of_copies(r: random.Random) -> list[int]:
    words: list[int] = []
    n, letters = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
    while len(words) < n:
        kind = r.random()
        if kind < 0.4 and words:
            p = r.randint(1, min(len(words), 12))
            for _ in range(r.randint(1, 40)):
                words.append(words[-p])
        elif kind < 0.6 and words:
            i = r.randrange(len(words))
            words += words[i : i + r.randint(1, 50)]
        else:
            words.append(r.randrange(letters))
    return words[:n]


def test_runs_by_brute_force() -> None:
    r = random.Random(5)
    for _ in range(1500):
        words = text_of_copies(r)
        exponent = r.choice([2, 3, 3, 4])
        length = max(exponent, r.choice([2, 5, 8, 24]))
        want = runs_by_force(words, length, exponent)
        assert word_runs.runs_of(words, length, exponent) == sorted(want)
        assert word_runs.text_runs([str(w).encode() for w in words], length, exponent) == want


def test_factors_are_the_longest_earlier_stretches() -> None:
    r = random.Random(6)
    for _ in range(300):
        words = text_of_copies(r)
        end = 0
        for start, length, earlier in word_runs.factors(words):
            assert start == end
            end = start + length
            places = lambda n: [i for i in range(start) if words[i : i + n] == words[start : start + n]]  # noqa: B023, E731
            if earlier < 0:
                assert length == 1 and not places(1)
            else:
                assert places(length)[0] == earlier and (end == len(words) or not places(length + 1))
        assert end == len(words)


def test_runs_of_a_long_text_take_linear_memory_and_keep_all_words() -> None:
    words = [b"w%d" % (i % 37) for i in range(60_000)] + [b"end"]
    assert word_runs.text_runs(words, 24, 3) == [(0, 60_000, 37)]
    assert len(word_runs.collapsed(words, [(0, 60_000, 37)]).split()) == 38


def test_strongest_run_is_compared_exactly() -> None:
    assert word_runs.strongest([(9, 30, 7), (5, 60, 14), (5, 60, 15), (5, 30, 7)]) == (5, 30, 7)
    assert word_runs.strongest([(0, 10**17 + 1, 10**17), (4, 10**17 + 2, 10**17)]) == (4, 10**17 + 2, 10**17)
    assert word_runs.strongest([]) is None


def test_runs_of_odd_rows(spark) -> None:
    lap = "a b\tc\x0bd " * 8
    found = {r.doc_id: r for r in word_runs.find_runs(docs(spark, None, "", lap, "x " * 24, "one two " * 30, "y " * 23)).collect()}
    assert [found[i].n_words for i in range(6)] == [0, 0, 32, 24, 30, 23]
    assert [[tuple(x) for x in found[i].runs] for i in range(6)] == [[], [], [(0, 32, 4)], [(0, 24, 1)], [(0, 30, 1)], []]
    assert found[2].collapsed == "a b c d" and found[3].collapsed == "x" and found[0].collapsed == "" and found[0].strongest is None
    twice = word_runs.find_runs(docs(spark, lap, lap, ids=[7, None]).unionAll(docs(spark, lap, ids=[7]))).collect()
    assert sorted((r.doc_id is None, r.doc_id, len(r.runs)) for r in twice) == [(False, 7, 1), (False, 7, 1), (True, None, 1)]
    assert word_runs.find_runs(docs(spark)).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(docs(spark), least_exponent=1)


@needs_data
def test_word_runs_query_by_brute_force(spark) -> None:
    got = {r.doc_id: r for r in queries.op11_word_runs(spark, DATA).collect()}
    total = 0
    for key, text in duck().sql("SELECT doc_id, text FROM documents").fetchall():
        words = (text or "").encode().split()
        n, h = len(words), binascii.crc32(str(key).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_force(words)
        total += len(runs)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = got.pop(key)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.n_runs == len(runs) and row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert not got and total


# 12

def best_by_force(own: int, label: int, vector, rows, low: int, high: int, k: int, same: bool) -> list[tuple[int, int]]:
    scores = [(-int(np.dot(vector, v)), int(i)) for i, other, v in rows if i != own and (other == label) == same]
    return [(i, -s) for s, i in sorted(scores) if low <= -s <= high][:k]


def test_dual_search_by_brute_force() -> None:
    r = np.random.default_rng(12)
    pruned = 0
    for trial in range(60):
        n, m, dim, k = int(r.integers(1, 900)), int(r.integers(1, 120)), int(r.integers(1, 9)), int(r.integers(1, 8))
        centres = r.integers(-300, 300, (5, dim))
        make = lambda count: (centres[p := r.integers(0, 5, count)] + r.integers(-20, 21, (count, dim)), p if trial % 2 else r.integers(0, 3, count))  # noqa: B023, E731
        (x, labels), (q, asked) = make(n), make(m)
        if trial % 3 == 0:
            x[: n // 2] = x[0]  # one very common vector
        ids, own = r.permutation(2 * n)[:n], r.integers(0, 2 * n, m)
        anchors, rows = hard_negatives.Side.of(own, asked, q), hard_negatives.Side.of(ids, labels, x)
        counts = r.integers(0, 4, m)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        low = r.integers(-200_000, 100_000, offsets[-1]).astype(float)
        high = low + r.integers(0, 200_000, offsets[-1])
        for same in (True, False):
            (request, score, found), scored = hard_negatives.dual_search(anchors, offsets, low, high, rows, k, same)
            pruned += len([kid for kid in rows.tree.kids if kid is None]) * len([kid for kid in anchors.tree.kids if kid is None]) - scored
            got: dict[int, list] = {}
            for a, s, i in zip(request.tolist(), score.tolist(), found.tolist(), strict=True):
                got.setdefault(a, []).append((i, int(s)))
            whole = list(zip(ids, labels, x, strict=True))
            for at in range(m):
                for request_id in range(offsets[at], offsets[at + 1]):
                    want = best_by_force(anchors.ids[at], anchors.labels[at], anchors.vectors[at], whole, low[request_id], high[request_id], k, same)
                    assert got.get(request_id, []) == want
    assert pruned > 0


@pytest.mark.parametrize("block", [1, 60, 512])
def test_small_nodes_are_scored_by_one_product(monkeypatch, block: int) -> None:
    """Whatever the size at which the descent ends the result is the same, and the pairs of nodes are as few as it allows."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    r = np.random.default_rng(5)
    x, labels, ids = r.integers(-9, 9, (1_500, 8)), r.integers(0, 4, 1_500), r.permutation(3_000)[:1_500]
    asks = r.integers(0, 3, 40)
    offsets = np.concatenate([[0], np.cumsum(asks)])
    low = r.integers(-60, 60, offsets[-1]).astype(float)
    high = low + r.integers(0, 120, offsets[-1])
    anchors, rows = (hard_negatives.Side.of(ids[:n], labels[:n], x[:n]) for n in (40, 1_500))
    whole = list(zip(ids, labels, x, strict=True))
    for same in (True, False):
        (request, score, found), scored = hard_negatives.dual_search(anchors, offsets, low, high, rows, 3, same)
        assert block < 512 or scored <= 4
        for at in range(40):
            for q in range(offsets[at], offsets[at + 1]):
                of = request == q
                assert list(zip(found[of].tolist(), score[of].tolist(), strict=True)) == best_by_force(anchors.ids[at], anchors.labels[at], anchors.vectors[at], whole, low[q], high[q], 3, same)


def test_held_rows_are_let_go_without_loss(monkeypatch) -> None:
    monkeypatch.setattr(hard_negatives, "HELD", 50)
    best = hard_negatives.Best(1, 3)
    for ids in np.arange(500)[::-1].reshape(50, 10):
        best.add(0, np.ones((1, 10)), np.ones((1, 10), bool), ids)
    assert best.ranked()[2].tolist() == [0, 1, 2]


def test_more_requests_than_held_rows_are_not_sorted_at_each_step(monkeypatch) -> None:
    monkeypatch.setattr(hard_negatives, "HELD", 50)
    best, sorts = hard_negatives.Best(100, 3), []
    monkeypatch.setattr(best, "ranked", lambda whole=best.ranked: sorts.append(1) or whole())
    for ids in np.arange(400):
        best.add(0, np.full((100, 1), float(ids)), np.ones((100, 1), bool), np.array([ids]))
    assert len(sorts) <= 150
    assert best.ranked()[2].tolist() == [399, 398, 397] * 100


def test_too_large_components_are_refused() -> None:
    with pytest.raises(ValueError):
        hard_negatives.exact(np.array([[2**40]]), np.array([[2**20]]))


def mined(rows: list[tuple], every: int) -> list[tuple]:
    """By brute force: (anchor, positive, rank, negative, positive score, negative score)."""
    sound = [(i, label, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, label, v in rows if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    anchors: dict = {}
    for i, label, v in sound:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v.tolist())), (label, v.tolist()))
    for i, (label, v) in anchors.items():
        fit = [row for row in sound if len(row[2]) == len(v)]
        for positive, score in best_by_force(i, label, np.array(v), fit, -(10**15), 10**15, 5, True):
            found = best_by_force(i, label, np.array(v), fit, -(-30 * score // 100), 90 * score // 100, 10, False)
            out += [(i, positive, n, j, score, s) for n, (j, s) in enumerate(found, 1)]
    return sorted(out)


def test_mining_in_cells_by_brute_force(spark, monkeypatch) -> None:
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 70)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 6)
    r = np.random.default_rng(3)
    x = (r.normal(size=(400, 5)) * 0.4 + 0.5).round(2)
    x[100:200] = x[100]
    rows = [(i, int(r.choice([0, 0, 0, 1, 2, 9])), v.tolist()) for i, v in enumerate(x)]
    rows += [(20, 1, x[3].tolist()), (20, 1, x[3].tolist()), (401, None, x[0].tolist()), (None, 1, x[0].tolist()), (402, 1, None), (403, 0, [float("nan")] * 5), (404, 0, [None, 1.0]), (440, 0, [1.0]), (441, 0, [1.0]), (442, 3, [0.5]), (443, 3, [])]
    given = spark.createDataFrame([(*row, "clash", 1.5) for row in rows], "vec_id long, label int, embedding array<double>, rank string, terms double")
    v = hard_negatives.labelled_vectors(given)
    found = hard_negatives.mine(v, v.where("vec_id % 20 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, found.collect())) == mined(rows, 20)
    assert hard_negatives.mine(v.where("false"), v.where("false")).count() == 0


def test_positives_below_zero_have_no_negatives(spark) -> None:
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.5, 0.0]), (3, 2, [0.5, 0.0])]
    v = hard_negatives.labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert hard_negatives.mine(v, v.where("vec_id = 0")).count() == 0
    assert topk.search(v.drop("label"), v.where("vec_id = 0").drop("label"), 1).first().vec_id == 3


# 13

def removed_by_force(texts: list[bytes], least: int) -> list[bytes]:
    """A mark for each byte: 1 where it goes."""
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                marks[i : i + least] = b"\1" * least
        out.append(bytes(marks))
    return out


def compared(rows, texts: list[bytes], least: int) -> int:
    """Bytes removed, if ``rows`` (their doc_id numbers the texts) are as brute force has them."""
    total = 0
    for row in rows:
        text, marks = texts[row.doc_id], removed_by_force_cache[row.doc_id]
        spans = [(r.first, r.last) for r in row.removed]
        got = bytearray(len(text))
        for a, z in spans:
            got[a : z + 1] = b"\1" * (z + 1 - a)
        assert bytes(got) == marks, row.doc_id
        assert spans == sorted(spans) and all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:]))
        assert row.n_bytes == len(text) and row.kept_sha256 == hashlib.sha256(bytes(b for b, m in zip(text, marks) if not m)).hexdigest()
        total += sum(marks)
    return total


removed_by_force_cache: list[bytes] = []


def collage(r: random.Random, pool: list[str]) -> str:
    """A text of own words, passages of other texts, laps and single letters."""
    parts = []
    for _ in range(r.randint(0, 6)):
        kind = r.random()
        if kind < 0.35:
            parts.append(" ".join(r.choice("the a of über end".split()) + str(r.randrange(9999)) for _ in range(r.randint(1, 40))))
        elif kind < 0.7 and pool:
            source = r.choice(pool)
            at = r.randrange(len(source) + 1)
            parts.append(source[at : at + r.randint(50, 260)])
        elif kind < 0.85:
            parts.append(r.choice(["ab", "x", "lap of words ", "é"]) * r.randint(1, 160))
        else:
            parts.append(r.choice("xyz"))
    text = r.choice(["", " "]).join(parts)
    pool.append(text)
    return text


@pytest.mark.parametrize("piece", [1 << 20, 150])
def test_suffix_levels_by_brute_force(spark, monkeypatch, piece: int) -> None:
    monkeypatch.setattr(suffix_levels, "PIECE", piece)
    r = random.Random(piece)
    pool: list[str] = []
    texts = [collage(r, pool) for _ in range(150)]
    texts += [texts[3], texts[5] + "!", "", "q" * 99, "z" * 3000, "z" * 200]
    texts += ["passage that all share, and quite long it is at that, so that no text has it by chance. " * 2 + str(i) for i in range(60)]
    bodies = [t.encode() for t in texts]
    removed_by_force_cache[:] = removed_by_force(bodies, 100)
    found = suffix_levels.deduplicate(docs(spark, *texts), least=100, batches=5).collect()
    assert len(found) == len(texts)
    assert compared(found, bodies, 100) > 5_000


def test_suffix_dedup_of_odd_rows(spark) -> None:
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    rows = docs(spark, None, "", text, text, text[:399], ids=[None, 1, 2, 2, 4])
    found = sorted(map(tuple, suffix_levels.deduplicate(rows).withColumn("removed", queries.F.size("removed")).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert found == sorted([(None, 0, 0, empty), (1, 0, 0, empty), (2, len(text), 1, empty), (2, len(text), 1, empty), (4, 399, 0, hashlib.sha256(text[:399].encode()).hexdigest())], key=str)
    assert suffix_levels.deduplicate(docs(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_levels.deduplicate(rows, least=50)


def test_equal_strings_have_their_anchors_at_equal_offsets() -> None:
    r = random.Random(1)
    for _ in range(60):
        core = bytes(r.choices(b"ab" if r.random() < 0.5 else bytes(range(256)), k=r.randint(100, 400)))
        one, two = (bytes(r.choices(range(256), k=r.randint(0, 300))) + core + bytes(r.choices(range(256), k=r.randint(0, 300))) for _ in range(2))
        a, b = one.index(core), two.index(core)

        def anchor(text: bytes, start: int) -> tuple[int, int]:
            place, first, last, key = suffix_levels.anchors(text, 100)
            assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(text) - 100
            at = int(np.searchsorted(first, start, "right")) - 1
            return int(place[at]) - start, int(key[at])

        for i in range(len(core) - 99):
            assert anchor(one, a + i) == anchor(two, b + i)


def test_levels_merge_geometrically_and_find_what_two_batches_share(spark) -> None:
    index = suffix_levels.Levels()
    batch = lambda *keys: spark.createDataFrame([(k // 10, k) for k in keys], "head long, key long")
    found = [sorted(r.key for r in index.add(batch(*keys)).collect()) for keys in ((1, 2, 3, 3), (4, 2), (5, 3), (6, 1, 5), (7,))]
    assert found == [[3], [2], [3], [1, 5], []]
    assert [size for size, _ in index.levels] == [4, 1]
    assert {r.key: r.n for r in index.levels[0][1].collect()} == {1: 2, 2: 2, 3: 3, 4: 1, 5: 2, 6: 1}


@needs_data
def test_suffix_dedup_query_by_brute_force(spark) -> None:
    texts = {k: (t or "").encode() for k, t in duck().sql("SELECT doc_id, text FROM documents").fetchall()}
    marks = dict(zip(texts, removed_by_force(list(texts.values()), 400), strict=True))
    got = queries.op13_suffix_dedup(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text, mark = texts[r.doc_id], marks[r.doc_id]
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), sum(mark), runs)
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, m in zip(text, mark) if not m)).hexdigest()
    assert sum(r.n_removed for r in got) > 0
