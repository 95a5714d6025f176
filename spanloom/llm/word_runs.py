"""Periodic runs of words by Kolpakov and Kucherov's method.

A run is a stretch of words with a smallest period q that no neighbouring word extends, here of at least
``least_exponent`` periods and ``least_length`` words. A text's words are numbers. Its suffix automaton,
whose states know where their words first end, gives the Lempel-Ziv factors: each is a new word or the
longest stretch that also starts earlier. A run either touches a border of factors or lies inside of one.
Main's algorithm finds those of the first kind: at every border, matches to the left and to the right for
all periods at once from Z-functions of windows as long as the factors beside it. Those inside of a factor
are copies of runs in the factor's earlier occurrence, read off from the runs already known.

All of this is linear in the words. Most texts have no runs, and a word of a run lies in a stretch of
``least_length - least_length // least_exponent`` words that occurs twice, a period apart. So a text is first
cut, exactly, at words that no repeated stretch covers; the method runs on what is left, piece by piece.

Documents are independent: no shuffle, and memory in proportion to a batch and its longest text.

Defined results: a null text has no words; texts of fewer words than ``least_length`` have no runs; repeated
rows give repeated rows, null keys stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks

Run = tuple[int, int, int]  # start, length, period
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """start, length, start of the earliest earlier occurrence (-1: a new word) of each Lempel-Ziv factor."""
    steps: list[dict[int, int]] = [{}]
    link, length, first_end = [-1], [0], [-1]
    last = 0
    for at, word in enumerate(words):
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        first_end.append(at)
        state, last = last, new
        while state >= 0 and word not in steps[state]:
            steps[state][word] = new
            state = link[state]
        if state < 0:
            continue
        target = steps[state][word]
        if length[target] > length[state] + 1:
            twin = len(steps)
            steps.append(dict(steps[target]))
            link.append(link[target])
            length.append(length[state] + 1)
            first_end.append(first_end[target])
            while state >= 0 and steps[state].get(word) == target:
                steps[state][word] = twin
                state = link[state]
            link[target] = target = twin
        link[new] = target
    found, start, n = [], 0, len(words)
    while start < n:
        state, at, earlier = 0, start, -1
        while at < n and first_end[step := steps[state][words[at]]] < at:
            state, at = step, at + 1
            earlier = first_end[state] - (at - start) + 1
        at = max(at, start + 1)
        found.append((start, at - start, earlier))
        start = at
    return found


def z_function(s: list[int]) -> list[int]:
    """For each place how much of the beginning of ``s`` stands there; 0 at place 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(words: list[int], border: int, before: int, after: int, least_length: int, least_exponent: int) -> Iterator[Run]:
    """Runs that start up to ``border`` and end from there to the end of the factor after it.

    ``before`` and ``after`` are the lengths of the factors on both sides. A longer period, or a start further
    to the left, would have made the factor before longer than it is.
    """
    most = (before + after) // (least_exponent - 1)
    if before + most + after < least_length:
        return
    n = len(words)
    low, high = max(0, border - before - most - 1), min(n, border + after + 1)
    left, right = words[low:border], words[border:high]
    back = left[::-1]
    nl, nr = len(left), len(right)
    left_back = z_function(back)
    right_on = z_function(right)
    right_in_left = z_function([*right, -1, *left, *right])
    left_in_right = z_function([*back, -1, *right[::-1], *back])
    for period in range(1, min(most, nl + nr) + 1):
        spans = []
        if period <= nl:  # this period begins at the left
            behind = left_back[period] if period < nl else 0
            ahead = right_in_left[nr + 1 + nl - period]
            if behind + ahead >= (least_exponent - 1) * period:
                spans.append((border - behind - period, border + ahead))
        if period <= nr:  # and this one at the right
            behind = left_in_right[nl + 1 + nr - period]
            ahead = right_on[period] if period < nr else 0
            if behind + ahead >= (least_exponent - 1) * period:
                spans.append((border - behind, border + period + ahead))
        for start, end in spans:
            if end - start < least_length or end > border + after:
                continue
            if start == low > 0 and words[low - 1] == words[low - 1 + period]:
                continue
            yield start, end - start, period


def runs_of(words: list[int], least_length: int, least_exponent: int) -> list[Run]:
    """All runs, by start, then period."""
    cuts = factors(words)
    periods: dict[tuple[int, int], int] = {}  # (start, end): smallest period
    ends: dict[int, list[int]] = {}
    starts: list[int] = []

    def note(start: int, end: int, period: int) -> None:
        known = periods.get((start, end))
        if known is None:
            if start not in ends:
                ends[start] = []
                insort(starts, start)
            ends[start].append(end)
        if known is None or period < known:
            periods[start, end] = period

    before = 0
    for border, length, earlier in [*cuts, (len(words), 0, -1)]:
        for start, size, period in at_border(words, border, before, length, least_length, least_exponent):
            note(start, start + size, period)
        if earlier >= 0 and length > least_length:
            shift, place = border - earlier, earlier
            while (i := bisect_right(starts, place)) < len(starts) and starts[i] < earlier + length - least_length:
                place = starts[i]
                for end in list(ends[place]):
                    if end < earlier + length:
                        note(place + shift, end + shift, periods[place, end])
        before = length
    return sorted((start, end - start, period) for (start, end), period in periods.items())


def stretches(numbers: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[int, int]]:
    """Pieces that hold all runs: neighbouring words that stretches occurring twice in their piece cover."""
    width = least_length - least_length // least_exponent
    width = 1 << (width.bit_length() - 1)
    todo = [(0, len(numbers))]
    while todo:
        low, high = todo.pop()
        if high - low < least_length:
            continue
        hashes = numbers[low:high].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        size = 1
        while size < width:
            hashes = (hashes[:-size] ^ (hashes[:-size] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + hashes[size:]
            size *= 2
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        if not same.any():
            continue
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edges = np.zeros(high - low + 1, np.int32)
        at = np.flatnonzero(twice)
        edges[at] += 1
        edges[at + width] -= 1
        covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        pieces = list(zip((turns[::2] + low).tolist(), (turns[1::2] + low).tolist(), strict=True))
        if pieces == [(low, high)]:
            yield low, high
        else:
            todo += pieces


def text_runs(words: list[bytes], least_length: int, least_exponent: int) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    if len(words) < least_length:
        return []
    names: dict[bytes, int] = {}
    numbers = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    found = []
    for low, high in stretches(numbers, least_length, least_exponent):
        found += [(start + low, length, period) for start, length, period in runs_of(numbers[low:high].tolist(), least_length, least_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period, compared exactly; ties to the smaller start, then period."""
    return min(runs, key=cmp_to_key(lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(df: DataFrame, key: str = "doc_id", text: Column | str = "text", least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_words, runs (array of start, length, period by start, then
    period), strongest (one of them or null), collapsed (the text without the repetitions).

    Words are what ASCII white space parts. ``least_exponent`` is a whole number from 2 on.
    """
    if least_exponent < 2 or least_length < least_exponent:
        raise ValueError("runs have two periods and two words at least")
    source = F.col(text) if isinstance(text, str) else text
    given = df.select(F.col(key).alias("doc_id"), F.coalesce(source.cast("binary"), F.lit(b"").cast("binary")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, runs, best, rest = [], [], [], []
                for body in part.column("text").to_pylist():
                    words = body.split()
                    found = text_runs(words, least_length, least_exponent)
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    top = strongest(found)
                    best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    rest.append(collapsed(words, found))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(rest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    span = "struct<start: bigint, length: bigint, period: bigint>"
    found = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{span}>, strongest {span}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
