"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of many texts lie end to end in one numpy array of symbols. Each round finds
every sequence's pair of lowest rank and merges all its (non-overlapping) places in all sequences
at once; finished sequences leave. What remains of a sequence is its token count, which is kept for
later texts. No token id is ever built for a whole text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are independent, so repeated
rows and keys give repeated results; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks

#: Pre-tokens whose counts a worker keeps at most, and characters of one that it keeps.
CACHE, CACHED_CHARS = 500_000, 64
_NEVER = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merges and added tokens of a tokenizer file (``.json``), applied to batches of pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE without prefix space is needed")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
        vocab = spec["model"]["vocab"]
        self.base = np.full(256, -1, np.int64)
        for sign, byte in byte_symbols().items():
            self.base[byte] = vocab[sign]
        self.size = max(vocab.values()) + 1
        keys, made = [], []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[left] * self.size + vocab[right])
            made.append(vocab[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, _NEVER).astype(np.int32)
        self.made = np.array(made, np.int64)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty byte string when no pair can be merged."""
        out = np.array([len(t) for t in tokens], np.int64)
        row = np.flatnonzero(out > 1)
        if not len(row):
            return out
        size = out[row]
        sym = self.base[np.frombuffer(b"".join(tokens[i] for i in row), np.uint8)]
        first = np.cumsum(size) - size
        rank = np.full(len(sym), _NEVER, np.int32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[first + size - 1] = _NEVER
        while len(row):
            least = np.minimum.reduceat(rank, first)
            done = least == _NEVER
            if done.any():
                out[row[done]] = size[done]
                keep = np.repeat(~done, size)
                row, size, least, sym, rank = row[~done], size[~done], least[~done], sym[keep], rank[keep]
                if not len(row):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            if (overlap := hit[at[1:] - 1] & (np.diff(at) == 1)).any():  # x x x: every second pair of a run
                begins = np.r_[True, ~overlap]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym[at] = self.made[rank[at]]
            last = np.zeros(len(sym), bool)
            last[first + size - 1] = True
            last[at] |= last[at + 1]
            size -= np.add.reduceat((~keep).astype(np.int64), first)
            place = (np.cumsum(keep) - 1)[at]
            sym, rank, last = sym[keep], rank[keep], last[keep]
            first = np.cumsum(size) - size
            for p in (place, place[place > 0] - 1):
                p = p[~last[p]]
                rank[p] = self.rank(sym[p], sym[p + 1])
            rank[last] = _NEVER
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many added tokens stand in it."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.words(text), 0
        parts = self.split_added.split(text)
        return [w for p in parts for w in self.words(p)], len(parts) - 1

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Token counts; pre-tokens not met before are merged together, once for all texts."""
        out: list[int] = []
        open_: list[tuple[int, list[str]]] = []
        for text in texts:
            words, n = self.pieces(text) if text else ((), 0)
            counts = list(map(self.known.get, words))
            if None in counts:
                open_.append((len(out), [w for w, c in zip(words, counts, strict=True) if c is None]))
                n += sum(filter(None, counts))
            else:
                n += sum(counts)
            out.append(n)
        if open_:
            new = list(set().union(*(w for _, w in open_)))
            lengths = dict(zip(new, self.merged_lengths([w.encode("utf-8") for w in new]).tolist(), strict=True))
            for i, words in open_:
                out[i] += sum(map(lengths.__getitem__, words))
            if len(self.known) + len(lengths) > CACHE:
                self.known.clear()
            self.known.update((w, n) for w, n in lengths.items() if len(w) <= CACHED_CHARS)
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(df: DataFrame, tokenizer_path: str, key: Column | str = "doc_id", text: Column | str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``df``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    given = df.select(F.col(key).alias("doc_id") if isinstance(key, str) else key.alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer_path)
        for batch in batches:
            for part in chunks(batch, "text"):
                n = pa.array(own.count(part.column("text").to_pylist()), pa.int64())
                size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
