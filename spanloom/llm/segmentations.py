"""SentencePiece segmentations by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node for each character and an arc for each piece (or byte fallback) that fits;
pieces do not cross word starts, so the lattice of a text is the chain of its words' lattices, and
each distinct word's is built once for many texts. Words are found and told apart as arrays of
characters: by hashes, compared character by character after that. Arc probabilities come from summed path scores
backwards from each word's end. Piece scores are those of the model times ``alpha``.

The k segmentations with the largest perturbed log-probabilities are found by A* over regions of the
lattice (Gumbel top-down sampling): a region is a fixed beginning, a node at which some arcs are
excluded, and a free rest. Its best perturbed value is drawn from its total mass, below that of the
region it was cut from. The best region yields its path and falls apart into one region for each
step of the path. The first value that is not emitted is the threshold kappa; with it
1 - exp(-exp(log_prob - kappa)) is a segmentation's inclusion score (1 if nothing is left out), by
which sums over segmentations can be estimated without bias.

All random numbers are functions of the seed, the row key, the sample and the place in the text, so a
row's segmentations do not depend on partitions, batches or attempts.

Defined results: a null or empty text has one segmentation without pieces; a text with fewer than k
segmentations gives all; rows are independent, so repeated rows (and keys) repeat; other columns are
ignored; an empty table gives an empty table. A text that holds the model's own blank sign comes
back with spaces in its place, as from the library, and is marked by ``round_trip`` false.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks

#: Upper bound of the text bytes, but for a longer text, of which a worker holds the lattice: 1 MB took it 145 MB, this takes 33 MB.
LATTICE_BYTES = 1 << 17
BLANK = "▁"
LETTER, OTHER, MARK, LINE_END = range(4)
#: Whether a unit begins between characters of two kinds (16 pairs).
_parts = np.array([[a != b and not (a == MARK and b <= OTHER) or b == LINE_END for b in range(4)] for a in range(4)]).ravel()
_odd = np.uint64(0x9E3779B97F4A7C15)
_odd_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def uniforms(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) for pairs of 64-bit integers (splitmix)."""
    z = seed + (place.astype(np.uint64) + np.uint64(1)) * _odd
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each character."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = np.arange(len(kinds), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")  # a string each would fill a worker
    for run in re.finditer(r"[^\W\d_¹²³]+", every):
        kinds[run.start() : run.end()] = LETTER
    kinds[ord(BLANK)], kinds[ord("\n")] = MARK, LINE_END
    return kinds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _units(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie end to end and begin at ``first``.

    A unit is what no piece reaches beyond: blanks and letters, blanks and other signs, a line end.
    """
    kinds = _kinds()[codes]
    begins = np.ones(len(codes), bool)
    begins[1:] = _parts[kinds[:-1] * 4 + kinds[1:]]
    begins[first] = True
    return np.flatnonzero(begins)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With these the hash of the characters from a to b is (sums[b] - sums[a]) * back[a]."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    back = np.full(len(codes), _odd)
    np.cumprod(back, out=back)
    np.add(codes, np.uint64(1), out=sums[1:])
    sums[1:] *= back
    np.cumsum(sums, out=sums)
    back[:1], back[1:] = 1, _odd_inverse
    return sums, np.cumprod(back, out=back)


def distinct(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each unit among the distinct ones, and of each distinct one a unit that is like it."""
    sums, back = _sums(codes)
    ends = np.append(begins[1:], len(codes))
    key = (sums[ends] - sums[begins]) * back[begins]
    del sums, back
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = np.diff(key[order]) != 0
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    like = order[new]
    sizes = ends - begins
    away = begins[like[number]] - begins
    if (sizes == sizes[like[number]]).all() and (codes[np.arange(len(codes)) + np.repeat(away, sizes)] == codes).all():
        return number, like
    seen: dict[bytes, int] = {}  # unlike units have a hash in common
    number = np.array([seen.setdefault(codes[a:b].tobytes(), len(seen)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    return number, np.unique(number, return_index=True)[1]


class Pieces:
    """The pieces of a model file as arrays: hashes by length, scores, bytes."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.decode(sp.encode("  a  b ")) != "  a  b ":
            raise ValueError("a model that keeps white space is needed")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        sizes = np.array([len(names[i]) for i in plain])
        if len(_units(_codes("".join(names[i] for i in plain)), np.cumsum(sizes) - sizes)) != len(plain):
            raise ValueError("a piece reaches beyond a unit of the text")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(not sp.is_byte(int(i)) for i in self.byte):
            raise ValueError("byte fallback is needed")
        usual = [sp.get_score(i) for i in plain if sp.get_score(i) > -1e8]
        self.least = alpha * min(usual, default=0.0)
        self.score = np.array([max(alpha * sp.get_score(i), self.least) for i in range(n)])
        self.single = np.full(0x110000, -1, np.int32)
        by_length: dict[int, list[int]] = {}
        for i in plain:
            if len(names[i]) == 1:
                self.single[ord(names[i])] = i
            else:
                by_length.setdefault(len(names[i]), []).append(i)
        self.by_length = {}
        for length, ids in sorted(by_length.items()):
            codes = np.array([list(map(ord, names[i])) for i in ids], np.uint64)
            with np.errstate(over="ignore"):
                hashes = ((codes + np.uint64(1)) * np.cumprod(np.full(length, _odd))).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            many = np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=1 << 16)  # by the first bits of the hash
            first = np.where(many > 0, np.cumsum(many) - many, len(ids)).astype(np.int32)
            self.by_length[length] = (np.append(hashes[order], np.uint64(2**64 - 1)), np.append(np.array(ids)[order], -1), first, int(many.max()))
        text = [b""] * n
        for i in plain:
            text[i] = names[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            text[i] = bytes((b,))
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.count = n

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation, without the blank that encoding puts in front."""
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.bytes[at].tobytes()[1:]


class Lattice:
    """Arcs of distinct words. Nodes of all words are numbered on; arcs are sorted by their start.

    ``codes`` has the words' characters end to end, ``sizes`` the words' lengths.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, pieces: Pieces):
        words = len(sizes)
        ends = np.cumsum(sizes, dtype=np.int32)
        self.stop = ends + np.arange(words, dtype=np.int32)
        self.base = self.stop - sizes
        node = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(words, dtype=np.int32), sizes)  # where the character starts
        left = np.repeat(ends, sizes) - np.arange(len(codes), dtype=np.int32)  # characters up to the word's end
        widest = max(pieces.by_length, default=1)
        fits = np.full((len(codes), widest), -1, np.int32)  # the piece of each length at each character
        fits[:, 0] = pieces.single[codes]
        sums, back = _sums(codes)
        at = np.arange(len(codes), dtype=np.int32)
        for length, (hashes, found, first, deep) in pieces.by_length.items():
            at = at[left[at] >= length]
            key = sums[at + length]
            key -= sums[at]
            key *= back[at]
            k = first[key >> np.uint64(48)]
            maybe = np.flatnonzero(k < len(found) - 1)
            key, k = key[maybe], k[maybe]
            for _ in range(deep - 1):
                k += hashes[k] < key
            hit = np.flatnonzero(hashes[k] == key)
            fits[at[maybe[hit]], length - 1] = found[k[hit]]
        lost = np.flatnonzero(fits[:, 0] < 0)  # characters without a piece: their bytes
        raw = [chr(c).encode() for c in codes[lost].tolist()]
        fits[lost, 0] = pieces.count + np.arange(len(lost))
        width = np.concatenate([np.ones(pieces.count, np.int64), np.array([len(b) for b in raw], np.int64)])
        self.pool = np.concatenate([np.arange(pieces.count), pieces.byte[np.frombuffer(b"".join(raw), np.uint8)]])
        score = np.concatenate([pieces.score, pieces.least * width[pieces.count :]])

        there = fits >= 0
        many = there.sum(axis=1, dtype=np.int32)  # at least the character's own arc
        flat = np.flatnonzero(there.ravel()).astype(np.int32)
        piece = fits.ravel()[flat]
        self.begin = np.repeat(node, many)
        flat %= widest
        flat += 1
        self.end = self.begin + flat
        gain = score[piece]

        mass = np.zeros(len(codes) + words)
        longest = int(sizes.max(initial=0))
        distance = left.astype(np.int16 if longest < 1 << 15 else np.int32)
        by_distance = np.argsort(distance, kind="stable")
        order = np.argsort(np.repeat(distance, many), kind="stable")
        near_gain, near_end, near_many, near_node = gain[order], self.end[order], many[by_distance], node[by_distance]
        near_first = np.append(0, np.cumsum(near_many))
        bounds = np.append(0, np.cumsum(np.bincount(left, minlength=longest + 1)[1:]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lo, hi = near_first[a], near_first[b]
            value = near_gain[lo:hi]
            value += mass[near_end[lo:hi]]
            starts = near_first[a:b] - lo
            top = np.maximum.reduceat(value, starts)
            value -= np.repeat(top, near_many[a:b])
            np.exp(value, out=value)
            mass[near_node[a:b]] = top + np.log(np.add.reduceat(value, starts))
        self.log_p = gain
        self.log_p += mass[self.end]
        self.log_p -= np.repeat(mass[node], many)
        np.minimum(self.log_p, 0, out=self.log_p)
        self.p = np.exp(self.log_p)
        self.plain = bool((width == 1).all())
        self.width = None if self.plain else width[piece]
        self.piece = piece if self.plain else (np.cumsum(width) - width)[piece]
        self.first_of = np.append(0, np.cumsum(np.bincount(self.begin, minlength=len(mass))))
        # an arc is taken below its bound: the sum of its node's arcs up to it, and anything for the last
        self.bound = self.p.copy()
        last = np.cumsum(many) - 1
        for r in range(1, int(many.max(initial=1)) - 1):
            arc = (last - many + (1 + r))[many > r + 1]
            self.bound[arc] += self.bound[arc - 1]
        self.bound[last] = np.inf

    def ids(self, arcs: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths that lie end to end, and the bounds of each path's ids."""
        if self.plain:
            return self.pool[self.piece[arcs]], np.append(0, stops)
        widths = self.width[arcs]
        upto = np.cumsum(widths)
        at = np.repeat(self.piece[arcs] - upto + widths, widths) + np.arange(int(upto[-1]))
        return self.pool[at], np.append(0, upto[stops - 1])

    def arcs(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        arc = self.first_of[node]
        on = np.flatnonzero(self.bound[arc] <= u)
        while len(on):
            arc[on] += 1
            on = on[self.bound[arc[on]] <= u[on]]
        return arc

    def other(self, node: int, excluded: set[int], u: float) -> int:
        """An arc of the node besides the excluded ones, in proportion to its probability."""
        a, b = self.first_of[node : node + 2]
        rest = [e for e in range(int(a), int(b)) if e not in excluded]
        odds = self.p[rest]
        return rest[min(int(np.searchsorted(np.cumsum(odds), u * odds.sum(), side="right")), len(rest) - 1)]

    def left_out(self, excluded: set[int]) -> float:
        """Log of the probability of the node's arcs that are not excluded."""
        node = self.begin[next(iter(excluded))]
        a, b = self.first_of[node : node + 2]
        odds = sum(float(self.p[e]) for e in range(int(a), int(b)) if e not in excluded)
        return float(np.log(odds)) if odds > 0 else -np.inf

    def paths(self, node: np.ndarray, stop: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from nodes to their words' ends: arcs end to end, and how many each has.

        ``place`` is the position of each node in its text.
        """
        taken = np.zeros(len(node), np.int64)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.argsort(node)  # neighbours look up neighbouring arcs
        live = live[node[live] < stop[live]]
        node, stop, place, seed = node[live], stop[live], place[live], seed[live]
        while len(live):
            arc = self.arcs(node, uniforms(seed, place))
            rounds.append((live, arc))
            after = self.end[arc]
            on = after < stop
            place = place + (after - node)
            taken[live] += 1
            live, node, stop, place, seed = live[on], after[on], stop[on], place[on], seed[on]
        out = np.empty(int(taken.sum()), np.int64)
        first = np.cumsum(taken) - taken
        for r, (who, arc) in enumerate(rounds):
            out[first[who] + r] = arc
        return out, taken


def _seed(key: int, seed: int, sample: int) -> int:
    return (key ^ (seed * 0x632BE59BD9B4E019 + sample * 0xD6E8FEB86659FD93)) & (1 << 64) - 1


def log_inclusion(above: float) -> float:
    """Log of 1 - exp(-exp(above)), also where that is beyond the doubles."""
    if above > 6:
        return 0.0
    return above if above < -30 else float(np.log(-np.expm1(-np.exp(above))))


class Sampler:
    """The k best perturbed segmentations of each of many texts."""

    def __init__(self, pieces: Pieces, k: int, seed: int):
        self.pieces, self.k, self.seed = pieces, k, seed

    def sample(self, texts: list[str | None], keys: list[int]) -> list[list[dict]]:
        """For each text its segmentations by falling perturbed value."""
        codes = _codes("".join([BLANK + text for text in texts if text])).copy()
        if not len(codes):
            return [[self._nothing()] for _ in texts]
        codes[codes == ord(" ")] = ord(BLANK)
        lengths = np.array([len(text) + 1 if text else 0 for text in texts], np.int64)
        upto = np.cumsum(lengths)
        begins = _units(codes, (upto - lengths)[lengths > 0])
        ends = np.searchsorted(begins, upto)
        sizes = np.diff(ends, prepend=0)
        word, like = distinct(codes, begins)
        long = np.diff(begins, append=len(codes))[like]
        at = np.repeat(begins[like] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        lattice = Lattice(codes[at], long.astype(np.int32), self.pieces)
        node, stop = lattice.base[word], lattice.stop[word]
        length = np.cumsum(stop - node) - (stop - node)
        place = length - np.repeat(length[np.minimum(ends - sizes, len(word) - 1)], sizes)
        # texts' own state
        heaps: list[list] = [[] for _ in texts]
        out: list[list[dict]] = [[] if n else [self._nothing()] for n in sizes.tolist()]
        todo = [(t, np.zeros(0, np.int64), -1, set()) for t in np.flatnonzero(sizes).tolist()]
        tops = (-np.log(-np.log(uniforms(np.array([_seed(key, self.seed, 99) for key in keys], np.uint64), np.zeros(len(keys)))))).tolist()
        for sample in range(self.k):
            # 1: every text's words that are free, from a text's forced arc on
            begin_word = np.array([ends[t] - sizes[t] if w < 0 else w for t, _, w, _ in todo], np.int64)
            counts = np.array([ends[t] for t, *_ in todo], np.int64) - begin_word
            which = np.repeat(begin_word - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            start, at = node[which].copy(), place[which].copy()
            first = np.cumsum(counts) - counts
            for i, (_, prefix, w, _) in enumerate(todo):
                if w >= 0:
                    at[first[i]] += lattice.end[prefix[-1]] - start[first[i]]
                    start[first[i]] = lattice.end[prefix[-1]]
            seeds = np.repeat(np.array([_seed(keys[t], self.seed, sample) for t, *_ in todo], np.uint64), counts)
            arcs, steps = lattice.paths(start, stop[which], at, seeds)
            per_text = np.add.reduceat(steps, first) if len(first) else steps
            upto = np.cumsum(per_text)
            # 2: emit the paths, and the regions that are left of each
            own = [np.concatenate([prefix, arcs[upto[i] - per_text[i] : upto[i]]]) if len(prefix) else arcs[upto[i] - per_text[i] : upto[i]] for i, (_, prefix, *_) in enumerate(todo)]
            count_ = np.array([len(o) for o in own], np.int64)
            stops = np.cumsum(count_)
            begins = stops - count_
            flat = np.concatenate(own)
            logs = lattice.log_p[flat]
            total = np.cumsum(logs)
            before = total - logs - np.repeat(total[begins] - logs[begins], count_)
            step_ = np.arange(len(flat)) - np.repeat(begins, count_)
            top = np.array([tops[t] for t, *_ in todo])
            with np.errstate(divide="ignore"):
                rest = before + np.log1p(-lattice.p[flat])
            froms = np.array([max(0, len(prefix) - 1) for _, prefix, *_ in todo], np.int64)
            for i, (*_, excluded) in enumerate(todo):
                if excluded:
                    at_ = begins[i] + froms[i]
                    rest[at_] = before[at_] + lattice.left_out(excluded | {int(flat[at_])})
            spread = -np.log(uniforms(np.repeat(np.array([_seed(keys[t], self.seed, 100 + sample) for t, *_ in todo], np.uint64), count_), step_))
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                value = np.where(np.isfinite(rest), rest - np.log(np.exp(rest - np.repeat(top, count_)) + spread), -np.inf)
            sums = (before[stops - 1] + logs[stops - 1]).tolist()
            ids, id_stops = lattice.ids(flat, stops)
            for i, (t, _, _, excluded) in enumerate(todo):
                a, b, from_ = int(begins[i]), int(stops[i]), int(froms[i])
                out[t].append({"arcs": own[i], "ids": ids[id_stops[i] : id_stops[i + 1]], "log_prob": sums[i], "perturbed": tops[t]})
                open_ = value[a + from_ : b]
                keep = min(self.k - sample, len(open_))
                for j in np.argpartition(open_, len(open_) - keep)[len(open_) - keep :].tolist():
                    if open_[j] > -np.inf:
                        step = from_ + j
                        cut = (excluded if j == 0 else set()) | {int(own[i][step])}
                        heapq.heappush(heaps[t], (-float(open_[j]), sample, step, cut))
            if sample + 1 == self.k:
                break
            # 3: the best region of each text; its path so far and another arc at its node
            again = []
            best = [(t, *heapq.heappop(heaps[t])) for t, *_ in todo if heaps[t]]
            draws = uniforms(np.array([_seed(keys[t], self.seed, 200 + sample) for t, *_ in best], np.uint64), np.array([step for *_, step, _ in best], np.int64))
            for (t, value, parent, step, cut), u in zip(best, draws.tolist(), strict=True):
                path = out[t][parent]["arcs"]
                at_node = int(lattice.begin[path[step]])
                forced = lattice.other(at_node, cut, u)
                offset = int((lattice.end[path[:step]] - lattice.begin[path[:step]]).sum())
                a, b = ends[t] - sizes[t], ends[t]
                w = int(a + np.searchsorted(place[a:b], offset, side="right") - 1)
                tops[t] = -value
                again.append((t, np.append(path[:step], forced), w, cut))
            todo = again
            if not todo:
                break
        for t, found in enumerate(out):
            kappa = -heaps[t][0][0] if heaps[t] else -np.inf
            for s in found:
                if s.pop("arcs", None) is not None:
                    s["log_inclusion"] = log_inclusion(s["log_prob"] - kappa)
        return out

    def _nothing(self) -> dict:
        return {"ids": np.zeros(0, np.int64), "log_prob": 0.0, "perturbed": 0.0, "log_inclusion": 0.0}


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


ROW = "rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sample_segmentations(df: DataFrame, model_path: str, k: int = 2, alpha: float = 1 / 2_000, seed: int = 11, key: str = "doc_id", text: Column | str = "text", most: int = LATTICE_BYTES) -> DataFrame:
    """Up to k rows for each row of ``df``: doc_id, rank (from 1), ids, log_prob, perturbed,
    log_inclusion (the inclusion score's log, as scores of long texts are below the doubles),
    round_trip (whether decoding the ids gives the text)."""
    source = F.col(text) if isinstance(text, str) else text
    given = df.select(F.col(key).alias("doc_id"), F.xxhash64(key).alias("place"), source.cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model_path, alpha)
        sampler = Sampler(own, k, seed)
        for batch in batches:
            for part in chunks(batch, "text", most):
                texts = part.column("text").to_pylist()
                found = sampler.sample(texts, [p & (1 << 64) - 1 for p in part.column("place").to_pylist()])
                counts = [len(f) for f in found]
                flat = [s for f in found for s in f]
                ids = [s["ids"] for s in flat]
                sizes = np.array([0, *map(len, ids)], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)))
                trips = [own.decode(s["ids"]) == (t or "").encode() for t, f in zip(texts, found, strict=True) for s in f]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), counts))),
                        pa.array([r for n in counts for r in range(1, n + 1)], pa.int32()),
                        lists,
                        *(pa.array([s[c] for s in flat], pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion")),
                        pa.array(trips, pa.bool_()),
                    ],
                    ["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {ROW}")


def decode(df: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of each id sequence in the column ``name``; null ids give null.

    Bytes that are no UTF-8 come out as replacement characters.
    """
    from pyspark.sql.types import ArrayType

    at = df.columns.index(ids)
    if not isinstance(df.schema[at].dataType, ArrayType):
        raise ValueError(f"{ids} is no array")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model_path, 1.0)
        for batch in batches:
            made = [None if v is None else own.decode(np.array(v, np.int64)).decode("utf-8", "replace") for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{name}` string")
