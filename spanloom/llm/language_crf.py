"""Language identification of words and documents by a linear-chain conditional random field.

Every word of a text (a run of letters, lower-cased) has a language label. Emission scores add the
learned weights of its affixes, character n-grams and, for words of the learned lexicon, the word
itself; transition scores between neighbouring labels are learned with them, on sequences that
switch between labelled documents; a text's first word may have any label, equally likely.
Forward-backward gives every word its label probabilities: a document's language is the one with the largest mean, its score that mean, and runs of words with
one most likely label are the spans of a code-switched text.

Words repeat, so a worker keeps the emissions of words it has met. Forward-backward runs over blocks
of words: the transfer matrix of every block first, then a scan over each text's blocks, then all
blocks at once. A text of any length is processed whole.

Training takes a bounded sample: ``per_language`` documents of each language, fewer of each where there
would be more than ``documents`` in all, but one of each at least; of long ones the first ``most_chars``
characters. They are the first by a hash of key and text, whatever the order of the table.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no labelled row
every text is ``und``; ties go to the label first in the alphabet; rows are independent, so repeated
rows repeat; columns besides those named are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm.common import chunks, quoted

UNKNOWN = "und"
#: Words of a block; words whose emissions a worker keeps, and characters of them.
BLOCK = 32
CACHE, CACHE_CHARS = 150_000, 4_000_000
_words = re.compile(r"[^\W\d_]+").findall
_places = re.compile(r"[^\W\d_]+").finditer


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(word: str) -> list[str]:
    """Affixes of one to four letters, inner n-grams of two and three, and the word itself."""
    marked = f"^{word}$"
    n = len(marked)
    return [
        *(marked[: k + 1] for k in range(1, min(4, n - 2) + 1)),
        *(marked[-k - 1 :] for k in range(1, min(4, n - 2) + 1)),
        *(f"2{marked[i : i + 2]}" for i in range(1, n - 2)),
        *(f"3{marked[i : i + 3]}" for i in range(1, n - 3)),
        f"={word}",
    ]


@dataclass
class Model:
    """Labels in alphabetical order, feature weights (one row each) and transition scores."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)
    held: int = field(default=0, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "rows": None, "held": 0}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, one row each."""
        ids, ends = [], np.zeros(len(words), np.int64)
        get = self.index.get
        for k, word in enumerate(words):
            ids += [i for f in features(word) if (i := get(f)) is not None]
            ends[k] = len(ids)
        total = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(self.weights[np.array(ids, np.int64)], axis=0, dtype=np.float64)])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]

    def potentials(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission potentials of all words of the texts end to end, and the texts' word counts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = [w for t in texts for w in t]
        ids = list(map(self.known.get, flat))
        if None in ids:
            new = list({w for w, i in zip(flat, ids, strict=True) if i is None})
            if len(self.known) + len(new) > CACHE or self.held + sum(map(len, new)) > CACHE_CHARS:
                self.known, self.rows, self.held, new = {}, None, 0, list(set(flat))
            made = self.emissions(new)
            made = np.exp(made - made.max(axis=1, keepdims=True))
            self.held += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
            ids = list(map(self.known.__getitem__, flat))
        if self.rows is None:
            return np.zeros((0, len(self.labels))), sizes
        return self.rows[np.array(ids, np.int64)], sizes

    def marginals(self, potentials: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities of each word; ``sizes`` cuts the words into texts."""
        return forward_backward(potentials, sizes, np.exp(self.transitions - self.transitions.max()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def forward_backward(potentials: np.ndarray, sizes: np.ndarray, moves: np.ndarray, filtered: np.ndarray | None = None) -> np.ndarray:
    """Marginals of chains laid end to end. The first label of a chain is any, equally likely.

    ``filtered`` is filled with each word's label probabilities by the words up to it alone.
    """
    n, labels = potentials.shape
    if not n:
        return potentials
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    firsts = (np.cumsum(sizes) - sizes)[order]
    counts = -(-sizes[order] // BLOCK)
    heads = np.cumsum(counts) - counts  # the first block of each chain
    inner = np.arange(counts.sum()) - np.repeat(heads, counts)
    begin = np.repeat(firsts, counts) + inner * BLOCK
    width = np.minimum(BLOCK, np.repeat(firsts + sizes[order], counts) - begin)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    there = np.arange(BLOCK) < width[:, None]
    emit = potentials[at]  # block, place, label

    matrix = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for t in range(BLOCK):
        live = slice(None) if (on := there[:, t]).all() else np.flatnonzero(on)
        step = (matrix[live].reshape(-1, labels) @ moves).reshape(-1, labels, labels)
        if not t:
            step[heads] = matrix[heads]  # no move leads to a chain's first word
        step *= emit[live, t][:, None, :]
        matrix[live] = step / np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)

    ahead = np.full((len(begin), labels), 1 / labels)
    state = np.full((len(order), labels), 1 / labels)
    most = int(counts[0])
    lasting = np.searchsorted(-counts, -np.arange(most), side="left")  # chains with more than b blocks come first
    for b in range(most):
        own = heads[: lasting[b]] + b
        ahead[own] = state[: lasting[b]]
        state[: lasting[b]] = _unit(np.einsum("cl,clm->cm", state[: lasting[b]], matrix[own]))
    behind = np.ones((len(begin), labels))
    state = np.ones((len(order), labels))
    for b in range(most - 1, -1, -1):
        own = heads[: lasting[b]] + b
        behind[own] = state[: lasting[b]]
        state[: lasting[b]] = _unit(np.einsum("clm,cm->cl", matrix[own], state[: lasting[b]]))

    forward = np.empty_like(emit)
    for t in range(BLOCK):
        come = ahead @ moves
        if not t:
            come[heads] = ahead[heads]
        new = _unit(come * emit[:, t])
        ahead = np.where(there[:, t : t + 1], new, ahead)
        forward[:, t] = ahead
    if filtered is not None:
        filtered[at[there]] = forward[there]
    for t in range(BLOCK - 1, -1, -1):
        on = there[:, t : t + 1]
        forward[:, t] *= behind
        behind = np.where(on, _unit((emit[:, t] * behind) @ moves.T), behind)
    out = np.empty_like(potentials)
    out[at[there]] = _unit(forward[there])
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, sequences: int = 2_000, spans: int = 4, span_words: int = 16, rounds: int = 30, decay: float = 1e-4, rate: float = 0.15) -> Model:
    """Fits a model to (text, language) rows by full-batch gradient steps on the likelihood.

    Each training sequence joins ``spans`` runs of words, each from a random row.
    """
    labels = sorted({lang for _, lang in rows})
    texts = [(w, labels.index(lang)) for text, lang in rows if (w := _words(text.lower()))]
    if not texts:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    by_label: dict[int, list[list[str]]] = {}
    for words, label in texts:
        by_label.setdefault(label, []).append(words)
    present = sorted(by_label)
    ids: dict[str, int] = {}
    flat, gold, sizes = [], [], []
    for _ in range(sequences):
        size = 0
        for _ in range(spans):
            label = present[rng.integers(len(present))]
            words = by_label[label][rng.integers(len(by_label[label]))]
            start = int(rng.integers(max(1, len(words) - span_words + 1)))
            run = words[start : start + int(rng.integers(1, span_words + 1))]
            flat += [ids.setdefault(w, len(ids)) for w in run]
            gold += [label] * len(run)
            size += len(run)
        sizes.append(size)
    flat_, gold_, sizes_ = np.array(flat), np.array(gold), np.array(sizes)

    distinct = list(ids)
    found = [features(w) for w in distinct]
    seen = Counter(f for fs in found for f in fs)
    uses = Counter(distinct[i] for i in flat)
    index: dict[str, int] = {}
    for word, fs in zip(distinct, found, strict=True):
        for f in fs:
            if seen[f] > 1 or (f[0] == "=" and uses[word] > 1):  # the lexicon: words met more than once
                index.setdefault(f, len(index))
    cells = [[index[f] for f in fs if f in index] for fs in found]
    widths = np.array([len(c) for c in cells])
    columns = np.array([c for cs in cells for c in cs], np.int64)
    owner = np.repeat(np.arange(len(distinct)), widths)

    k = len(labels)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    after = np.ones(len(flat_), bool)
    after[np.cumsum(sizes_) - sizes_] = False
    pairs = np.flatnonzero(after)
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (gold_[pairs - 1], gold_[pairs]), 1)
    state = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(moves), np.zeros_like(moves)]]
    for step in range(1, rounds + 1):
        scores = np.stack([np.bincount(owner, weights[columns, c], len(distinct)) for c in range(k)], axis=1)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))[flat_]
        move = np.exp(moves - moves.max())
        margin, joint = expected(emit, sizes_, move, pairs)
        lack = -margin
        lack[np.arange(len(gold_)), gold_] += 1
        per_word = np.stack([np.bincount(flat_, lack[:, c], len(distinct)) for c in range(k)], axis=1)
        grad_w = np.stack([np.bincount(columns, per_word[owner, c], len(index)) for c in range(k)], axis=1) / len(sizes_) - decay * weights
        grad_t = (seen_moves - joint) / len(sizes_) - decay * moves
        for (value, grad), (m, v) in zip(((weights, grad_w), (moves, grad_t)), state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(labels, index, weights.astype(np.float32), moves)


def expected(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected counts of label pairs at the words ``pairs`` and those before them.

    They are the gradients of the chains' log partition sums by emission and transition scores. Given
    a word's label and all words, the label before it depends on the words up to there alone.
    """
    filtered = np.empty_like(emit)
    margin = forward_backward(emit, sizes, move, filtered)
    before = filtered[pairs - 1]
    return margin, move * (before.T @ (margin[pairs] / np.maximum(before @ move, 1e-300)))


def training_rows(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, documents: int = 4_000, most_chars: int = 20_000) -> list[tuple[str, str]]:
    """The bounded sample that ``train`` gets.

    A rate for each language leaves a few times what is wanted, so that the exact choice moves little.
    A count for each language comes to the driver.
    """
    usable = df.select(F.xxhash64(key, text).alias("place"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return []
    each = max(1, min(per_language, documents // len(counts)))
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, (4 * each + 32) / r["count"]))))
    near = usable.where(F.pmod("place", F.lit(1_000_003)) / 1_000_003 < F.try_element_at(rate, F.col("lang")))
    distinct = near.groupBy("lang", "place").agg(F.first(F.left("text", F.lit(most_chars))).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return sorted((r.text, r.lang) for r in distinct.withColumn("n", first).where(F.col("n") <= each).select("text", "lang").collect())


_latest: list[Model] = []


def current(model: Model) -> Model:
    """The model; emissions that a worker has kept for an earlier one go."""
    if _latest and _latest[0] is not model:
        _latest[0].known, _latest[0].rows, _latest[0].held = {}, None, 0
    _latest[:] = [model]
    return model


def _judge(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    words = [_words(t.lower()) if t and has_letter(t) else [] for t in texts]
    if not model.labels:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    emit, sizes = model.potentials(words)
    total = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(model.marginals(emit, sizes), axis=0)])
    ends = np.cumsum(sizes)
    mean = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)[:, None]
    best = mean.argmax(axis=1)
    score = np.clip(np.round(mean[np.arange(len(best)), best], 6), 0, 1)
    return [model.labels[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0).tolist()


def spans(model: Model, text: str | None) -> list[dict]:
    """Runs of words with one most likely label: start and end (characters), lang, mean score."""
    if not text or not has_letter(text) or not model.labels:
        return []
    lower = text.lower()
    places = [m.span() for m in _places(lower if len(lower) == len(text) else text)]
    words = [text[a:b].lower() for a, b in places]
    emit, sizes = model.potentials([words])
    odds = model.marginals(emit, sizes)
    best = odds.argmax(axis=1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": model.labels[best[a]], "score": float(odds[a:b, best[a]].mean())} for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), with_spans: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default), then lang_pred, score and on request spans.

    ``names`` renames the two columns where kept columns have these names.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kept = df.columns if keep is None else keep
    # plain names on the way through Python, whatever the columns are called
    given = df.select(F.col(text).alias("text"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)))
    made = StructType.fromDDL("lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string,score:double>>" * with_spans)
    schema = StructType([*given.schema.fields[1:], *made.fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = current(shipped.value)
        for batch in batches:
            for part in chunks(batch, 0):
                texts = part.column(0).to_pylist()
                lang, score = _judge(own, texts)
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if with_spans:
                    found.append(pa.array([spans(own, t) for t in texts], kind))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], schema.names)

    return given.mapInArrow(run, schema).toDF(*kept, *names, *["spans"] * with_spans)
