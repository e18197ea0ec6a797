"""Operator 6: language of text by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features (hashed), a chain of learned transitions ties
neighbours, and forward-backward gives every word's distribution, so that code-switched text gets its
languages word by word. A document's language is the one with the largest mean over its words.

Training maximises the conditional likelihood by AdaGrad on the driver, on at most ``SAMPLE`` documents
of at most ``SAMPLE_CHARS`` characters, those with the least hashes of their ids among all that may be
learned from. Documents of the sample are strung together, so that transitions between languages are
seen. Prediction reads whole texts and runs over all words; a task holds one block of texts.

Defined cases: a null text and one without a letter is ``und`` with score 0; with nothing to learn
from every text is ``und``; ties go to the first language in order of name; repeated rows are judged alike;
empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Block, Hasher, column, mix64, slices

#: The most documents a model is fitted on, and their most characters.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
UNKNOWN = "und"
_BUCKETS = 1 << 16
_EPOCHS, _RATE, _L2 = 2, 0.3, 1e-6
_STRUNG, _BATCH = 3, 24
_BLOCK_BYTES = 12_000_000

_HASH = Hasher(6)
#: Words are runs of letters; bytes of other scripts count as letters.
_APART = np.ones(256, bool)
_APART[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


class _Words:
    """The words of some texts, their distinct forms and the forms' features."""

    def __init__(self, texts: pa.Array) -> None:
        self.block = b = Block(texts, lower=True, apart=_APART)
        h = _HASH.words(b.data, b.starts, b.ends)
        _, first, self.form = np.unique(h, return_index=True, return_inverse=True)
        size = (b.ends - b.starts)[first]
        # forms one after the other, each between two zero bytes
        ends = np.cumsum(size + 2)
        begin = ends - size - 2
        data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        data[np.repeat(begin + 1, size) + inner] = b.data[np.repeat(b.starts[first], size) + inner]
        wide = data.astype(np.uint64)
        owner = np.repeat(np.arange(len(first)), size + 2)
        feats, owners = [], []

        def add(kind: int, value: np.ndarray, of: np.ndarray) -> None:
            feats.append(mix64(value + (np.uint64(kind) << np.uint64(56))) & np.uint64(_BUCKETS - 1))
            owners.append(of)

        last = ends - 1
        pairs = wide[:-1] << np.uint64(8) | wide[1:]
        inside = owner[:-1] == owner[1:]
        add(2, pairs[inside], owner[:-1][inside])  # with the edges these are affixes of one letter too
        triples = pairs[:-1] << np.uint64(8) | wide[2:]
        inside = owner[:-2] == owner[2:] if len(owner) > 2 else np.zeros(0, bool)
        add(3, triples[inside], owner[:-2][inside])
        for n in (3, 4):  # longer affixes
            ok = np.flatnonzero(size >= n)
            head, tail = np.zeros(len(ok), np.uint64), np.zeros(len(ok), np.uint64)
            for k in range(n):
                head = head << np.uint64(8) | wide[begin[ok] + 1 + k]
                tail = tail << np.uint64(8) | wide[last[ok] - n + k]
            add(10 + n, head, ok)
            add(20 + n, tail, ok)
        add(1, h[first] >> np.uint64(8), np.arange(len(first)))  # the lexicon
        self.forms = len(first)
        self.feature = np.concatenate(feats).astype(np.int64)
        self.owner = np.concatenate(owners)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores of the words, from those of their forms."""
        out = np.column_stack([np.bincount(self.owner, weights=weights[self.feature, k], minlength=self.forms) for k in range(weights.shape[1])])
        return out[self.form].astype(np.float32)


class _Chain:
    """Forward-backward over many sequences at once, step by step, longest sequences first."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        #: Sequences with a word at each step; words are laid out by step.
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        starts = (np.cumsum(lengths) - lengths)[self.order]
        rank = np.arange(int(self.offset[-1])) - np.repeat(self.offset[:-1], self.active)
        step = np.repeat(np.arange(steps), self.active)
        #: Where each word of the layout stands in the input.
        self.word = starts[rank] + step

    def posteriors(self, emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's distribution, and the expected count of each transition."""
        e = emissions[self.word]
        e = np.exp(e - e.max(1, keepdims=True)) + np.float32(1e-30) if len(e) else e
        t = np.exp(transitions).astype(np.float32)
        forward, backward = np.empty_like(e), np.ones_like(e)
        for s, n in enumerate(self.active.tolist()):
            at = self.offset[s]
            a = e[at : at + n] if not s else (forward[self.offset[s - 1] : self.offset[s - 1] + n] @ t) * e[at : at + n]
            forward[at : at + n] = a / a.sum(1, keepdims=True)
        expected = np.zeros_like(t, dtype=np.float64)
        for s in range(len(self.active) - 2, -1, -1):
            at, after, n = self.offset[s], self.offset[s + 1], int(self.active[s + 1])
            right = e[after : after + n] * backward[after : after + n]
            b = right @ t.T
            a = forward[at : at + n]
            joint = (a / (a * b).sum(1, keepdims=True)).T @ right
            expected += joint * t
            backward[at : at + n] = b / b.sum(1, keepdims=True)
        p = forward * backward
        p /= p.sum(1, keepdims=True)
        out = np.empty_like(p)
        out[self.word] = p
        return out, expected


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray

    def words(self, texts: pa.Array) -> tuple[_Words, np.ndarray]:
        """The words of the texts and each one's distribution over the languages."""
        w = _Words(texts)
        p, _ = _Chain(np.diff(w.block.first)).posteriors(w.emissions(self.weights), self.transitions)
        return w, p

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        w, p = self.words(texts)
        b = w.block
        count = np.diff(b.first)
        mean = np.column_stack([np.bincount(b.doc, weights=p[:, k], minlength=b.n) for k in range(len(self.languages))]) / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        names = [self.languages[k] for k in best]
        score = np.clip(mean[np.arange(b.n), best], 0, 1)
        ascii_letters = np.concatenate([[0], np.cumsum((b.data >= 97) & (b.data <= 122))])
        for i in np.flatnonzero(np.diff(ascii_letters[b.offsets]) == 0):
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score


def train(texts: list[str], languages: list[str], seed: int = 0) -> Model:
    """Fit weights and transitions; documents of the list are strung together a few at a time."""
    names = tuple(sorted(set(languages)))
    if not names:
        return Model((), np.zeros((_BUCKETS, 0), np.float32), np.zeros((0, 0)))
    gold_of = np.array([names.index(x) for x in languages])
    weights, transitions = np.zeros((_BUCKETS, len(names))), np.zeros((len(names), len(names)))
    squares, t_squares = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(_EPOCHS):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // _BATCH)):
            w = _Words(pa.array([texts[i] for i in rows]))
            count = np.diff(w.block.first)
            if not count.sum():
                continue
            gold = np.repeat(gold_of[rows], count)
            lengths = np.add.reduceat(count, np.arange(0, len(count), _STRUNG))
            p, expected = _Chain(lengths).posteriors(w.emissions(weights), transitions)
            p[np.arange(len(p)), gold] -= 1
            per_form = np.column_stack([np.bincount(w.form, weights=p[:, k], minlength=w.forms) for k in range(len(names))])
            slope = np.column_stack([np.bincount(w.feature, weights=per_form[w.owner, k], minlength=_BUCKETS) for k in range(len(names))])
            slope = slope / len(p) + _L2 * weights
            squares += slope**2
            weights -= _RATE * slope / np.sqrt(squares)
            joined = np.ones(len(gold), bool)
            joined[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # the first word of a string has none before it
            seen = np.zeros_like(transitions)
            np.add.at(seen, (gold[:-1][joined[1:]], gold[1:][joined[1:]]), 1)
            slope = (expected - seen) / len(p) + _L2 * transitions
            t_squares += slope**2
            transitions -= _RATE * slope / np.sqrt(t_squares)
    return Model(names, weights.astype(np.float32), transitions)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of the documents that are not held out."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rank = F.xxhash64("doc_id")
    # first the hashes alone, then the texts below the last of them
    least = usable.select(rank.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h
    rows = usable.filter(rank <= least).select("doc_id", "text", "lang").limit(sample).collect() if least is not None else []
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: _BUCKETS rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BLOCK_BYTES):
                names, score = shared.value.predict(column(part, "text"))
                yield pa.record_batch([column(part, "doc_id"), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
