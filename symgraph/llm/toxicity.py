"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, found by a block-max inverted index.

Terms are all lower-case words of the labelled examples. A term weighs
(1 + log tf) idf relevance; relevance grows from a small floor to 1 with how surely the term marks the label among the
examples (likelihood ratio). No term is left out; the floor keeps the invented topic words, of which a text has hundreds,
from drowning the few that tell. Cosines are exact over all terms.

Examples with equal vectors share an entry with counts of both labels; entries are ordered by content, so ties are too.
The commonest terms are multiplied densely, many queries at once, in single precision. A query adds the block maxima of
its other terms to that, takes the blocks that can still reach the k-th best, and scores anew, in double precision over
all terms, what is within a margin of the k best. Votes are weighted by angular distance and drawn to the prior; their log odds are shifted so that
0.5 parts the examples best, each scored without itself. A text without any term of the examples gets the label's rate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, row_ids, slices, split_words, staged, text_of
from .quality_classifier import labelled_sample

#: Lengths of beginnings of words that are terms too; each about doubles the work.
BEGINNINGS: tuple[int, ...] = ()


def plain(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def begins(words: pa.Array, n: int) -> pa.Array:
    """The first n characters of words that have as many; else nothing."""
    return pc.if_else(pc.greater_equal(pc.utf8_length(words), n), pc.utf8_slice_codeunits(words, 0, n), pa.scalar(None, pa.string()))


def term_counts(texts: pa.Array, vocabulary: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the vocabulary's terms (words, then beginnings of each length), by text and term."""
    codes, distinct, offsets = split_words(texts)
    rows, size, at, found = row_ids(offsets), sum(map(len, vocabulary)), 0, []
    for part, n in zip(vocabulary, (None, *BEGINNINGS), strict=True):
        keys = distinct if n is None else begins(distinct, n)
        # a null key has no place
        t = pc.fill_null(pc.index_in(keys, part, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        hit = np.flatnonzero(t >= 0)
        found.append(rows[hit] * size + t[hit] + at)
        at += len(part)
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return keys // max(size, 1), keys % max(size, 1), n


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class BlockMaxIndex:
    """Postings of the entries by term and block of entries, with the largest weight of each term in each block. Terms in
    a `heavy`-th of the entries or more, the commonest first, as far as `cells` go, also have a dense row each."""

    def __init__(self, entry: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = 64, heavy: int = 16, cells: int = 4_000_000):
        self.n, self.blocks, self.block = n, max(-(-n // block), 1), block
        order = np.lexsort((entry, term))
        self.entry, term, self.weight = entry[order].astype(np.int32), term[order], weight[order].astype(np.float32)
        pair = term * self.blocks + self.entry // block
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.first = np.append(first, len(pair))
        self.of = (pair[first] % self.blocks).astype(np.int32)
        self.bound = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.terms = np.searchsorted(pair[first] // self.blocks, np.arange(n_terms + 1))
        held = np.diff(self.first[self.terms])
        often = np.argsort(-held, kind="stable")[: cells // max(n, 1)]
        self.often = often[held[often] * heavy >= max(n, 1)]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[self.often] = np.arange(len(self.often))

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of the common terms by entry; made where it is used, so it isn't sent."""
        out = np.zeros((len(self.often), self.n), np.float32)
        for i, t in enumerate(self.often.tolist()):
            part = slice(self.first[self.terms[t]], self.first[self.terms[t + 1]])
            out[i, self.entry[part]] = self.weight[part]
        return out

    def _scores(self, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        counts = self.first[pairs + 1] - self.first[pairs]
        at = _ranges(self.first[pairs], counts)
        return np.bincount(self.entry[at], np.repeat(weights, counts) * self.weight[at], self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest positive cosine, ties to the lower number: cosines, entries."""
        return next(self.nearest_of([(terms, weights)], k))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, most: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each of the queries; common terms of `most` queries are multiplied at once."""
        for at in range(0, len(queries), most):
            part = queries[at : at + most]
            q = np.zeros((len(part), len(self.often)), np.float32)
            for i, (terms, weights) in enumerate(part):
                row = self.row[terms]
                q[i, row[row >= 0]] = weights[row >= 0]
            for (terms, weights), common in zip(part, q @ self.dense, strict=True):
                yield self._best(terms, weights, common, k)

    def _best(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray, k: int, margin: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """common: the cosines' shares of the common terms in single precision, which is off by less than the margin."""
        if not self.n:
            return np.zeros(0), np.zeros(0, np.int64)
        row = self.row[terms]
        rare, w_rare, row, w_row = terms[row < 0], weights[row < 0], row[row >= 0], weights[row >= 0]
        counts = self.terms[rare + 1] - self.terms[rare]
        pairs = _ranges(self.terms[rare], counts)
        w = np.repeat(w_rare, counts)
        bounds = np.bincount(self.of[pairs], w * self.bound[pairs], self.blocks) + np.maximum.reduceat(common, np.arange(0, self.n, self.block))
        # No weight is negative, so the k-th best can only rise: blocks below it hold none of the k.
        kth = np.partition(common, self.n - k)[self.n - k] if k < self.n else 0.0
        own = (bounds + margin >= kth)[self.of[pairs]]
        rest = self._scores(pairs[own], w[own])
        about = common + rest
        kth = np.partition(about, self.n - k)[self.n - k] if k < self.n else 0.0
        at = np.flatnonzero(about >= max(kth - margin, 1e-7))
        scores = np.round(rest[at] + w_row @ self.dense[np.ix_(row, at)], 6)
        at, scores = at[scores > 0], scores[scores > 0]
        order = np.argsort(-scores, kind="stable")[:k]
        return scores[order], at[order]


def _moved(p: float, shift: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(shift - np.log(p / (1 - p)))))


def _cut(scored: list[tuple[float, int]]) -> float:
    """The log odds at which the fewest examples fall on the wrong side, in the middle of the best stretch; 0 without both labels."""
    if len({y for _, y in scored}) < 2:
        return 0.0
    p, y = np.array(sorted(scored)).T
    odds = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[odds[0] - 0.1], (odds[1:] + odds[:-1]) / 2, [odds[-1] + 0.1]])
    best = edges[wrong == wrong.min()]
    return float(np.clip((best[0] + best[-1]) / 2, -2, 2))


class Model:
    """k nearest entries of the index; see the module."""

    def __init__(self, vocabulary: list[pa.Array], weights: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, y: np.ndarray, doc_ids: np.ndarray, k: int, prior_weight: float):
        """row, term, count of the examples' terms, by row and term; y and doc_ids of the examples."""
        self.vocabulary, self.weights, self.k, self.prior_weight = vocabulary, weights, k, prior_weight
        ends = np.searchsorted(row, np.arange(len(y) + 1))
        entries: dict[bytes, list] = {}
        for i in range(len(y)):
            part = slice(ends[i], ends[i + 1])
            entries.setdefault(term[part].tobytes() + count[part].tobytes(), []).append(i)
        # Ordered by content: by the term with the largest count, which puts texts of a language together, then by all terms.
        top = {key: int(term[ends[m[0]] + np.argmax(count[ends[m[0]] : ends[m[0] + 1]])]) if key else -1 for key, m in entries.items()}
        held = [entries[key] for key in sorted((key for key in entries if key), key=lambda key: (top[key], key))]
        self.labels = np.array([[len(m) - y[m].sum(), y[m].sum()] for m in held], float).reshape(-1, 2)
        self.doc_ids = np.array([doc_ids[m].min() for m in held], np.int64)
        self.prior = (y.sum() + 0.5) / (len(y) + 1)
        size = np.array([ends[m[0] + 1] - ends[m[0]] for m in held], np.int64)
        at = _ranges(np.array([ends[m[0]] for m in held], np.int64), size) if held else np.zeros(0, np.int64)
        entry = np.repeat(np.arange(len(held)), size)
        w = self.raw(term[at], count[at])
        norm = np.sqrt(np.bincount(entry, w * w, len(held)))
        self.index = BlockMaxIndex(entry, term[at], w / norm[entry], len(held), len(weights))
        self.cache: dict[bytes, tuple[float, list]] = {}
        self.shift = 0.0

    def raw(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.weights[terms]

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text (terms, counts) the weighted share of label 1 among the nearest, their cosines and entries; leave: the labels of the texts, examples themselves, which are left out once."""
        queries = []
        for terms, counts in texts:
            w = self.raw(terms, counts)
            queries.append((terms, w / np.sqrt((w * w).sum()) if len(terms) else w))
        for i, (cosines, entries) in enumerate(self.index.nearest_of(queries, self.k + (leave is not None))):
            labels = self.labels[entries]
            if leave is not None and len(entries) and cosines[0] > 1 - 2e-6:
                labels = labels.copy()
                labels[0, leave[i]] = max(labels[0, leave[i]] - 1, 0)
            v = cosines / (0.05 + np.arccos(np.minimum(cosines, 1.0)))
            yield float((self.prior * self.prior_weight + v @ labels[:, 1]) / (self.prior_weight + v @ labels.sum(1))), cosines, entries

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        """Score and evidence of each text (terms, counts); equal ones are looked up once."""
        if len(self.cache) > 4_000:
            self.cache.clear()
        keys = [terms.tobytes() + counts.tobytes() for terms, counts in texts]
        new = {key: x for key, x in zip(keys, texts, strict=True) if key not in self.cache}
        for key, (p, cosines, entries) in zip(new, self.votes(list(new.values())), strict=True):
            self.cache[key] = (_moved(p, self.shift), [(int(self.doc_ids[e]), float(self.labels[e, 1] / self.labels[e].sum()), float(c)) for c, e in zip(cosines[:3], entries[:3], strict=True)])
        return [self.cache[key] for key in keys]


def relevance(n: np.ndarray, a: np.ndarray, n_all: int, n_yes: int, sure: float, floor: float) -> np.ndarray:
    """floor to 1 for terms in n examples, a of them of label 1: the likelihood ratio against the label's rate over `sure`, where it is above that rate."""
    rate = (n_yes + 0.5) / (n_all + 1)
    p = (a + 0.5) / (n + 1)
    gain = a * np.log(p / rate) + (n - a) * np.log((1 - p) / (1 - rate))
    return floor + (1 - floor) * np.where(p > rate, np.clip(gain / sure, 0, 1), 0)


def build(examples: pa.Table, k: int, prior_weight: float, sure: float, floor: float) -> Model:
    """The index of examples (doc_id, y, w: distinct words, n: their counts)."""
    got = examples
    y, ids = got["y"].to_numpy().astype(np.int64), got["doc_id"].to_numpy()
    lists = got["w"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    times = got["n"].combine_chunks().flatten().to_numpy().astype(np.int64)
    vocabulary, term, size = [], [], 0
    for n in (None, *BEGINNINGS):
        part = (distinct if n is None else begins(distinct, n)).dictionary_encode()
        place = pc.fill_null(part.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        names = part.dictionary
        order = pc.array_sort_indices(names).to_numpy()
        rank = np.empty(len(names) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(names)), -1
        t = rank[place][codes] if len(codes) else codes
        vocabulary.append(names.take(pa.array(order)))
        term.append(np.where(t >= 0, t + size, -1))
        size += len(names)
    del got, lists, coded
    t, r, c = np.concatenate(term), np.tile(row, len(term)), np.tile(times, len(term))
    hit = t >= 0
    keys, back = np.unique(r[hit] * max(size, 1) + t[hit], return_inverse=True)
    count = np.bincount(back, c[hit], len(keys)).astype(np.int64)
    row, term = keys // max(size, 1), keys % max(size, 1)
    n = np.bincount(term, minlength=size)
    a = np.bincount(term, y[row], size) if len(row) else np.zeros(size)
    weights = (np.log((len(y) + 1) / (n + 1)) + 1) * relevance(n, a, len(y), int(y.sum()), sure, floor)
    return Model(vocabulary, weights, row, term, count, y, ids, k, prior_weight)


class Fitted(NamedTuple):
    """A broadcast of the pickled index, and the shift of its log odds."""

    model: Broadcast
    shift: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8_000, k: int = 12, prior_weight: float = 0.5, sure: float = 20.0, floor: float = 0.03, allowed: Column | None = None) -> Fitted:
    """Learns from at most `sample` labelled rows; the index holds them all, with all their terms. Without rows every score is 0.5.

    Texts are split in tasks and the index is made in one; the driver passes it on as bytes, whose number the sample
    bounds. Examples are ordered by their texts' hashes, so ids don't matter.
    """
    rows = staged(labelled_sample(docs, labels, label, sample, allowed if allowed is not None else F.lit(True)).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "h", plain(F.col("text")).alias("text")), "examples")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, distinct, offsets = split_words(part.column("text"))
                keys, n = np.unique(row_ids(offsets) * max(len(distinct), 1) + codes, return_counts=True)
                at = np.searchsorted(keys // max(len(distinct), 1), np.arange(part.num_rows + 1))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "h")), pa.ListArray.from_arrays(at, distinct.take(pa.array(keys % max(len(distinct), 1)))), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))], names=["doc_id", "y", "h", "w", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build(pa.Table.from_batches(held), k, prior_weight, sure, floor))], pa.binary())], names=["model"])

    kind = "doc_id long, y int, h long, w array<string>, n array<int>"
    # One task for a bounded sample; the driver holds the finished index as bytes only.
    ordered = rows.mapInArrow(words, kind).repartition(1).sortWithinPartitions("h", "y")
    got = ordered.mapInArrow(learn, "model binary").toArrow()
    blob = got["model"][0].as_py() if got.num_rows else pickle.dumps(build(pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("w", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))]).empty_table(), k, prior_weight, sure, floor))
    del got
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                y = part.column("y").to_numpy()
                p = [x for x, *_ in m.votes(_grouped(part.column("text"), m.vocabulary, part.num_rows), y.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), part.column("y")], names=["p", "y"])

    left = rows.select("text", "y").mapInArrow(leave_one_out, "p double, y int").toArrow()
    return Fitted(shared, _cut(list(zip(left["p"].to_pylist(), left["y"].to_pylist(), strict=True))))


def _grouped(texts: pa.Array, vocabulary: list[pa.Array], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each text."""
    rows, terms, counts = term_counts(texts, vocabulary)
    at = np.searchsorted(rows, np.arange(n + 1)).tolist()
    return [(terms[a:b], counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def score(docs: DataFrame, model: Fitted, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, evidence (nearest examples: doc_id, share of label 1, cosine). A null text is empty and, as any text without a term of the examples, gets the label's rate. Repeated rows score alike; an empty table gives no rows."""
    shared, shift = model  # the terms of `sample` texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        m.shift = shift
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                got = m.score(_grouped(part.column("text"), m.vocabulary, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([[dict(zip(("doc_id", "share", "cosine"), e, strict=True)) for e in es] for _, es in got], kind)], names=["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(text_of()).alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:bigint,share:double,cosine:double>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence. Labels of the held fold are never used."""
    model = fit(docs, labels, allowed=crc_fold("doc_id", folds) != held, **options)
    return score(docs, model).select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", "predicted", "evidence")
