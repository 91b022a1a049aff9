"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features are words and punctuation runs (case kept) and their bigrams (a word twice in a row is one and the same bigram
for all words), hashed to 2^bits, each valued count / sqrt(number
of n-grams). Fitting takes a bounded sample of labelled rows (`sample`, those of the smallest hash of the id); scoring
takes every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, slices, split_words, text_of

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The bigram of any word with itself.
_SAME = np.uint64(0x5A3E)


def separated(text: Column) -> Column:
    """Punctuation runs set off as words of their own."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s]+)", " $1 ")


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, then hashed bigrams, of each text, and each text's offsets."""
    codes, distinct, offsets = split_words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)[codes]
    n = np.diff(offsets)
    pair = (h[:-1] * _MIX) ^ np.roll(h, -1)[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair[h[:-1] == h[1:]] = _SAME
    inside = np.ones(len(h), bool)
    inside[offsets[1:][n > 0] - 1] = False
    out_n = n + np.maximum(n - 1, 0)
    ends = np.cumsum(out_n)
    out = np.empty(int(ends[-1]), np.uint64)
    starts = ends - out_n
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - offsets[:-1][row]
    out[starts[row] + at] = h
    two = np.flatnonzero(inside)
    out[starts[row[two]] + n[row[two]] + at[two]] = pair[two]
    return ((out * _MIX) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], ends])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, epochs: int = 5, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: distinct hashed features of each example and their values."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias, bias_n = float(np.log(prior / (1 - prior))), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = p - y[k]
            gi = g * x
            n[i] = ni + gi * gi
            z[i] = zi + gi - (np.sqrt(n[i]) - np.sqrt(ni)) / alpha * w
            bias_n += g * g
            bias -= 0.05 * g / (1 + bias_n) ** 0.5
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, allowed: Column) -> DataFrame:
    """doc_id, y, h, text of at most `sample` rows: those of the smallest hash of the id; h is the hash of the text.

    Null labels and ids don't count; of several labels of an id the majority holds, ties to 1; of several rows with one
    id the text with the smallest hash counts. An empty table or no labels give no rows.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.h", "t.text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8_000, bits: int = 18, allowed: Column | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt in one task from at most `sample` rows in the order of their texts' hashes; without rows all are 0.

    Tasks hash the texts; only 2^bits weights come to the driver.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f, off = features(part.column("text"), bits)
                found = [np.unique(f[a:b], return_counts=True) for a, b in zip(off[:-1], off[1:], strict=True)]
                at = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]), pa.int32())
                i = np.concatenate([i for i, _ in found]).astype(np.int32)
                x = np.concatenate([c / max(c.sum(), 1) ** 0.5 for _, c in found]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.ListArray.from_arrays(at, pa.array(i)), pa.ListArray.from_arrays(at, pa.array(x))], names=["h", "y", "i", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            i, x, off = batch.column("i").values.to_numpy(), batch.column("x").values.to_numpy(), batch.column("i").offsets.to_numpy()
            rows += [(i[a:b], x[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            y.append(batch.column("y").to_numpy())
        if rows:
            weights, bias = fit_ftrl(rows, np.concatenate(y), bits)
            yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float32())), pa.array([bias])], names=["w", "bias"])

    found = labelled_sample(docs, labels, label, sample, allowed if allowed is not None else F.lit(True)).select("h", "y", separated(F.col("text")).alias("text"))
    # One task for a bounded sample; the order makes the result independent of partitions.
    ordered = found.mapInArrow(hashed, "h long, y int, i array<int>, x array<float>").repartition(1).sortWithinPartitions("h", "y")
    got = ordered.mapInArrow(learn, "w array<float>, bias double").toArrow()
    if not got.num_rows:
        return np.zeros(1 << bits, np.float32), 0.0
    return got["w"].combine_chunks().flatten().to_numpy().astype(np.float32), got["bias"][0].as_py()


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Every row of docs as struct `doc`, and its score (0 to 1). A null or empty text scores by the bias alone; repeated rows score alike; an empty table gives no rows."""
    weights, bias = model
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits floats, whatever the corpus
    rows = docs.select(separated(text_of()).alias("text"), F.struct("*").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                f, off = features(part.column("text"), bits)
                sums = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
                x = (sums[off[1:]] - sums[off[:-1]]) / np.sqrt(np.maximum(np.diff(off), 1)) + bias
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=["doc", "score"])

    return rows.mapInArrow(run, rows.select("doc", F.lit(0.0).alias("score")).schema)


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold; none of an empty table."""
    return scored(docs, model).filter(F.col("score") >= threshold).select("doc.*")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of the held fold are never used."""
    model = train(docs, labels, allowed=crc_fold("doc_id", folds) != held, **options)
    rows = scored(docs.select("doc_id", "text"), model).select(F.col("doc.doc_id").alias("doc_id"), "score")
    return rows.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
