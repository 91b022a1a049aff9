"""The language model's own words follow the training counts."""

import zlib

import numpy as np

from symgraph.llm import recurrent_lm as L


def test_words_make_up_the_share(spark):
    table = spark.createDataFrame([(f"w{i:05}", 2) for i in range(5000)], "word string, c long")
    counts = L.Counts(table, 100, 0.8)
    assert counts.needed == 4000 and len(counts.vocabulary) >= 4000


def test_classes_cost_least():
    c = 1e6 / np.arange(1, 5001)
    bounds = L.class_bounds(c)
    assert bounds[0] == 0 and bounds[-1] == 5000 and (np.diff(bounds) > 0).all()
    p = c / c.sum()
    cost = lambda b: len(b) - 1 + (np.add.reduceat(p, b[:-1]) * np.diff(b)).sum()
    assert cost(bounds) < 0.75 * cost(np.append(np.arange(0, 5000, 71), 5000))


def test_order_of_less_frequent_words_counts(spark):
    """Words of rank 2,000 and more among 3,000 are seen by the network, so their order changes the score."""
    words = [f"w{i:05}" for i in range(3000)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    train = [i for i in range(200) if fold(i) != 1][:60]
    held = [i for i in range(200) if fold(i) == 1][:2]
    docs = [(i, " ".join(words[k % 20 :: 20])) for k, i in enumerate(train)] + [(held[0], " ".join(words[2000:2040])), (held[1], " ".join(words[2039:1999:-1]))]
    got = {r["doc_id"]: r for r in L.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).filter("held_out").collect()}
    a, b = got[held[0]], got[held[1]]
    assert abs(a["base_score"] - b["base_score"]) < 1e-6 and abs(a["score"] - b["score"]) > 1e-3


def test_training_carries_state_through_a_document():
    class Net:
        hidden, calls = 2, []

        def window(self, xs, ys, h, rate, floor, news):
            self.calls.append((h[:, 0].tolist(), np.concatenate(xs).tolist(), np.concatenate(ys).tolist(), [len(n) for n in news]))
            return h + 1, 0.0

    net, n = Net(), 1300
    ids = np.arange(n + 40)
    L.train_lanes(net, ids, np.array([0, n, n + 40]), 32, 0.1, 1, tokens=32)
    assert [h for h, *_ in net.calls] == [[k] for k in range(42)]
    assert sum((y for *_, y, _ in net.calls), []) == ids.tolist()
    assert sum((x for _, x, *_ in net.calls), []) == [0, *range(n + 39)]
    assert np.flatnonzero(sum((k for *_, k in net.calls), [])).tolist() == [0, n]


def test_lanes_hold_each_document_once():
    n = np.random.default_rng(0).integers(1, 300, 500)
    lanes = L.dealt_lanes(np.concatenate([[0], np.cumsum(n)]), 1000)
    assert sorted(d for ds in lanes for d in ds) == list(range(500))
    sizes = [sum(n[d] for d in ds) for ds in lanes]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 300 and len(lanes) == n.sum() // 1000
