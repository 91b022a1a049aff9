"""Near duplicates in a group that shares a long passage, against all pairs by the operator's own similarity."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.group import GroupedData

from symgraph.llm import near_duplicates as N
from symgraph.llm.common import split_words


def planted():
    """Texts around one passage: any two are just below 0.8, and each is near one other."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, docs = words(504), []
    for k in range(150):
        both = words(33)
        docs += [(2 * k + i, f"{passage} {both} {words(33)}") for i in range(2)]
    return docs


def classes_of_all_pairs(docs, least=0.8):
    codes, distinct, offsets = split_words(pa.array([t for _, t in docs]))
    kmers, off = N.labelled_kmers(N._hashes(distinct)[codes], offsets)
    label = np.array([i for i, _ in docs])
    for i in range(len(docs)):
        for j in range(i):
            if N.similarity(kmers[off[i] : off[i + 1]], kmers[off[j] : off[j + 1]], least) >= least:
                x, y = sorted((label[i], label[j]))
                label[label == y] = x
    return {i: int(x) for (i, _), x in zip(docs, label, strict=True)}


def test_near_pairs_around_a_passage(spark):
    docs = planted()
    expected = classes_of_all_pairs(docs)
    assert len(set(expected.values())) == 150
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"block": 64}, {"rounds": 1}):
        assert {r["doc_id"]: r["class_id"] for r in N.classes(df, **options).collect()} == expected, options


def test_shared_kmers():
    rng = np.random.default_rng(3)
    sets = [rng.choice(40, rng.integers(0, 30), replace=False).astype(np.uint64) for _ in range(12)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    got = N.shared_kmers(np.concatenate(sets), off, most=7)
    for i in range(12):
        for j in range(12):
            if i != j:
                assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_memory_of_two_blocks(spark, monkeypatch):
    """Two blocks of texts that share a passage, none alike: masks and counts of all pairs aren't held several times over."""
    rng, n = random.Random(4), 2048
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage = words(60)
    group = pa.table({
        "band": pa.array([3] * n, pa.int32()), "lo": pa.array([0] * n, pa.int32()), "hi": pa.array([1] * n, pa.int32()), "own": pa.array([k % 2 for k in range(n)], pa.int32()),
        "key": [str(k).encode() for k in range(n)], "label": [str(k).encode() for k in range(n)], "sigs": [[rng.randrange(10**9) for _ in range(12)] for _ in range(n)], "text": [f"{passage} {words(30)}" for _ in range(n)],
    })
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, run, schema: run)
    run = N.exhausted(spark.createDataFrame([], "band int, sig long, key binary, label binary"), spark.createDataFrame([], "key binary, sigs array<long>, chars int, text string"), 0.8, 1024, 8_000_000)
    tracemalloc.start()
    assert run(group).num_rows == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


def test_few_links_take_no_stars(spark, monkeypatch):
    """A path and a ring: up to `few` links are solved in one task after one write; more go through stars, with equal labels."""
    rng, names = random.Random(6), list(range(1500))
    rng.shuffle(names)
    links = [*zip(names[:999], names[1:1000], strict=True), *zip(names[1000:], [*names[1001:], names[1000]], strict=True)]
    expected = {x: min(part) for part in (names[:1000], names[1000:]) for x in part}
    df, writes = spark.createDataFrame(rng.sample(links, len(links)), "a long, b long").repartition(5), []
    monkeypatch.setattr(N, "staged_with", lambda *a, f=N.staged_with: writes.append(1) or f(*a))
    assert {r["node"]: r["label"] for r in N.components(df).collect()} == expected
    assert len(writes) == 1
    assert {r["node"]: r["label"] for r in N.tied(df).collect()} == expected
    assert {r["node"]: r["label"] for r in N.components(df, few=0).collect()} == expected
    assert all(expected[r["label"]] == expected[r["node"]] for r in N.tied(df, few=0).collect())
    assert N.components(df.limit(0)).count() == 0
