"""The pipeline against a direct version of each stage."""

import importlib.util
import math
import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir(DATA), reason="no pipeline or tables")


def test_stages(spark):
    import corpus_pipeline as P
    from symgraph.llm import quality_classifier as Q
    from symgraph.llm import secrets as S
    from symgraph.llm.common import crc_fold, staged
    from symgraph.llm.queries import tokenizer
    from symgraph.llm.tokens import Encoder

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(P.STAGES)
    run = lambda name, d: staged(stage[name](spark, d, DATA), "t")
    text = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}

    good = run("quality classifier", docs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = Q.train(docs, labels, allowed=crc_fold("doc_id", 4) != 2)
    want = {r["doc"]["doc_id"] for r in Q.scored(docs, model).collect() if r["score"] >= 0.7}
    assert set(text(good)) == want and good.columns == docs.columns
    clean = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(clean & want) >= 0.95 * len(clean)

    one = run("near duplicates", good)
    kept, before = text(one), text(good)
    sh = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in before.items()}
    jac = lambda a, b: len(sh[a] & sh[b]) / len(sh[a] | sh[b])
    for i in before:
        if i not in kept:
            assert any(jac(i, j) > 0.3 for j in kept)
    ids = sorted(kept)
    assert not any(jac(a, b) >= 0.85 for k, a in enumerate(ids) for b in ids[k + 1 :])

    masked = run("secret scan", one)
    after = text(masked)
    found = {r["doc"]["doc_id"]: r["live"] for r in S.scan(one).collect()}
    assert after.keys() == kept.keys()
    for i, t in kept.items():
        out, at = "", 0
        for s in sorted(found[i], key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out += t[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert after[i] == out + t[at:]

    mixed = run("mixing", masked)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(after) and max(times.values()) <= 2
    assert sum(n * len(after[i].split()) for i, n in times.items()) == pytest.approx(1.5 * sum(len(t.split()) for t in after.values()), rel=0.05)

    packed = stage["packing"](spark, mixed, DATA).collect()
    coder = Encoder(tokenizer())
    import pyarrow as pa

    want = Counter()
    for i, n in times.items():
        want[i] = n * (len(coder.encode(pa.array([after[i]]))[0]) + 1)
    got, seq = Counter(), {}
    for r in packed:
        got[r["doc_id"]] += r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seq) <= math.ceil(sum(want.values()) / 2048) * 1.02 + 1
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5
