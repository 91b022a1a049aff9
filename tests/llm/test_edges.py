"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import importlib.util
import os

import pytest
from pyspark.sql import functions as F

from symgraph.llm import media, mixing, near_duplicates, packing, quality_classifier, quality_rules, recurrent_lm, secrets, token_files, toxicity
from symgraph.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, h string, key string, uid long, text_key string, label int, copies int"
LONG = " ".join(f"w{i % 997} AKIA{'A1' * 8}" if i % 5000 == 0 else f"w{i % 997}" for i in range(30_000))


def rows():
    t = "The quick brown fox jumps over the lazy dog and runs far away from here today. " * 8
    base = [(1, t), (2, t), (2, t), (3, None), (4, ""), (None, "a null id with a few words"), (5, " \n\t "), (6, LONG), (7, "one"), (8, "password: hunter2hunter2 and é ü 中"), (None, None)]
    return [(i, x, None if k == 1 else "en", None if k in (0, 3) else f"s{k % 2}", None, 7, 0.5, "h", "k", 1, "t", 1, 9) for k, (i, x) in enumerate(base)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (7, 1, None), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda d, y: packing.pack_documents(d, tokenizer()),
    "toxicity": lambda d, y: toxicity.classify(d, y),
    "lm": lambda d, y: recurrent_lm.lm_scores(d),
    "mix": lambda d, y: mixing.mix(d, ["doc_id"]),
    "secrets": lambda d, y: secrets.digests(secrets.scan(d)),
    "rules": lambda d, y: quality_rules.rules(d),
    "media": lambda d, y: media.media_columns(d),
    "near": lambda d, y: near_duplicates.classes(d),
    "tokens": lambda d, y: token_files.read_token_files(token_files.write_token_files(d, tokenizer())),
    "classifier": lambda d, y: quality_classifier.classify(d, y),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(edge, labelled, name):
    got = OPERATORS[name](edge, labelled).collect()
    if name != "pack":
        assert len(got) == len(rows())
        assert sum((r["doc"] if name == "mix" else r)["doc_id"] is None for r in got) == 2
    else:
        assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    for r in got:
        if "score" in r.__fields__ and name != "lm":
            assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(edge, labelled, name):
    assert OPERATORS[name](edge.limit(0), labelled).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "classifier"])
def test_no_labels(edge, labelled, name):
    assert OPERATORS[name](edge, labelled.limit(0)).count() == len(rows())


def test_defined_results(edge, labelled):
    packed = {(r["doc_id"], r["piece"]): r for r in OPERATORS["pack"](edge, labelled).filter("doc_id is not null").collect()}
    assert packed[(3, 0)]["length"] == packed[(4, 0)]["length"] == 1
    assert max(r["length"] for r in packed.values()) == 2048
    near = {r["doc_id"]: r for r in OPERATORS["near"](edge, labelled).collect()}
    assert near[1]["class_id"] == near[2]["class_id"] == 1 and near[1]["class_size"] == 3
    assert near[3]["class_id"] == near[4]["class_id"] == near[5]["class_id"] == 3
    mixed = OPERATORS["mix"](edge, labelled).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed)
    rules = {r["doc_id"]: r for r in OPERATORS["rules"](edge, labelled).collect()}
    assert not rules[3]["kept"] and rules[3]["base_failed"] and rules[3]["n_words"] == 0
    lm = {r["doc_id"]: r for r in OPERATORS["lm"](edge, labelled).collect()}
    assert lm[3]["n_tokens"] == 1 and lm[4]["score"] == lm[3]["score"]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_on_edges(spark, edge, labelled, tmp_path):
    import corpus_pipeline as P

    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, edge.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
        assert (P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0) == (docs.limit(1).count() == 0)
