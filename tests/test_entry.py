import re

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["caller", "n_sites", "first_seq"] and df.count() > 0


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_core_stands_alone():
    import pathlib

    root = pathlib.Path(E.__file__).parent
    for p in (root / "symgraph").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
