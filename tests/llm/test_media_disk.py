"""What a media store leaves on the executors' disks."""

import time

from symgraph.llm import media
from symgraph.llm.common import freed


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffles_of_the_store_are_freed(spark):
    """The texts' shuffle is gone once the store is written, and the columns can be computed again and again."""
    docs, before = spark.createDataFrame([(i, f"text {i % 40} " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(3), shuffle_files(spark)
    out = media.media_columns(docs)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    first = {r["doc_id"]: r for r in out.collect()}
    assert len(first) == 300 and first == {r["doc_id"]: r for r in out.collect()}


def test_freed_restores_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    try:
        with freed(spark):
            assert spark.conf.get(key) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key) == before
