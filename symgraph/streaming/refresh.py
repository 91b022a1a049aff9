"""Continuous refresh: new source files arrive as a stream, and each batch is folded into the manifest and the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import language_of
from ..operators.relational import first_of, manifest_delta


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """rel, face, size, hash, mtime of files as they appear below path."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + path.removeprefix("file:").strip("/") + "/", "")
    return s.select(F.coalesce(language_of(rel), F.lit("Other")).alias("face"), rel.alias("rel"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("mtime"))


def refresh(stream: DataFrame, manifest_path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Keeps the manifest current, a folder for each batch, and calls on_change with what changed (face, rel, change). A batch that is replayed writes the same folder again."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = first_of(batch, ["face", "rel"], [F.desc("mtime"), "hash"]).select("face", "rel", "size", "hash")
        before = spark.read.parquet(f"{manifest_path}/batch={number - 1}") if number else latest.limit(0)
        after = before.join(latest.select("face", "rel"), ["face", "rel"], "left_anti").unionByName(latest)
        after.write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")
        on_change(manifest_delta(before, spark.read.parquet(f"{manifest_path}/batch={number}")), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
