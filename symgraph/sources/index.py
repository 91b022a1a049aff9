"""Occurrence indexes: a Python data source for the protobuf files, and the relations read from them.

An index is a sequence of length-delimited fields; documents are field 2 of the top message (1: relative path, 2:
occurrences), occurrences have 1: range (packed), 2: symbol, 3: roles, 7: enclosing range (packed). Merged indexes are
concatenations of such files, and read the same.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.exprs import ingest_kind

SCHEMA = "leg int, doc int, occ int, relative_path string, symbol string, symbol_roles int, range array<int>, enclosing_range array<int>"


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[at]
        at += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield tag >> 3, value


def _ints(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def decode(data: bytes) -> Iterator[tuple[int, int, str, str, int, list[int], list[int]]]:
    """(doc, occ, path, symbol, roles, range, enclosing range) in scan order. An index without documents is an error."""
    n = -1
    for field, value in _fields(data):
        if field != 2:
            continue
        n += 1
        path, occurrences = "", []
        for f, v in _fields(value):
            if f == 1:
                path = v.decode()
            elif f == 2:
                occurrences.append(v)
        for i, o in enumerate(occurrences):
            symbol, roles, where, around = "", 0, [], []
            for f, v in _fields(o):
                if f == 1:
                    where += _ints(v)
                elif f == 2:
                    symbol = v.decode()
                elif f == 3:
                    roles = v
                elif f == 7:
                    around += _ints(v)
            yield n, i, path, symbol, roles, where, around
    if n < 0:
        raise ValueError("the index has no documents")


def _encode(field: int, value: bytes | int) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(field << 3) + varint(value) if isinstance(value, int) else varint(field << 3 | 2) + varint(len(value)) + value


def encode(documents: list[tuple[str, list[tuple[str, int, list[int], list[int]]]]]) -> bytes:
    """The inverse, for tests and merges: documents of (path, [(symbol, roles, range, enclosing range)])."""

    def packed(xs: list[int]) -> bytes:
        return b"".join(_encode(0, x)[1:] for x in xs)

    out = b""
    for path, occurrences in documents:
        doc = _encode(1, path.encode())
        for symbol, roles, where, around in occurrences:
            o = _encode(1, packed(where)) + _encode(2, symbol.encode()) + (_encode(3, roles) if roles else b"") + (_encode(7, packed(around)) if around else b"")
            doc += _encode(2, o)
        out += _encode(2, doc)
    return out


class IndexPartition(InputPartition):
    def __init__(self, leg: int, path: str):
        self.leg, self.path = leg, path


class IndexReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for part in options["path"].split(",") for p in (glob.glob(os.path.join(part, "*.scip")) if os.path.isdir(part) else [part]))

    def partitions(self):
        return [IndexPartition(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for row in decode(f.read()):
                doc, occ, path, symbol, roles, where, around = row
                yield (partition.leg, doc, occ, path, symbol, roles, where, around)


class IndexSource(DataSource):
    """spark.read.format("symbol_index").load(path): a file, a folder of .scip files, or several by commas, in leg order. The paths must be readable by executors' own file system; use read_index for others."""

    @classmethod
    def name(cls):
        return "symbol_index"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return IndexReader(self.options)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's binary reader, for any store; legs are numbered in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    legs = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("leg"))

    def run(batches):
        import pandas as pd

        names = ["leg", "doc", "occ", "relative_path", "symbol", "symbol_roles", "range", "enclosing_range"]
        for b in batches:
            for leg, content in zip(b["leg"], b["content"], strict=True):
                yield pd.DataFrame([(leg, d, o, p, s, r, w, a) for d, o, p, s, r, w, a in decode(bytes(content))], columns=names)

    return files.join(F.broadcast(legs), "path").select("leg", "content").mapInPandas(run, SCHEMA)  # a name for each file


def occurrences(index: DataFrame) -> DataFrame:
    """seq, symbol, rel_path, line (from 1), is_def, col of ingested symbols. seq follows (leg, document, occurrence): a stable 64-bit ordinal, not one of a partition."""
    seq = F.shiftleft(F.col("leg").cast("long"), 52) + F.shiftleft(F.col("doc").cast("long"), 26) + F.col("occ")
    o = index.filter(F.size("range") >= 3).select(seq.alias("seq"), "symbol", F.col("relative_path").alias("rel_path"), (F.col("range")[0] + 1).cast("long").alias("line"), (F.col("symbol_roles").bitwiseAND(1) == 1).alias("is_def"), F.col("range")[1].cast("long").alias("col"))
    return o.filter(ingest_kind("symbol", "rel_path").isNotNull())


def spans(index: DataFrame) -> DataFrame:
    """seq, symbol, rel_path, start_line, end_line (from 1) of function definitions with an enclosing range of 3 or 4 numbers."""
    e = F.col("enclosing_range")
    seq = F.shiftleft(F.col("leg").cast("long"), 52) + F.shiftleft(F.col("doc").cast("long"), 26) + F.col("occ")
    d = index.filter((F.col("symbol_roles").bitwiseAND(1) == 1) & F.size(e).isin(3, 4) & (ingest_kind("symbol", "relative_path") == "Function"))
    return d.select(seq.alias("seq"), "symbol", F.col("relative_path").alias("rel_path"), (e[0] + 1).cast("long").alias("start_line"), (F.when(F.size(e) == 4, F.get(e, F.lit(2))).otherwise(e[0]) + 1).cast("long").alias("end_line"))


def odd_ranges(index: DataFrame) -> DataFrame:
    """Definitions whose enclosing range has neither 0, 3 nor 4 numbers: warnings."""
    return index.filter((F.col("symbol_roles").bitwiseAND(1) == 1) & ~F.size("enclosing_range").isin(0, 3, 4)).select("relative_path", "symbol", F.size("enclosing_range").alias("n"))
