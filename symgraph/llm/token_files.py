"""Token files in directly addressable codes.

An id is split into 8-bit levels. Level 0 has a byte for each id and a bitmap that tells which ids go on; level 1 has a
byte for each of those, and so on. A rank directory (set bits before each 512-bit block) finds an id's byte on the next
level, so any token is read by a few look-ups and no block is decoded.

A file is a run of segments, one Parquet row each (Spark can write that to any store). A segment holds whole documents
in ascending order: their ids, their token offsets and the levels, all in `payload`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, staged, text_of
from .tokens import crc, encoder, with_end

MAGIC, BLOCK = b"DAC1", 512
SEGMENTS = "shard int, segment long, n_ids long, payload binary"
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(doc_ids: np.ndarray, known: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment. known: which doc_ids aren't null."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_BITS[bits], dtype=np.uint32)]).astype("<u4")[:: BLOCK // 8]
        if not more.any():
            bits = ones = np.zeros(0, np.uint8)
        levels.append((rest.astype(np.uint8), bits, ones))
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QQB", len(doc_ids), len(ids), len(levels)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(known, np.uint8).tobytes(), np.asarray(offsets, "<u8").tobytes()]
    for low, bits, ones in levels:
        out += [struct.pack("<QQQ", len(low), len(bits), ones.nbytes), low.tobytes(), bits.tobytes(), ones.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_ids, n = struct.unpack_from("<QQB", payload, 4)
        at = 21

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, count, at)
            at += x.nbytes
            return x

        self.doc_ids, self.known, self.offsets = take("<i8", self.n_docs), take("u1", self.n_docs), take("<u8", self.n_docs + 1)
        self.levels = []
        for _ in range(n):
            low, bits, ones = struct.unpack_from("<QQQ", payload, at)
            at += 24
            self.levels.append((take("u1", low), take("u1", bits), take("<u4", ones // 4)))

    def token(self, i: int) -> int:
        """The i-th id, by a look-up on each level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ones) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            rank = int(ones[block]) + int(_BITS[bits[block * BLOCK // 8 : i >> 3]].sum()) + int(_BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i = rank
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n_ids, np.uint32)
        at: np.ndarray | slice = slice(None)
        for k, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << (8 * k)
            if not len(bits):
                break
            went = np.flatnonzero(np.unpackbits(bits, count=len(low), bitorder="little"))
            at = went if k == 0 else at[went]
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end: int = 2, segment_ids: int = 500_000) -> DataFrame:
    """Encodes every text (null: empty), adds the end id, and writes segments in ascending (doc_id, hash of the text) order, null ids first.

    A range shuffle of the texts on (doc_id, hash) deals out even a single id that has most rows. Repeated rows are
    repeated. The shards are ranges in order; the returned DataFrame reads the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder, n = TaskContext.get().partitionId(), encoder(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            lens = np.concatenate([np.diff(h[2]) for h in held])
            payload = pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(lens)]), np.concatenate([h[3] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([count], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "segment", "n_ids", "payload"])

        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                ids, offsets = with_end(*coder.encode(part.column("text")), end)
                keys = part.column("doc_id")
                doc_ids, known = keys.fill_null(0).to_numpy(zero_copy_only=False), ~keys.is_null().to_numpy(zero_copy_only=False)
                at = 0
                while at < len(doc_ids):
                    upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + segment_ids - count, side="right")) - 1)
                    held.append((doc_ids[at:upto], known[at:upto], offsets[at : upto + 1], ids[offsets[at] : offsets[upto]]))
                    count += int(offsets[upto] - offsets[at])
                    at = upto
                    if count >= segment_ids or at < len(doc_ids):
                        yield flush()
                        held, count, n = [], 0, n + 1
        if held:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return staged(dealt.mapInArrow(run, SEGMENTS), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32, shard, segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, base, payload in zip(*(batch.column(k).to_pylist() for k in ("shard", "segment", "base", "payload")), strict=True):
                s = Segment(payload)
                ids, off = s.all(), s.offsets.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=s.known == 0), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array([crc(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64()), pa.array([shard] * s.n_docs, pa.int32()), pa.array([segment] * s.n_docs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"],
                )

    # Two levels of running sums: within a shard, and over the shards (as many as write tasks).
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    bases = sizes.withColumn("base", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    # Scanned where it lies: one base for each segment, bounded by the bytes of payload (about a megabyte a segment).
    return files.join(F.broadcast(bases), ["shard", "segment"]).select("shard", "segment", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment long")


def random_access(spark: SparkSession, files: DataFrame, shard: int, segment: int, i: int) -> int:
    """The i-th id of a segment; only that segment's row is read."""
    return Segment(bytes(files.filter((F.col("shard") == shard) & (F.col("segment") == segment)).select("payload").first()[0])).token(i)
