"""Media columns by content-defined chunking.

The stored form of a text is a container: a 24-byte header (magic, sample width, text bytes) and the padded payload as
8-bit samples. A gear hash over the last 32 bytes cuts it into chunks, so that texts that share passages share chunks.
Digests are counted by a Spark join: a chunk of one text only lies with its text in a private store, bucketed by the
text's key; a chunk of several texts lies once in a shared store. Reading joins both by the ordered chunk list (the
recipe) and checks every chunk and the whole container.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, staged, text_of

MAGIC, ROW = b"SAMPLES8", 576
LEVEL = 6  # of zstd, for texts on their way and in the store
_GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint32)


def container(text: bytes) -> bytes:
    """Header and payload: the bytes, then 255s up to a positive multiple of 576."""
    return MAGIC + struct.pack("<QQ", ROW, len(text)) + text + b"\xff" * ((-len(text)) % ROW if text else ROW)


def cuts(data: bytes, least: int = 512, bits: int = 11, most: int = 16_384) -> list[int]:
    """Ends of chunks of `least` to `most` bytes, after bytes where the top `bits` bits of the gear hash are 0."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over windows of 2, 4 ... 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, at, n = [], 0, len(data)
    for c in (np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1).tolist():
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least and n - c >= least:
            at = c
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    return [*ends, n]


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (sha256 of the text), digests and lengths of the container's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, digests, lengths = [], [], []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    data = container(t)
                    ends = cuts(data)
                    keys.append(hashlib.sha256(t).digest())
                    digests.append([hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends], ends)])
                    lengths.append(np.diff([0, *ends]).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], names=["doc_id", "text_key", "digests", "lengths"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, text_key binary, digests array<binary>, lengths array<int>")


def _texts(docs: DataFrame) -> DataFrame:
    """text_key and the compressed text, once for each text and task: copies are dropped before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch, "text"):
                keys, blobs = [], []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    key = hashlib.sha256(t).digest()
                    if key not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(key)
                        keys.append(key)
                        blobs.append(z.compress(t))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["text_key", "blob"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "text_key binary, blob binary")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each text's container by its recipe: a private row, and a row for each shared chunk that this text gives."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch, "blob", 1_000_000):
            keys, private, gives = [], [], []
            for key, blob, lengths, shared, given in zip(*(part.column(c).to_pylist() for c in ("text_key", "blob", "lengths", "shared", "given")), strict=True):
                data = container(z.decompress(blob))
                ends = np.cumsum(lengths).tolist()
                chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
                skip = set(shared or ())
                keys.append(key)
                private.append(b"".join(c for i, c in enumerate(chunks) if i not in skip))
                gives.append([chunks[i] for i in given or ()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(private, pa.binary()), pa.array(gives, pa.list_(pa.binary()))], names=["text_key", "private", "gives"])


def _media(key: bytes, private: bytes, digests: list[bytes], lengths: list[int], fetched: list[dict] | None) -> tuple:
    """The container by its recipe, each chunk checked, and its figures."""
    got = {x["i"]: x["bytes"] for x in fetched or ()}
    at, parts = 0, []
    for i, (digest, n) in enumerate(zip(digests, lengths, strict=True)):
        if i in got:
            chunk = got[i]
        else:
            chunk = private[at : at + n]
            at += n
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"chunk {i} of {key.hex()} is damaged")
        parts.append(chunk)
    media = b"".join(parts)
    if media[:8] != MAGIC:
        raise ValueError(f"{key.hex()} is no container")
    _, n_bytes = struct.unpack_from("<QQ", media, 8)
    payload = media[24:]
    samples = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, samples)), len(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for part in slices(batch, "private"):
            out = [_media(*row) for row in zip(*(part.column(c).to_pylist() for c in ("text_key", "private", "digests", "lengths", "fetched")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def media_columns(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Stores every text and reads it back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    feature: counts of the payload's samples by their upper four bits. A null text is empty: one row of padding. Equal
    texts are stored once and have equal values; repeated rows and null ids are returned each. An empty table gives no
    rows. Texts travel once, compressed, to their bucket; a shuffle's files go once what it fed is written.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed(spark):
        rows = staged(recipes(docs), "recipes")
    texts = rows.select("text_key", "digests", "lengths").dropDuplicates(["text_key"])
    refs = texts.select("text_key", F.posexplode("digests").alias("i", "digest"))
    # A chunk is shared if it occurs twice, be it in one text; its first place gives it.
    owners = refs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "i")).alias("owner")).filter("n > 1")
    with freed(spark):
        shared = staged(refs.join(owners, "digest").select("text_key", "i", "digest", ((F.col("owner.text_key") == F.col("text_key")) & (F.col("owner.i") == F.col("i"))).alias("gives")), "shared-chunks")
    marks = shared.groupBy("text_key").agg(F.collect_list("i").alias("shared"), F.sort_array(F.collect_list(F.when(F.col("gives"), F.col("i")))).alias("given"))
    plan = texts.select("text_key", "lengths").join(marks, "text_key", "left")
    store = _texts(docs).join(plan, "text_key").dropDuplicates(["text_key"]).select("text_key", "blob", "lengths", "shared", "given")
    name = f"media_{uuid.uuid4().hex}"
    chunks = store.mapInArrow(_store, "text_key binary, private binary, gives array<binary>")
    with freed(spark):
        chunks.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVEL)).bucketBy(buckets, "text_key").saveAsTable(name)
    stored = spark.table(name)
    # Chunks are addressed by digest, which the reader checks.
    gives = stored.filter(F.size("gives") > 0).select(F.explode("gives").alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256)))
    fetched = shared.select("text_key", "i", "digest").join(gives, "digest").groupBy("text_key").agg(F.collect_list(F.struct("i", "bytes")).alias("fetched"))
    whole = stored.select("text_key", "private").join(texts, "text_key").join(fetched, "text_key", "left").select("text_key", "private", "digests", "lengths", "fetched")
    values = whole.mapInArrow(_read, "text_key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long")
    return rows.select("doc_id", "text_key").join(values, "text_key").drop("text_key")
