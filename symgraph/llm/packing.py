"""Packing of token pieces into sequences of a fixed length.

The plan is made on the histogram of lengths (at most `capacity` distinct ones, whatever the corpus), not on rows:
Martello-Toth dominance fixes sets in bulk, and what is left goes best-fit, longest first. A plan is a list of
placements "`n` pieces of this length, from this rank on, go into the sequences from `bin` on, at this offset"; pieces
find theirs by their rank among the pieces of the same length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, text_of
from .tokens import crc, encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Placement = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Placement]:
    """Placements (length, first rank, pieces, first bin, offset). Work and result depend on the distinct lengths only.

    Dominance, for the longest item left, with room r = capacity - length:
    - nothing left fits r: the item alone;
    - an item of exactly r is left: that pair (any set with the item can give its others for the one of size r);
    - no two items left fit r together: the item and the largest that fits;
    - no three fit, and the largest single that fits is at least as large as any pair that fits: the same.
    Items to which none applies stay; when all sizes were tried, they go best-fit.
    """
    left = {k: n for k, n in histogram.items() if n}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is out of range")
    used = dict.fromkeys(left, 0)
    out: list[Placement] = []
    bins = 0

    def take(length: int, n: int, at: int, offset: int) -> None:
        out.append((length, used[length], n, at, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
            sizes.pop(bisect_left(sizes, length))

    def fixed(big: int) -> int | None:
        """The mate that provably serves an item of this size best (0: none fits), or None."""
        room = capacity - big
        mates = [s for s in sizes[: bisect_left(sizes, room + 1)] if s != big or left[s] > 1]
        if not mates:
            return 0
        count = lambda s: left[s] - (s == big)
        best = mates[-1]
        least = [s for s in mates[:3] for _ in range(min(3, count(s)))][:3]
        if best == room or len(least) < 2 or least[0] + least[1] > room:
            return best
        if len(least) == 3 and sum(least) <= room:
            return None
        pair, j = 0, len(mates) - 1
        for i, x in enumerate(mates):
            while j >= 0 and (x + mates[j] > room or j == i and count(x) < 2):
                j -= 1
            if j < 0:
                break
            pair = max(pair, x + mates[j])
        return best if best >= pair else None

    sizes = sorted(left)
    for big in sizes[::-1]:
        while big in left and (mate := fixed(big)) is not None:
            n = left[big] if not mate else left[big] // 2 if mate == big else min(left[big], left[mate])
            take(big, n, bins, 0)
            if mate:
                take(mate, n, bins, big)
            bins += n
    sizes = sorted(left)
    spaces: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def space(room: int, at: int, n: int) -> None:
        if room and n:
            if room not in spaces:
                spaces[room] = []
                order.insert(bisect_left(order, room), room)
            spaces[room].append((at, n))

    while sizes:
        big = sizes[-1]
        while left.get(big):
            k = bisect_left(order, big)
            if k < len(order):
                room = order[k]
                at, n = spaces[room].pop()
                if not spaces[room]:
                    del spaces[room]
                    order.pop(k)
            else:
                each = capacity // big
                room, at, n = capacity, bins, -(-left[big] // each)
                bins += n
            m = min(n, left[big])
            take(big, m, at, capacity - room)
            space(room - big, at, m)
            space(room, at + m, n - m)
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0) -> DataFrame:
    """A narrow row for each piece, no ids. Documents over the capacity are cut; their first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                ids, offsets = with_end(*coder.encode(part.column("text")), end)
                lens = np.diff(offsets)
                pieces = -(-lens // capacity)
                doc = np.repeat(np.arange(len(lens)), pieces)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = lens - (pieces - 1) * capacity
                start = np.where(no == 0, 0, first[doc] + (no - 1) * capacity)
                length = np.where(no == 0, first[doc], capacity)
                at = offsets[doc] + start
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(no, pa.int32()), pa.array(start), pa.array(length), pa.array([crc(ids[a : a + n]) for a, n in zip(at, length, strict=True)], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset. A table of lengths that were counted beforehand must be stable: it is read three times.

    Ranks among pieces of one length are taken within salts and shifted by the counts of earlier salts, so that a length
    which a third of all pieces share is dealt over many tasks. Equal rows are interchangeable; any order of them gives
    the same result.
    """
    spark = pieces.sparkSession
    salts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    placed = spark.createDataFrame(plan(histogram, capacity), "length long, first long, n long, bin long, offset long")
    shift = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("in_salt", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)))
    ranked = ranked.join(shift, ["length", "salt"]).withColumn("rank", F.col("in_salt") + F.col("before") - 1)
    # The plan has a few rows for each of at most `capacity` lengths, whatever the corpus.
    p = F.broadcast(placed.withColumnRenamed("length", "of"))
    found = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return found.select(*key, (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Packs every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone; a null doc_id stays null; repeated rows are packed each. An
    empty table gives no rows. Texts are read and encoded once; from then on only narrow rows move.
    """
    return pack_pieces(staged(token_pieces(docs, tokenizer, capacity, end), "pieces"), capacity)
