"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is hashed into at most `blocks` blocks, permuted by a seeded hash. A source whose target is at least its
size gives all blocks once and the rest of the target as second copies; the last block needed is cut between documents.
A tree then halves the exact block quotas of all sources, each left child's share drawn without replacement
(multivariate hypergeometric), down to one leaf for each output shard; a leaf gets disjoint runs of each source's
permuted blocks and is shuffled locally by `order_key`.

DataFrame operations only. The driver sees one row for each source and holds sources x shards quotas. Plans are made on
narrow rows; texts move once, to their shard.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, staged, text_of, whole

SEED = 20_011


def shard_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """quotas[s] blocks of each source s, dealt over the shards: a row for each shard. Sums are exact both ways: sources by quota, shards within one block."""
    rng = np.random.default_rng(seed)
    level = [np.array(quotas, np.int64)]
    parts = [shards]
    while any(p > 1 for p in parts):
        above, counts, level, parts = level, parts, [], []
        for q, p in zip(above, counts, strict=True):
            if p == 1:
                level.append(q)
                parts.append(1)
                continue
            half = p // 2
            total = int(q.sum())
            # marginals: a hypergeometric draw for each source in turn, whatever the totals
            left = rng.multivariate_hypergeometric(q, total * half // p, method="marginals") if total else q * 0
            level += [left, q - left]
            parts += [half, p - half]
    return [x.tolist() for x in level]


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (skey, source_size) with target: `share` of all sizes by weight, at most `most` times the size, the excess reshared.

    A source is at its cap exactly if its cap by weight lies below the final level, so the level is found by one pass in
    the order of cap by weight. One row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey"))
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("weight", F.sum("w").over(everything))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.col("weight") - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    w = w.withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    w = w.withColumn("level", F.max("fits").over(everything))
    return w.select("skey", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _placed(docs: DataFrame, blocks: int, seed: int) -> list[Column]:
    h = F.xxhash64(F.lit(seed), docs["doc_id"], docs["source"])
    return [_key(docs["source"]).alias("skey"), h.alias("h"), F.pmod(h, F.lit(blocks)).cast("int").alias("block")]


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, shards: int, seed: int) -> DataFrame:
    """For each block with rows: skey, block, source_size, target, whole, words, part and the shards of its first and second copy. At most `blocks` rows for each source."""
    if not 0 < share <= most <= 2:
        raise ValueError("0 < share <= most <= 2")
    spark = rows.sparkSession
    held = rows.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    held = staged(held, "mix-blocks")  # at most `blocks` rows for each source
    target = targets(held.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, most)
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "skey", "block"), "block")
    plan = held.join(target, "skey").withColumn("whole", (F.col("target") >= F.col("source_size")).cast("int"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("upto", F.sum("words").over(permuted)).withColumn("no", F.row_number().over(permuted))
    plan = plan.withColumn("part", F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.col("need") - F.col("upto") + F.col("words"))))
    # Drawn blocks of a source: its whole pass, then the drawn ones of the partial pass, each pass in permuted order.
    plan = plan.withColumn("drawn", (F.col("part") > 0).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy("skey")))
    plan = staged(plan.select("skey", "block", "source_size", "target", "whole", "words", "part", "drawn", "no", "n"), "mix-plan")
    quotas = {r["skey"]: r["q"] for r in plan.groupBy("skey").agg(F.sum(F.col("whole") + F.col("drawn")).alias("q")).orderBy("skey").collect()}
    dealt = shard_quotas(list(quotas.values()), shards, seed) if quotas else []
    ends = [[k, np.cumsum([d[i] for d in dealt]).tolist()] for i, k in enumerate(quotas)]
    leaves = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"skey": k, "ends": e} for k, e in ends])), "array<struct<skey:string,ends:array<bigint>>>")).alias("x")).select("x.*")
    leaf = lambda at: F.size(F.filter("ends", lambda e: e < at))  # noqa: E731  the at-th drawn block (from 1) of a source
    return plan.join(leaves, "skey").select("skey", "block", "source_size", "target", "whole", "words", "part", F.when(F.col("whole") == 1, leaf(F.col("no"))).alias("shard_1"), F.when(F.col("drawn") == 1, leaf(F.col("whole") * F.col("n") + F.col("no"))).alias("shard_2"))


def _last(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the blocks that are cut (one for each source at most), with `second`: whether their middle lies within what is needed."""
    cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    inside = Window.partitionBy("skey", "block").orderBy("h", "x").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(plan.filter(cut), ["skey", "block"])
    return found.withColumn("before", F.sum("size").over(inside) - F.col("size")).withColumn("second", (F.col("before") + F.col("size") / 2 <= F.col("part")).cast("int")).drop("before")


def _shards() -> Column:
    return F.array_compact(F.array("shard_1", F.when(F.col("second") == 1, F.col("shard_2"))))


def mix(docs: DataFrame, carried: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, blocks: int = 4096, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Every row of docs (as struct `doc` of the carried columns) with size, source_size, target, copies, taken, shards (of each copy) and order_key.

    Size is the number of words between ASCII white space; a null text has none, a null source is a source of its own
    and the last, a null id hashes as such. Repeated rows hash alike and are taken alike, but within the last block
    their order is arbitrary and without effect on what is returned for them together. An empty table gives no rows.
    `most` may be at most 2. Carry narrow columns: they are staged and joined with the plan.
    """
    rows = docs.select(whole(carried).alias("doc"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("x"), *_placed(docs, blocks, seed))
    rows = staged(rows, "mix")  # texts are read and counted once
    plan = _plan(rows, weights, share, most, shards, seed)
    cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    found = rows.join(plan.filter(~cut), ["skey", "block"]).withColumn("second", (F.col("part") > 0).cast("int"))
    found = found.unionByName(_last(rows, plan))
    copies = F.col("whole") + F.col("second")
    return found.select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), _shards().alias("shards"), F.xxhash64(F.lit(seed + 2), "h").alias("order_key"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, blocks: int = 4096, shards: int = 16, seed: int = SEED, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The mix itself: the rows of docs as often as they are taken, by shard and in shuffled order within one.

    An empty table gives none. The plan (a row for each block) is sent to all tasks if it has at most `broadcast_rows`
    rows and joined by a shuffle beyond. Of a cut block it holds the last (hash, hash of the row) that is taken twice;
    rows that are equal to the one at the cut are alike, so one of them stands for all.
    """
    names = docs.columns
    x = F.xxhash64(*map(column, names)).alias("x")
    rows = staged(docs.select(F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), x, *_placed(docs, blocks, seed)), "mix")
    plan = _plan(rows, weights, share, most, shards, seed)
    key = F.struct("h", "x")
    same = _last(rows, plan).groupBy("skey", "block", "h", "x").agg(F.count("*").alias("n"), F.sum("second").alias("m"))
    split = (F.col("m") > 0) & (F.col("m") < F.col("n"))
    ends = same.groupBy("skey", "block").agg(F.max(F.when(F.col("m") == F.col("n"), key)).alias("upto"), F.max(F.when(split, F.struct("h", "x", "n", "m"))).alias("tie"))
    plan = staged(plan.join(ends, ["skey", "block"], "left"), "mix-plan")
    n, ties = plan.agg(F.count("*"), F.count("tie")).first()
    found = docs.select(whole(names).alias("doc"), x, *_placed(docs, blocks, seed)).join(F.broadcast(plan) if n <= broadcast_rows else plan, ["skey", "block"])
    cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    tied = F.coalesce((F.col("tie.h") == F.col("h")) & (F.col("tie.x") == F.col("x")), F.lit(False))
    wide = ["doc", "h", "shard_1", "shard_2", "second"]
    out = found.withColumn("second", F.when(cut, F.coalesce((key <= F.col("upto")).cast("int"), F.lit(0))).otherwise((F.col("part") > 0).cast("int")))
    if ties:
        alike = found.filter(tied).groupBy("skey", "h", "x").agg(*(F.first(c).alias(c) for c in ("doc", "shard_1", "shard_2", "tie")))
        alike = alike.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("tie.n")))).withColumn("second", (F.col("no") <= F.col("tie.m")).cast("int"))
        out = out.filter(~tied).select(*wide).unionByName(alike.select(*wide))
    out = out.select("doc", F.explode(_shards()).alias("shard"), F.xxhash64(F.lit(seed + 2), "h").alias("order_key"))
    return out.repartition("shard", F.pmod("order_key", F.lit(64))).sortWithinPartitions("shard", "order_key").select("doc.*")
