"""Selection among candidates of one name: qualified methods, collapse of twins and scope chains, paths, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import descriptors as D
from .relational import ordered_mode


def qualified_select(candidates: DataFrame, frames: DataFrame, key: str = "frame") -> DataFrame:
    """frames (key, receiver, method, trait) with the one candidate (key, symbol) whose impl head has both receiver and trait.

    outcome: unique, qualifier_no_hit, qualifier_ambiguous or qualifier_unverified. An impl head that doesn't parse could
    be the wanted one unless its receiver is another, so it forbids any verdict.
    """
    c = candidates.select(key, "symbol", D.impl_head(D.descriptor_region("symbol")).alias("h"))
    j = frames.join(c.hint("merge"), key, "left")  # many candidates are small on disk, so Spark would send them to every task
    match = F.coalesce((F.col("h.state") == "valid") & (F.col("h.receiver") == F.col("receiver")) & F.array_contains("h.traits", F.col("trait")), F.lit(False))
    shadow = F.coalesce((F.col("h.state") == "malformed") & (F.col("h.receiver").isNull() | (F.col("h.receiver") == F.col("receiver"))), F.lit(False))
    per = j.groupBy(*frames.columns).agg(F.count_if(match).alias("n"), F.max(shadow).alias("shadow"), F.min(F.when(match, F.col("symbol"))).alias("hit"), F.count("symbol").alias("n_candidates"))
    outcome = F.when((F.col("n") <= 1) & F.col("shadow"), "qualifier_unverified").when(F.col("n") == 1, "unique").when(F.col("n") == 0, "qualifier_no_hit").otherwise("qualifier_ambiguous")
    return per.select(*frames.columns, outcome.alias("outcome"), F.when(outcome == "unique", F.col("hit")).alias("symbol"), "n_candidates")


def collapse(candidates: DataFrame, frames: DataFrame, key: str = "frame") -> DataFrame:
    """frames (key, full: dotted name, whole) with the candidate (key, line, symbol, kind) they mean.

    One candidate is it. Two may be a type and its constructor on one line: the type. Else the dotted name must equal one
    candidate's scope chain, or be the tail of one longer chain, and every candidate's chain must parse.
    outcome: not-in-graph, filled or ambiguous; rule: one, twin, chain, tail.
    """
    chain = D.descriptor_chain(D.descriptor_region("symbol"))
    c = candidates.select(key, "line", "symbol", "kind", chain.alias("chain"))
    doc = F.split("full", r"\.")
    usable = ~F.exists(doc, lambda x: x == "")
    j = frames.join(c.hint("merge"), key, "left")  # many candidates are small on disk, so Spark would send them to every task
    equal = F.col("chain") == doc
    tail = (F.size("chain") > F.size(doc)) & (F.slice("chain", F.greatest(F.size("chain") - F.size(doc) + 1, F.lit(1)), F.size(doc)) == doc)
    row = F.struct("line", "symbol")
    twin_type = (F.col("kind") == "Type") & F.col("symbol").endswith("#")
    per = j.groupBy(*frames.columns).agg(
        F.count("symbol").alias("n"), F.count_if(F.col("symbol").isNotNull() & F.col("chain").isNull()).alias("unread"), F.min(row).alias("first"),
        F.count_if(equal).alias("n_equal"), F.min(F.when(equal, row)).alias("equal"), F.count_if(tail).alias("n_tail"), F.min(F.when(tail, row)).alias("tail"),
        F.min(F.when(twin_type, row)).alias("type"), F.min(F.when((F.col("kind") == "Function") & ~twin_type, row)).alias("maker"),
    )
    twin = (F.col("n") == 2) & (F.col("type.line") == F.col("maker.line")) & (F.concat(F.regexp_replace("type.symbol", "#$", ""), F.lit("().")) == F.col("maker.symbol"))
    chained = (F.col("unread") == 0) & usable
    rule = (
        F.when(F.col("n") == 0, None).when(F.col("n") == 1, "one").when(~F.col("whole"), None).when(F.coalesce(twin, F.lit(False)), "twin")
        .when(chained & (F.col("n_equal") == 1), "chain").when(chained & (F.col("n_equal") == 0) & (F.col("n_tail") == 1), "tail")
    )
    hit = F.when(rule == "one", F.col("first")).when(rule == "twin", F.col("type")).when(rule == "chain", F.col("equal")).when(rule == "tail", F.col("tail"))
    return per.select(*frames.columns, F.when(F.col("n") == 0, "not-in-graph").when(rule.isNotNull(), "filled").otherwise("ambiguous").alias("outcome"), rule.alias("rule"), hit["line"].alias("line"), hit["symbol"].alias("symbol"))


def outcomes(rows: DataFrame, column: str = "outcome") -> DataFrame:
    """How often each outcome occurs."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def resolve_paths(tokens: DataFrame, files: DataFrame, prefixes: Sequence[str] = (), key: str = "token_id") -> DataFrame:
    """tokens (key, doc, path) with the file (path) they mean and how: direct, prefixed, suffix (one file ends so), ctx or ambiguous, else none.

    Of several files that end with the token, the one in the directory that most of the document's settled tokens lie in
    is taken, ties to the smaller path (a vote over the document, so tokens don't depend on their order).
    """
    f = files.select(F.col("path").alias("hit")).distinct()
    t = tokens.select(key, "doc", "path")
    tiers = [t.join(f, t["path"] == f["hit"]).select(key, "hit", F.lit(0).alias("tier"), F.lit("direct").alias("how"))]
    for i, p in enumerate(prefixes):
        tiers.append(t.withColumn("_p", F.concat(F.lit(p), "path")).join(f, F.col("_p") == F.col("hit")).select(key, "hit", F.lit(1 + i).alias("tier"), F.lit("prefixed").alias("how")))
    exact = tiers[0]
    for x in tiers[1:]:
        exact = exact.unionByName(x)
    exact = exact.groupBy(key).agg(F.min(F.struct("tier", "hit", "how")).alias("x")).select(key, "x.hit", "x.how")
    parts = F.split("hit", "/")
    ends = f.withColumn("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, 1_000_000), "/")))).filter("path <> ''").distinct()
    loose = t.join(exact.select(key), key, "left_anti").join(ends, "path")
    pool = loose.groupBy(key).agg(F.count("*").alias("n"), F.min("hit").alias("only"))
    single = pool.filter("n = 1").select(key, F.col("only").alias("hit"), F.lit("suffix").alias("how"))
    settled = exact.unionByName(single)
    directory = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    votes = settled.join(t.select(key, "doc"), key).groupBy("doc", directory("hit").alias("dir")).agg(F.count("*").alias("votes"))
    among = loose.join(pool.filter("n > 1").select(key), key).withColumn("dir", directory("hit")).join(votes, ["doc", "dir"], "left")
    best = among.groupBy(key).agg(F.min(F.struct((-F.coalesce("votes", F.lit(0))).alias("v"), "hit")).alias("b"))
    several = best.select(key, F.when(F.col("b.v") < 0, F.col("b.hit")).alias("hit"), F.when(F.col("b.v") < 0, "ctx").otherwise("ambiguous").alias("how"))
    return tokens.join(settled.unionByName(several), key, "left").withColumn("how", F.coalesce("how", F.lit("none"))).select(*tokens.columns, F.col("hit").alias("file"), "how")


def majority_directory(hits: DataFrame, key: str = "doc") -> DataFrame:
    """The directory that most files of each key lie in, ties to the first seen (ord)."""
    return ordered_mode(hits.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), [key], "dir", "ord").select(key, "dir", "n")


def tree_depths(lines: DataFrame, key: str = "block") -> DataFrame:
    """lines (key, pos, indent) with depth: how many of the lines above are still open, each closed by a line that isn't indented further.

    The line is open for those after it up to the next with no more indentation; depth counts open ones, by an equi join
    within the block.
    """
    w = Window.partitionBy(key).orderBy("pos")
    nums = lines.select(key, "pos", "indent")
    later = nums.toDF(key, "_p", "_i")
    ends = nums.join(later, key).filter((F.col("_p") > F.col("pos")) & (F.col("_i") <= F.col("indent"))).groupBy(key, "pos").agg(F.min("_p").alias("end"))
    spans = nums.join(ends, [key, "pos"], "left").select(key, F.col("pos").alias("_p"), F.coalesce("end", F.lit(1 << 60)).alias("_e"))
    depth = nums.join(spans, key).filter((F.col("_p") < F.col("pos")) & (F.col("_e") > F.col("pos"))).groupBy(key, "pos").agg(F.count("*").alias("depth"))
    return lines.join(depth, [key, "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("ordinal", F.row_number().over(w))
