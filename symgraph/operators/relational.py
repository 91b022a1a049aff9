"""Interval, as-of, nearest, reconciliation and set operators. DataFrames in and out; every order has an ordinal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, event_name, event_path, matches_query


def bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each `width` lines that an interval touches: an equi key for range joins within large files."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def innermost(refs: DataFrame, spans: DataFrame, keys: Sequence[str] = ("rel_path",), at: str = "line", start: str = "start_line", end: str = "end_line", order: str = "seq", ref_key: str = "seq", bucket: int | None = 256) -> DataFrame:
    """refs with `span`, the narrowest span that contains `at` (inclusive; ties to the lower order), or null.

    An equi join on the keys with the range as residual, and the minimum taken by aggregation, so partial results combine
    before the second shuffle. Long partitions are cut further into slots of `bucket` lines; None leaves them whole.
    """
    s = spans if bucket is None else bucketed(spans, start, end, bucket)
    r = refs if bucket is None else refs.withColumn("bucket", F.floor(F.col(at) / bucket))
    on = [*keys, *(["bucket"] if bucket is not None else [])]
    s = s.select(*on, F.struct((F.col(end) - F.col(start)).alias("width"), F.col(order).alias("order"), *(F.col(c) for c in spans.columns if c not in (*keys, "bucket"))).alias("span"))
    hit = r.join(s, on).filter((F.col(at) >= F.col(f"span.{start}")) & (F.col(at) <= F.col(f"span.{end}")))
    best = hit.groupBy(ref_key).agg(F.min("span").alias("span"))
    return refs.join(best, ref_key, "left")


def nearest_preceding(refs: DataFrame, defs: DataFrame, keys: Sequence[str] = ("rel_path",), at: str = "line", value: str = "symbol") -> DataFrame:
    """refs with `nearest`: of the defs of the same keys, the last whose `at` isn't behind (ties to the largest value).

    One sort of both sides by key and position; no range join.
    """
    d = defs.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(refs.select(F.struct("*")).schema[0].dataType).alias("_ref"))
    r = refs.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(defs.schema[value].dataType).alias("_value"), F.struct("*").alias("_ref"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    return d.unionByName(r).withColumn("nearest", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").select("_ref.*", "nearest")


def nested_parent(events: DataFrame, keys: Sequence[str] = ("pid", "tid"), order: str = "ord") -> DataFrame:
    """events with `parent` (struct), the latest event before it in (ts, -dur, ord) that hasn't ended at its start.

    An equi join on the keys and a slot of time, with the interval as residual. Slots are as wide as a quarter of the mean
    duration, so intervals make about five rows each whatever the longest is, and one long thread is dealt out over slots.
    """
    e = events.select(*keys, order, "ts", "dur", "name")
    total, n = e.agg(F.coalesce(F.sum("dur"), F.lit(0)), F.count("*")).first()
    width = max(total / (4 * max(n, 1)), 1)
    p = e.select(*keys, F.struct("ts", (-F.col("dur")).alias("neg"), F.col(order).alias("o"), "dur", "name").alias("p"))
    p = p.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("p.ts") / width), F.floor((F.col("p.ts") + F.col("p.dur")) / width))))
    c = e.withColumn("bucket", F.floor(F.col("ts") / width)).withColumn("me", F.struct("ts", (-F.col("dur")).alias("neg"), F.col(order).alias("o")))
    hit = c.join(p, [*keys, "bucket"]).filter((F.struct("p.ts", "p.neg", "p.o") < F.col("me")) & (F.col("p.ts") + F.col("p.dur") > F.col("ts")))
    best = hit.groupBy(*keys, order).agg(F.max("p").alias("parent"))
    return e.join(best, [*keys, order], "left")


def trace_edges(events: DataFrame, **options) -> DataFrame:
    """caller, callee, dur, ord of complete events that have a parent."""
    own = events.filter((F.col("cat") == "fee") & (F.col("ph") == "X")) if "cat" in events.columns else events
    return nested_parent(own, **options).filter("parent is not null").select(F.col("parent.name").alias("caller"), F.col("name").alias("callee"), "dur", "ord")


def trace_stats(edges: DataFrame) -> DataFrame:
    """caller, callee, count, p50_ms (mean of the middle two), p95_ms (nearest rank, ceiling), first_seen; unrounded."""
    e = edges.select(event_name("caller").alias("caller"), event_name("callee").alias("callee"), "dur", "ord")
    return e.groupBy("caller", "callee").agg(F.count("*").alias("count"), (F.median("dur") / 1000).alias("p50_ms"), (F.expr("percentile_disc(0.95) within group (order by dur)") / 1000).alias("p95_ms"), F.min("ord").alias("first_seen"))


def repo_only(edges: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/") + "/"
    inside = lambda c: F.coalesce(event_path(c).startswith(base), F.lit(False))
    return edges.filter(inside("caller") | inside("callee"))


def with_text(rows: DataFrame, include: str | None = None, exclude: str | None = None, columns: Sequence[str] = ("caller", "callee")) -> DataFrame:
    has = lambda s: F.greatest(*(F.col(c).contains(s) for c in columns))
    rows = rows if include is None else rows.filter(has(include))
    return rows if exclude is None else rows.filter(~has(exclude))


# --- references and callers


def definitions(occurrences: DataFrame, query: str) -> DataFrame:
    return occurrences.filter(F.col("is_def") & matches_query("symbol", "rel_path", query))


def references(occurrences: DataFrame, defs: DataFrame) -> DataFrame:
    """Non-definition occurrences of the defined symbols."""
    return occurrences.filter(~F.col("is_def")).join(defs.select("symbol").distinct(), "symbol", "left_semi")


def callers(refs: DataFrame, spans: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(caller, def_path, sites, n_sites, first_seq) and the references that no span contains."""
    hit = innermost(refs, spans, **options)
    grouped = hit.filter("span is not null").groupBy(F.col("span.symbol").alias("caller")).agg(F.min_by("rel_path", "seq").alias("def_path"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "rel_path", "line"))), lambda s: F.struct(s["rel_path"], s["line"])).alias("sites"), F.count("*").alias("n_sites"), F.min("seq").alias("first_seq"))
    return grouped, hit.filter("span is null").select("seq", "symbol", "rel_path", "line")


def derive_edges(occurrences: DataFrame, spans: DataFrame, **options) -> DataFrame:
    """(caller, callee, n_sites) of references to symbols that are defined, by innermost span."""
    defs = occurrences.filter("is_def").select("symbol").distinct()
    refs = occurrences.filter("not is_def").join(defs, "symbol", "left_semi")
    return innermost(refs, spans, **options).filter("span is not null").groupBy(F.col("span.symbol").alias("caller"), F.col("symbol").alias("callee")).agg(F.count("*").alias("n_sites"))


# --- sets


def edge_diff(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """added, removed (src, dst, kind), reversed (src, dst in the added direction, on pairs), changed (module)."""
    a, b = before.select("src", "dst", "kind").distinct(), after.select("src", "dst", "kind").distinct()
    added, removed = b.exceptAll(a), a.exceptAll(b)
    pairs, gone = added.select("src", "dst").distinct(), removed.select("src", "dst").distinct()
    ends = lambda p: p.select(F.explode(F.array("src", "dst")).alias("module"))
    return {"added": added, "removed": removed, "reversed": pairs.intersect(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "changed": ends(pairs).union(ends(gone)).distinct()}


def compare_claims(claimed: DataFrame, changed: DataFrame) -> DataFrame:
    """module, verdict: hit, surprise (changed only) or missed (claimed only)."""
    c, x = claimed.select("module").distinct().withColumn("c", F.lit(True)), changed.select("module").distinct().withColumn("x", F.lit(True))
    return c.join(x, "module", "full_outer").select("module", F.when(F.col("c").isNull(), "surprise").when(F.col("x").isNull(), "missed").otherwise("hit").alias("verdict"))


def manifest_delta(manifest: DataFrame, current: DataFrame, keys: Sequence[str] = ("face", "rel")) -> DataFrame:
    """keys, change: changed (size or hash), added or removed; equal entries don't appear."""
    m, c = manifest.select(*keys, F.struct("size", "hash").alias("m")), current.select(*keys, F.struct("size", "hash").alias("c"))
    change = F.when(F.col("m").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("m") != F.col("c"), "changed")
    return m.join(c, list(keys), "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def identity_hash(manifest: DataFrame, header: str = "") -> DataFrame:
    """One row: sha256 over the entries in the order of rel, then face. Entries of a repository are bounded by its files."""
    line = F.concat_ws("\u0000", "face", "rel", F.col("size").cast("string"), "hash", F.lit(""))
    entries = F.sort_array(F.collect_list(F.struct("rel", "face", line.alias("line"))))
    return manifest.agg(F.sha2(F.concat(F.lit(header), F.array_join(F.transform(entries, lambda e: e["line"]), "")).cast("binary"), 256).alias("identity"))


def collisions(defs: DataFrame, key: str = "symbol", root: str = "root") -> DataFrame:
    """Keys defined under several roots."""
    return defs.select(key, root).distinct().groupBy(key).agg(F.count("*").alias("n_roots")).filter("n_roots > 1")


def set_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with side `missing` (left only) or `extra`."""
    return left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("missing")).unionByName(right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("extra")))


# --- look-ups and counters


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by an order that must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def ordered_mode(df: DataFrame, keys: Sequence[str], value: str, order: str, top: int = 1) -> DataFrame:
    """The `top` most frequent values of each key, ties to the first seen: keys, value, n, first_seen, rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_seen")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def two_tier_lookup(rows: DataFrame, table: DataFrame, exact: Sequence[str], fallback: str, value: str) -> DataFrame:
    """rows with `found` and `tier`: by all exact keys, else by the fallback key where only one row of the table has it."""
    first = table.groupBy(*exact).agg(F.min(value).alias("_v1"))
    unique = table.groupBy(fallback).agg(F.count("*").alias("_n"), F.min(value).alias("_v2")).filter("_n = 1").drop("_n")
    out = rows.join(first, list(exact), "left").join(unique, fallback, "left")
    return out.withColumn("found", F.coalesce("_v1", "_v2")).withColumn("tier", F.when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2)).drop("_v1", "_v2")


def shadowed(rows: DataFrame, keys: Sequence[str], legacy: Column) -> DataFrame:
    """Legacy rows stay only where no other row has their keys."""
    return rows.filter(~legacy).unionByName(rows.filter(legacy).join(rows.filter(~legacy).select(*keys).distinct(), list(keys), "left_anti"))


def hotspots(rows: DataFrame, rel: Column, is_test: Column, excluded: Column, order: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bucket, dir, n, first_seen, rank) of production and test rows, and one row of counters. A null rel is outside."""
    d = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
    bucket = F.when(rel.isNull(), "outside").when(excluded, "excluded").when(is_test | rel.startswith("tests/"), "test").otherwise("prod")
    r = rows.select(bucket.alias("bucket"), d.alias("dir"), F.col(order).alias("_o"))
    totals = r.agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in ("prod", "test", "excluded", "outside")))
    return ordered_mode(r.filter(F.col("bucket").isin("prod", "test")), ["bucket"], "dir", "_o", top), totals


def _closest(anchors: DataFrame, nodes: DataFrame, on: Sequence[str], key: str) -> DataFrame:
    """key, hit: the node nearest to an anchor's doc_line among those of the same keys, ties to the upper line, then the smaller symbol; a node without a line comes first.

    Both sides are sorted together, once each way; no pairs are made.
    """
    n = nodes.groupBy(*on, "line_start").agg(F.min(F.struct("symbol", "file_path")).alias("_s")).select(*on, F.col("line_start").alias("_at"), F.lit(0).alias("_side"), F.struct("_s.symbol", "_s.file_path", "line_start").alias("_node"))
    both = n.unionByName(anchors.select(*on, F.col("doc_line").alias("_at"), F.lit(1).alias("_side"), F.col(key).alias("_key")), allowMissingColumns=True)
    for c in on:
        both = both.filter(F.col(c).isNotNull())
    down = Window.partitionBy(*on).orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*on).orderBy(F.desc_nulls_last("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_none", F.first(F.when(F.col("_at").isNull(), F.col("_node")), ignorenulls=True).over(down)).withColumn("_before", F.last("_node", ignorenulls=True).over(down)).withColumn("_after", F.last("_node", ignorenulls=True).over(up))
    far = lambda c: F.abs(F.col(c)["line_start"] - F.col("_at"))
    hit = F.coalesce("_none", F.when(far("_before") <= far("_after"), F.col("_before")), F.when(far("_before") > far("_after"), F.col("_after")), "_before", "_after")
    found = both.filter("_side = 1").select(F.col("_key").alias(key), "_at", hit.alias("hit")).filter("hit is not null")
    return found.groupBy(key).agg(F.min_by("hit", F.struct(F.abs(F.col("hit.line_start") - F.col("_at")), "hit.line_start", "hit.symbol")).alias("hit"))


def nearest_line(anchors: DataFrame, nodes: DataFrame, key: str = "anchor_id") -> DataFrame:
    """anchors (file, name, doc_line) with the nearest definition of that name in the file, else across files where just one file has it."""
    n = nodes.select("symbol", "name", "file_path", "line_start")
    # A path is met by each of its ends at a slash, so files match by equality; ends that no anchor names are left out.
    parts = F.split("file_path", "/")
    ends = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1_000_000), "/"))))
    keyed = n.filter("file_path is not null").withColumn("file", ends).join(anchors.select("file").distinct(), "file", "left_semi")
    near = _closest(anchors, keyed, ["name", "file"], key)
    # Across files only names that one file has are looked up.
    single = n.groupBy("name").agg(F.min("file_path").alias("_f"), F.max("file_path").alias("_l")).filter("_f = _l").select("name")
    away = _closest(anchors.join(near, key, "left_anti"), n.join(single, "name", "left_semi"), ["name"], key)
    found = near.withColumn("how", F.lit("same_file")).unionByName(away.withColumn("how", F.lit("only_file")))
    return anchors.join(found, key, "left").select(*anchors.columns, "hit.symbol", "hit.file_path", "hit.line_start", F.coalesce("how", F.lit("none")).alias("how"))


def resolve(nodes: DataFrame, query: str) -> tuple[str, DataFrame]:
    """'none', 'one' or 'many', and the nodes: `Parent.name`, else qname, symbol or name, else the part after `::`."""
    owner, dot, name = query.rpartition(".")
    tiers = [(F.col("parent_name") == owner) & (F.col("name") == name)] if dot else []
    tiers += [(F.col("qname") == query) | (F.col("symbol") == query) | (F.col("name") == query)]
    if "::" in query:
        tiers.append(F.col("name") == query.rpartition("::")[2])
    found = nodes.limit(0)
    for t in tiers:
        found = nodes.filter(t).orderBy("id")
        n = found.limit(2).count()
        if n:
            return "one" if n == 1 else "many", found
    return "none", found


def like_symbols(rows: DataFrame, column: str, query: str, separator: str = ".") -> DataFrame:
    """Symbols equal to the query or with it as a part between separators; case of ASCII letters doesn't count."""
    c, q, s = F.lower(col(column)), query.lower(), separator
    return rows.filter((c == q) | c.endswith(s + q) | c.startswith(q + s) | c.contains(s + q + s))


def with_examples(rows: DataFrame, keys: Sequence[str], value: str, most: int = 5) -> DataFrame:
    """keys, n (complete) and the `most` smallest values: ranked, so that no list grows with its group."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= most)
    return n.join(few.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("examples")), list(keys))


def other_files(nodes: DataFrame, file: str, looked: int = 6, shown: int = 4) -> DataFrame:
    """name, shown, more: for each name the first other files that hold it, `shown` of `looked` at most, and whether there are more than are shown."""
    f = nodes.filter(F.col("file_path") != file).select("name", "file_path").distinct()
    r = f.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("file_path"))).filter(F.col("_r") <= looked)
    return r.groupBy("name").agg(F.sort_array(F.collect_list(F.when(F.col("_r") <= shown, F.col("file_path")))).alias("shown"), (F.count("*") > shown).alias("more"))
