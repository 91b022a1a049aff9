"""Near duplicates by Order MinHash.

A text's k-mers of five words carry the number of their occurrence, so that repeats differ. Each of `sketches` hash
functions takes the `least` smallest labelled k-mers and keeps their order in the text; equal sketches make candidates.
A candidate pair is verified by aligning the two sequences of labelled k-mers within a band; their similarity is
aligned / (k-mers of both - aligned), which is at most the Jaccard index of five-word shingles and equal to it where
order agrees.

Exact copies are one class from the start. In each bucket of equal sketches, members are compared with a leader, not
with each other, and then with leaders of four other components. Buckets that hold several components after that are
searched for all their pairs, block by block, less those within the leader's component. Links become classes in
one task if they are few, else by alternating large and small stars. Nothing is capped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_ids, slices, split_words, staged, staged_with, text_of

K = 5
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def labelled_kmers(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, occurrence) of each text in order, and offsets. A text of one to four words is one k-mer."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - K + 1, 1))
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    at = offsets[:-1][row] + np.arange(len(row)) - (ends - count)[row]
    padded = np.concatenate([hashes, np.zeros(K, np.uint64)])
    h = np.zeros(len(row), np.uint64)
    for j in range(K):
        w = padded[at + j]
        if (n < K).any():
            w = np.where(j < n[row], w, np.uint64(j))
        h = _mix(h * np.uint64(31) + w)
    mixed = h + _mix(row.astype(np.uint64))
    order = np.argsort(mixed, kind="stable")
    run = mixed[order]
    new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    occurrence = np.empty(len(run), np.uint64)
    occurrence[order] = (np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))).astype(np.uint64)
    return np.where(occurrence == 0, h, _mix(h + occurrence * _A)), np.concatenate([[0], ends])


def order_sketches(kmers: np.ndarray, offsets: np.ndarray, sketches: int, least: int) -> np.ndarray:
    """For each text with k-mers and each hash function: a hash of its `least` minimal k-mers in text order."""
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    starts, row = offsets[full], np.repeat(np.arange(len(full)), n[full])
    out = np.zeros((len(full), sketches), np.uint64)
    none = np.iinfo(np.uint64).max
    for s in range(sketches):
        v = _mix(kmers ^ _mix(np.array([s + 1], np.uint64)))
        places = np.full((len(full), least), -1, np.int64)
        for j in range(least):
            low = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == low[row])
            hit = hit[low[row[hit]] != none]
            places[row[hit[::-1]], j] = hit[::-1]
            v[hit] = none
        places.sort(axis=1)
        for j in range(least):
            out[:, s] = _mix(out[:, s] * np.uint64(31) + np.where(places[:, j] < 0, np.uint64(j), kmers[places[:, j]]))
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of two sequences without repeats, |i - j| <= band: the longest increasing run of matches."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if not len(j) or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """0 if it can't reach `least`. Texts that reach it are at most (|a|+|b|) (1-least)/(1+least) edits apart, which bounds the band."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = aligned(a, b, int((len(a) + len(b)) * (1 - least) / (1 + least)) + 1)
    return common / (len(a) + len(b) - common)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _hashes(distinct: pa.Array) -> np.ndarray:
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64) if len(distinct) else np.zeros(0, np.uint64)


def _roots(a: pa.Array, b: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The nodes of links (a, b) in order, and for each the place of the smallest node of its component."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    names, at = both.dictionary, both.indices.to_numpy()
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    at, n = rank[at], len(at) // 2
    root = list(range(len(names)))
    for x, y in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # roots are smaller, so theirs are final
        root[x] = root[root[x]]
    return names.take(order), np.array(root, np.int64)


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) with those of a batch replaced by (member, smallest member) of their components: at most as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, top = _roots(batch.column("a"), batch.column("b"))
            child = np.flatnonzero(top != np.arange(len(top)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(top[child]))], names=["a", "b"])

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def solved(links: DataFrame) -> DataFrame:
    """node, label as of components, from few links (a, b): all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            all_ = pa.Table.from_batches(got)
            names, top = _roots(*(pa.concat_arrays(all_[c].chunks) for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(top))], names=["node", "label"])

    kind = links.schema["a"].dataType.simpleString()
    return staged(links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, label {kind}"), "labels")


def components(links: DataFrame, few: int = 200_000) -> DataFrame:
    """node, label: the smallest node it is linked with, from links (a, b); nodes without links don't appear. Once no more than `few` links are left, one task solves them: the work of a star is small beside that of its many tasks."""
    edges, state = forest(links.filter("a <> b")), None
    while True:
        edges, now = staged_with(edges, "stars", F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now[0] <= few:
            return solved(edges)
        if now == state:
            return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct()), "labels")
        state = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = forest(large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)).distinct()


def tied(links: DataFrame, few: int = 200_000) -> DataFrame:
    """node, label from links (a, b): the smallest node it is linked with, if no more than `few` links are left; else a node it is linked with, the smallest that a look-up or two find. Cheaper than components; nodes with equal labels are of one component, but not the other way round."""
    edges, (n,) = staged_with(forest(links.filter("a <> b")), "near", F.count(F.lit(1)))
    if n <= few:
        return solved(edges)
    near = staged(edges.groupBy("a").agg(F.min("b").alias("b")), "near")
    far = near.join(near.toDF("b", "c"), "b", "left").select("a", F.coalesce("c", "b").alias("label"))
    roots = near.select("b").distinct().join(near.select("a"), F.col("a") == F.col("b"), "left_anti")
    return staged(far.toDF("node", "label").union(roots.select("b", "b")), "labels")


def sketch(docs: DataFrame, sketches: int, least: int) -> DataFrame:
    """doc_id, key (of the normal text), sigs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                codes, distinct, offsets = split_words(part.column("text"))
                kmers, off = labelled_kmers(_hashes(distinct)[codes], offsets)
                full = np.diff(off) > 0
                sigs = order_sketches(kmers, off, sketches, least).view(np.int64)
                at = np.concatenate([[0], np.cumsum(full)]) * sketches
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sigs.ravel()))], names=["doc_id", "key", "sigs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal(text_of()).alias("text")).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    return staged(rows.mapInArrow(run, "doc_id long, key binary, sigs array<long>"), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with their similarity, where it is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 2_000_000):
                n = part.num_rows
                codes, distinct, offsets = split_words(pa.concat_arrays([part.column("ta"), part.column("tb")]))
                kmers, off = labelled_kmers(_hashes(distinct)[codes], offsets)
                got = np.array([similarity(kmers[off[i] : off[i + 1]], kmers[off[n + i] : off[n + i + 1]], least) for i in range(n)])
                hit = pa.array(np.flatnonzero(got >= least))
                yield pa.RecordBatch.from_arrays([part.column("a").take(hit), part.column("b").take(hit), pa.array(got).take(hit)], names=["a", "b", "similarity"])

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """buckets with the label of each key's component so far: the key itself without links."""
    if labels is None:
        return buckets.withColumn("label", F.col("key"))
    return buckets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def kmers_of(texts: pa.Array, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """labelled_kmers of texts, made in parts of about `most` bytes, so that only the k-mers themselves follow the whole."""
    found, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", most):
        codes, distinct, offsets = split_words(part.column("text"))
        kmers, off = labelled_kmers(_hashes(distinct)[codes], offsets)
        found.append(kmers)
        size.append(np.diff(off))
    return np.concatenate(found), np.cumsum(np.concatenate(size))


def shared_kmers(kmers: np.ndarray, offsets: np.ndarray, most: int = 1024, panel: int = 256) -> np.ndarray:
    """For each two texts, how many labelled k-mers both have; `most` k-mers and `panel` rows at a time."""
    n = len(offsets) - 1
    order = np.argsort(kmers, kind="stable")
    run = kmers[order]
    same = np.concatenate([[False], run[1:] == run[:-1], [False]])
    member = same[1:] | same[:-1]
    # of k-mers that several texts have: numbered in order, with their texts
    place = np.cumsum(member & ~same[:-1])[member] - 1
    row = np.searchsorted(offsets, order[member], side="right") - 1
    del order, run, same, member
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, most):
        part = slice(*np.searchsorted(place, [at, at + most]))
        has = np.zeros((n, most), np.float32)
        has[row[part], place[part] - at] = 1
        for r in range(0, n, panel):
            out[r : r + panel, r:] += has[r : r + panel] @ has[r:].T
    for r in range(0, n, panel):
        out[r + panel :, r : r + panel] = out[r : r + panel, r + panel :].T
    return out


def alike(kmers: np.ndarray, off: np.ndarray, sigs: np.ndarray, label: np.ndarray, own: np.ndarray, band: int, similar: float, panel: int = 256) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity) that reach `similar`, of different labels and blocks, if there are two, and without an equal
    sketch before `band`; one at most for each two components tied here. Masks are made `panel` rows at a time.
    """
    n, size = len(label), np.diff(off)
    root, hits, both, two = label.copy(), [], None, own.min() != own.max()
    for r in range(0, n, panel):
        p = slice(r, min(r + panel, n))
        open_ = root[p, None] != root[r:]
        open_ &= np.arange(r, p.stop)[:, None] < np.arange(r, n)
        if two:
            open_ &= own[p, None] != own[r:]
        for s in range(band):
            open_ &= sigs[p, s, None] != sigs[r:, s]
        open_ &= np.minimum(size[p, None], size[r:]) >= similar * np.maximum(size[p, None], size[r:])
        if not open_.any():
            continue
        if both is None:
            both = shared_kmers(kmers, off)
        # The alignment has at most the k-mers of both; the margin is for rounding.
        open_ &= both[p, r:] >= similar * (size[p, None] + size[r:] - both[p, r:]) - 1e-3
        for i in (np.flatnonzero(open_.any(axis=1)) + r).tolist():
            for j in (np.flatnonzero(open_[i - r]) + r).tolist():
                if root[i] != root[j]:
                    got = similarity(kmers[off[i] : off[i + 1]], kmers[off[j] : off[j + 1]], similar)
                    if got >= similar:
                        hits.append((i, j, got))
                        root[root == root[j]] = root[i]
    return hits


def exhausted(now: DataFrame, texts: DataFrame, similar: float, block: int, chars: int) -> DataFrame:
    """Links (a, b, similarity) from all pairs in buckets that still hold several components, one at most for each two
    components tied in a task. The members of one component (the leader's) and the others are dealt by hash into blocks
    of about `block` texts or `chars` characters; every two blocks of a bucket meet in one group, but for two of the
    leader's component. A pair with several buckets is left to its first one.
    """
    first = F.min(F.struct(F.xxhash64(F.lit(0), "label").alias("h"), "label"))["label"].alias("lead")
    several = now.groupBy("band", "sig").agg(first, F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high and n > 2")  # two members have met in the first round
    open_ = now.join(several.select("band", "sig", "lead"), ["band", "sig"]).withColumn("side", (F.col("label") != F.col("lead")).cast("int"))
    open_ = staged(open_.join(texts.select("key", "chars"), "key"), "open-buckets")
    size = lambda side: F.greatest(F.ceil(F.count_if(F.col("side") == side) / block), F.ceil(F.sum(F.when(F.col("side") == side, F.col("chars"))) / chars), F.lit(0)).cast("int")
    dealt = open_.join(open_.groupBy("band", "sig").agg(size(0).alias("same"), size(1).alias("rest")), ["band", "sig"])
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64(F.lit(-1), "key"), "same")).otherwise(F.col("same") + F.pmod(F.xxhash64(F.lit(-1), "key"), "rest")).cast("int")
    dealt = dealt.select("band", "sig", "key", "label", "same", "rest", "side", own.alias("own"))
    others = F.when(F.col("side") == 0, F.sequence(F.col("same"), F.col("same") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("same") + F.col("rest") - 1))
    met = dealt.withColumn("other", F.explode(others)).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    met = met.join(texts.select("key", "sigs", "text"), "key").select("band", "sig", "lo", "hi", "own", "key", "label", "sigs", "text")

    def run(group: pa.Table) -> pa.Table:
        label = group["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        sigs = group["sigs"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        kmers, off = kmers_of(group["text"].combine_chunks())
        hits = alike(kmers, off, sigs, label, group["own"].to_numpy(), group["band"][0].as_py(), similar)
        keys = group["key"].to_pylist()
        return pa.table({"a": pa.array([max(keys[i], keys[j]) for i, j, _ in hits], pa.binary()), "b": pa.array([min(keys[i], keys[j]) for i, j, _ in hits], pa.binary()), "similarity": pa.array([x for *_, x in hits], pa.float64())})

    return met.groupBy("band", "sig", "lo", "hi").applyInArrow(run, "a binary, b binary, similarity double")


def classes(docs: DataFrame, sketches: int = 12, least: int = 2, similar: float = 0.8, rounds: int = 2, block: int = 1024, chars: int = 8_000_000) -> DataFrame:
    """Every row of docs: doc_id, key, class_id (smallest doc_id of its class), class_size, n_copies, n_verified.

    Words are split at ASCII white space and compared in lower case. A null text is empty; empty texts are copies of each
    other and near nothing else. Repeated rows belong to one class; a null id never names a class if the class has
    another. Extra columns are ignored; an empty table gives no rows. n_verified counts the links by which the text was
    found near others, not all texts near it. `rounds` bounds the rounds of leaders only, which make the search cheap
    where texts are much alike; what they leave is searched in full, in blocks of about `block` texts or `chars`
    characters.
    """
    rows = sketch(docs, sketches, least)
    keys = staged(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("sigs").alias("sigs")), "keys")
    buckets = keys.select("key", F.posexplode("sigs").alias("band", "sig"))
    lead = F.min(F.struct(F.xxhash64(F.lit(0), "key").alias("h"), "key"))["key"].alias("lead")
    shared = buckets.groupBy("band", "sig").agg(F.count("*").alias("n"), lead).filter("n > 1").drop("n")
    buckets = staged(buckets.join(shared, ["band", "sig"]), "shared-buckets")
    needed = buckets.select("key").distinct().join(keys.select("key", "doc_id", "sigs"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _normal(text_of()).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = texts.join(needed, (texts["key"] == needed["key"]) & texts["id"].eqNullSafe(needed["doc_id"])).select(texts["key"], "sigs", F.length("text").alias("chars"), "text")
    texts = staged(texts.dropDuplicates(["key"]), "texts")
    links = labels = None
    for r in range(rounds):
        now = labelled(buckets, labels)
        if r:
            leads = F.array(*(F.min(F.struct(F.xxhash64(F.lit(x), "label").alias("h"), F.xxhash64(F.lit(x), "key").alias("k"), "key", "label")) for x in range(4 * r, 4 * r + 4)))
            led = now.groupBy("band", "sig").agg(leads.alias("leads"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band", "sig", F.explode("leads").alias("l"))
            pairs = now.join(led, ["band", "sig"]).filter(F.col("label") != F.col("l.label")).select("key", F.col("l.key").alias("lead"))
        else:
            pairs = now.filter("key <> lead").select("key", "lead")
        pairs = pairs.select(F.greatest("key", "lead").alias("a"), F.least("key", "lead").alias("b")).distinct()
        found = staged(verified(pairs, texts.select("key", "text"), similar), "links")
        links = found if links is None else links.union(found)
        labels = tied(links) if r + 1 < rounds else components(links)
    now = staged(labelled(buckets.drop("lead"), labels), "labelled-buckets")
    found, (n,) = staged_with(exhausted(now, texts, similar, block, chars), "links", F.count(F.lit(1)))
    if n:
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found.select("a", "b")))
    links = links.union(found).dropDuplicates(["a", "b"])
    n_links = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    joined = keys.select("key", "doc_id", "n").join(labels.withColumnRenamed("node", "key"), "key", "left").join(n_links, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = joined.join(sizes, "label").select("key", "class_id", "class_size", F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_verified"))
    return rows.select("doc_id", "key").join(by_key, "key").select("doc_id", "key", "class_id", "class_size", "n_copies", "n_verified")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: of the smallest id, and of equal ids the first text by its hash; of rows that are equal in both, any one. An empty table gives none."""
    from pyspark.sql import Window

    found = classes(docs, **options)
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("key").alias("key"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(_normal(text_of()).cast("binary"))).alias("key"))
    kept = rows.join(chosen, (rows["key"] == chosen["key"]) & rows["id"].eqNullSafe(chosen["class_id"])).select("doc", rows["key"], "id")
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.xxhash64("doc")))
    return kept.withColumn("first", first).filter("first = 1").select("doc.*")
