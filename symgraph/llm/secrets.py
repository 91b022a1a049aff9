"""Secret scans: patterns find candidates, corpus-wide ownership tells live-looking ones from copied examples.

DataFrame operations only. Candidate values are hashed and counted by distinct repositories (documents) and owners
(sources); a value with more than `max_owners` owners, or in more than `max_repositories` repositories be they of one
owner, is a widely copied example. Base spans always stay; a further kind, `owned`, holds long mixed tokens that no base
span touches and that are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of, whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: 20 characters or more with a letter and two digits.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9][A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
_SPAN = "struct<start:int,kind:int,end:int,value:bigint>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point offsets: each match lies between two pieces of the split text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), hits.alias("m"), values.alias("v"))
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["v"]).alias("value")).cast(_SPAN)
        kept = x["m"].isNotNull() & (F.length(x["v"]) >= least)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(kept, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.size(hits) == 0, empty).otherwise(found)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 50, carried: list[str] | None = None) -> DataFrame:
    """Every row of docs (struct `doc` of the carried columns): base and spans (arrays of start, kind, end, value), n_live, n_example.

    A null text is empty; an empty one has no spans. A null owner or repository counts as one of its own. Repeated rows
    are scanned each and count as one repository if they share its id. Texts are scanned once, whole; afterwards only
    spans move, and only of documents that have any. A value that most rows share is counted with map-side aggregation
    and joined with one count row, which adaptive execution splits.
    """
    text = text_of()
    base = F.concat(_spans(text, ASSIGN, 0, 2, 8), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), whole(carried or ["doc_id"]).alias("doc"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), base.alias("base"), _spans(text, OWNED, 3).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = staged(rows.withColumn("more", free), "secrets")
    spans = rows.filter((F.size("base") > 0) | (F.size("more") > 0)).select("uid", F.struct(F.col("owner").isNull(), "owner").alias("owner"), F.struct(F.col("repository").isNull(), "repository").alias("repository"), F.explode(F.concat("base", "more")).alias("s"))
    spans = spans.withColumn("value", F.col("s.value"))
    owned = spans.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    repos = spans.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("n_repositories"))
    judged = spans.join(owned, "value").join(repos, "value").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    per_doc = judged.groupBy("uid").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added"),
        F.collect_list(F.when(F.col("live"), F.col("s"))).alias("live"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    empty = F.array().cast(f"array<{_SPAN}>")
    out = rows.join(per_doc, "uid", "left")
    return out.select("doc", "base", F.concat("base", F.coalesce("added", empty)).alias("spans"), F.coalesce("live", empty).alias("live"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")))


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc.doc_id", count(0), count(1), count(2), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners", "most_repositories")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with each live-looking span (and what overlaps it) replaced by the mark; everything else stays as it is.

    A null text stays null; an empty table gives no rows.
    """
    names = docs.columns
    found = scan(docs, carried=names, **options)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["start"] < F.when(F.size(acc) > 0, last["end"]))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate(F.array_sort("live"), empty, merge)
    text = F.col("doc.text")
    cut = F.aggregate(merged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out")))
    tail = F.substring(text, cut["at"] + 1, F.length(text))
    clean = F.when(F.size("live") == 0, text).otherwise(F.concat(cut["out"], tail))
    return found.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names))
