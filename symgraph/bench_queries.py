"""Queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for the relations of a symbol graph: calls are (customer, supplier) pairs of order lines, spans and
references are intervals and instants of events, manifests are documents by source, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import reconcile as C
from .operators import relational as R


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Edge rows (id, kind, caller_symbol, callee_symbol): one for each order line."""
    o, li = _t(s, d, "orders"), _t(s, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "REFERENCES").otherwise("IMPORTS_FROM")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), kind.alias("kind"), F.concat(F.lit("c"), "o_custkey").alias("caller_symbol"), F.concat(F.lit("s"), "l_suppkey").alias("callee_symbol"))


_CALLS = """calls as (select l_orderkey * 100 + l_linenumber as id, case l_returnflag when 'R' then 'CALLS' when 'A' then 'REFERENCES' else 'IMPORTS_FROM' end as kind,
 'c' || o_custkey as caller_symbol, 's' || l_suppkey as callee_symbol from lineitem join orders on l_orderkey = o_orderkey)"""


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as nodes; the nation is the file, the region its folder."""
    nat, reg = _t(s, d, "nation"), _t(s, d, "region")
    where = nat.join(reg, nat["n_regionkey"] == reg["r_regionkey"]).select(F.col("n_nationkey").alias("k"), F.concat(F.lit("/w/"), "r_name", F.lit("/"), "n_name", F.lit("/x.py")).alias("file_path"))
    c = _t(s, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.concat(F.lit("c"), "c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("language"))
    p = _t(s, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("k"), F.lit("supply").alias("language"))
    return c.union(p).join(where, "k").select("id", "symbol", F.lit("Function").alias("kind"), "name", F.concat("file_path", F.lit("::"), "name").alias("qname"), "file_path", F.lit(1).cast("long").alias("line_start"), F.lit(9).cast("long").alias("line_end"), "language", F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_test"), F.lit("{}").alias("extra"), F.col("k").cast("long").alias("community_id"))


_NODES = """nodes as (select 2 * c_custkey as id, 'c' || c_custkey as symbol, c_name as name, c_nationkey as community, c_mktsegment as language, r_name, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 union all select 2 * s_suppkey + 1, 's' || s_suppkey, s_name, s_nationkey, 'supply', r_name, n_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def hub_degrees(s, d):
    """Degrees of all nodes over edge rows, parallel edges counted."""
    return G.degrees(_nodes(s, d), _calls(s, d)).select("symbol", "in_degree", "out_degree", "total_degree")


def hub_top(s, d):
    return G.hub_nodes(_nodes(s, d), _calls(s, d), 20).select("symbol", "total_degree")


def _snapshots(s, d):
    """Calls of orders before and from mid-1995 on: customers and suppliers by number."""
    o, li = _t(s, d, "orders"), _t(s, d, "lineitem")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), "o_orderdate")
    cutoff = F.lit("1995-06-01").cast("timestamp")
    return e.filter(F.col("o_orderdate") < cutoff).drop("o_orderdate"), e.filter(F.col("o_orderdate") >= cutoff).drop("o_orderdate")


_SNAP = """e as (select o_custkey as src, l_suppkey as dst, l_returnflag as kind, o_orderdate from lineitem join orders on l_orderkey = o_orderkey),
 a as (select distinct src, dst, kind from e where o_orderdate < timestamp '1995-06-01'), b as (select distinct src, dst, kind from e where o_orderdate >= timestamp '1995-06-01'), added as (select * from b except select * from a), removed as (select * from a except select * from b)"""


def edge_diff(s, d):
    x = R.edge_diff(*_snapshots(s, d))
    return x["added"].withColumn("change", F.lit("added")).union(x["removed"].withColumn("change", F.lit("removed")))


def edge_reversed(s, d):
    return R.edge_diff(*_snapshots(s, d))["reversed"]


def changed_modules(s, d):
    return R.edge_diff(*_snapshots(s, d))["changed"]


def compare_claims(s, d):
    claimed = _t(s, d, "nation").filter("n_regionkey <= 2").select(F.col("n_nationkey").alias("module"))
    changed = R.edge_diff(*_snapshots(s, d))["reversed"].select(F.col("src").alias("module"))
    return R.compare_claims(claimed, changed)


def _intervals(s, d):
    e = _t(s, d, "events").select("event_id", "user_id", "event_type", "value", _micros("ts").alias("t"))
    spans = e.filter("event_type in ('view', 'click')").select(F.col("event_id").alias("seq"), F.concat(F.lit("f"), "event_id").alias("symbol"), F.col("user_id").alias("rel_path"), F.col("t").alias("start_line"), (F.col("t") + F.floor(F.col("value") * 60_000_000).cast("long")).alias("end_line"))
    refs = e.filter("event_type not in ('view', 'click')").select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.col("user_id").alias("rel_path"), F.col("t").alias("line"))
    return refs, spans


def callers(s, d):
    """References by the innermost interval that holds them, with all their sites."""
    refs, spans = _intervals(s, d)
    found = R.callers(refs, spans, bucket=_SLOT)[0]
    return found.select("caller", "n_sites", "first_seq", F.array_join(F.transform("sites", lambda x: x["line"]), ",").alias("lines"))


def item_level(s, d):
    refs, spans = _intervals(s, d)
    return R.callers(refs, spans, bucket=_SLOT)[1].select("seq", "symbol")


def derived_edges(s, d):
    """Edges from references to defined symbols by innermost span; only some event types are defined."""
    refs, spans = _intervals(s, d)
    defined = s.createDataFrame([(t,) for t in ("purchase", "error", "none")], "symbol string")
    occ = refs.withColumn("is_def", F.lit(False)).unionByName(defined.select(F.lit(-1).cast("long").alias("seq"), "symbol", F.lit(-1).cast("long").alias("rel_path"), F.lit(-1).cast("long").alias("line"), F.lit(True).alias("is_def")))
    return R.derive_edges(occ, spans, bucket=_SLOT).select("caller", "callee", "n_sites")


#: Slots of long partitions, in microseconds: an hour.
_SLOT = 3_600_000_000
_INNER = """ev as (select event_id, user_id, event_type, value, epoch_us(ts) as t from events),
 sp as (select event_id as seq, 'f' || event_id as symbol, user_id, t as a, t + cast(floor(value * 60000000) as bigint) as b from ev where event_type in ('view', 'click')),
 rf as (select event_id as seq, event_type as symbol, user_id, t from ev where event_type not in ('view', 'click')),
 hit as (select rf.seq, rf.symbol, rf.t, sp.symbol as caller, row_number() over (partition by rf.seq order by b - a, sp.seq) as n from rf join sp on rf.user_id = sp.user_id and t between a and b),
 best as (select seq, symbol, caller, t from hit where n = 1)"""


def nearest_preceding(s, d):
    e = _t(s, d, "events").select("event_id", "user_id", "event_type", _micros("ts").alias("line"))
    defs = e.filter("event_type = 'signup'").select("user_id", "line", F.col("event_id").alias("symbol"))
    refs = e.filter("event_type = 'purchase'").select("user_id", "line", "event_id")
    return R.nearest_preceding(refs, defs, ["user_id"]).select("event_id", F.col("nearest").alias("signup_id"))


def _traced(s, d):
    e = _t(s, d, "events")
    return e.select(F.col("user_id").alias("pid"), F.lit(0).alias("tid"), _micros("ts").alias("ts"), F.floor(F.col("value") * 60_000_000).cast("long").alias("dur"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"))


def trace_nesting(s, d):
    return R.nested_parent(_traced(s, d)).filter("parent is not null").select("ord", F.col("parent.o").alias("parent_ord"))


def trace_stats(s, d):
    e = R.trace_stats(R.trace_edges(_traced(s, d)))
    return e.select("caller", "callee", "count", "p50_ms", "p95_ms", "first_seen")


_TRACE = """ev as (select user_id, event_id, event_type, epoch_us(ts) as t, cast(floor(value * 60000000) as bigint) as dur from events),
 hit as (select c.event_id, c.event_type as callee, c.dur, p.event_id as parent_ord, p.event_type as caller, row_number() over (partition by c.event_id order by p.t desc, p.dur, p.event_id desc) as n
  from ev c join ev p on c.user_id = p.user_id and (p.t < c.t or p.t = c.t and (p.dur > c.dur or p.dur = c.dur and p.event_id < c.event_id)) and p.t + p.dur > c.t), best as (select * from hit where n = 1)"""


def _links(s, d):
    """All calls of customers on suppliers, and of suppliers on the customers they took goods back from."""
    e = _calls(s, d)
    a = e.select(F.col("caller_symbol").alias("caller"), F.col("callee_symbol").alias("callee"))
    return a.union(e.filter("kind = 'CALLS'").select(F.col("callee_symbol").alias("caller"), F.col("caller_symbol").alias("callee")))


_LINKS = f"{_CALLS}, links as (select distinct caller_symbol as caller, callee_symbol as callee from calls union select callee_symbol, caller_symbol from calls where kind = 'CALLS')"


def _flow_graph(s, d):
    """Nodes and edges with depth: customers call suppliers, each supplier the next one of its nation, and parts, which are no nodes; some are tested, some names are sensitive."""
    n = _nodes(s, d).withColumn("name", F.when(F.col("id") % 10 == 1, F.concat(F.lit("auth_"), "name")).otherwise(F.col("name")))
    sup = _t(s, d, "supplier").select("s_suppkey", "s_nationkey")
    after = sup.withColumn("next", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).filter("next is not null")
    chain = after.select((F.col("s_suppkey") + 10**12).alias("id"), F.lit("CALLS").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("caller_symbol"), F.concat(F.lit("s"), "next").alias("callee_symbol"))
    tested = sup.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 2 * 10**12).alias("id"), F.lit("TESTED_BY").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("caller_symbol"), F.concat(F.lit("t"), F.col("s_suppkey") % 7).alias("callee_symbol"))
    out = _t(s, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")).select((F.col("id") + 3 * 10**12).alias("id"), F.lit("CALLS").alias("kind"), F.concat(F.lit("s"), "l_suppkey").alias("caller_symbol"), F.concat(F.lit("p"), "l_partkey").alias("callee_symbol"))
    return n, _calls(s, d).unionByName(chain).unionByName(tested).unionByName(out)


_FLOW = f"""{_CALLS}, {_NODES}, chain as (select 's' || s_suppkey as caller, 's' || lead(s_suppkey) over (partition by s_nationkey order by s_suppkey) as callee from supplier),
 k as (select distinct caller_symbol as caller, callee_symbol as callee from calls where kind = 'CALLS' union select caller, callee from chain where callee is not null),
 ext as (select 's' || l_suppkey as symbol, count(distinct l_partkey) as n from lineitem where l_returnflag = 'R' group by 1),
 tst as (select 's' || s_suppkey as symbol, 't' || s_suppkey % 7 as test from supplier where s_suppkey % 3 = 0),
 named as (select *, case when id % 10 = 1 then 'auth_' || name else name end as nm from nodes)"""


def closure(s, d):
    """Who reaches supplier 1 in three hops, with the number of hops and of re-entries into what was known."""
    found, again = G.closure(_links(s, d), s.createDataFrame([("s1",)], "symbol string"), 3)
    return found.withColumn("again", F.lit(again).cast("long"))


def closure_levels(s, d):
    """New symbols of each level, and how many files they lie in."""
    found, _ = G.closure(_links(s, d), s.createDataFrame([("s1",)], "symbol string"), 4)
    n = _nodes(s, d).select("symbol", F.col("file_path").alias("rel_path"))
    return G.closure_levels(found, n, 4).select("depth", "n_new", F.coalesce(F.size("by_file"), F.lit(0)).alias("n_files"))


def _impact(s, d, most: int):
    nodes = _nodes(s, d)
    first = nodes.filter("symbol = 's1'").select(F.col("file_path").alias("path"))
    return G.impact_radius(nodes, _calls(s, d), first, 2, most)


def impact_radius(s, d):
    """Best impact scores within two hops of the file of supplier 1, edges weighted by kind; the 500 highest."""
    x = _impact(s, d, 500)
    return x["impacted"].select("symbol", "score", F.lit(x["total_impacted"]).cast("long").alias("total"), F.lit(x["truncated"]).alias("truncated"))


def impact_files(s, d):
    """Files of all that is impacted."""
    return _impact(s, d, 1_000_000_000)["files"]


def flows(s, d):
    """Flows from what nothing calls, up to 15 calls deep, with criticality."""
    n, e = _flow_graph(s, d)
    return G.trace_flows(n, e, 15).select("entry_point_id", "depth", "node_count", "file_count", "criticality", F.size("path").alias("n_path"))


def entry_points(s, d):
    n, e = _flow_graph(s, d)
    return G.entry_points(n, e).select("symbol")


def affected_flows(s, d):
    """Flows through the files of one region."""
    n, e = _flow_graph(s, d)
    f = G.trace_flows(n, e, 15)
    changed = n.filter("file_path like '/w/ASIA/%'").select(F.col("file_path").alias("path"))
    return G.affected_flows(f, changed).select("entry_point_id", "node_count")


def memberships(s, d):
    """How many flows each node lies in."""
    n, e = _flow_graph(s, d)
    return G.flow_memberships(G.trace_flows(n, e, 15)).groupBy("node_id").agg(F.count("*").alias("flows"))


def cohesion(s, d):
    return G.cohesion(_nodes(s, d).select("symbol", F.col("community_id").alias("group")), _calls(s, d))


def cross_communities(s, d):
    n = _nodes(s, d)
    return G.cross_edges(n, _calls(s, d)).select("a", "b", "n", F.size("kinds").alias("n_kinds"))


def communities(s, d):
    """Directory communities with size, cohesion and the usual language."""
    n = _nodes(s, d)
    return G.communities(G.directory_groups(n), _calls(s, d)).select("group", "size", "cohesion", "dominant_language")


def _churn(s, d):
    return _nodes(s, d).select("file_path").distinct().withColumn("commits", (F.length("file_path") % 7).cast("long"))


def risk_scores(s, d):
    """Risk of all nodes from flows, callers, tests, names and churn."""
    n, e = _flow_graph(s, d)
    return G.risk_scores(n, n, e, G.trace_flows(n, e, 15), _churn(s, d)).select("symbol", "risk_score")


def test_counts(s, d):
    """Tests of each node and of those that it calls."""
    n, e = _flow_graph(s, d)
    return G.test_counts(n, e)


def changed_functions(s, d):
    """What changes in one region's files touch: risks of the first 500 nodes."""
    n, e = _flow_graph(s, d)
    files = n.filter("file_path like '/w/EUROPE/%'").select(F.col("file_path").alias("path"))
    return G.detect_changes(n, e, G.trace_flows(n, e, 15), files, churn=_churn(s, d))["changed_functions"].select("symbol", "risk_score")


def test_gaps(s, d):
    n, e = _flow_graph(s, d)
    files = n.filter("file_path like '/w/EUROPE/%'").select(F.col("file_path").alias("path"))
    return G.detect_changes(n, e, G.trace_flows(n, e, 15), files)["test_gaps"].select("symbol")


def map_changes(s, d):
    r = _t(s, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("x/"), "n_name", F.lit("/x.py")).alias("path"), F.lit(5).cast("long").alias("start"), F.lit(6).cast("long").alias("end"))
    r = r.select(F.substring("path", 3, 1000).alias("path"), "start", "end")
    return G.map_changes(_nodes(s, d), r).select("symbol")


def two_tier_lookup(s, d):
    """Parts looked up by (brand, type), else by type where it is unique among small parts."""
    p = _t(s, d, "part")
    table = p.filter("p_size <= 2").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_partkey").alias("v"))
    rows = p.filter("p_size > 40").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return R.two_tier_lookup(rows, table, ["brand", "type"], "type", "v").select("p_partkey", "found", "tier")


def manifest_delta(s, d):
    """Documents of three sources against those of three others, keyed by the hash of the whole text."""
    doc = _t(s, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("rel"), F.col("lang").alias("face"), "source", (F.col("n_chars") + F.length("source")).alias("size"), F.md5(F.col("source").cast("binary")).alias("hash"), "doc_id")
    state = lambda src: R.first_of(doc.filter(F.col("source").isin(*src)), ["face", "rel"], ["doc_id"]).select("face", "rel", "size", "hash")
    return R.manifest_delta(state(["src0", "src1", "src2"]), state(["src2", "src3", "src4"]))


def search_words(s, d):
    """Documents with all words, as whole words."""
    n = _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("source").alias("qname"))
    return G.search(n, "the that with", 2_000_000_000)[0].select("id")


def search_tokens(s, d):
    """Documents with all words, by the table of tokens."""
    n = _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return G.search_tokens(G.token_table(n), n, "the that with", 1_000_000).select("id")


def search_substring(s, d):
    n = _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("source").alias("qname"))
    return G.search(n, "ertion bleea", 2_000_000_000, index=False)[0].select("id")


def _page_rows(s, d):
    return _t(s, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("rel"))


def hotspots(s, d):
    r = _page_rows(s, d)
    spots, _ = R.hotspots(r, F.when(F.col("page_id") % 11 != 0, F.col("rel")), F.col("page_id") % 7 == 0, F.col("page_id") % 13 == 0, "page_id", 5)
    return spots.select("bucket", "dir", "n", "first_seen", "rank")


def hotspot_totals(s, d):
    r = _page_rows(s, d)
    return R.hotspots(r, F.when(F.col("page_id") % 11 != 0, F.col("rel")), F.col("page_id") % 7 == 0, F.col("page_id") % 13 == 0, "page_id", 5)[1]


def module_export(s, d):
    from .plans.build import module_export as run

    x = run(_nodes(s, d), _calls(s, d), "/w", [("ASIA/", 1)])
    return x["module_edges"]


def participating_files(s, d):
    from .plans.build import module_export as run

    return run(_nodes(s, d), _calls(s, d), "/w")["files"]


def shadowed(s, d):
    """Lines not returned give way to returned lines of the same order and supplier parity."""
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 2).alias("side"), "l_returnflag")
    return R.shadowed(li, ["l_orderkey", "side"], F.col("l_returnflag") != "R")


def collisions(s, d):
    """Part prices and sizes met in orders of several market segments: keys under several roots."""
    o, c = _t(s, d, "orders"), _t(s, d, "customer")
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("symbol"), F.col("c_mktsegment").alias("root"))
    return R.collisions(x)


def set_delta(s, d):
    return R.set_delta(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels").filter("toxic = 0").select("doc_id").union(s.range(-3, 0).select(F.col("id").alias("doc_id"))))


def ordered_mode(s, d):
    """Each customer's usual order priority, ties to the first order."""
    return R.ordered_mode(_t(s, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderpriority", "n", "first_seen")


def audit(s, d):
    """Files where fewer nodes of a language are known than suppliers and customers counted."""
    n = _nodes(s, d).filter("id % 3 <> 0").withColumn("name", F.col("language"))
    have = _nodes(s, d).groupBy(F.col("file_path").alias("file"), F.col("language").alias("name")).agg(F.count("*").alias("n"))
    return C.audit(n, have)


def nearest_line(s, d):
    """Each purchase's nearest sign-up of the same user, by time."""
    e = _t(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("u"), "event_type", _micros("ts").alias("t"))
    a = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("anchor_id"), F.col("u").alias("file"), F.lit("signup").alias("name"), F.col("t").alias("doc_line"))
    n = e.filter("event_type = 'signup'").select(F.concat(F.lit("e"), "event_id").alias("symbol"), F.lit("signup").alias("name"), F.col("u").alias("file_path"), F.col("t").alias("line_start"))
    return R.nearest_line(a, n).filter("how = 'same_file'").select("anchor_id", "symbol")


def strongest_edges(s, d):
    return G.strongest(_calls(s, d)).select("caller_symbol", "callee_symbol", "w")


def bridges(s, d):
    """Betweenness over all nodes of a ring of nations' suppliers and their calls."""
    n, e = _flow_graph(s, d)
    return G.bridge_nodes(n, e, None).select("symbol", F.round("betweenness", 9).alias("betweenness"))


def leiden(s, d):
    return G.leiden_groups(_nodes(s, d), _calls(s, d)).select("symbol", "group")


def modularity(s, d):
    """Modularity of the nations as groups."""
    m = _nodes(s, d).select("symbol", F.col("community_id").alias("group"))
    return G.modularity(m, _calls(s, d)).select(F.round("modularity", 9).alias("modularity"))


def warnings(s, d):
    """Pairs of communities with more than ten edges, the 20 largest."""
    n = _nodes(s, d)
    named = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("test-"), "n_name")).otherwise(F.col("n_name")).alias("name"))
    return G.coupling_warnings(G.cross_edges(n, _calls(s, d)), named).select("name_a", "name_b", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "closure_levels impact_files affected_flows memberships test_counts changed_functions test_gaps modularity warnings hub_degrees hub_top edge_diff edge_reversed changed_modules compare_claims callers item_level derived_edges nearest_preceding trace_nesting trace_stats closure impact_radius flows entry_points cohesion cross_communities communities risk_scores map_changes two_tier_lookup manifest_delta search_words search_tokens search_substring hotspots hotspot_totals module_export participating_files shadowed collisions set_delta ordered_mode audit nearest_line strongest_edges bridges leiden"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    degrees = f"with {_CALLS}, {_NODES}, ends as (select caller_symbol as symbol, 0 as i, 1 as o from calls union all select callee_symbol, 1, 0 from calls), deg as (select symbol, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i + o) as bigint) as total_degree, min(id) as id from ends join nodes using (symbol) group by symbol)"
    hot = "r as (select page_id, case when page_id % 11 <> 0 then regexp_replace(url, '^https?://', '') end as rel from pages), c as (select page_id, regexp_extract(rel, '^(.*)/[^/]*$', 1) as dir, case when rel is null then 'outside' when page_id % 13 = 0 then 'excluded' when page_id % 7 = 0 or starts_with(rel, 'tests/') then 'test' else 'prod' end as bucket from r)"
    module = lambda a: f"case when {a}.r_name = 'ASIA' then 'ASIA/' || {a}.n_name else {a}.r_name end"
    weight = "case kind when 'CALLS' then 1.0 when 'REFERENCES' then 0.6 when 'IMPORTS_FROM' then 0.5 end"
    hops4 = ", ".join(f"h{k} as (select distinct caller as symbol from links join h{k - 1} on callee = h{k - 1}.symbol)" for k in (1, 2, 3, 4))
    levels4 = " union all ".join(f"select symbol, {k} as depth from h{k}" for k in (0, 1, 2, 3, 4))
    hops = ", ".join(f"h{k} as (select distinct caller as symbol from links join h{k - 1} on callee = h{k - 1}.symbol)" for k in (1, 2, 3))
    levels = " union all ".join(f"select symbol, {k} as depth from h{k}" for k in (0, 1, 2, 3))
    return {
        "hub_degrees": degrees + " select symbol, in_degree, out_degree, total_degree from deg",
        "hub_top": degrees + " select symbol, total_degree from deg order by total_degree desc, id limit 20",
        "edge_diff": f"with {_SNAP} select src, dst, kind, 'added' as change from added union all select src, dst, kind, 'removed' from removed",
        "edge_reversed": f"with {_SNAP} select src, dst from added intersect select dst, src from removed",
        "changed_modules": f"with {_SNAP}, x as (select src, dst from added union all select src, dst from removed) select src as module from x union select dst from x",
        "compare_claims": f"with {_SNAP}, c as (select n_nationkey as module from nation where n_regionkey <= 2), x as (select distinct src as module from (select src, dst from added intersect select dst, src from removed)) select coalesce(c.module, x.module) as module, case when c.module is null then 'surprise' when x.module is null then 'missed' else 'hit' end as verdict from c full join x on c.module = x.module",
        "callers": f"with {_INNER} select caller, count(*) as n_sites, min(seq) as first_seq, string_agg(t, ',' order by seq) as lines from best group by caller",
        "item_level": f"with {_INNER} select seq, symbol from rf where seq not in (select seq from best)",
        "derived_edges": f"with {_INNER} select caller, symbol as callee, count(*) as n_sites from best where symbol in ('purchase', 'error') group by caller, symbol",
        "nearest_preceding": "select p.event_id, (select arg_max(s.event_id, (s.ts, s.event_id)) from events s where s.event_type = 'signup' and s.user_id = p.user_id and s.ts <= p.ts) as signup_id from events p where p.event_type = 'purchase'",
        "trace_nesting": f"with {_TRACE} select event_id as ord, parent_ord from best",
        "trace_stats": f"with {_TRACE} select caller, callee, count(*) as count, median(dur) / 1000 as p50_ms, quantile_disc(dur, 0.95) / 1000 as p95_ms, min(event_id) as first_seen from best group by caller, callee",
        "closure": f"with {_LINKS}, h0 as (select 's1' as symbol), {hops}, x as ({levels}), m as (select symbol, min(depth) as depth from x group by symbol), e as (select depth, count(*) as n from (select distinct m.symbol, m.depth, l.caller from m join links l on l.callee = m.symbol where m.depth < 3) group by depth) select symbol, depth, (select sum(n) from e)::bigint - (select count(*) from m where depth > 0) as again from m where depth > 0",
        "closure_levels": f"with {_LINKS}, {_NODES}, h0 as (select 's1' as symbol), {hops4}, x as ({levels4}), m as (select symbol, min(depth) as depth from x group by symbol) select k::int as depth, count(m.symbol) as n_new, count(distinct case when m.symbol is not null then (r_name, n_name) end)::int as n_files from range(1, 5) t(k) left join m on m.depth = k left join nodes using (symbol) group by k",
        "impact_radius": f"with {_CALLS}, {_NODES}, e as (select caller_symbol as a, callee_symbol as b, max({weight})::double * 0.6::double as w from calls group by 1, 2), g as (select a as s, b as o, w from e union all select b, a, w from e), seed as (select symbol from nodes where (r_name, n_name) = (select (r_name, n_name) from nodes where symbol = 's1')), r1 as (select o as symbol, max(w) as score from g join seed on s = symbol where w > 0.05 and o not in (select symbol from seed) group by o), r2 as (select o as symbol, max(score * w) as score from g join r1 on s = symbol where score * w > 0.05 and o not in (select symbol from seed) group by o), best as (select symbol, max(score) as score from (select * from r1 union all select * from r2) join nodes using (symbol) group by symbol) select symbol, score, (select count(*) from best) as total, (select count(*) > 500 from best) as truncated from best order by score desc, symbol limit 500",
        "impact_files": f"with {_CALLS}, {_NODES}, e as (select caller_symbol as a, callee_symbol as b, max({weight})::double * 0.6::double as w from calls group by 1, 2), g as (select a as s, b as o, w from e union all select b, a, w from e), seed as (select symbol from nodes where (r_name, n_name) = (select (r_name, n_name) from nodes where symbol = 's1')), r1 as (select o as symbol, max(w) as score from g join seed on s = symbol where w > 0.05 and o not in (select symbol from seed) group by o), r2 as (select o as symbol, max(score * w) as score from g join r1 on s = symbol where score * w > 0.05 and o not in (select symbol from seed) group by o), best as (select symbol, max(score) as score from (select * from r1 union all select * from r2) join nodes using (symbol) group by symbol) select distinct '/w/' || r_name || '/' || n_name || '/x.py' as file_path from best join nodes using (symbol)",
        "flows": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow) select id as entry_point_id, depth, node_count, file_count, criticality, node_count::int as n_path from fl",
        "affected_flows": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow) select id as entry_point_id, node_count from fl where id in (select tour.id from tour join nodes using (symbol) where r_name = 'ASIA')",
        "memberships": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow), z as (select tour.id, tour.symbol from tour join fl using (id)) select nodes.id as node_id, count(*) as flows from z join nodes using (symbol) group by 1",
        "entry_points": f"with {_FLOW} select symbol from nodes where symbol not in (select callee from k)",
        "cohesion": f"with {_CALLS}, {_NODES}, e as (select a.community as g1, b.community as g2 from calls left join nodes a on caller_symbol = a.symbol left join nodes b on callee_symbol = b.symbol), x as (select g1 as g, cast(g1 = g2 as int) as i from e union all select g2, 0 from e where g1 <> g2) select cast(g as bigint) as \"group\", cast(sum(i) as bigint) as internal, cast(sum(1 - i) as bigint) as external, sum(i) / count(*) as cohesion from x group by g",
        "cross_communities": f"with {_CALLS}, {_NODES}, e as (select least(a.community, b.community) as a, greatest(a.community, b.community) as b, kind from calls join nodes a on caller_symbol = a.symbol join nodes b on callee_symbol = b.symbol where a.community <> b.community) select cast(a as bigint) as a, cast(b as bigint) as b, count(*) as n, cast(count(distinct kind) as int) as n_kinds from e group by a, b",
        "communities": f"with {_CALLS}, {_NODES}, ends as (select caller_symbol as symbol, callee_symbol as other from calls union all select callee_symbol, caller_symbol from calls), size as (select r_name, count(*) as n, count(distinct n_name) as k from nodes group by r_name), deep as (select count(*) >= 10 as top from size where n >= 2), g as (select symbol, id, language, case when (select top from deep) then r_name else r_name || '/' || n_name end as grp from nodes), lang as (select grp, language, row_number() over (partition by grp order by count(*) desc, min(id)) as r from g group by grp, language), c as (select a.grp as g1, b.grp as g2 from calls join g a on caller_symbol = a.symbol join g b on callee_symbol = b.symbol), x as (select g1 as grp, cast(g1 = g2 as int) as i from c union all select g2, 0 from c where g1 <> g2), co as (select grp, sum(i) / count(*) as cohesion from x group by grp) select g.grp as \"group\", count(*) as size, coalesce(min(cohesion), 0) as cohesion, min(lang.language) as dominant_language from g join lang on g.grp = lang.grp and r = 1 left join co on g.grp = co.grp group by g.grp having count(*) >= 2",
        "risk_scores": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow), callers as (select distinct caller_symbol, callee_symbol from calls where kind = 'CALLS' union select caller, callee from chain where callee is not null), p as (select n.symbol, count(*) as callers, count(*) filter (c.community <> n.community) as crossing from callers x join nodes n on x.callee_symbol = n.symbol left join nodes c on x.caller_symbol = c.symbol group by n.symbol), share as (select tour.symbol, least(sum(criticality), 0.25::double) as flow from tour join fl using (id) group by 1), o as (select caller as symbol, callee, min(eid) as eid from (select caller_symbol as caller, callee_symbol as callee, id as eid from calls where kind = 'CALLS' union all select caller, callee, 1000000000000 + substr(caller, 2)::bigint from chain where callee is not null union all select 's' || l_suppkey, 'p' || l_partkey, 3000000000000 + l_orderkey * 100 + l_linenumber from lineitem where l_returnflag = 'R') group by 1, 2), o50 as (select * from (select *, row_number() over (partition by symbol order by eid) as r from o) where r <= 50), tests as (select symbol, count(distinct test) as tests from (select symbol, test from tst union all select o50.symbol, tst.test from o50 join tst on o50.callee = tst.symbol) group by 1) select named.symbol, least(1, greatest(0, coalesce(flow, 0) + least(coalesce(crossing, 0) * 0.05::double, 0.15::double) + 0.30::double - least(coalesce(tests, 0) / 5.0::double, 1) * 0.25::double + case when nm like 'auth_%' then 0.20::double else 0 end + least(coalesce(callers, 0) / 20.0::double, 0.10::double) + least(length('/w/' || r_name || '/' || n_name || '/x.py') % 7 / 10.0::double, 1) * 0.15::double)) as risk_score from named left join share on named.symbol = share.symbol left join p on named.symbol = p.symbol left join tests on named.symbol = tests.symbol",
        "test_counts": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow), callers as (select distinct caller_symbol, callee_symbol from calls where kind = 'CALLS' union select caller, callee from chain where callee is not null), p as (select n.symbol, count(*) as callers, count(*) filter (c.community <> n.community) as crossing from callers x join nodes n on x.callee_symbol = n.symbol left join nodes c on x.caller_symbol = c.symbol group by n.symbol), share as (select tour.symbol, least(sum(criticality), 0.25::double) as flow from tour join fl using (id) group by 1), o as (select caller as symbol, callee, min(eid) as eid from (select caller_symbol as caller, callee_symbol as callee, id as eid from calls where kind = 'CALLS' union all select caller, callee, 1000000000000 + substr(caller, 2)::bigint from chain where callee is not null union all select 's' || l_suppkey, 'p' || l_partkey, 3000000000000 + l_orderkey * 100 + l_linenumber from lineitem where l_returnflag = 'R') group by 1, 2), o50 as (select * from (select *, row_number() over (partition by symbol order by eid) as r from o) where r <= 50), tests as (select symbol, count(distinct test) as tests from (select symbol, test from tst union all select o50.symbol, tst.test from o50 join tst on o50.callee = tst.symbol) group by 1) select named.symbol, tests from named join tests on named.symbol = tests.symbol",
        "changed_functions": f"with {_FLOW}, entry as (select id, symbol from nodes where symbol not in (select callee from k)), tour as (with recursive f(id, symbol, depth) as (select id, symbol, 0 from entry union select f.id, k.callee, f.depth + 1 from f join k on k.caller = f.symbol where f.depth < 15) select id, symbol, min(depth) as depth from f group by 1, 2), flow as (select m.id, max(depth)::bigint as depth, count(*) as node_count, count(distinct (r_name, n_name)) as file_count, sum(coalesce(ext.n, 0)) as external, avg(case when nm like 'auth_%' then 1.0::double else 0 end) as secure, avg(case when m.symbol in (select symbol from tst) then 1.0::double else 0 end) as tested from tour m join named on m.symbol = named.symbol left join ext on m.symbol = ext.symbol group by m.id having count(*) >= 2), fl as (select *, 0.30::double * least((file_count - 1) / 4.0::double, 1) + 0.20::double * least(external / 5.0::double, 1) + 0.25::double * secure + 0.15::double * (1 - tested) + 0.10::double * least(depth / 10.0::double, 1) as criticality from flow), callers as (select distinct caller_symbol, callee_symbol from calls where kind = 'CALLS' union select caller, callee from chain where callee is not null), p as (select n.symbol, count(*) as callers, count(*) filter (c.community <> n.community) as crossing from callers x join nodes n on x.callee_symbol = n.symbol left join nodes c on x.caller_symbol = c.symbol group by n.symbol), share as (select tour.symbol, least(sum(criticality), 0.25::double) as flow from tour join fl using (id) group by 1), o as (select caller as symbol, callee, min(eid) as eid from (select caller_symbol as caller, callee_symbol as callee, id as eid from calls where kind = 'CALLS' union all select caller, callee, 1000000000000 + substr(caller, 2)::bigint from chain where callee is not null union all select 's' || l_suppkey, 'p' || l_partkey, 3000000000000 + l_orderkey * 100 + l_linenumber from lineitem where l_returnflag = 'R') group by 1, 2), o50 as (select * from (select *, row_number() over (partition by symbol order by eid) as r from o) where r <= 50), tests as (select symbol, count(distinct test) as tests from (select symbol, test from tst union all select o50.symbol, tst.test from o50 join tst on o50.callee = tst.symbol) group by 1) select named.symbol, least(1, greatest(0, coalesce(flow, 0) + least(coalesce(crossing, 0) * 0.05::double, 0.15::double) + 0.30::double - least(coalesce(tests, 0) / 5.0::double, 1) * 0.25::double + case when nm like 'auth_%' then 0.20::double else 0 end + least(coalesce(callers, 0) / 20.0::double, 0.10::double) + least(length('/w/' || r_name || '/' || n_name || '/x.py') % 7 / 10.0::double, 1) * 0.15::double)) as risk_score from named left join share on named.symbol = share.symbol left join p on named.symbol = p.symbol left join tests on named.symbol = tests.symbol where r_name = 'EUROPE' order by named.id limit 500",
        "test_gaps": f"with {_FLOW}, first as (select * from nodes where r_name = 'EUROPE' order by id limit 500) select symbol from first where symbol not in (select symbol from tst)",
        "map_changes": f"with {_NODES} select symbol from nodes where n_name in (select n_name from nation where n_regionkey = 1)",
        "two_tier_lookup": "with t as (select p_brand, p_type, p_partkey from part where p_size <= 2), a as (select p_brand, p_type, min(p_partkey) as v from t group by 1, 2), b as (select p_type, min(p_partkey) as v from t group by 1 having count(*) = 1) select p.p_partkey, coalesce(a.v, b.v) as found, case when a.v is not null then 1 when b.v is not null then 2 end as tier from part p left join a on p.p_brand = a.p_brand and p.p_type = a.p_type left join b on p.p_type = b.p_type where p_size > 40",
        "manifest_delta": "with x as (select md5(text) as rel, lang as face, source, n_chars + length(source) as size, md5(source) as hash, doc_id from documents), a as (select face, rel, arg_min(size, doc_id) as size, arg_min(hash, doc_id) as hash from x where source in ('src0', 'src1', 'src2') group by all), b as (select face, rel, arg_min(size, doc_id) as size, arg_min(hash, doc_id) as hash from x where source in ('src2', 'src3', 'src4') group by all), j as (select coalesce(a.face, b.face) as face, coalesce(a.rel, b.rel) as rel, case when a.rel is null then 'added' when b.rel is null then 'removed' when (a.size, a.hash) <> (b.size, b.hash) then 'changed' end as change from a full join b on a.face = b.face and a.rel = b.rel) select * from j where change is not null",
        "modularity": f"with {_CALLS}, {_NODES}, e as (select least(caller_symbol, callee_symbol) as a, greatest(caller_symbol, callee_symbol) as b, max({weight})::double as w from calls where caller_symbol <> callee_symbol group by 1, 2), x as (select n.community as g, w, n.community = m.community as i from e join nodes n on a = n.symbol join nodes m on b = m.symbol union all select m.community, w, n.community = m.community from e join nodes n on a = n.symbol join nodes m on b = m.symbol), p as (select g, sum(case when i then w / 2 else 0 end) as i, sum(w) as d from x group by g), t as (select sum(d) as m2 from p) select round(sum(i / (m2 / 2) - (d / m2) ** 2), 9) as modularity from p, t",
        "warnings": f"with {_CALLS}, {_NODES}, e as (select least(a.community, b.community) as x, greatest(a.community, b.community) as y, calls.id from calls join nodes a on caller_symbol = a.symbol join nodes b on callee_symbol = b.symbol where a.community <> b.community), p as (select x, y, count(*) as n, min(id) as f from e group by 1, 2 having count(*) > 10) select a.n_name as name_a, b.n_name as name_b, n from p join nation a on x = a.n_nationkey join nation b on y = b.n_nationkey where x % 5 <> 0 and y % 5 <> 0 order by n desc, f limit 20",
        "search_words": "with x as (select doc_id as id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' as t from documents) select id from x where contains(t, ' the ') and contains(t, ' that ') and contains(t, ' with ')",
        "search_tokens": "with x as (select doc_id as id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' as t from documents) select id from x where contains(t, ' the ') and contains(t, ' that ') and contains(t, ' with ')",
        "search_substring": "select doc_id as id from documents where contains(lower(text), 'ertion') and contains(lower(text), 'bleea')",
        "hotspots": f"with {hot}, n as (select bucket, dir, count(*) as n, min(page_id) as first_seen from c where bucket in ('prod', 'test') group by 1, 2), k as (select *, cast(row_number() over (partition by bucket order by n desc, first_seen) as int) as rank from n) select * from k where rank <= 5",
        "hotspot_totals": f"with {hot} select count(*) filter (bucket = 'prod') as prod, count(*) filter (bucket = 'test') as test, count(*) filter (bucket = 'excluded') as excluded, count(*) filter (bucket = 'outside') as outside from c",
        "module_export": f"with {_CALLS}, {_NODES}, e as (select distinct {module('a')} as src, {module('b')} as dst, kind from calls join nodes a on caller_symbol = a.symbol join nodes b on callee_symbol = b.symbol where kind in ('CALLS', 'IMPORTS_FROM')) select * from e where src <> dst",
        "participating_files": f"with {_CALLS}, {_NODES}, s as (select caller_symbol as symbol from calls union select callee_symbol from calls) select distinct r_name || '/' || n_name || '/x.py' as file from s join nodes using (symbol)",
        "shadowed": "with x as (select l_orderkey, l_linenumber, l_suppkey % 2 as side, l_returnflag from lineitem) select * from x where l_returnflag = 'R' or not exists (select 1 from x y where y.l_orderkey = x.l_orderkey and y.side = x.side and y.l_returnflag = 'R')",
        "collisions": "select strftime(o_orderdate, '%Y-%m-%d') as symbol, count(distinct c_mktsegment) as n_roots from orders join customer on o_custkey = c_custkey group by 1 having count(distinct c_mktsegment) > 1",
        "set_delta": "with a as (select doc_id from documents), b as (select doc_id from labels where toxic = 0 union select unnest([-3, -2, -1])) select doc_id, 'missing' as side from (select * from a except select * from b) union all select doc_id, 'extra' from (select * from b except select * from a)",
        "ordered_mode": "with n as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as first_seen from orders group by 1, 2), k as (select *, row_number() over (partition by o_custkey order by n desc, first_seen) as r from n) select o_custkey, o_orderpriority, n, first_seen from k where r = 1",
        "audit": f"with {_NODES}, h as (select '/w/' || r_name || '/' || n_name || '/x.py' as file, language as name, count(*) as expected, count(*) filter (id % 3 <> 0) as found from nodes group by 1, 2) select * from h where found < expected",
        "nearest_line": "with p as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'purchase'), s as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'signup') select p.event_id as anchor_id, arg_min('e' || s.event_id, (abs(s.t - p.t), s.t, 'e' || s.event_id)) as symbol from p join s using (user_id) group by p.event_id",
        "strongest_edges": f"with {_CALLS} select caller_symbol, callee_symbol, cast(max({weight}) as double) as w from calls group by 1, 2",
    }
