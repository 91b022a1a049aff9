"""Queries for operators on symbols, paths, names, candidates, snapshots and states, each with SQL that gives the same rows.

Inputs are derived from the driver's tables by simple rules, so that SQL can state the right answer without parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import descriptors as D
from .functions import exprs as E
from .operators import reconcile as C
from .operators import relational as R
from .operators import resolve as V
from .operators import transition as T
from .plans import serving as P
from .sources import files as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cases(n: Column, *values: str) -> Column:
    """The n-th SQL expression."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(n == i, F.expr(v)).otherwise(out)
    return out


def _sql_cases(n: str, *values: str) -> str:
    return f"case {n} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


# --- symbols

_SYMBOLS = (
    "'scip-python python pkg 0.1 `a.b`/C' || z || '#m' || k || '().'",
    "'scip-python python pkg 0.1 `a.b`/K' || k || '#'",
    "'rust-analyzer cargo pkg 0.1.0 dir/impl#[T' || z || '][Tr]f' || k || '().'",
    "'scip-typescript npm pkg 1.0 src/`x.ts`/v' || k || '.'",
    "'rust-analyzer cargo pkg 0.1.0 dir/impl#[T' || z || '][]f' || k || '().'",
    "'bare' || k",
    "'lsp python pkg 0 `m`/f_' || k || '().'",
    "'rust-analyzer cargo pkg 0.1.0 dir/impl#[T' || z || '][AsRef<[u8]>]f' || k || '().'",
)
_PATHS = ("'src/a' || z || '.py'", "'src/b.pyi'", "'crates/x/src/l.rs'", "'web/x.ts'", "'crates/y/src/l.rs'", "'README'", "'tests/t.py'", "'crates/z/src/l.rs'")


def _symbols(s, d):
    g = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    return g.select("k", "z", _cases(F.col("k") % 8, *_SYMBOLS).alias("symbol"), _cases(F.col("k") % 8, *_PATHS).alias("path"))


_G = f"g as (select p_partkey as k, p_size as z, p_partkey % 8 as v, {_sql_cases('p_partkey % 8', *(x.replace('|| z', '|| p_size').replace('|| k', '|| p_partkey') for x in _SYMBOLS))} as symbol from part)"


def symbol_parts(s, d):
    """Tails, own class, tail word, scheme, language and kind of symbols."""
    x = F.col("symbol")
    return _symbols(s, d).select("k", E.fn_tail(x).alias("fn"), E.class_tail(x).alias("cls"), E.class_segment(x).alias("owner"), E.symbol_tail(x).alias("tail"), E.is_python_symbol(x).alias("python"), E.language_of("path").alias("language"), E.language_of("path", x).alias("by_scheme"), E.ingest_kind(x, "path").alias("kind"), D.descriptor_region(x).alias("region"))


def symbol_chains(s, d):
    """Scope chains and impl heads."""
    r = D.descriptor_region("symbol")
    h = D.impl_head(r)
    return _symbols(s, d).select("k", F.array_join(D.descriptor_chain(r), "/").alias("chain"), h["state"].alias("state"), h["receiver"].alias("receiver"), F.array_join(h["traits"], "/").alias("traits"))


def identifiers(s, d):
    """The called or longest name in texts around a name, and qualifiers."""
    g = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    t = _cases(F.col("k") % 6, "'see Abc.run' || k || '(x) and something_longer_' || z", "'def run' || k", "'Cls' || z || '::m' || k || '()[Disp]'", "'a::b::Cls' || z || '::m' || k || '[Tr<[u8]>]'", "'self::items[0]'", "'Cls::m[]'")
    b, q = D.best_ident("t"), D.parse_qualifier("t")
    return g.select("k", t.alias("t")).select("k", b["last"].alias("last"), b["full"].alias("full"), q["state"].alias("state"), q["receiver"].alias("receiver"), q["method"].alias("method"), q["trait"].alias("trait"))


def symbol_queries(s, d):
    """Definitions that a bare name and `Type.method` find, and symbols with a part between separators."""
    o = _symbols(s, d).withColumn("is_def", F.lit(True)).withColumn("rel_path", F.col("path"))
    a = R.definitions(o, "m8").select("k", F.lit("name").alias("by"))
    b = R.definitions(o, "K9").select("k", F.lit("class").alias("by"))
    c = o.filter(E.matches_query("symbol", "path", "T7.f66")).select("k", F.lit("owner").alias("by"))
    n = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(".", F.concat(F.lit("pkg"), "p_size"), F.col("p_type"), F.concat(F.lit("n"), "p_partkey")).alias("name"))
    return a.union(b).union(c).union(R.like_symbols(n, "name", "Economy").select("k", F.lit("like").alias("by")))


def referenced(s, d):
    """References to the symbols that a query defines, with their number, and the outline of a file by line."""
    g = _symbols(s, d)
    li = _t(s, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).join(g, "k")
    occ = g.select("symbol", F.col("path").alias("rel_path"), F.lit(True).alias("is_def"), F.col("k").alias("line")).union(li.select("symbol", F.col("path").alias("rel_path"), F.lit(False).alias("is_def"), "line"))
    return R.references(occ, occ.filter("is_def")).groupBy("symbol").agg(F.count("*").alias("refs"), F.min("line").alias("first"))


def name_lookup(s, d):
    """Nodes by `Parent.name`, by name, and after `::`."""
    n = _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.col("p_partkey") % 500).alias("name"), F.concat(F.lit("P"), "p_size").alias("parent_name"), F.concat(F.lit("q"), "p_partkey").alias("qname"), F.concat(F.lit("s"), "p_partkey").alias("symbol"))
    out = None
    for q in ("P7.n66", "n123", "mod::n124", "q77", "nothing"):
        how, rows = R.resolve(n, q)
        x = rows.select(F.lit(q).alias("query"), F.lit(how).alias("how"), "id")
        out = x if out is None else out.union(x)
    return out


# --- paths, names, numbers, dates


def path_facts(s, d):
    g = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    p = _cases(F.col("k") % 7, "'tests/a' || z || '.py'", "'src/app/m' || z || '/x.spec.ts'", "'./src\\\\win' || z || '/y.rs'", "'.venv/lib/z.py'", "'/root/r/core/deep/er/f' || z || '.py'", "'python/pkg/sub' || z || '/__init__.pyi'", "'pkg/core/n' || z || '.pyi'")
    x = F.col("p")
    return g.select("k", p.alias("p")).select(
        "k", E.is_test_path(x).alias("test"), E.is_excluded(x, ["src/app/m1"]).alias("excluded"), E.module_of(x, [("src/app/", 1), ("src/", 2)]).alias("module"), E.repo_relative(x, "/root/r").alias("rel"),
        E.directory(x).alias("dir"), E.file_stem(x).alias("stem"), E.extension(x).alias("ext"), E.normalize_rel(x).alias("plain"), E.pyi_module(x, "pkg").alias("stub"), C.crate_of(E.normalize_rel(x)).alias("crate"),
        E.path_matches(x, F.lit("core/deep/er/f7.py")).alias("match"),
    )


def name_facts(s, d):
    g = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    n = _cases(F.col("k") % 8, "'main'", "'test_case' || z", "'verifyToken' || z", "'doGet'", "'parseHTTPBody' || z", "'plain_name-part' || z", "'boot'", "'on_start' || z")
    deco = _cases(F.col("k") % 5, "'{\"decorators\":\"app.route(\\'/x\\')\"}'", "'{\"decorators\":[\"functools.cache\",\"pytest.fixture\"]}'", "'{\"decorators\":[\"functools.cache\"]}'", "'no json'", "'{\"verilog_kind\":\"module\"}'")
    php = F.when(F.col("k") % 2 == 0, "php").otherwise("python")
    return g.select("k", "z", n.alias("n"), deco.alias("extra"), php.alias("lang")).select(
        "k", E.is_entry_name("n", "lang").alias("entry"), E.has_framework_decorator("extra").alias("decorated"), E.is_verilog("extra").alias("verilog"), E.is_security_sensitive("n").alias("secure"), E.slug("n").alias("slug"), F.array_join(E.split_name("n"), "/").alias("words"),
        E.screaming_snake("n").alias("snake"), E.kebab(F.concat(F.lit("  "), "n", F.lit("!"))).alias("kebab"), E.sanitize_name(F.concat("n", F.lit("\x01\t"), F.repeat(F.lit("y"), 300))).alias("clean"), E.is_test_community(F.when(F.col("z") % 2 == 0, F.concat(F.lit("test-"), "n")).otherwise(F.col("n"))).alias("test_community"),
        E.event_name(F.concat("n", F.lit(" (/r/x.py:12)"))).alias("event"), E.event_path(F.concat("n", F.lit(" (/r/x.py:12)"))).alias("where"), E.anchor_pattern(F.concat(F.lit("  "), "n", F.lit("(a, b)  "))).alias("anchor"), E.ts_key(F.concat(F.lit("#12 - "), "n", F.lit(" - rest"))).alias("title"),
        E.sanitize_brackets(F.concat(F.lit("see ["), "n", F.lit("] or [x](y)"))).alias("brackets"), E.revive_crossrefs(F.concat(F.lit("go [3 - "), "n", F.lit("]")), {3: "key three"}).alias("link"), E.like_escape(F.concat("n", F.lit("%"))).alias("like"),
    )


def number_facts(s, d):
    """Shares, bands, rounding, weights and positions."""
    o = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("l_extendedprice").alias("x"), "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "TESTED_BY").otherwise("OTHER")
    return o.select("l_orderkey", "l_linenumber", E.pct(F.col("l_quantity").cast("long"), F.col("l_linenumber") - 1 + F.lit(50)).alias("pct"), E.pct(F.lit(1), F.col("l_linenumber") - 1).alias("pct0"), E.risk_band(F.col("l_discount") * 10).alias("band"), E.edge_weight(kind).alias("weight"), E.one_based(F.col("l_linenumber") - 2).alias("line"))


def rounded_prices(s, d):
    """Half-even rounding on the binary value, as printing does."""
    return _t(s, d, "orders").select("o_orderkey", E.rounded(F.col("o_totalprice") / 7, 2).alias("two"), E.rounded(F.col("o_totalprice") / 8, 1).alias("one"))


def date_facts(s, d):
    """ISO dates and times in several forms as seconds; days; expiry."""
    o = _t(s, d, "orders").select("o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.expr("case o_orderkey % 5 when 0 then 'T10:20:30Z' when 1 then ' 01:02:03.5+02:00' when 2 then 't23:59:59-0130' when 3 then 'T25:00:00Z' else 'T00:00:00' end")
    return o.select("o_orderkey", E.iso_epoch(F.concat(day, form)).alias("epoch"), E.civil_days(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate") + 3).cast("long").alias("days"), E.expired("o_orderdate", F.lit("1998-06-01").cast("date"), 365).alias("expired"))


def utf16_columns(s, d):
    x = F.substring("text", 1, 40)
    mixed = F.concat(x, F.when(F.col("doc_id") % 3 == 0, "\U0001f600\U0001f680").otherwise(""))
    return _t(s, d, "documents").select("doc_id", E.utf16_column(mixed).alias("col"))


# --- candidates and paths


def qualified(s, d):
    """One method of a trait among the candidates of each frame."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    c = p.select((F.col("k") % 200).alias("frame"), _cases(F.col("k") % 3, "'rust-analyzer cargo p 1 d/impl#[A' || z % 4 || '][Tr' || z % 3 || ']f().'", "'rust-analyzer cargo p 1 d/impl#[A' || z % 2 || '][]f().'", "'free' || k").alias("symbol"))
    f = s.range(210).select(F.col("id").cast("long").alias("frame"), F.concat(F.lit("A"), F.col("id") % 4).alias("receiver"), F.lit("f").alias("method"), F.concat(F.lit("Tr"), F.col("id") % 3).alias("trait"))
    return V.qualified_select(c, f).select("frame", "outcome", "symbol", "n_candidates")


def collapsed(s, d):
    """Candidates of one name: alone, a type and its constructor, or by scope chain."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    f = p.select(F.col("k").alias("frame"), _cases(F.col("k") % 5, "'C.m'", "'X' || k", "'B.C.m'", "'m'", "'C.m'").alias("full"), (F.col("z") % 7 != 0).alias("whole"))
    row = lambda line, symbol, kind: F.struct(F.lit(line).alias("line"), F.expr(symbol).alias("symbol"), F.lit(kind).alias("kind"))
    sets = [
        F.array(row(3, "'s p a 1 `m`/C#m().'", "Function"), row(9, "'s p a 1 `m`/D#m().'", "Function")), F.array(row(4, "'s p a 1 `m`/X' || k || '#'", "Type"), row(4, "'s p a 1 `m`/X' || k || '().'", "Function")),
        F.array(row(5, "'s p a 1 `m`/A#B#C#m().'", "Function"), row(6, "'s p a 1 `m`/A#C#m().'", "Function")), F.array(row(7, "'s p a 1 `m`/A#m().'", "Function"), row(8, "'s p a 1 `m`/B#m().'", "Function")), F.array(row(1, "'s p a 1 `m`/Z#m().'", "Function")),
    ]
    x = F.lit(None)
    for i, v in enumerate(sets):
        x = F.when(F.col("k") % 5 == i, v).otherwise(x)
    c = p.filter("k % 11 <> 0").select(F.col("k").alias("frame"), F.explode(x).alias("r")).select("frame", "r.*")
    return V.collapse(c, f)


def collapse_outcomes(s, d):
    return V.outcomes(collapsed(s, d))


def resolved_paths(s, d):
    """Path tokens of documents: as they are, below a prefix, by a unique end, or in the directory of most others."""
    nat = _t(s, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    files = nat.select(F.explode(F.array(F.expr("'src/r' || r || '/n' || n || '.py'"), F.expr("'lib/r' || r || '/common.py'"))).alias("path")).distinct()
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("token_id"), (F.col("c_custkey") % 40).alias("doc"), F.col("c_nationkey").alias("n")).join(nat, "n")
    kind = F.col("token_id") % 5
    t = c.select("token_id", "doc", _cases(kind, "'src/r' || r || '/n' || n || '.py'", "'r' || r || '/n' || n || '.py'", "'n' || n || '.py'", "'common.py'", "'none' || n || '.py'").alias("path"))
    return V.resolve_paths(t, files, ["src/"]).select("token_id", "file", "how")


def nearest_definitions(s, d):
    """Anchors by the nearest definition of the name in the file, else in the only file that has it."""
    c = _t(s, d, "customer").select("c_custkey", "c_nationkey")
    n = c.filter("c_custkey % 3 <> 0").select(F.expr("'d' || c_custkey").alias("symbol"), F.expr("'n' || c_custkey % 37").alias("name"), F.expr("'/r/f' || case when c_custkey % 37 < 9 then 0 else c_nationkey % 5 end || '.py'").alias("file_path"), F.col("c_custkey").alias("line_start"))
    a = c.select(F.col("c_custkey").alias("anchor_id"), F.expr("'f' || c_nationkey % 5 || '.py'").alias("file"), F.expr("'n' || c_custkey % 41").alias("name"), (F.col("c_custkey") + 7).alias("doc_line"))
    return R.nearest_line(a, n).select("anchor_id", "symbol", "how")


def majority_dirs(s, d):
    c = _t(s, d, "customer").select((F.col("c_custkey") % 40).alias("doc"), F.expr("'d' || c_nationkey % 6 || '/f.py'").alias("path"), F.col("c_custkey").alias("ord"))
    return V.majority_directory(c)


def tree_depths(s, d):
    """Depth of the lines of an order as a tree drawn by indentation."""
    x = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey").groupBy("block", "pos").agg((F.min("l_partkey") % 4).alias("indent"))
    return V.tree_depths(x).select("block", "pos", "depth")


# --- snapshots


def _snapshot(s, d, after: bool):
    o = _t(s, d, "orders").withColumn("late", F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp"))
    e = _t(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("late") == after).select(F.concat(F.lit("m"), F.col("o_custkey") % 300).alias("src"), F.concat(F.lit("m"), F.col("l_partkey") % 300).alias("dst"), F.col("l_returnflag").alias("kind"))
    f = o.filter(F.col("late") == after).select(F.expr("'m' || o_custkey % 300 || '/f' || o_custkey || '.py'").alias("file"))
    return {"files": f, "module_edges": e}


_TRANSITION = """o as (select *, o_orderdate >= timestamp '1995-06-01' as late from orders), e as (select distinct late, 'm' || o_custkey % 300 as src, 'm' || l_partkey % 300 as dst, l_returnflag as kind from lineitem join o on l_orderkey = o_orderkey),
 f as (select distinct late, 'm' || o_custkey % 300 || '/f' || o_custkey || '.py' as file from o), fc as (select file, case when bool_and(late) then 'new' else 'gone' end as change from f group by file having count(*) = 1), ec as (select src, dst, kind, bool_and(late) as added from e group by 1, 2, 3 having count(*) = 1)"""


def transition_files(s, d):
    return T.transition(_snapshot(s, d, False), _snapshot(s, d, True))["files"]


def transition_modules(s, d):
    return T.transition(_snapshot(s, d, False), _snapshot(s, d, True))["modules"]


def transition_reversed(s, d):
    return T.transition(_snapshot(s, d, False), _snapshot(s, d, True))["reversed"]


def transition_claims(s, d):
    claimed = _t(s, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey") * 13).alias("module"))
    return T.transition(_snapshot(s, d, False), _snapshot(s, d, True), claimed)["claims"]


def path_claims(s, d):
    """Modules named by path tokens of pages' addresses."""
    p = _t(s, d, "pages").select(F.concat(F.lit("see "), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", ""), F.lit(".html and pkg/"), F.col("page_id") % 9, F.lit("/x.py")).alias("text"))
    dirs = s.range(5).select(F.concat(F.lit("src/pkg"), F.col("id")).alias("path")).union(s.createDataFrame([("src/pkg",)], "path string"))
    return T.path_claims(p, [("src/", 2), ("lib/", 1)], dirs)


def snapshot_guards(s, d):
    """What weakens a comparison, for a table of pairs."""
    side = lambda k: F.struct(F.expr(f"cast({k} % 4 as bigint)").alias("n_files"), F.expr(f"case {k} % 3 when 0 then null when 1 then 'wide' else 'all' end").alias("files_face"), F.expr(f"case {k} % 5 when 0 then null else 'g' || ({k} % 2) end").alias("generation"))
    p = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", side("l_partkey").alias("before"), side("l_suppkey").alias("after"))
    return T.guard_rows(p).select("l_orderkey", "l_linenumber", F.array_join("guards", ",").alias("guards"))


# --- states


def _flag(k: str, n: int) -> Column:
    return F.expr(f"case ({k}) % {n} when 0 then true when 1 then null else false end")


_SIGNS = {"graph_lags": ("l_partkey", 7), "identity_algo_upgrade": ("l_suppkey", 11), "identity_drift": ("l_orderkey", 3), "doc_set_drift": ("l_partkey + l_suppkey", 5), "corpus_policy_drift": ("l_orderkey + l_suppkey", 6), "source_newer": ("l_linenumber", 3), "head_drift": ("l_partkey + l_linenumber", 4)}


def serving_states(s, d):
    """What a state serves and why it is stale, over combinations of signals."""
    x = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(_flag(k, n).alias(c) for c, (k, n) in _SIGNS.items()))
    return P.evaluated(x).select("l_orderkey", "l_linenumber", "fresh", "serves", F.array_join("reasons", ",").alias("reasons"))


def stale_snapshots(s, d):
    o = _t(s, d, "orders")
    sha = F.expr("case o_orderkey % 4 when 0 then '' when 1 then 'abc' when 2 then null else 'def' end")
    day = F.expr("case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'bad' else date_format(o_orderdate, 'yyyy-MM-dd') || 'T00:00:00Z' end")
    mtime = F.when(F.col("o_orderkey") % 5 != 0, F.unix_timestamp("o_orderdate") + 5)
    return o.select("o_orderkey", P.snapshot_stale(sha, day, mtime, F.lit("abc"), F.lit(800_000_000)).alias("stale"))


def stale_caches(s, d):
    o = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 50).alias("c"), (F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 7 != 0).alias("ok"), F.expr("'v' || l_suppkey % 3").alias("schema"), _flag("l_linenumber", 3).alias("head"))
    return o.select("l_orderkey", "l_linenumber", P.cache_stale(F.col("c"), F.col("i"), F.col("ok"), F.col("schema"), "v1", F.col("head")).alias("stale"))


def eval_scopes(s, d):
    o = _t(s, d, "part").select("p_partkey", F.expr("case p_partkey % 3 when 0 then null when 1 then array('Python') else array('Python', 'Rust') end").alias("a"), F.expr("case p_partkey % 4 when 0 then null when 1 then array('Rust') else array('TypeScript', 'Python') end").alias("b"))
    return o.select("p_partkey", F.array_join(P.eval_scope(F.col("a"), F.col("b")), ",").alias("scope"))


def fingerprints(s, d):
    n = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.fingerprints(n.select(F.col("r_name").alias("face"), F.col("n_name").alias("rel")))


def source_inventory(s, d):
    return S.inventory(_symbols(s, d).select("path"))


def newest_sources(s, d):
    return S.newest(_symbols(s, d).select("path", F.col("k").alias("mtime")), ["Python", "Rust"])


def span_coverage(s, d):
    """The share of function definitions that have a span, A18."""
    from .plans.build import containment

    g = _symbols(s, d)
    occ = g.select("symbol", F.col("path").alias("rel_path"), F.lit(True).alias("is_def"))
    return containment(occ, g.filter("z % 2 = 0").select("symbol", F.col("path").alias("rel_path")))


def runtime_top(s, d):
    """Pairs of a trace by count, the first 7."""
    from .bench_queries import trace_stats

    return S.runtime_rows(trace_stats(s, d), 7).select("caller", "callee", "count", "first_seen")


def bounded_examples(s, d):
    """Complete counts beside at most five examples."""
    return R.with_examples(_t(s, d, "customer"), ["c_mktsegment"], "c_name", 5).select("c_mktsegment", "n", F.array_join("examples", ",").alias("examples"))


def cross_file_rows(s, d):
    """Files that hold a name besides the asked one, four shown of six looked up."""
    n = _t(s, d, "customer").select(F.concat(F.lit("g"), F.col("c_custkey") % 50).alias("name"), F.concat(F.lit("f"), "c_nationkey", F.lit(".py")).alias("file_path"))
    return R.other_files(n, "f3.py").select("name", F.array_join("shown", ",").alias("shown"), "more")


def repo_filters(s, d):
    """Trace edges with an end inside the repository, with and without a text."""
    e = _t(s, d, "events").select("event_id", F.expr("'e' || event_type || ' (/' || case user_id % 3 when 0 then 'repo' else 'usr' end || '/x.py:3)'").alias("caller"), F.expr("event_type || ' (/' || case event_id % 4 when 0 then 'repo' else 'lib' end || '/y.py:9)'").alias("callee"))
    return R.with_text(R.repo_only(e, "/repo"), include="click", exclude="eerror").select("event_id")


def shown_nodes(s, d):
    """Nodes as they are shown, as JSON."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Function").alias("kind"), F.concat("p_name", F.lit("\x02")).alias("name"), F.concat("p_type", F.lit("::"), "p_name").alias("qname"), F.lit("a.py").alias("file_path"), F.col("p_size").cast("long").alias("line_start"), (F.col("p_size") + 1).cast("long").alias("line_end"), F.lit("Python").alias("language"), F.lit(None).cast("string").alias("parent_name"), (F.col("p_size") > 25).alias("is_test"))
    return p.select("id", E.node_dict().alias("x")).select("id", "x.name", "x.qualified_name", "x.line_end", "x.is_test")


def hub_references(s, d):
    """Sites that call one symbol, with the file of the caller."""
    from .bench_queries import _calls, _nodes

    e = _calls(s, d).withColumn("file_path", F.lit("edge.py")).withColumn("line", F.col("id") % 100)
    n = _nodes(s, d).filter("id % 3 <> 0")
    return C.hub_references(n, e, "s7").select("id", "symbol", "file_path", "line")


def overlay_claims(s, d):
    """Projected calls against real ones: WIRED, HOLE or MISSING."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    occ = p.select(F.expr("'t' || k").alias("symbol"), F.expr("'f' || k % 50").alias("rel_path"), F.lit(True).alias("is_def"), F.col("k").alias("line"), F.col("k").alias("seq"))
    ref = lambda rows, at: rows.select(F.expr("'t' || k").alias("symbol"), F.expr(f"'f' || k % {at}").alias("rel_path"), F.lit(False).alias("is_def"), F.col("k").alias("line"), (F.col("k") + 1_000_000).alias("seq"))
    span = lambda rows, at: rows.select(F.expr(f"'f' || k % {at}").alias("rel_path"), F.expr("'o' || k").alias("symbol"), (F.col("k") - 1).alias("start_line"), (F.col("k") + 1).alias("end_line"), F.col("k").alias("seq"))
    extra = ref(p.filter("z <= 10"), 40)
    real = occ.union(ref(p.filter("z % 3 = 0"), 50))
    targets = p.select(F.expr("'t' || k").alias("symbol")).union(s.createDataFrame([("t-none",)], "symbol string"))
    return C.overlay(real, span(p, 50), extra, span(p.filter("z <= 10"), 40), targets).select("symbol", "new_sites", "verdict")


def link_checks(s, d):
    l = _t(s, d, "customer").select(F.col("c_custkey").alias("link_id"), F.expr("'k' || c_custkey % 300").alias("key"))
    return C.unique_links(l, _t(s, d, "supplier").select(F.expr("'k' || s_suppkey % 70").alias("key"), F.col("s_name").alias("title"))).select("link_id", "n", "ok")


def audit_scope(s, d):
    return C.audit_coverage(_t(s, d, "customer").select(F.col("c_mktsegment").alias("language")), ["BUILDING", "MACHINERY"])


def missing_targets(s, d):
    """Definitions of missing items with their reference counts."""
    g = _symbols(s, d)
    occ = g.select("symbol", F.col("path").alias("rel_path"), F.lit(True).alias("is_def")).union(_t(s, d, "lineitem").select(F.col("l_partkey").alias("k")).join(g, "k").select("symbol", F.col("path").alias("rel_path"), F.lit(False).alias("is_def")))
    missing = g.filter("z < 20").select(F.col("path").alias("file"), E.fn_tail("symbol").alias("name")).filter("name is not null")
    return C.audit_targets(missing, occ).select("symbol", "refs")


def identity(s, d):
    """The identity of a manifest of nations."""
    n = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.identity_hash(n.select(F.col("r_name").alias("face"), F.col("n_name").alias("rel"), F.col("n_nationkey").alias("size"), F.md5(F.col("n_name").cast("binary")).alias("hash")), "v1")


def boundary_edges(s, d):
    """Classes and functions of two languages reconciled: orders as bindings, customers as stubs."""
    return _boundary(s, d)[0].select("level", "py_symbol", "rs_symbol", "pyi_line", "rs_line", "match_kind")


def boundary_coverage(s, d):
    c = _boundary(s, d)[1]
    one = lambda k: c[k].select(F.lit(k).alias("level"), "matched", "rs_only", "pyi_only", "unresolved_module")
    return one("classes").union(one("functions"))


def _boundary(s, d):
    p = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    mod = F.expr("case when k % 10 = 0 then null else 'm' || k % 4 end")
    rs = p.select(mod.alias("py_module"), F.expr("'C' || k").alias("exposed"), F.expr("case when k % 6 = 0 then 'R' || k else 'C' || k end").alias("rust_name"), F.expr("'c' || k % 3 || '/src/l.rs'").alias("rs_path"), F.col("k").alias("line"))
    py = p.filter("z > 10").select(F.expr("'m' || k % 4").alias("module"), F.expr("'C' || k").alias("name"), F.expr("'m' || k % 4 || '.pyi'").alias("pyi_path"), (F.col("k") * 2).alias("line"), F.create_map(F.lit("run"), F.col("k")).alias("methods"), F.create_map(F.lit("A"), F.col("k")).alias("members"))
    fn = p.select(mod.alias("py_module"), F.expr("'f' || k").alias("exposed"), F.expr("case when k % 6 = 0 then 'g' || k else 'f' || k end").alias("rust_fn"), F.lit("c/src/f.rs").alias("rs_path"), F.col("k").alias("line"))
    pf = p.filter("z > 30").select(F.expr("'m' || k % 4").alias("module"), F.expr("'f' || k").alias("name"), F.lit("f.pyi").alias("pyi_path"), (F.col("k") * 3).alias("line"))
    m = p.filter("k % 10 <> 0").select(F.expr("case when k % 6 = 0 then 'R' || k else 'C' || k end").alias("rust_class"), F.lit("run").alias("rust_fn"), F.expr("case when k % 5 = 0 then 'gone' else 'run' end").alias("exposed"), F.lit("method").alias("kind"), (F.col("k") % 7 == 0).alias("renamed"), F.expr("'c' || k % 3 || '/src/l.rs'").alias("rs_path"), F.col("k").alias("line"))
    return C.boundary(rs, m, fn, py, pf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", None) == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    v = lambda *x: _sql_cases("v", *x)
    cand = "c as (select p_partkey % 200 as frame, p_partkey % 3 as v, p_size as z, p_partkey as k from part)"
    weak = "case when {b} = 0 and {a} = 0 then 'both_empty' when {b} = 0 then 'before_empty' when {a} = 0 then 'after_empty' end"
    face = lambda k: f"case {k} % 3 when 0 then null when 1 then 'wide' else 'all' end"
    gen = lambda k: f"case {k} % 5 when 0 then null else 'g' || ({k} % 2) end"
    flag = lambda k, n: f"case ({k}) % {n} when 0 then true when 1 then null else false end"
    signs = ", ".join(f"{flag(*x)} as {c}" for c, x in _SIGNS.items())
    on = lambda c: f"coalesce({c}, false)"
    rebuild = f"({on('graph_lags')} or {on('identity_algo_upgrade')} or {on('identity_drift')} or {on('doc_set_drift')} or {on('corpus_policy_drift')} or (identity_drift is null and {on('source_newer')}))"
    from .bench_queries import _CALLS, _NODES, _TRACE

    return {
        "symbol_parts": f"with {_G} select k, {v("'m' || k", 'null', "'f' || k", 'null', "'f' || k", 'null', "'f_' || k", "'f' || k")} as fn, {v('null', "'K' || k")} as cls, {v("'C' || z", "'K' || k", "'impl'", 'null', "'impl'", 'null', 'null', "'impl'")} as owner, "
        f"case when v = 5 then symbol else regexp_extract(symbol, '[^ ]+$') end as tail, v in (0, 1, 6) as python, {v("'Python'", "'Python'", "'Rust'", "'TypeScript'", "'Rust'", 'null', "'Python'", "'Rust'")} as language, {v("'Python'", "'Python'", "'Rust'", "'TypeScript'", "'Rust'", "'Rust'", "'Python'", "'Rust'")} as by_scheme, "
        f"{v("'Function'", "'Type'", "'Function'", 'null', "'Function'", 'null', "'Function'", "'Function'")} as kind, {v("'C' || z || '#m' || k || '().'", "'K' || k || '#'", "'impl#[T' || z || '][Tr]f' || k || '().'", "'v' || k || '.'", "'impl#[T' || z || '][]f' || k || '().'", 'null', "'f_' || k || '().'", "'impl#[T' || z || '][AsRef<[u8]>]f' || k || '().'")} as region from g",
        "symbol_chains": f"with {_G} select k, {v("'C' || z || '/m' || k", "'K' || k", "'T' || z || '/f' || k", "'v' || k", 'null', 'null', "'f_' || k", 'null')} as chain, case when v in (2, 7) then 'valid' when v = 4 then 'malformed' else 'none' end as state, case when v in (2, 4, 7) then 'T' || z end as receiver, case v when 2 then 'Tr' when 7 then 'AsRef<[u8]>' else '' end as traits from g",
        "identifiers": f"with g as (select p_partkey as k, p_size as z, p_partkey % 6 as v from part) select k, {v("'run' || k", "'run' || k", "'m' || k", "case when length('Cls' || z) >= length('m' || k) then 'Cls' || z else 'm' || k end", "'items'", "'Cls'")} as last, {v("'Abc.run' || k", "'run' || k", "'m' || k", "case when length('Cls' || z) >= length('m' || k) then 'Cls' || z else 'm' || k end", "'items'", "'Cls'")} as \"full\", {v("'none'", "'none'", "'formed'", "'formed'", "'none'", "'malformed'")} as state, case when v in (2, 3) then 'Cls' || z end as receiver, case when v in (2, 3) then 'm' || k end as method, case v when 2 then 'Disp' when 3 then 'Tr<[u8]>' end as trait from g",
        "symbol_queries": f"with {_G} select k, 'name' as by from g where k = 8 and v = 0 union all select k, 'class' from g where k = 9 and v = 1 union all select k, 'owner' from g where k = 66 and z = 7 and v = 2 union all select p_partkey, 'like' from part where p_type = 'ECONOMY'",
        "referenced": f"with {_G} select symbol, count(*) as refs, min(l_orderkey * 10 + l_linenumber) as first from g join lineitem on l_partkey = k group by symbol",
        "name_lookup": "with n as (select p_partkey as id, 'n' || p_partkey % 500 as name, 'P' || p_size as parent_name from part), q as (select 'P7.n66' as query, id from n where parent_name = 'P7' and name = 'n66' union all select 'n123', id from n where name = 'n123' union all select 'mod::n124', id from n where name = 'n124' union all select 'q77', id from n where id = 77) select query, case when count(*) over (partition by query) = 1 then 'one' else 'many' end as how, id from q",
        "path_facts": "with g as (select p_partkey as k, p_size as z, p_partkey % 7 as v from part) select k, v in (0, 1) as test, v = 3 or (v = 1 and cast(z as varchar)[1] = '1') as excluded, "
        + v("'tests'", "'src/app/m' || z", "'.'", "'.venv'", "''", "'python'", "'pkg'") + " as module, case v when 4 then 'core/deep/er/f' || z || '.py' end as rel, "
        + v("'tests'", "'src/app/m' || z", "'./src\\win' || z", "'.venv/lib'", "'/root/r/core/deep/er'", "'python/pkg/sub' || z", "'pkg/core'") + " as dir, "
        + v("'a' || z", "'x.spec'", "'y'", "'z'", "'f' || z", "'__init__'", "'n' || z") + " as stem, " + v("'py'", "'ts'", "'rs'", "'py'", "'py'", "'pyi'", "'pyi'") + " as ext, "
        + v("'tests/a' || z || '.py'", "'src/app/m' || z || '/x.spec.ts'", "'src/win' || z || '/y.rs'", "'.venv/lib/z.py'", "'/root/r/core/deep/er/f' || z || '.py'", "'python/pkg/sub' || z || '/__init__.pyi'", "'pkg/core/n' || z || '.pyi'") + " as plain, "
        + "case v when 5 then 'pkg.sub' || z when 6 then 'pkg.core.n' || z end as stub, " + v("'tests'", "'src'", "'src'", "'.venv'", "''", "'python'", "'pkg'") + " as crate, v = 4 and z = 7 as match from g",
        "name_facts": "with g as (select p_partkey as k, p_size as z, p_partkey % 8 as v from part), h as (select *, " + v("'main'", "'test_case' || z", "'verifyToken' || z", "'doGet'", "'parseHTTPBody' || z", "'plain_name-part' || z", "'boot'", "'on_start' || z") + " as n from g) select k, v in (0, 1, 3, 7) or (v = 6 and k % 2 = 0) as entry, k % 5 in (0, 1) as decorated, k % 5 = 4 as verilog, v in (2, 4) as secure, "
        + v("'main'", "'test-case' || z", "'verify-token' || z", "'do-get'", "'parse-httpbody' || z", "'plain-name-part' || z", "'boot'", "'on-start' || z") + " as slug, " + v("'main'", "'test/case' || z", "'verify/Token' || z", "'do/Get'", "'parse/HTTPBody' || z", "'plain/name/part' || z", "'boot'", "'on/start' || z") + " as words, "
        + v("'MAIN'", "'TEST_CASE' || z", "'VERIFY_TOKEN' || z", "'DO_GET'", "'PARSE_HTTP_BODY' || z", "'PLAIN_NAME-PART' || z", "'BOOT'", "'ON_START' || z") + " as snake, regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g') as kebab, substr(n || chr(9) || repeat('y', 300), 1, 256) as clean, z % 2 = 0 as test_community, n as event, '/r/x.py' as \"where\", '^[ \\t]*' || replace(n, '-', '\\-') || '\\(a,\\ b\\)[ \\t]*$' as anchor, "
        + "trim(split_part(n, '-', 1)) as title, 'see ［' || n || '］ or [x](y)' as brackets, 'go [' || n || '][key three#1]' as link, replace(n, '_', '\\_') || '\\%' as \"like\" from h",
        "number_facts": "select l_orderkey, l_linenumber, round_even(round_even(cast(cast(l_quantity as bigint) as double) / (l_linenumber + 49) * 100 * 10, 0) / 10, 1) as pct, case l_linenumber when 1 then 0 else round_even(1.0::double / (l_linenumber - 1) * 1000, 0) / 10 end as pct0, case when l_discount * 10 > 0.7 then 'high' when l_discount * 10 > 0.4 then 'medium' else 'low' end as band, case l_returnflag when 'R' then 1.0 when 'A' then 0.7 else 0.5 end::double as weight, case when l_linenumber >= 2 then l_linenumber - 1 else -1 end as line from lineitem",
        "rounded_prices": "select o_orderkey, cast(format('{:.2f}', o_totalprice / 7) as double) as two, cast(format('{:.1f}', o_totalprice / 8) as double) as one from orders",
        "date_facts": "select o_orderkey, epoch(date_trunc('day', o_orderdate))::bigint + case o_orderkey % 5 when 0 then 37230 when 1 then 3723 - 7200 when 2 then 86399 + 5400 when 3 then null else 0 end as epoch, (date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 3)::bigint as days, date_diff('day', cast(o_orderdate as date), date '1998-06-01') > 365 as expired from orders",
        "utf16_columns": "with x as (select doc_id, substr(text, 1, 40) || case when doc_id % 3 = 0 then chr(128512) || chr(128640) else '' end as t from documents) select doc_id, (length(t) + len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')))::bigint as col from x",
        "qualified": f"with {cand}, f as (select range as frame, 'A' || range % 4 as receiver, 'Tr' || range % 3 as trait from range(210)), j as (select f.frame, f.receiver, c.k, v = 0 and 'A' || z % 4 = receiver and 'Tr' || z % 3 = trait as hit, v = 1 and 'A' || z % 2 = receiver as shadow, case v when 0 then 'rust-analyzer cargo p 1 d/impl#[A' || z % 4 || '][Tr' || z % 3 || ']f().' end as symbol from f left join c on f.frame = c.frame), "
        "p as (select frame, count(*) filter (hit) as n, coalesce(bool_or(shadow), false) as shadow, min(symbol) filter (hit) as symbol, count(k) as n_candidates from j group by frame) select frame, case when n <= 1 and shadow then 'qualifier_unverified' when n = 1 then 'unique' when n = 0 then 'qualifier_no_hit' else 'qualifier_ambiguous' end as outcome, case when n = 1 and not shadow then symbol end as symbol, n_candidates from p",
        "collapsed": "with g as (select p_partkey as k, p_size as z, p_partkey % 5 as v, p_partkey % 11 = 0 as absent, p_size % 7 <> 0 as whole from part) select k as frame, " + v("'C.m'", "'X' || k", "'B.C.m'", "'m'", "'C.m'") + " as \"full\", whole, case when absent then 'not-in-graph' when v = 4 or (whole and v in (0, 1, 2)) then 'filled' else 'ambiguous' end as outcome, case when absent then null when v = 4 then 'one' when whole then " + v("'chain'", "'twin'", "'tail'") + " end as rule, case when absent then null when v = 4 then 1 when whole then "
        + v("3", "4", "5") + " end as line, case when absent then null when v = 4 then 's p a 1 `m`/Z#m().' when whole then " + v("'s p a 1 `m`/C#m().'", "'s p a 1 `m`/X' || k || '#'", "'s p a 1 `m`/A#B#C#m().'") + " end as symbol from g",
        "collapse_outcomes": "with g as (select p_partkey % 5 as v, p_partkey % 11 = 0 as absent, p_size % 7 <> 0 as whole from part) select case when absent then 'not-in-graph' when v = 4 or (whole and v in (0, 1, 2)) then 'filled' else 'ambiguous' end as outcome, count(*) as n from g group by 1",
        "resolved_paths": "with c as (select c_custkey as token_id, c_custkey % 40 as doc, c_custkey % 5 as v, c_nationkey as n, n_regionkey as r from customer join nation on c_nationkey = n_nationkey), votes as (select doc, r, count(*) as n from c where v in (0, 1, 2) group by 1, 2), no as (select token_id, doc, v from c where v = 3) "
        "select token_id, case when v in (0, 1, 2) then 'src/r' || r || '/n' || n || '.py' end as file, " + v("'direct'", "'prefixed'", "'suffix'", "null", "'none'") + " as how from c where v <> 3 union all select token_id, null, 'ambiguous' from no",
        "nearest_definitions": "with n as (select 'd' || c_custkey as symbol, 'n' || c_custkey % 37 as name, 'f' || case when c_custkey % 37 < 9 then 0 else c_nationkey % 5 end || '.py' as f, c_custkey as l from customer where c_custkey % 3 <> 0), a as (select c_custkey as id, 'f' || c_nationkey % 5 || '.py' as f, 'n' || c_custkey % 41 as name, c_custkey + 7 as l from customer), one as (select name from n group by 1 having count(distinct f) = 1), "
        "x as (select a.id, n.symbol, row_number() over (partition by a.id order by abs(n.l - a.l), n.l, n.symbol) as r from a join n on a.name = n.name and a.f = n.f), y as (select a.id, n.symbol, row_number() over (partition by a.id order by abs(n.l - a.l), n.l, n.symbol) as r from a join n on a.name = n.name where a.name in (select name from one) and a.id not in (select id from x)) "
        "select a.id as anchor_id, coalesce(x.symbol, y.symbol) as symbol, case when x.id is not null then 'same_file' when y.id is not null then 'only_file' else 'none' end as how from a left join x on a.id = x.id and x.r = 1 left join y on a.id = y.id and y.r = 1",
        "majority_dirs": "with x as (select c_custkey % 40 as doc, 'd' || c_nationkey % 6 as dir, count(*) as n, min(c_custkey) as f from customer group by 1, 2), y as (select *, row_number() over (partition by doc order by n desc, f) as r from x) select doc, dir, n from y where r = 1",
        "tree_depths": "with x as (select l_orderkey as block, l_linenumber::bigint as pos, min(l_partkey) % 4 as indent from lineitem group by 1, 2) select a.block, a.pos, (select count(*) from x b where b.block = a.block and b.pos < a.pos and not exists (select 1 from x c where c.block = a.block and c.pos > b.pos and c.pos <= a.pos and c.indent <= b.indent)) as depth from x a",
        "transition_files": f"with {_TRANSITION} select * from fc",
        "transition_modules": f"with {_TRANSITION} select src as module from ec union select dst from ec union select split_part(file, '/', 1) from fc",
        "transition_reversed": f"with {_TRANSITION} select distinct a.src, a.dst from ec a join ec b on a.src = b.dst and a.dst = b.src where a.added and not b.added",
        "transition_claims": f"with {_TRANSITION}, x as (select src as module from ec union select dst from ec union select split_part(file, '/', 1) from fc), c as (select 'm' || n_nationkey * 13 as module from nation) select coalesce(c.module, x.module) as module, case when c.module is null then 'surprise' when x.module is null then 'missed' else 'hit' end as verdict from c full join x on c.module = x.module",
        "path_claims": "select distinct 'src/pkg/' || page_id % 9 as module from pages",
        "snapshot_guards": f"select l_orderkey, l_linenumber, concat_ws(',', {weak.format(b='l_partkey % 4', a='l_suppkey % 4')}, case when {face('l_partkey')} is distinct from {face('l_suppkey')} then 'face_mismatch' end, case when {gen('l_partkey')} <> {gen('l_suppkey')} then 'generation_mismatch' end) as guards from lineitem",
        "serving_states": f"with x as (select l_orderkey, l_linenumber, {signs} from lineitem) select l_orderkey, l_linenumber, not {rebuild} as fresh, case when {on('identity_algo_upgrade')} then 'committed-baseline' when identity_drift is null then 'legacy-signals' when not identity_drift and not {rebuild} then 'current-tree' else 'committed-baseline' end as serves, concat_ws(',', case when {on('graph_lags')} then 'torn-plane' end, case when {on('identity_algo_upgrade')} then 'identity-algo-upgrade' end, case when {on('identity_drift')} then 'content-drift' end, case when {on('doc_set_drift')} then 'doc-set-drift' end, case when {on('corpus_policy_drift')} then 'policy-drift' end, case when identity_drift is null and {on('source_newer')} then 'legacy-signals' end) as reasons from x",
        "stale_snapshots": "select o_orderkey, case when o_orderkey % 4 = 1 then null when o_orderkey % 4 = 3 then 'sha' when o_orderkey % 3 = 2 then case when epoch(date_trunc('day', o_orderdate)) < 800000000 then 'last_updated' end when o_orderkey % 5 <> 0 and epoch(o_orderdate) + 5 < 800000000 then 'mtime' end as stale from orders",
        "stale_caches": "select l_orderkey, l_linenumber, case when l_partkey % 9 = 0 then 'stat' when l_partkey % 50 < l_suppkey % 50 then 'older' when l_partkey % 7 = 0 then 'corrupt' when l_suppkey % 3 <> 1 then 'schema' when l_linenumber % 3 = 0 then 'head' end as stale from lineitem",
        "eval_scopes": "select p_partkey, case p_partkey % 12 when 0 then null when 1 then 'Python,Rust' when 2 then 'Python,Rust,TypeScript' when 3 then 'TypeScript,Python' when 4 then 'Python' when 5 then 'Python,Rust' when 6 then 'TypeScript,Python' when 7 then 'Python,TypeScript' when 8 then 'Python,Rust' when 9 then 'Rust' when 10 then 'Python,TypeScript' else 'Python,Rust,TypeScript' end as scope from part",
        "fingerprints": "with x as (select r_name as face, string_agg(r_name || chr(0) || n_name || chr(0), '' order by n_name) as t from nation join region on n_regionkey = r_regionkey group by 1) select face, lpad(printf('%x', list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(t) + 1), lambda i: ord(substr(t, i::int, 1))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)), 16, '0') as fingerprint from x",
        "source_inventory": f"with {_G} select case when v in (0, 1, 6) then 'Python' when v in (2, 4, 7) then 'Rust' else 'JavaScript/TypeScript' end as family, count(*) as n from g where v <> 5 group by 1",
        "newest_sources": f"with {_G} select case when v in (0, 1, 6) then 'Python' else 'Rust' end as language, max(k) as newest from g where v in (0, 1, 2, 4, 6, 7) group by 1",
        "span_coverage": f"with {_G} select count(*) as functions, count(*) filter (z % 2 = 0) as spanned, count(*) filter (z % 2 = 0) / count(*) as ratio from g where v in (0, 2, 4, 6, 7)",
        "runtime_top": f"with {_TRACE} select caller, callee, count(*) as count, min(event_id) as first_seen from best group by 1, 2 order by count(*) desc, min(event_id) limit 7",
        "bounded_examples": "select c_mktsegment, count(*) as n, array_to_string(list(c_name order by c_name)[1:5], ',') as examples from customer group by 1",
        "cross_file_rows": "with x as (select distinct 'g' || c_custkey % 50 as name, 'f' || c_nationkey || '.py' as f from customer where c_nationkey <> 3), y as (select name, list(f order by f)[1:6] as l from x group by 1) select name, array_to_string(l[1:4], ',') as shown, len(l) > 4 as more from y",
        "repo_filters": "select event_id from events where (user_id % 3 = 0 or event_id % 4 = 0) and contains(event_type, 'click') and not contains('e' || event_type, 'eerror')",
        "shown_nodes": "select p_partkey as id, p_name as name, p_type || '::' || p_name as qualified_name, (p_size + 1)::bigint as line_end, p_size > 25 as is_test from part",
        "hub_references": f"with {_CALLS}, {_NODES} select c.id, caller_symbol as symbol, coalesce('/w/' || r_name || '/' || n_name || '/x.py', 'edge.py') as file_path, c.id % 100 as line from calls c left join (select * from nodes where id % 3 <> 0) n on c.caller_symbol = n.symbol where kind = 'CALLS' and callee_symbol = 's7'",
        "overlay_claims": "select 't' || p_partkey as symbol, case when p_size <= 10 and not (p_size % 3 = 0 and p_partkey % 50 = p_partkey % 40) then 1 else 0 end::bigint as new_sites, case when p_size <= 10 and not (p_size % 3 = 0 and p_partkey % 50 = p_partkey % 40) then 'WIRED' else 'HOLE' end as verdict from part union all select 't-none', 0, 'MISSING'",
        "link_checks": "with t as (select 'k' || s_suppkey % 70 as key, count(*) as n from supplier group by 1) select c_custkey as link_id, coalesce(n, 0) as n, coalesce(n, 0) = 1 as ok from customer left join t on 'k' || c_custkey % 300 = key",
        "audit_scope": "with x as (select count(distinct c_mktsegment) as n, count(distinct c_mktsegment) filter (c_mktsegment in ('BUILDING', 'MACHINERY')) as k from customer) select case when k = 0 then 'Unsupported' when k = n then 'Full' else 'Partial' end as coverage, n, k from x",
        "missing_targets": f"with {_G}, r as (select l_partkey, count(*) as n from lineitem group by 1) select symbol, coalesce(n, 0) as refs from g left join r on l_partkey = k where z < 20 and v in (0, 2, 4, 6, 7)",
        "identity": "select sha256('v1' || string_agg(r_name || chr(0) || n_name || chr(0) || n_nationkey || chr(0) || md5(n_name) || chr(0), '' order by n_name, r_name)) as identity from nation join region on n_regionkey = r_regionkey",
        "boundary_edges": "with p as (select p_partkey as k, p_size as z, 'm' || p_partkey % 4 as m, case when p_partkey % 6 = 0 then 'R' else 'C' end || p_partkey as rn, case when p_partkey % 6 = 0 then 'g' else 'f' end || p_partkey as fn from part where p_partkey % 10 <> 0) select 'class' as level, m || '.C' || k as py_symbol, rn as rs_symbol, k * 2 as pyi_line, k as rs_line, case when k % 6 = 0 then 'PYCLASS_NAME_RENAME' else 'NAME_MATCH' end as match_kind from p where z > 10 "
        "union all select 'function', m || '.f' || k, fn, k * 3, k, case when k % 6 = 0 then 'PYO3_NAME_RENAME' else 'NAME_MATCH' end from p where z > 30 union all select 'method', m || '.C' || k || '.run', rn || '::run', k, k, case when k % 7 = 0 then 'PYO3_NAME_RENAME' else 'NAME_MATCH' end from p where z > 10 and k % 5 <> 0",
        "boundary_coverage": "select 'classes' as level, count(*) filter (p_size > 10 and p_partkey % 10 <> 0) as matched, count(*) filter (p_size <= 10 or p_partkey % 10 = 0) as rs_only, count(*) filter (p_size > 10 and p_partkey % 10 = 0) as pyi_only, count(*) filter (p_partkey % 10 = 0) as unresolved_module from part union all select 'functions', count(*) filter (p_size > 30 and p_partkey % 10 <> 0), count(*) filter (p_size <= 30 and p_partkey % 10 <> 0), count(*) filter (p_size > 30 and p_partkey % 10 = 0), count(*) filter (p_partkey % 10 = 0) from part",
    }
