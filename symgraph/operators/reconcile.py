"""Reconciliation across languages, completeness audits, hazards of dynamic use, overlays and tours."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .relational import first_of, innermost, references


def crate_of(path) -> F.Column:
    """The part before /src/, or the top directory."""
    c = E.col(path)
    return F.when(c.contains("/src/"), F.regexp_extract(c, "^(.*?)/src/", 1)).otherwise(F.split(c, "/")[0])


def boundary(classes: DataFrame, methods: DataFrame, functions: DataFrame, py_classes: DataFrame, py_functions: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Edges (level, py_symbol, pyi_path, pyi_line, rs_symbol, rs_path, rs_line, match_kind, method_kind) and coverage counts by level.

    classes (py_module, exposed, rust_name, rs_path, line), methods (rust_class, rust_fn, exposed, kind, renamed, rs_path,
    line), functions (py_module, exposed, rust_fn, rs_path, line), py_classes (module, name, pyi_path, line, methods map,
    members map), py_functions (module, name, pyi_path, line). Of equal keys the first by path and line counts.
    """
    py = first_of(py_classes, ["module", "name"], ["pyi_path", "line"])
    rs = classes.withColumn("crate", crate_of("rs_path"))
    on = (rs["py_module"] == py["module"]) & (rs["exposed"] == py["name"])
    pair = rs.join(py, on, "full_outer").select(*(rs[c].alias(c) for c in ("py_module", "exposed", "rust_name", "rs_path", "crate")), rs["line"].alias("rs_line"), py["module"].alias("module"), py["name"].alias("name"), "pyi_path", py["line"].alias("pyi_line"), "methods", "members")
    both = pair.filter("rust_name is not null and name is not null")
    class_edges = both.select(F.lit("class").alias("level"), F.concat_ws(".", "py_module", "exposed").alias("py_symbol"), "pyi_path", "pyi_line", F.col("rust_name").alias("rs_symbol"), "rs_path", "rs_line", F.when(F.col("exposed") == F.col("rust_name"), "NAME_MATCH").otherwise("PYCLASS_NAME_RENAME").alias("match_kind"), F.lit(None).cast("string").alias("method_kind"))
    class_cov = pair.agg(F.count_if(F.expr("rust_name is not null and name is not null")).alias("matched"), F.count_if(F.expr("rust_name is not null and name is null")).alias("rs_only"), F.count_if(F.expr("rust_name is null")).alias("pyi_only"), F.count_if(F.expr("rust_name is not null and py_module is null")).alias("unresolved_module"))

    owner = first_of(rs, ["crate", "rust_name"], ["rs_path", "line"]).select("crate", F.col("rust_name").alias("rust_class"), F.struct("py_module", "exposed").alias("_exact"))
    alone = rs.groupBy(F.col("rust_name").alias("rust_class")).agg(F.count("*").alias("_n"), F.first(F.struct("py_module", "exposed")).alias("_bare")).filter("_n = 1").drop("_n")
    m = methods.withColumn("crate", crate_of("rs_path")).join(owner, ["crate", "rust_class"], "left").join(alone, "rust_class", "left").withColumn("_c", F.coalesce("_exact", "_bare"))
    m = m.withColumn("_m", F.col("_c.py_module")).withColumn("_e", F.col("_c.exposed"))
    p = py.select(F.col("module").alias("_m"), F.col("name").alias("_e"), "pyi_path", "methods", "members")
    j = m.join(p, ["_m", "_e"], "left")
    has = lambda k: F.coalesce(F.map_contains_key("methods", F.lit(k)), F.lit(False))
    j = j.withColumn("as", F.when((F.col("kind") == "new") & has("__init__"), "__init__").when((F.col("kind") == "new") & has("__new__"), "__new__").otherwise(F.col("exposed")))
    j = j.withColumn("_line", F.when(F.col("kind") == "variant", F.try_element_at("members", F.col("as"))).otherwise(F.try_element_at("methods", F.col("as"))))
    state = F.when(F.col("_c").isNull(), "unresolved_class").when(F.col("pyi_path").isNull(), "unmatched_class").when(F.col("_line").isNotNull(), "matched").when(F.col("kind") == "dunder", "dunder_rs_only").otherwise("rs_only")
    j = j.withColumn("state", state)
    kind = F.when(F.col("renamed"), "PYO3_NAME_RENAME").when(F.col("kind").isin("getter", "setter"), "GETTER_PROPERTY").when(F.col("kind") == "field_property", "FIELD_PROPERTY").when(F.col("kind") == "variant", "ENUM_VARIANT").otherwise("NAME_MATCH")
    method_edges = j.filter("state = 'matched'").select(F.lit("method").alias("level"), F.concat_ws(".", "_m", "_e", "as").alias("py_symbol"), "pyi_path", F.col("_line").alias("pyi_line"), F.concat_ws("::", "rust_class", "rust_fn").alias("rs_symbol"), "rs_path", F.col("line").alias("rs_line"), kind.alias("match_kind"), F.col("kind").alias("method_kind"))
    claimed = j.filter("pyi_path is not null").select(F.col("_m").alias("module"), F.col("_e").alias("name"), F.col("as").alias("method")).distinct()
    stub_only = both.select("module", "name", F.explode(F.map_keys("methods")).alias("method")).filter(~F.col("method").startswith("__")).join(claimed, ["module", "name", "method"], "left_anti")
    method_cov = j.groupBy("state", "kind").count().unionByName(stub_only.agg(F.count("*").alias("count")).select(F.lit("pyi_only").alias("state"), F.lit(None).cast("string").alias("kind"), "count"))

    pf = first_of(py_functions, ["module", "name"], ["pyi_path", "line"])
    f = functions.join(pf, (functions["py_module"] == pf["module"]) & (functions["exposed"] == pf["name"]), "full_outer").select(functions["py_module"], functions["exposed"], functions["rust_fn"], functions["rs_path"], functions["line"].alias("rs_line"), pf["name"], pf["pyi_path"], pf["line"].alias("pyi_line"))
    function_edges = f.filter("rust_fn is not null and name is not null").select(F.lit("function").alias("level"), F.concat_ws(".", "py_module", "exposed").alias("py_symbol"), "pyi_path", "pyi_line", F.col("rust_fn").alias("rs_symbol"), "rs_path", "rs_line", F.when(F.col("exposed") == F.col("rust_fn"), "NAME_MATCH").otherwise("PYO3_NAME_RENAME").alias("match_kind"), F.lit(None).cast("string").alias("method_kind"))
    function_cov = f.agg(F.count_if(F.expr("rust_fn is not null and name is not null")).alias("matched"), F.count_if(F.expr("rust_fn is not null and name is null and py_module is not null")).alias("rs_only"), F.count_if(F.expr("rust_fn is null")).alias("pyi_only"), F.count_if(F.expr("rust_fn is not null and py_module is null")).alias("unresolved_module"))
    return class_edges.unionByName(method_edges).unionByName(function_edges), {"classes": class_cov, "methods": method_cov, "functions": function_cov}


def boundary_lookup(edges: DataFrame, query: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Edges of a symbol on either side, and candidates that hold its last segment."""
    q = query.lower()
    p, r = F.lower("py_symbol"), F.lower("rs_symbol")
    hit = edges.filter((p == q) | p.endswith("." + q) | p.startswith(q + ".") | p.contains(f".{q}.") | (r == q) | r.endswith("::" + q))
    last = re.split(r"::|\.", q)[-1]
    near = edges.filter(p.contains(last) | r.contains(last)).select("py_symbol").distinct().orderBy("py_symbol").limit(limit)
    return hit, near


def audit(nodes: DataFrame, expected: DataFrame, legacy_provenance: str | None = None) -> DataFrame:
    """(file, name, expected, found) where the graph has fewer functions of a name in a file than counted outside (file, name, n)."""
    f = nodes.filter("kind = 'Function'")
    if legacy_provenance is not None and "provenance" in nodes.columns:
        old = F.col("provenance") == legacy_provenance
        f = f.filter(~old).unionByName(f.filter(old).join(f.filter(~old).select("file_path", "name").distinct(), ["file_path", "name"], "left_anti"))
    have = f.groupBy(F.col("file_path").alias("file"), "name").agg(F.count("*").alias("found"))
    return expected.join(have, ["file", "name"], "left").select("file", "name", F.col("n").alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).filter("found < expected")


def audit_coverage(nodes: DataFrame, supported: Sequence[str]) -> DataFrame:
    """One row: Full if all languages are supported, Partial if some, Unsupported if none."""
    langs = nodes.filter("language is not null").select("language").distinct()
    return langs.agg(F.count("*").alias("n"), F.count_if(F.col("language").isin(*supported)).alias("k")).select(F.when((F.col("k") == 0), "Unsupported").when(F.col("k") == F.col("n"), "Full").otherwise("Partial").alias("coverage"), "n", "k")


def audit_targets(missing: DataFrame, occ: DataFrame) -> DataFrame:
    """Definitions of missing (file, name) with their reference counts."""
    d = occ.filter("is_def").withColumn("name", E.fn_tail("symbol")).join(missing.select(F.col("file").alias("rel_path"), "name").distinct(), ["rel_path", "name"], "left_semi").select("rel_path", "name", "symbol").distinct()
    n = occ.filter("not is_def").groupBy("symbol").agg(F.count("*").alias("refs"))
    return d.join(n, "symbol", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def classified_lines(lines: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    return lines.withColumn("class", F.when(F.col("path").startswith("tests/"), "test").when(E.is_excluded("path", excluded), "excluded").otherwise("prod"))


def hazards(facts: DataFrame, lines: DataFrame, registries: Sequence[tuple[str, str]] = (), static_callers: DataFrame | None = None, excluded: Sequence[str] = (), full: bool = True) -> DataFrame:
    """(rel_path, name, hazard, prod, test): how a class may be used past its static edges.

    facts (rel_path, name, is_strenum, is_protocol, values, module), lines (path, line_no, text). Each detector turns
    lines into the tokens it would name (string literals, attribute names, imports, annotations, calls) once and joins
    them on the token, whatever the number of classes. Without `full`, existence only (counts 0).
    """
    f = facts.select("rel_path", "name", "is_strenum", "is_protocol", "values", *(["module"] if "module" in facts.columns else [F.lit(None).cast("string").alias("module")]))
    registered = F.lit(False)
    for prefix, suffix in registries:
        registered = registered | (F.col("rel_path").startswith(prefix) & F.col("name").endswith(suffix))
    resident = f.filter(registered).select("rel_path", "name", F.lit("registry-auto-discovery").alias("hazard"), F.lit(1).cast("long").alias("prod"), F.lit(0).cast("long").alias("test"))
    if not full:
        flags = F.array_compact(F.array(F.when(F.col("is_strenum"), F.lit("strenum-string-dispatch")), F.when(F.col("is_protocol"), F.lit("protocol-duck-typing"))))
        return f.select("rel_path", "name", F.explode(flags).alias("hazard"), F.lit(0).cast("long").alias("prod"), F.lit(0).cast("long").alias("test")).unionByName(resident)
    ln = classified_lines(lines, excluded)

    def tokens(pattern: str, group: int = 1) -> DataFrame:
        return ln.select("path", "line_no", "class", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))).alias("token"))

    def counted(keyed: DataFrame, found: DataFrame, hazard: str, own: bool) -> DataFrame:
        hit = keyed.join(found, "token")
        if not own:
            hit = hit.filter("path <> rel_path")
        return hit.select("rel_path", "name", "path", "line_no", "class").distinct().groupBy("rel_path", "name").agg(F.count_if(F.col("class") == "prod").alias("prod"), F.count_if(F.col("class") == "test").alias("test")).select("rel_path", "name", F.lit(hazard).alias("hazard"), "prod", "test")

    named = f.select("rel_path", "name", F.col("name").alias("token"))
    out = resident.unionByName(counted(f.filter("is_strenum").select("rel_path", "name", F.explode("values").alias("token")), tokens(r'"([^"]*)"'), "strenum-string-dispatch", False))
    out = out.unionByName(counted(named, tokens(r"""getattr\([^,]+,\s*["']([^"']+)["']"""), "getattr-string-dispatch", False))
    out = out.unionByName(counted(named.join(f.filter("is_protocol").select("rel_path", "name"), ["rel_path", "name"], "left_semi"), tokens(r"(?::\s*|->\s*|isinstance\([^,]*,\s*)(\w+)\b"), "protocol-duck-typing", True))
    out = out.unionByName(counted(f.filter("module is not null").select("rel_path", "name", F.col("module").alias("token")), tokens(r"""import_module\(\s*["']([^"']+)["']"""), "importlib-lazy-load", True))
    if static_callers is not None:
        called = tokens(r"\b(\w+)\(").select("path", "token").distinct().join(static_callers.select(F.col("name").alias("token"), "path").distinct(), ["token", "path"], "left_anti")
        gap = named.join(called, "token").filter("path <> rel_path").groupBy("rel_path", "name").agg(F.count_if(~F.col("path").startswith("tests/")).alias("prod"), F.count_if(F.col("path").startswith("tests/")).alias("test"))
        out = out.unionByName(gap.select("rel_path", "name", F.lit("static-edge-gap").alias("hazard"), "prod", "test"))
    return out


def hub_references(nodes: DataFrame, edges: DataFrame, symbol: str, incoming: bool = True) -> DataFrame:
    """(symbol, file_path, line, is_test, id) at the other end of a symbol's CALLS; the edge's file where no node is known."""
    mine, other = ("callee_symbol", "caller_symbol") if incoming else ("caller_symbol", "callee_symbol")
    n = nodes.select(F.col("symbol").alias("_s"), F.col("file_path").alias("_f"), "is_test")
    e = edges.filter((F.col("kind") == "CALLS") & (F.col(mine) == symbol)).join(n, F.col(other) == F.col("_s"), "left")
    return e.select(F.col(other).alias("symbol"), F.coalesce("_f", "file_path").alias("file_path"), "line", F.coalesce("is_test", F.lit(False)).alias("is_test"), "id")


def overlay(occ: DataFrame, spans: DataFrame, extra: DataFrame, extra_spans: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims on a projected graph: targets (symbol, note) with real and projected call sites and WIRED, HOLE or MISSING.

    WIRED: a projected site calls it; HOLE: it is defined and nothing new does; MISSING: it isn't defined.
    """
    all_occ, all_spans = occ.unionByName(extra), spans.unionByName(extra_spans)
    defs = all_occ.filter("is_def").select("symbol").distinct().withColumn("_d", F.lit(True))
    sites = lambda o, s: innermost(references(o, targets), s).groupBy("symbol", "rel_path", "line").agg(F.max(F.col("span").isNotNull()).alias("in_function"))
    real, projected = sites(occ, spans), sites(all_occ, all_spans)
    new = projected.join(real.select("symbol", "rel_path", "line"), ["symbol", "rel_path", "line"], "left_anti").groupBy("symbol").agg(F.count("*").alias("new_sites"))
    return targets.join(defs, "symbol", "left").join(new, "symbol", "left").select(*targets.columns, F.coalesce("new_sites", F.lit(0)).alias("new_sites"), F.when(F.col("_d").isNull(), "MISSING").when(F.col("new_sites") > 0, "WIRED").otherwise("HOLE").alias("verdict"))


def unique_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """links (link_id, key) with `ok`: exactly one title (key, title) has the key."""
    t = titles.groupBy("key").agg(F.count("*").alias("n"))
    return links.join(t, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ok", F.col("n") == 1)


def delta_steps(diff: dict[str, DataFrame], files: DataFrame, lines: DataFrame) -> DataFrame:
    """Steps of a change tour: files (file, change) with their first changed line (path, line), then modules that changed."""
    s = files.join(lines.withColumnRenamed("path", "file"), "file", "left").select(F.lit(1).alias("part"), "file", F.coalesce("line", F.lit(1)).alias("line"), F.col("change").alias("what"))
    return s.unionByName(diff["changed"].select(F.lit(2).alias("part"), F.col("module").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("module").alias("what"))).orderBy("part", "file")
