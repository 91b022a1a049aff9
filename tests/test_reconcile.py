import random
import re

from symgraph.functions import descriptors as D
from symgraph.operators import reconcile as C
from symgraph.operators import relational as R
from symgraph.operators import resolve as V
from symgraph import schema


def test_boundary(spark):
    classes = spark.createDataFrame([("m", "LiveNode", "LiveNode", "core/src/a.rs", 1), ("m", "UsdM", "UsdMarket", "core/src/a.rs", 5), ("m", "NotStubbed", "NotStubbed", "core/src/a.rs", 9)], "py_module string, exposed string, rust_name string, rs_path string, line long")
    methods = spark.createDataFrame([("LiveNode", "new_py", "new_py", "new", False), ("LiveNode", "run_py", "run", "method", True), ("LiveNode", "get_id", "id", "getter", False), ("UsdMarket", "Linear", "LINEAR", "variant", False), ("UsdMarket", "size", "size", "field_property", False), ("LiveNode", "__str__", "__str__", "dunder", False), ("LiveNode", "hidden", "hidden", "method", False), ("Gone", "x", "x", "method", False)], "rust_class string, rust_fn string, exposed string, kind string, renamed boolean")
    from pyspark.sql import functions as F

    methods = methods.withColumn("rs_path", F.when(F.col("rust_class") == "UsdMarket", "py/src/b.rs").otherwise("core/src/a.rs")).withColumn("line", F.lit(2).cast("long"))
    functions = spark.createDataFrame([("m", "connect", "connect_py", "core/src/a.rs", 3), (None, "lost", "lost", "core/src/a.rs", 4)], "py_module string, exposed string, rust_fn string, rs_path string, line long")
    py_classes = spark.createDataFrame([("m", "LiveNode", "m.pyi", 1, {"__init__": 2, "run": 3, "id": 4, "only_stub": 6}, {}), ("m", "UsdM", "m.pyi", 9, {"size": 10}, {"LINEAR": 11})], "module string, name string, pyi_path string, line long, methods map<string,long>, members map<string,long>")
    py_functions = spark.createDataFrame([("m", "connect", "m.pyi", 20), ("m", "alone", "m.pyi", 21)], "module string, name string, pyi_path string, line long")
    edges, cov = C.boundary(classes, methods, functions, py_classes, py_functions)
    rows = edges.collect()
    assert {r["match_kind"] for r in rows if r["level"] == "class"} == {"NAME_MATCH", "PYCLASS_NAME_RENAME"}
    got = {r["rs_symbol"]: (r["match_kind"], r["pyi_line"]) for r in rows if r["level"] == "method"}
    assert got == {"LiveNode::new_py": ("NAME_MATCH", 2), "LiveNode::run_py": ("PYO3_NAME_RENAME", 3), "LiveNode::get_id": ("GETTER_PROPERTY", 4), "UsdMarket::Linear": ("ENUM_VARIANT", 11), "UsdMarket::size": ("FIELD_PROPERTY", 10)}
    assert [r["match_kind"] for r in rows if r["level"] == "function"] == ["PYO3_NAME_RENAME"]
    assert cov["classes"].first().asDict() == {"matched": 2, "rs_only": 1, "pyi_only": 0, "unresolved_module": 0}
    assert cov["functions"].first().asDict() == {"matched": 1, "rs_only": 0, "pyi_only": 1, "unresolved_module": 1}
    state = {(r["state"], r["kind"]): r["count"] for r in cov["methods"].collect()}
    assert state[("dunder_rs_only", "dunder")] == state[("rs_only", "method")] == state[("unresolved_class", "method")] == state[("pyi_only", None)] == 1
    hit, near = C.boundary_lookup(edges, "livenode.RUN")
    assert [r["py_symbol"] for r in hit.collect()] == ["m.LiveNode.run"] and near.count() >= 1


def test_audit(spark):
    nodes = spark.createDataFrame([("a.rs", "open", "Function", "new", "Rust"), ("a.rs", "open", "Function", "old", "Rust"), ("a.rs", "shut", "Function", "old", "Python")], "file_path string, name string, kind string, provenance string, language string")
    want = spark.createDataFrame([("a.rs", "open", 2), ("a.rs", "shut", 1), ("b.rs", "x", 1)], "file string, name string, n long")
    assert {(r["name"], r["expected"], r["found"]) for r in C.audit(nodes, want, "old").collect()} == {("open", 2, 1), ("x", 1, 0)}
    assert C.audit_coverage(nodes, ["Rust"]).first()["coverage"] == "Partial"
    assert C.audit_coverage(nodes, ["Rust", "Python"]).first()["coverage"] == "Full"
    assert C.audit_coverage(nodes, []).first()["coverage"] == "Unsupported"
    occ = spark.createDataFrame([(1, "s shut().", "a.rs", 1, True, 0), (2, "s shut().", "b.rs", 1, False, 0)], schema.OCCURRENCES)
    missing = spark.createDataFrame([("a.rs", "shut")], "file string, name string")
    assert C.audit_targets(missing, occ).first()["refs"] == 1


def test_hazards(spark):
    facts = spark.createDataFrame([("app/mode.py", "Mode", True, False, ["1d", "1w"], "app.mode"), ("app/reg/FooPlugin.py", "FooPlugin", False, False, [], None), ("app/p.py", "Duck", False, True, [], None)], "rel_path string, name string, is_strenum boolean, is_protocol boolean, values array<string>, module string")
    lines = spark.createDataFrame([("cfg/a.yaml", 1, 'x: "1d"'), ("tests/t.py", 2, 'go("1w")'), ("app/mode.py", 3, 'd = "1d"'), ("app/u.py", 4, "def f(x: Duck) -> Duck:"), ("app/u.py", 5, "m = importlib.import_module('app.mode')"), ("app/u.py", 6, 'getattr(obj, "Mode")'), ("app/v.py", 7, "FooPlugin(1)"), (".venv/x.py", 8, '"1d"')], "path string, line_no long, text string")
    got = {(r["name"], r["hazard"]): (r["prod"], r["test"]) for r in C.hazards(facts, lines, [("app/reg/", "Plugin")], spark.createDataFrame([("FooPlugin", "app/w.py")], "name string, path string")).collect()}
    assert got == {("Mode", "strenum-string-dispatch"): (1, 1), ("Mode", "getattr-string-dispatch"): (1, 0), ("Mode", "importlib-lazy-load"): (1, 0), ("Duck", "protocol-duck-typing"): (1, 0), ("FooPlugin", "registry-auto-discovery"): (1, 0), ("FooPlugin", "static-edge-gap"): (1, 0)}
    assert {r["hazard"] for r in C.hazards(facts, lines, full=False).collect()} == {"strenum-string-dispatch", "protocol-duck-typing"}


def test_overlay(spark):
    o = lambda *r: spark.createDataFrame(list(r), schema.OCCURRENCES)
    occ = o((1, "s compute().", "a.py", 1, True, 0), (2, "s untouched().", "a.py", 9, True, 0))
    extra = o((100, "s compute().", "b.py", 5, False, 0))
    spans = spark.createDataFrame([(1, "s caller().", "b.py", 1, 9)], schema.SPANS)
    t = spark.createDataFrame([("s compute().", ""), ("s untouched().", ""), ("s gone().", "")], "symbol string, note string")
    got = {r["symbol"]: r["verdict"] for r in C.overlay(occ, spans, extra, spans.limit(0), t).collect()}
    assert got == {"s compute().": "WIRED", "s untouched().": "HOLE", "s gone().": "MISSING"}


def test_anchors_and_links(spark):
    n = spark.createDataFrame([("x1", "f", "/r/a.py", 10), ("x2", "f", "/r/a.py", 20), ("x3", "g", "/r/b.py", 1)], "symbol string, name string, file_path string, line_start long")
    a = spark.createDataFrame([(1, "a.py", "f", 18), (2, "z.py", "g", 5), (3, "z.py", "q", 5)], "anchor_id long, file string, name string, doc_line long")
    got = {r["anchor_id"]: (r["symbol"], r["how"]) for r in R.nearest_line(a, n).collect()}
    assert got == {1: ("x2", "same_file"), 2: ("x3", "only_file"), 3: (None, "none")}
    links = spark.createDataFrame([(1, "k"), (2, "d"), (3, "z")], "link_id long, key string")
    titles = spark.createDataFrame([("k", "t"), ("d", "t1"), ("d", "t2")], "key string, title string")
    assert {r["link_id"]: r["ok"] for r in C.unique_links(links, titles).collect()} == {1: True, 2: False, 3: False}


def test_nearest_line_makes_no_pairs(spark):
    """Against all pairs, with equal lines, missing lines and paths that end alike; no join on the name's many rows."""
    rng = random.Random(3)
    line = lambda: rng.choice([None, *range(1, 40)]) if rng.random() < 0.2 else rng.randrange(1, 40)
    nodes = [(f"s{i:03}", f"n{rng.randrange(12)}", rng.choice(["/r/a.py", "/r/x/a.py", "b.py", "/c.py"]), line() if i % 9 else rng.randrange(1, 40)) for i in range(60)]
    nodes += [(f"t{i}", "only", "/c.py", i // 2) for i in range(8)]
    anchors = [(i, rng.choice(["a.py", "x/a.py", "b.py", "none.py", None]), rng.choice(["only", *(f"n{k}" for k in range(13))]), line()) for i in range(120)]
    a = spark.createDataFrame(anchors, "anchor_id long, file string, name string, doc_line long")
    n = spark.createDataFrame(nodes, "symbol string, name string, file_path string, line_start long")
    order = lambda x, at: ((x[3] is not None and at is not None, abs((x[3] or 0) - (at or 0)) if x[3] is not None and at is not None else 0), (x[3] is not None, x[3] or 0), x[0])
    expected = {}
    for i, file, name, at in anchors:
        here = [x for x in nodes if x[1] == name and file and (x[2] == file or x[2].endswith("/" + file))]
        away = [x for x in nodes if x[1] == name] if len({x[2] for x in nodes if x[1] == name}) == 1 else []
        best = min(here or away, key=lambda x: order(x, at), default=(None, 0, None, None))
        expected[i] = (best[0], best[2], best[3], "same_file" if here else "only_file" if away else "none")
    found = R.nearest_line(a, n)
    assert {r["anchor_id"]: (r["symbol"], r["file_path"], r["line_start"], r["how"]) for r in found.collect()} == expected
    assert not re.search(r"Join\S* Inner", found._jdf.queryExecution().optimizedPlan().toString())


def test_heads_are_read_once(spark):
    """Brackets are gone through once a row however many fields are read; nested, open and deep ones as letter by letter."""
    rows = [("impl#[A][B<[u8]>]f().", "valid", "A", ["B<[u8]>"]), ("impl#[A", "malformed", None, []), ("impl#[A][B", "malformed", "A", []), ("impl#[a[b[c[d[e[f]]]]]][T]x", "valid", "a[b[c[d[e[f]]]]]", ["T"]), ("impl#[][T]", "malformed", None, []), ("C#m().", "none", None, []), (None, "none", None, [])]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    h = D.impl_head("t")
    got = df.select("t", h["state"].alias("state"), h["receiver"].alias("receiver"), h["traits"].alias("traits"))
    assert [tuple(r) for r in got.collect()] == rows
    one = df.select(h.alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("aggregate(") == 1


def test_candidates_are_not_sent_to_tasks(spark):
    c = spark.range(20).selectExpr("id % 5 as frame", "id as line", "'s p a 1 `m`/C#m().' as symbol", "'Function' as kind")
    f = spark.range(6).selectExpr("id as frame", "'C.m' as full", "true as whole", "'A' as receiver", "'f' as method", "'T' as trait")
    for found in (V.collapse(c, f), V.qualified_select(c, f.select("frame", "receiver", "method", "trait"))):
        assert found.count() == 6 and "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
