from pyspark.sql import functions as F

from symgraph.functions import exprs as E
from symgraph.plans import build, freshness
from symgraph.plans.engine import Engine
from symgraph.sources import index as I
from symgraph.sources import texts as T
from symgraph.streaming import refresh as S

SYM = "scip-python python p 1 `m`/"


def _index(spark, tmp_path):
    data = I.encode(
        [
            ("src/lib.py", [(SYM + "helper().", 1, [0, 4, 10], [0, 0, 3, 5]), (SYM + "Greeter#", 1, [5, 6, 13], []), ("local 1", 1, [7, 0, 1], [])]),
            ("src/app.py", [(SYM + "main().", 1, [0, 4, 8], [0, 0, 9, 0]), (SYM + "helper().", 0, [2, 4, 10], []), (SYM + "Greeter#", 0, [3, 4, 11], []), (SYM + "helper().", 0, [4, 4, 10], []), (SYM + "gone().", 0, [4, 9, 10], [])]),
        ]
    )
    (tmp_path / "a.scip").write_bytes(data)
    spark.dataSource.register(I.IndexSource)
    one = spark.read.format("symbol_index").load(str(tmp_path / "a.scip"))
    two = I.read_index(spark, str(tmp_path / "a.scip"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    return one


def test_index_to_graph(spark, tmp_path):
    index = _index(spark, tmp_path)
    occ, spans = I.occurrences(index), I.spans(index)
    assert occ.count() == 7 and I.odd_ranges(index).count() == 0
    assert {(r["start_line"], r["end_line"]) for r in spans.collect()} == {(1, 4), (1, 10)}
    marks = spark.createDataFrame([("src/app.py", 3, -1, "helper"), ("src/app.py", 4, -1, "Greeter")], "rel_path string, line long, col long, name string")
    g = build.build_graph(occ, spans, marks, "/repo")
    assert [(r["id"], r["name"], r["kind"]) for r in g.nodes.orderBy("id").collect()] == [(1, "main", "Function"), (2, "helper", "Function"), (3, "Greeter", "Type")]
    got = sorted((r["kind"], r["callee_symbol"].split("/")[-1], r["line"]) for r in g.edges.collect())
    assert got == [("CALLS", "Greeter#", 4), ("CALLS", "helper().", 3), ("REFERENCES", "helper().", 5)]
    tables = build.derived(g)
    root = f"file://{tmp_path}/graph"
    first = build.publish(spark, tables, root, {"k": "v"})
    second = build.publish(spark, tables, root)
    assert first != second
    e = Engine.open(spark, root, occurrences=occ, spans=spans)
    assert e.hub(1).first()["name"] in ("main", "helper")
    assert e.flows().first()["name"] == "main"
    assert e.search("helper")[0].count() == 1
    assert e.callers("helper")[0].first()["n_sites"] == 2
    found, again = e.closure("helper")
    assert [r["symbol"] for r in found.collect()] == [SYM + "main()."]
    assert e.symbols("src/lib.py").count() == 2
    assert e.minimal_context("review", ["/repo/src/lib.py"])["risk"] in ("low", "medium", "high")
    assert e.architecture_overview()["communities"].count() >= 1
    assert e.hub_refs("helper", "/repo")["state"] == "one"
    assert e.impact_radius(["lib.py"])["total_impacted"] == 1


def test_predicates(spark):
    x = spark.createDataFrame([("s Foo#bar().", "a.rs"), ("s impl#[Foo][Tr]bar().", "a.rs"), ("s Foo#", "a.rs"), (SYM + "Foo#", "a.py"), ("s xbar().", "a.rs"), ("t Foo#", "a.ts")], "symbol string, path string")
    hits = lambda q: [r[0] for r in x.filter(E.matches_query("symbol", "path", q)).select("symbol").collect()]
    assert hits("Foo.bar") == ["s Foo#bar().", "s impl#[Foo][Tr]bar()."]
    assert hits("bar") == ["s Foo#bar().", "s impl#[Foo][Tr]bar()."]
    assert hits("Foo") == [SYM + "Foo#", "t Foo#"]
    p = spark.createDataFrame([(v,) for v in ["tests/a.rs", "x/test_a.py", "a/__tests__/b.ts", "a.spec.tsx", "a.test.py", "src/attest_a.py"]], "p string")
    assert [r[0] for r in p.select(E.is_test_path("p")).collect()] == [True, True, True, True, False, False]
    m = spark.createDataFrame([(v,) for v in ["src/core/a/b.py", "src/core/x.py", "src/lib.py", "docs/a.md", "top.py"]], "p string")
    assert [r[0] for r in m.select(E.module_of("p", [("src/core/", 1), ("src/", 1)])).collect()] == ["src/core/a", "src/core", "src", "docs", "top.py"]
    n = spark.createDataFrame([("getHTTPName_of-it.x",), ("",)], "n string")
    assert n.select(E.split_name("n")).first()[0] == ["get", "HTTPName", "of", "it", "x"]
    assert spark.range(1).select(E.slug(F.lit("aVeryLongNameThatGoesOnAndOnForever"))).first()[0] == "a-very-long-name-that-goes-on"
    assert spark.range(1).select(E.rounded(F.lit(2.675), 2)).first()[0] == 2.67
    assert spark.range(1).select(E.has_framework_decorator(F.lit('{"decorators":["app.route"]}')), E.has_framework_decorator(F.lit("oops"))).first()[:] == (True, False)


def test_diff(spark):
    text = "--- a/pkg/a.py\n+++ b/pkg/a.py\n@@ -1,2 +1,3 @@\n x\n@@ -10 +10,2 @@ def f\n--- a/b\n+++ /dev/null\n@@ -1,3 +0,0 @@\n+++ b/c.py\n@@ -4,2 +3,0 @@"
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(text.split("\n"))], "diff_id long, line_no long, value string")
    assert sorted(tuple(r) for r in T.diff_ranges(d).collect()) == [("c.py", 3, 3), ("pkg/a.py", 1, 3), ("pkg/a.py", 10, 11)]
    assert T.first_changes(T.diff_ranges(d)).count() == 2
    assert T.name_status("A\0x\0R100\0o\0n\0C75\0a\0b\0T\0t\0") == [("A", "x", None), ("R", "n", "o"), ("A", "b", None), ("M", "t", None)]


def test_code(spark):
    py = spark.createDataFrame([("a.py", "import x\nclass Mode(StrEnum):\n    A = '1d'\n    B = '1w'\ndef f():\n    x.g(h())\n"), ("bad.py", "def (")], "rel string, text string")
    assert sorted((r["line"], r["name"]) for r in T.python_calls(py).collect()) == [(6, "g"), (6, "h")]
    (c,) = T.python_classes(py).collect()
    assert c["is_strenum"] and not c["is_protocol"] and c["values"] == ["1d", "1w"] and c["bases"] == ["StrEnum"]
    stub = spark.createDataFrame([("m.pyi", "class A:\n    x: int\n    def f(self): ...\n    def f(self, a): ...\ndef g(): ...\n")], "rel string, text string")
    assert {(r["kind"], r["name"], r["line"]) for r in T.stub_facts(stub).collect()} == {("class", "A", 1), ("method", "f", 4), ("member", "x", 2), ("function", "g", 5)}
    rs = spark.createDataFrame([("core/src/a.rs", '#[pyclass(name = "UsdM", module = "m", get_all)]\npub struct Usd {\n    pub size: u8,\n}\n#[pyclass]\npub enum Kind {\n    LinearOne,\n}\n#[pymethods]\nimpl Usd {\n    #[new]\n    fn make() -> Self { Usd { size: 1 } }\n    #[getter]\n    fn get_id(&self) -> u8 { 1 }\n    #[pyo3(name = "go")]\n    async fn run(&self) {}\n    fn __str__(&self) {}\n}\n#[pyfunction]\npub fn connect() {}\n')], "rel string, text string")
    got = {(r["kind"], r["owner"], r["exposed"], r["method_kind"]) for r in T.rust_bindings(rs).collect()}
    assert got == {("class", None, "UsdM", "struct"), ("method", "Usd", "size", "field_property"), ("class", None, "Kind", "enum"), ("method", "Kind", "LINEAR_ONE", "variant"), ("method", "Usd", "make", "new"), ("method", "Usd", "id", "getter"), ("method", "Usd", "go", "method"), ("method", "Usd", "__str__", "dunder"), ("function", None, "connect", "function")}
    impls = spark.createDataFrame([("k.rs", "impl Store {\n  fn open() {}\n}\nimpl Store {\n  fn open() {}\n  fn shut() {}\n}\n")], "rel string, text string")
    assert [(r["type"], r["names"]) for r in T.duplicate_methods(T.impl_functions(impls)).collect()] == [("Store", ["open"])]
    b = spark.createDataFrame([(1, "main\n├── a\n│   └── b\n└── c")], "block_id long, text string")
    assert [(r["depth"], r["text"]) for r in T.chain_frames(b).orderBy("ord").collect()] == [(0, "main"), (1, "a"), (2, "b"), (1, "c")]


def test_files(spark, tmp_path):
    import json

    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": [{"cat": "fee", "ph": "X", "pid": 1, "tid": 2, "ts": 0, "dur": 5, "name": "f (a:1)"}]}))
    assert T.read_trace(spark, str(tmp_path / "t.json")).first()["dur"] == 5
    edges = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, kind string")
    T.write_snapshot(spark.createDataFrame([("f",)], "file string"), edges, {"label": "x"}, str(tmp_path / "snap"))
    back = T.read_snapshot(spark, str(tmp_path / "snap"))
    assert [tuple(r) for r in back["edges"].collect()] == [("a", "b", "CALLS")] and back["meta"].first()[0] == {"label": "x"}
    src = tmp_path / "repo"
    for p in ("a.py", "venv/b.py", "target/c.rs", "x/d.rs", ".git/e.py", "skip/f.py"):
        (src / p).parent.mkdir(parents=True, exist_ok=True)
        (src / p).write_text("x")
    m = T.manifest(spark, str(src), ["skip/"])
    assert sorted(r["rel"] for r in m.collect()) == ["a.py", "x/d.rs"]
    before = spark.createDataFrame(m.collect(), m.schema)
    (src / "a.py").write_text("xy")
    after = T.manifest(spark, str(src), ["skip/"], cached=before)
    assert {(r["rel"], r["size"]) for r in after.collect()} == {("a.py", 2), ("x/d.rs", 1)}
    stamp = {"source_identity": freshness.identity_hash(before).first()["identity"]}
    v = freshness.verdict(stamp, before, after)
    assert (v.tier, v.changed, v.added, v.removed) == ("possibly-stale", 1, 0, 0)
    assert freshness.verdict(stamp, before, before).tier == "exact"
    assert freshness.verdict(stamp, after, before).reasons == ["binding_audit_failed"]
    assert freshness.verdict({}, before, after).tier == "indeterminate"
    none = before.limit(0)
    assert freshness.envelope("callers", none, v)["results"] is None
    assert freshness.envelope("hub", none, v)["results"] == []
    assert freshness.envelope("callers", none, freshness.verdict(stamp, before, before))["negative_verdict"] == "authoritative"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.py").write_text("1")
    seen = []
    go = lambda: S.refresh(S.arrivals(spark, str(src)), str(tmp_path / "m"), str(tmp_path / "c"), lambda df, n: seen.append(sorted((r["rel"], r["change"]) for r in df.collect()))).awaitTermination()
    go()
    (src / "b.py").write_text("2")
    go()
    assert seen == [[("a.py", "added")], [("b.py", "added")]]
