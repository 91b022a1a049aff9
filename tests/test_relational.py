import random

from symgraph import schema
from symgraph.operators import relational as R


def test_innermost(spark):
    spans = spark.createDataFrame([(0, "outer", "a", 100, 200), (1, "inner", "a", 120, 130), (2, "first", "b", 10, 20), (3, "second", "b", 10, 20)], schema.SPANS)
    refs = spark.createDataFrame([(i, "x", p, n, False, -1) for i, (p, n) in enumerate([("a", 125), ("a", 110), ("a", 120), ("a", 130), ("a", 100), ("a", 200), ("b", 15), ("a", 201), ("c", 1)])], schema.OCCURRENCES)
    for bucket in (None, 16):
        got = {r["seq"]: r["span"]["symbol"] if r["span"] else None for r in R.innermost(refs, spans, bucket=bucket).collect()}
        assert [got[i] for i in range(9)] == ["inner", "outer", "inner", "inner", "outer", "outer", "first", None, None]


def test_callers(spark):
    spans = spark.createDataFrame([(0, "one", "a.rs", 10, 20), (1, "two", "b.rs", 30, 40)], schema.SPANS)
    occ = spark.createDataFrame([(i, "s foo().", p, n, d, 0) for i, (p, n, d) in enumerate([("a.rs", 12, False), ("b.rs", 35, False), ("a.rs", 15, False), ("c.rs", 99, False), ("a.rs", 500, False), ("d.rs", 1, True)])], schema.OCCURRENCES)
    defs = R.definitions(occ, "foo")
    refs = R.references(occ, defs)
    assert defs.count() == 1 and refs.count() == 5
    grouped, rest = R.callers(refs, spans)
    got = [(r["caller"], [s["line"] for s in r["sites"]]) for r in grouped.orderBy("first_seq").collect()]
    assert got == [("one", [12, 15]), ("two", [35])]
    assert sorted((r["rel_path"], r["line"]) for r in rest.collect()) == [("a.rs", 500), ("c.rs", 99)]
    assert sorted((r["caller"], r["n_sites"]) for r in R.derive_edges(occ, spans).collect()) == [("one", 2), ("two", 1)]


def test_nearest_preceding(spark):
    rng = random.Random(1)
    defs = [(f"s{rng.randrange(5)}", f"p{rng.randrange(3)}", rng.randrange(30)) for _ in range(60)]
    refs = [(i, f"p{rng.randrange(4)}", rng.randrange(30)) for i in range(80)]
    got = R.nearest_preceding(spark.createDataFrame(refs, "seq long, rel_path string, line long"), spark.createDataFrame(defs, "symbol string, rel_path string, line long"))
    for r in got.collect():
        c = [(n, s) for s, p, n in defs if p == r["rel_path"] and n <= r["line"]]
        assert r["nearest"] == (max(c)[1] if c else None)


def _trace(spark, rows):
    return spark.createDataFrame([("fee", "X", str(p), str(t), ts, d, n, i) for i, (p, t, ts, d, n) in enumerate(rows)], schema.TRACE + ", ord long")


def test_nesting(spark):
    edges = lambda rows: sorted((r["caller"], r["callee"]) for r in R.trace_edges(_trace(spark, rows)).collect())
    assert edges([(1, 10, 0, 100, "outer"), (1, 10, 10, 30, "mid"), (1, 10, 15, 5, "inner"), (1, 10, 50, 10, "late")]) == [("mid", "inner"), ("outer", "late"), ("outer", "mid")]
    assert edges([(1, 10, 0, 50, "a"), (2, 10, 10, 5, "b")]) == []
    assert edges([(1, 10, 0, 10, "a"), (1, 10, 10, 10, "b")]) == []
    rng = random.Random(3)
    rows = [(1, rng.randrange(3), rng.randrange(60), rng.choice([0, 1, 5, 20, 300]), f"n{i}") for i in range(120)]
    want = []
    for t in range(3):
        own = sorted(((ts, -d, i, n) for i, (_, u, ts, d, n) in enumerate(rows) if u == t))
        stack = []
        for ts, neg, _, n in own:
            while stack and stack[-1][0] <= ts:
                stack.pop()
            if stack:
                want.append((stack[-1][1], n))
            stack.append((ts - neg, n))
    assert edges(rows) == sorted(want)


def test_trace_stats(spark):
    rows = [("o (/in/a.py:1)", "c (/out/b.py:2)", d, d) for d in range(100, 2001, 100)]
    e = spark.createDataFrame(rows, "caller string, callee string, dur long, ord long")
    (r,) = R.trace_stats(e).collect()
    assert (r["caller"], r["callee"], r["count"], r["p50_ms"], r["p95_ms"]) == ("o", "c", 20, 1.05, 1.9)
    four = spark.createDataFrame([("x (/in/a:1)", "y (/in/b:1)", 1, 0), ("noise", "y (/in/b:1)", 1, 1), ("x (/in/a:1)", "z (/out/b:1)", 1, 2), ("x (/inner/a:1)", "z (/out/b:1)", 1, 3)], "caller string, callee string, dur long, ord long")
    assert sorted(r["ord"] for r in R.repo_only(four, "/in").collect()) == [0, 1, 2]
    assert R.with_text(four, include="noise").count() == 1 and R.with_text(four, exclude="noise").count() == 3


def test_edge_diff(spark):
    e = lambda *r: spark.createDataFrame(list(r), schema.MODULE_EDGES)
    d = R.edge_diff(e(("m/a", "m/b", "CALLS")), e(("m/b", "m/a", "CALLS")))
    assert [tuple(r) for r in d["reversed"].collect()] == [("m/b", "m/a")] and d["added"].count() == d["removed"].count() == 1
    d = R.edge_diff(e(("a", "b", "CALLS")), e(("a", "b", "IMPORTS_FROM")))
    assert d["reversed"].count() == 0 and d["added"].count() == d["removed"].count() == 1
    d = R.edge_diff(e(("a", "b", "CALLS")), e(("a", "b", "CALLS"), ("a", "b", "IMPORTS_FROM")))
    assert (d["added"].count(), d["removed"].count(), d["reversed"].count()) == (1, 0, 0)
    m = lambda *x: spark.createDataFrame([(v,) for v in x], "module string")
    assert {tuple(r) for r in R.compare_claims(m("domain", "untouched"), m("domain", "features")).collect()} == {("domain", "hit"), ("features", "surprise"), ("untouched", "missed")}


def test_manifest(spark):
    m = spark.createDataFrame([("py", "a", 1, "h"), ("py", "b", 1, "h"), ("py", "c", 1, "h")], schema.MANIFEST)
    c = spark.createDataFrame([("py", "a", 1, "h"), ("py", "b", 2, "h"), ("py", "d", 1, "h")], schema.MANIFEST)
    assert {(r["rel"], r["change"]) for r in R.manifest_delta(m, c).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert R.identity_hash(m).first() == R.identity_hash(m.orderBy("rel", ascending=False)).first() != R.identity_hash(c).first()


def test_lookups(spark):
    rows = spark.createDataFrame([("k1", "A"), ("k1", "B"), ("k2", "A"), ("k9", "C")], "crate string, name string")
    table = spark.createDataFrame([("k1", "A", 1), ("k3", "A", 2), ("k4", "B", 3)], "crate string, name string, v int")
    got = {(r["crate"], r["name"]): (r["found"], r["tier"]) for r in R.two_tier_lookup(rows, table, ["crate", "name"], "name", "v").collect()}
    assert got == {("k1", "A"): (1, 1), ("k1", "B"): (3, 2), ("k2", "A"): (None, None), ("k9", "C"): (None, None)}
    x = spark.createDataFrame([("k", "b", 0), ("k", "a", 1), ("k", "a", 2), ("k", "b", 3)], "k string, v string, o int")
    assert [r["v"] for r in R.ordered_mode(x, ["k"], "v", "o").collect()] == ["b"]
    assert R.collisions(spark.createDataFrame([("s", "r1"), ("s", "r2"), ("t", "r1"), ("t", "r1")], "symbol string, root string")).count() == 1
    s = spark.createDataFrame([("f", "n", True), ("f", "n", False), ("f", "m", True)], "file string, name string, legacy boolean")
    assert R.shadowed(s, ["file", "name"], s["legacy"]).count() == 2
