"""Call sites of scripts."""

import pytest

from symgraph.sources.scripts import call_sites, script_calls


def names(text):
    return [n for *_, n in call_sites(text)]


def test_sites():
    assert names("foo(); obj.bar(); a?.b?.(); new Foo(1); new ns.Bar; (baz)();") == ["foo", "bar", "b", "Foo", "Bar", "baz"]
    assert names("await track<T>(x); a.b!(); f`x`;") == ["track", "b"]
    assert names("function one() { two() } async function* three() {} const x = { four() { five() } }") == ["two", "five"]
    assert names("class A extends B { m(x) { return this.k(x) } static s() { s2() } f = g(1) }\ninterface I { z(): void }") == ["k", "s2", "g"]
    assert names("if (a) { b() } for (;;) c(); while (d()) {} return e()") == ["b", "c", "d", "e"]
    assert names("// no()\n/* no() */ 'no()' + \"no()\" + `no() ${yes(1)} no()` + /no()/.test(q)") == ["yes", "test"]
    assert names("obj[key](); import('x'); super(1)") == []
    assert names("a < b(c); d > e") == ["b"]


def test_places():
    assert call_sites("x\n  é\U0001f600; run()") == [(2, 7, "run")]


def test_broken_files():
    for text in ("f(", "f())", "'abc\nf()", "`${f()", "`f()"):
        with pytest.raises(ValueError):
            call_sites(text)


def test_frame(spark):
    d = spark.createDataFrame([("a.ts", "go()"), ("b.js", "go("), ("c.py", "go()"), ("d.tsx", None)], "rel string, text string")
    assert [tuple(r) for r in script_calls(d).collect()] == [("a.ts", 1, 0, "go")]
