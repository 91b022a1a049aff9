"""Column builders on descriptors: regions, scope chains, impl heads, identifiers and qualifiers of symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, symbol_tail

_NAME = "[A-Za-z0-9_%]+"
_HEAD = rf"impl#\[{_NAME}\](?:\[{_NAME}\])*"
_STEP = rf"{_NAME}(?:\(\)\.|#|\.)"


#: What brackets hold, up to four deep; without backtracking.
_INSIDE = r"[^\[\]]*+"
for _ in range(3):
    _INSIDE = rf"(?:[^\[\]]++|\[{_INSIDE}\])*+"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def descriptor_region(symbol: Column | str) -> Column:
    """What follows the last back quote and slash, else the last slash of the symbol's tail; null without either."""

    def after(s: Column) -> Column:
        tail = symbol_tail(s)
        return F.when(s.contains("`/"), F.substring_index(s, "`/", -1)).when(tail.contains("/"), F.substring_index(tail, "/", -1))

    return _let(F.regexp_replace(col(symbol), r"\s+$", ""), after)


def descriptor_chain(region: Column | str) -> Column:
    """Names of the scopes and of the definition itself; of an impl head the type only. Null for what doesn't parse whole."""

    def names(r: Column) -> Column:
        rest = F.regexp_replace(r, f"^{_HEAD}", "")
        owner = F.regexp_extract(r, rf"^impl#\[({_NAME})\]", 1)
        steps = F.regexp_extract_all(rest, F.lit(rf"({_NAME})(?:\(\)\.|#|\.)"), F.lit(1))
        return F.when(r.rlike(rf"\A(?:{_HEAD}(?:{_STEP})*|(?!impl#\[)(?:{_STEP})+)\z"), F.when(owner != "", F.concat(F.array(owner), steps)).otherwise(steps))

    return _let(col(region), names)


def bracket_groups(text: Column | str) -> Column:
    """groups (list), closed: the bracketed groups that a text starts with, with nested brackets kept; closed is false if the last one isn't."""
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("groups"), F.lit(False).alias("done"))

    def step(a: Column, c: Column) -> Column:
        inner = F.when(c == "[", a["depth"] + 1).when(c == "]", a["depth"] - 1).otherwise(a["depth"])
        ends = (a["depth"] == 1) & (c == "]")
        started = F.struct(F.lit(1).alias("depth"), F.lit("").alias("now"), a["groups"].alias("groups"), F.lit(False).alias("done"))
        stopped = F.struct(a["depth"].alias("depth"), a["now"].alias("now"), a["groups"].alias("groups"), F.lit(True).alias("done"))
        inside = F.struct(inner.alias("depth"), F.when(ends, "").otherwise(F.concat(a["now"], c)).alias("now"), F.when(ends, F.concat(a["groups"], F.array(a["now"]))).otherwise(a["groups"]).alias("groups"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(a["depth"] > 0, inside).when(c == "[", started).otherwise(stopped)

    def one_by_one(t: Column) -> Column:
        return _let(F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), empty, step), lambda x: F.struct(x["groups"].alias("groups"), (x["depth"] == 0).alias("closed")))

    def groups(t: Column) -> Column:
        heads = F.regexp_extract(t, rf"\A((?:\[{_INSIDE}\])*+)", 1)
        found = F.regexp_extract_all(heads, F.lit(rf"\[({_INSIDE})\]"), F.lit(1))
        return F.when(t.rlike(rf"\A(?:\[{_INSIDE}\])*+(?!\[)"), F.struct(found.alias("groups"), F.lit(True).alias("closed"))).otherwise(one_by_one(t))

    # Only what is left open or nested deeper is read a letter at a time.
    return _let(col(text), groups)


def impl_head(region: Column | str) -> Column:
    """state ('valid', 'malformed' or 'none'), receiver, traits of a region that starts as an impl head. A malformed head keeps its receiver if that was read."""
    none = F.array().cast("array<string>")
    row = lambda state, receiver, traits: F.struct(state.alias("state"), receiver.alias("receiver"), traits.alias("traits"))

    def head(found: Column) -> Column:
        groups = found["groups"]
        receiver = F.when((F.size(groups) > 0) & (F.get(groups, F.lit(0)) != ""), F.get(groups, F.lit(0)))
        whole = found["closed"] & receiver.isNotNull() & ~F.exists(groups, lambda g: g == "")
        return row(F.when(whole, "valid").otherwise("malformed"), receiver, F.when(whole, F.slice(groups, 2, 1_000_000)).otherwise(none))

    def read(r: Column) -> Column:
        return F.when(F.coalesce(r.startswith("impl#["), F.lit(False)), _let(bracket_groups(F.substring(r, 6, 1_000_000)), head)).otherwise(row(F.lit("none"), F.lit(None).cast("string"), none))

    return _let(col(region), read)


def best_ident(text: Column | str, excluded: tuple[str, ...] = ()) -> Column:
    """(last, full) of the identifier in a text that is called, else the longest; the first of equals; empty without any."""
    word = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]*)*"
    hits = F.regexp_extract_all(col(text), F.lit(rf"{word}\(?"), F.lit(0))
    ranked = F.transform(hits, lambda h, i: F.struct(h.endswith("(").cast("int").alias("call"), F.length(F.rtrim(h, F.lit("("))).alias("n"), (-i).alias("at"), F.rtrim(h, F.lit("(")).alias("full")))
    if excluded:
        ranked = F.filter(ranked, lambda x: ~x["full"].isin(*excluded))
    full = F.coalesce(F.array_max(ranked)["full"], F.lit(""))
    return F.struct(F.substring_index(full, ".", -1).alias("last"), full.alias("full"))


def parse_qualifier(text: Column | str) -> Column:
    """state ('none', 'malformed' or 'formed'), receiver, method, trait of `path::Receiver::method()[Trait]`."""
    s = F.trim(col(text))
    looks = s.rlike(r"(?s)^.*?::.*\[")
    head = r"\A((?:[A-Za-z_][A-Za-z0-9_]*::)+[A-Za-z_][A-Za-z0-9_]*)(?:\([^)]*\))?(?=\[)"
    path = F.regexp_extract(s, head, 1)
    rest = F.regexp_replace(s, head, "")
    found = bracket_groups(rest)
    trait = F.get(found["groups"], F.lit(0))
    parts = F.split(path, "::")
    # What follows the first group, read off by its length.
    after = F.trim(F.substring(rest, F.length(trait) + 3, F.lit(1_000_000)))
    broken = (path == "") | trait.isNull() | (trait == "")
    formed = ~broken & after.isin("", "()")
    state = F.when(~looks, "none").when(broken, "malformed").when(~trait.rlike("[A-Za-z]"), "none").when(formed, "formed").otherwise("malformed")
    only = lambda c: F.when(state == "formed", c)
    return F.struct(state.alias("state"), only(F.element_at(parts, -2)).alias("receiver"), only(F.element_at(parts, -1)).alias("method"), only(trait).alias("trait"))
