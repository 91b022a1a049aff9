"""Column builders: predicates and scalar functions on symbols, paths and names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
#: Extension to (ingest face, label).
LANGUAGES = {"py": "Python", "pyi": "Python", "rs": "Rust", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript"}
WEIGHTS = {"CALLS": 1.0, "IMPLEMENTS": 0.9, "INHERITS": 0.9, "OVERRIDES": 0.9, "TESTED_BY": 0.7, "DEPENDS_ON": 0.6, "REFERENCES": 0.6, "IMPORTS_FROM": 0.5, "CONTAINS": 0.3}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _either(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


# --- symbols


def fn_tail(symbol: Column | str) -> Column:
    """The name in `name().` at the end, or null."""
    return F.nullif(F.regexp_extract(col(symbol), rf"({W}+)\(\)\.\n?$", 1), F.lit(""))


def class_tail(symbol: Column | str) -> Column:
    """The name in `Name#` at the end, or null."""
    return F.nullif(F.regexp_extract(col(symbol), rf"({W}+)#\n?$", 1), F.lit(""))


def class_segment(symbol: Column | str) -> Column:
    """The own class of a method-shaped symbol: between the last `/` and the last `#`."""
    return F.nullif(F.regexp_extract(col(symbol), r"^(?:[^\n]*/)?([^/]*)#[^#]*$", 1), F.lit(""))


def symbol_tail(symbol: Column | str) -> Column:
    """The descriptor: the last word of a symbol of more than four, else the symbol."""
    parts = F.split(col(symbol), " ")
    return F.when(F.size(parts) > 4, F.element_at(parts, -1)).otherwise(col(symbol))


def is_python_symbol(symbol: Column | str) -> Column:
    return F.coalesce(F.get(F.split(col(symbol), " "), F.lit(1)) == "python", F.lit(False))


def extension(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1)


def language_of(path: Column | str, symbol: Column | str | None = None) -> Column:
    """By extension; with a symbol, unknown extensions follow its scheme."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    known = F.try_element_at(table, extension(path))
    if symbol is None:
        return known
    return F.coalesce(known, F.when(col(symbol).rlike("^(lsp|pyrefly|scip-python) "), "Python").otherwise("Rust"))


def ingest_kind(symbol: Column | str, path: Column | str) -> Column:
    """Function, Type or null (not ingested)."""
    typed = is_python_symbol(symbol) | F.coalesce(language_of(path).isin("JavaScript", "TypeScript", "Rust"), F.lit(False))
    return F.when(fn_tail(symbol).isNotNull(), "Function").when(class_tail(symbol).isNotNull() & typed, "Type")


def matches_query(symbol: Column | str, path: Column | str, query: str) -> Column:
    """`Type.method` (split at the last dot) or a bare name; a bare name finds classes in Python and JS/TS only."""
    s = col(symbol)
    owner, dot, name = query.rpartition(".")
    tail = s.rlike(rf"(?<!{W}){re.escape(name)}\(\)\.\n?$")
    if dot:
        return tail & (s.contains(f"[{owner}]") | s.rlike(rf"(?<![\p{{L}}\p{{N}}_#]){re.escape(owner)}#"))
    classes = is_python_symbol(s) | F.coalesce(language_of(path).isin("JavaScript", "TypeScript"), F.lit(False))
    return tail | (classes & F.coalesce(class_tail(s) == name, F.lit(False)))


# --- paths


def is_test_path(path: Column | str) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return p.rlike(r"(^|/)(tests/|test_|__tests__/)") | p.rlike(r"\.(spec|test)\.([cm]?js|jsx|tsx?)$")


def is_excluded(path: Column | str, prefixes: Sequence[str] = ()) -> Column:
    """Below a virtual environment or one of the profile's prefixes."""
    out = F.lit(False)
    for p in (".venv/", *prefixes):
        out = out | col(path).startswith(p)
    return out


def module_of(path: Column | str, rules: Sequence[tuple[str, int]] = ()) -> Column:
    """The first rule (prefix, depth) that fits: its prefix and `depth` further segments, the prefix alone if one has a dot. Else the top directory."""
    p = col(path)
    out = F.split(p, "/")[0]
    for prefix, depth in reversed(rules):
        base, rest = prefix.rstrip("/"), F.substring(p, len(prefix) + 1, 1_000_000)
        segments = F.slice(F.split(rest, "/"), 1, max(depth, 0))
        inner = F.when((rest == "") | F.exists(segments, lambda s: s.contains(".")), base).otherwise(F.concat_ws("/", F.lit(base), F.array_join(segments, "/")))
        out = F.when(p.startswith(prefix), inner).otherwise(out)
    return out


def path_matches(path: Column, wanted: Column) -> Column:
    """Equal, or a suffix at a slash."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def repo_relative(path: Column | str, root: str) -> Column:
    """Below the root (by components), else null."""
    p, base = col(path), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1_000_000))


def directory(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


# --- names


_ENTRY = _either(
    "__main__", "main", "lifespan", "get_db", "log_message", "upgrade", "downgrade", "render", "resolve", "transform", "middleware", "errorHandler", "writeValue",
    "(?:lambda_)?handler?", "test_.*", "on_.*", "handle_.*", "Test[A-Z].*", "handle",
    "on(?:Bind|Create|Destroy|Pause|Receive|Resume|Start|Stop).*", "do(?:Delete|Get|Post|Put)", "do_(?:DELETE|GET|HEAD|OPTIONS|PATCH|POST|PUT)",
    "ng(?:(?:After(?:Content|View)(?:Checked|Init))|DoCheck|On(?:Changes|Destroy|Init))", "registerOn(?:Change|Touched)", "setDisabledState",
    "can(?:Activate(?:Child)?|Deactivate|Load|Match)", "component(?:Did(?:Mount|Update)|WillUnmount)", "shouldComponentUpdate",
)
_ENTRY = _ENTRY.replace("(?:lambda_)?handler?", "(?:lambda_)?handler")
_DECORATED = _either(
    r"(?i:\w+\.(?:command|exception_handler|group|middleware|on_exception|result_validator|route|system_prompt|tool|tool_plain)\b)",
    r"(?i:router\.(?:delete|get|patch|post|put|route))", r"(?:app|router)\.(?:all|delete|get|patch|post|put|use)\b", r"(?i:blueprint\.(?:after_request|before_request|route))",
    r"(?i:(?:after|before)_re(?:quest|sponse))", r"(?i:click\.(?:command|group))", r"(?i:(?:field|model)_(?:serializer|validator))", r"(?i:(?:periodic_|shared_)?task)",
    r"(?i:receiver)", r"(?i:api_view)", r"(?i:\baction\b)", r"pytest\.(?:fixture|mark)", r"(?i:(?:modify|override)_settings)", r"(?i:listens_for)",
    r"(?i:(?:delete|get|patch|post|put|requestmapping)mapping)", r"(?i:bean|configuration|eventlistener|scheduled)", r"(?i:kafkalistener)", r"(?i:(?:activity|workflow)method)",
    r"(?i:component|controller|guard|injectable|module|pipe)", r"(?i:mutation|query|resolver|subscribe)", r"(?i:@(?:composable|onlifecycleevent|override))", r"(?i:androidentrypoint|hiltviewmodel|inject)", r"^tool\b",
)
_SECURITY = _either(*"admin auth connect credential crypt execute hash http login password permission privilege query request sanitize secret session sign socket sql token validate verify".split())


def is_entry_name(name: Column | str, language: Column | str) -> Column:
    """Names that frameworks and conventions call."""
    return col(name).rlike(f"^{_ENTRY}$") | (F.coalesce(col(language) == "php", F.lit(False)) & col(name).rlike("^(__invoke|boot|register)$"))


def has_framework_decorator(extra: Column | str) -> Column:
    """extra.decorators (a string or an array of strings) names a framework hook. Bad JSON has none."""
    raw = F.get_json_object(col(extra), "$.decorators")
    listed = F.from_json(raw, "array<string>")
    return F.coalesce(F.exists(F.when(listed.isNotNull(), listed).otherwise(F.array(raw)), lambda d: F.coalesce(d.rlike(_DECORATED), F.lit(False))), F.lit(False))


def is_security_sensitive(*names: Column | str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.lower(col(n)).rlike(_SECURITY), F.lit(False))
    return out


def is_verilog(extra: Column | str) -> Column:
    return F.get_json_object(F.coalesce(col(extra), F.lit("{}")), "$.verilog_kind").isNotNull()


def edge_weight(kind: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(kind)), F.lit(0.5))


def sanitize_name(name: Column | str) -> Column:
    return F.substring(F.regexp_replace(col(name), r"[\x00-\x08\x0b-\x1f]", ""), 1, 256)


def split_name(name: Column | str) -> Column:
    """Words of an identifier: camel case, underscores, dashes, dots, white space."""
    return F.filter(F.split(F.regexp_replace(col(name), "(?<=[a-z])(?=[A-Z])", "_"), r"[_\-.\s]+"), lambda w: w != "")


def slug(name: Column | str, most: int = 30) -> Column:
    """Lower-case words joined by dashes, cut at a dash if longer than `most`."""
    s = F.array_join(F.transform(split_name(F.regexp_replace(col(name), "[^A-Za-z0-9]", " ")), F.lower), "-")
    head = F.regexp_extract(F.substring(s, 1, most + 1), "^(.+)-[^-]*$", 1)
    return F.when(F.length(s) <= most, s).otherwise(F.when(head != "", head).otherwise(F.substring(s, 1, most)))


def is_test_community(name: Column | str) -> Column:
    return col(name).rlike("(?i)^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$")


def risk_band(score: Column | str) -> Column:
    return F.when(col(score) > 0.7, "high").when(col(score) > 0.4, "medium").otherwise("low")


def event_name(name: Column | str) -> Column:
    return F.substring_index(col(name), " (", 1)


def event_path(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(name), r" \((.+?):\d+\)$", 1), F.lit(""))


def screaming_snake(name: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2"))


def kebab(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def one_based(line: Column | str) -> Column:
    """0-based to 1-based; absent stays -1."""
    return F.when(col(line) >= 0, col(line) + 1).otherwise(F.lit(-1))


def rounded(x: Column | str, places: int) -> Column:
    """Half even on the binary value, as printing does. The one expression here that needs Python."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(v):
        return v.map(lambda a: a if a is None or a != a else float(f"{a:.{places}f}"))

    return run(col(x))


def pct(part: Column | str, whole: Column | str) -> Column:
    """Per cent to one place, half to even; 0 of nothing."""
    share = col(part) / F.nullif(col(whole), F.lit(0)) * 100.0
    return F.coalesce(F.bround(share * 10.0, 0) / 10.0, F.lit(0.0))


def normalize_rel(path: Column | str) -> Column:
    """Slashes only, without a leading `./`."""
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def pyi_module(path: Column | str, package: str) -> Column:
    """The dotted module of a stub below the last folder of the package's name, or null outside."""
    inner = F.regexp_extract(col(path), rf"^(?:.*/)?({re.escape(package)}/.*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(inner, r"/__init__\.pyi$", ""), r"(\.pyi)+$", "")
    return F.when(inner != "", F.replace(stem, F.lit("/"), F.lit(".")))


def anchor_pattern(line: Column | str) -> Column:
    """A pattern that finds a line whatever its outer white space: its trimmed text, all marks and spaces escaped."""
    text = F.regexp_replace(F.regexp_replace(col(line), r"^\s+|\s+$", ""), r"([\\.+*?()|\[\]{}^$#&\-~ ])", r"\\$1")
    return F.concat(F.lit(r"^[ \t]*"), text, F.lit(r"[ \t]*$"))


def like_escape(text: Column | str, mark: str = "\\") -> Column:
    """Marks that LIKE would read as wildcards, escaped."""
    return F.regexp_replace(col(text), r"([\\%_])", re.escape(mark).replace("\\", "\\\\") + "$1" if mark != "\\" else r"\\$1")


def utf16_column(prefix: Column | str) -> Column:
    """UTF-16 units of what precedes a position in its line: characters beyond the basic plane count twice."""
    return (F.length(col(prefix)) + F.regexp_count(col(prefix), F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; a day beyond its month counts on."""
    return F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1


def iso_epoch(text: Column | str) -> Column:
    """Seconds since the epoch of an ISO date and time, with Z, an offset or (in the session's time zone) neither; null for anything else."""
    t = col(text)
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d*)?([Zz]|[+-]\d{2}(:?\d{2})?)?$"
    n = lambda at, size: F.substring(t, at, size).try_cast("int")
    valid = t.rlike(shape) & n(6, 2).between(1, 12) & n(9, 2).between(1, 31) & (n(12, 2) <= 23) & (n(15, 2) <= 59) & (n(18, 2) <= 59)
    days = civil_days(n(1, 4), F.when(valid, n(6, 2)), n(9, 2)).cast("long")
    wall = days * 86400 + n(12, 2) * 3600 + n(15, 2) * 60 + n(18, 2)
    # The offset, if any, as +hhmm.
    mark = F.rpad(F.replace(F.regexp_extract(t, r"([+-]\d{2}(:?\d{2})?)$", 1), F.lit(":"), F.lit("")), 5, "0")
    offset = F.substring(mark, 2, 2).try_cast("int") * 3600 + F.substring(mark, 4, 2).try_cast("int") * 60
    last = F.substring(t, 20, 100)
    shifted = F.when(last.rlike("-"), wall + offset).otherwise(wall - offset)
    local = F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(wall), F.current_timezone()))
    return F.when(valid, F.when(last.rlike("[Zz]$"), wall).when(last.rlike("[+-]"), shifted).otherwise(local))


def expired(day: Column | str, today: Column | str, days: int) -> Column:
    """Whether a date lies more than `days` days before another."""
    return F.date_diff(col(today), col(day)) > days


def node_dict() -> Column:
    """A node as it is shown: names without control marks, no ids of storage."""
    return F.struct(
        F.col("id"), F.col("kind"), sanitize_name("name").alias("name"), sanitize_name("qname").alias("qualified_name"), F.col("file_path"), F.col("line_start"), F.col("line_end"),
        F.col("language"), sanitize_name("parent_name").alias("parent_name"), F.col("is_test"),
    )


def ts_key(title: Column | str) -> Column:
    """A tour's title without its number in front: what stands between the first two dashes of a numbered title."""
    t = col(title)
    return F.when(t.rlike(r"^#?\d+\s-"), F.trim(F.coalesce(F.get(F.split(t, "-"), F.lit(1)), F.lit("")))).otherwise(t)


def revive_crossrefs(text: Column | str, keys: dict[int, str]) -> Column:
    """`[12 - name]` as a link `[name][key#1]` where the number has a key without marks of links; a few keys, given as literals."""
    out = col(text)
    for number, key in keys.items():
        if "]" not in key and "#" not in key:
            out = F.regexp_replace(out, rf"\[0?{number}\s*-\s*([^\]]+)\]", f"[$1][{re.escape(key)}#1]")
    return out


def sanitize_brackets(text: Column | str) -> Column:
    """Single brackets that are no part of a link become full-width ones."""
    return F.regexp_replace(col(text), r"(?<![\](\[])\[([^\]\[]+)\](?![\](])", "［$1］")
