"""Sources read from text: diffs, name-status lists, traces, snapshots, manifests, source trees, source code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import extension, is_excluded, language_of

SKIPPED = ("__pycache__", "node_modules", "venv")


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(path, start, end) of the new side of unified diffs (diff_id, line_no, value). An empty hunk is its position; deletions have none."""
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("path", F.last(F.when(F.col("value").startswith("+++ "), F.regexp_replace(F.substring("value", 5, 100_000), r"^b/|\t.*$", "")), ignorenulls=True).over(w))
    h = named.withColumn("h", F.regexp_extract("value", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)).filter("h <> '' and path <> '/dev/null'").withColumn("n", F.regexp_extract("value", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1))
    n = F.when(F.col("n") == "", 1).otherwise(F.try_to_number("n", F.lit("999999999")).cast("long"))
    start = F.col("h").cast("long")
    return h.select("path", start.alias("start"), F.greatest(start, start + n - 1).alias("end"))


def first_changes(ranges: DataFrame) -> DataFrame:
    return ranges.filter("start > 0").groupBy("path").agg(F.min("start").alias("line"))


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) of NUL-separated output: copies count as A, type changes as M."""
    parts, out = text.split("\0"), []
    while parts and parts[0]:
        code = parts.pop(0)
        if code[0] in "RC":
            old, new = parts.pop(0), parts.pop(0)
            out.append(("R", new, old) if code[0] == "R" else ("A", new, None))
        else:
            out.append(({"T": "M"}.get(code[0], code[0]), parts.pop(0), None))
    return out


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of trace files with `ord`, their order in the file; a file without traceEvents is an error."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("traceEvents array<struct<cat:string,ph:string,pid:string,tid:string,ts:double,dur:double,name:string>>").json(path)
    raw = raw.withColumn("traceEvents", F.when(F.col("traceEvents").isNull(), F.raise_error(F.lit("a trace has no traceEvents"))).otherwise(F.col("traceEvents")))
    return raw.select(F.posexplode("traceEvents").alias("ord", "e")).select("e.cat", "e.ph", "e.pid", "e.tid", F.col("e.ts").cast("long").alias("ts"), F.coalesce(F.col("e.dur"), F.lit(0)).cast("long").alias("dur"), "e.name", F.col("ord").cast("long").alias("ord"))


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files (file), edges (src, dst, kind) and meta (one map). An edge that isn't a triple is an error."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("_meta map<string,string>, files array<string>, module_edges array<array<string>>").json(path)
    e = raw.select(F.explode("module_edges").alias("e"))
    third = F.when(F.size("e") == 3, F.col("e")[2]).otherwise(F.raise_error(F.lit("a module edge isn't a triple")))
    return {"files": raw.select(F.explode("files").alias("file")).distinct(), "edges": e.select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), third.alias("kind")).distinct(), "meta": raw.select(F.col("_meta").alias("meta"))}


def write_snapshot(files: DataFrame, edges: DataFrame, meta: dict[str, str], path: str) -> None:
    """One JSON file; both sets are bounded by the repository's modules and files."""
    one = files.agg(F.sort_array(F.collect_set("file")).alias("files")).crossJoin(F.broadcast(edges.agg(F.transform(F.sort_array(F.collect_set(F.struct("src", "dst", "kind"))), lambda e: F.array(e["src"], e["dst"], e["kind"])).alias("module_edges"))))
    one.select(F.create_map(*(F.lit(x) for kv in meta.items() for x in kv)).alias("_meta") if meta else F.lit(None).cast("map<string,string>").alias("_meta"), "files", "module_edges").coalesce(1).write.mode("overwrite").json(path)


def source_files(spark: SparkSession, root: str, excluded: Sequence[str] = ()) -> DataFrame:
    """rel, face, size, mtime of governed source files below root; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file:") + "/"
    rel = F.regexp_replace(F.expr("url_decode(regexp_replace(path, '[+]', '%2B'))"), "^(?:file:)?/*" + re.escape(base.lstrip("/")), "")
    f = f.select("path", rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).withColumn("face", language_of("rel"))
    parts = F.split("rel", "/")
    skipped = F.exists(parts, lambda p: p.isin(*SKIPPED) | (p.startswith(".") & (p != "."))) | ((F.col("face") == "Rust") & F.array_contains(parts, "target"))
    return f.filter(F.col("face").isNotNull() & ~skipped & ~is_excluded("rel", excluded))


def manifest(spark: SparkSession, root: str, excluded: Sequence[str] = (), cached: DataFrame | None = None) -> DataFrame:
    """face, rel, size, hash (sha256), mtime. With a cached manifest, only files of another size or time are read."""
    walked = source_files(spark, root, excluded)
    if cached is not None:
        served = walked.join(cached.select("rel", "size", "mtime", "hash"), ["rel", "size", "mtime"])
        walked = walked.join(served.select("rel"), "rel", "left_anti")
    bytes_ = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    fresh = walked.join(bytes_, "path").select("face", "rel", "size", F.sha2("content", 256).alias("hash"), "mtime")
    return fresh if cached is None else fresh.unionByName(served.select("face", "rel", "size", "hash", "mtime"))


# --- source code, one text a row (rel, text)


def _per_text(files: DataFrame, run, schema: str) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]
        for b in batches:
            rows = []
            for rel, text in zip(b["rel"], b["text"], strict=True):
                try:
                    rows += [(rel, *r) for r in run(text or "")]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("rel", "text").mapInPandas(go, schema)


def python_calls(files: DataFrame) -> DataFrame:
    """(rel_path, line, col, name) of call sites, col -1; a file that doesn't parse has none."""

    def run(text: str):
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.Call):
                f = node.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    yield (f.end_lineno if isinstance(f, ast.Attribute) else f.lineno), -1, name

    return _per_text(files, run, "rel_path string, line long, col long, name string")


def python_classes(files: DataFrame) -> DataFrame:
    """(rel_path, name, line, bases, is_strenum, is_protocol, values) of classes; values are the string members of string enums."""

    def run(text: str):
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.ClassDef):
                bases = [b.attr if isinstance(b, ast.Attribute) else b.id if isinstance(b, ast.Name) else b.value.id if isinstance(b, ast.Subscript) and isinstance(b.value, ast.Name) else "" for b in node.bases]
                text_enum = "StrEnum" in bases or {"str", "Enum"} <= set(bases)
                values = [s.value.value for s in node.body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)] if text_enum else []
                yield node.name, node.lineno, bases, text_enum, "Protocol" in bases, values

    return _per_text(files, run, "rel_path string, name string, line long, bases array<string>, is_strenum boolean, is_protocol boolean, values array<string>")


def stub_facts(files: DataFrame) -> DataFrame:
    """(rel_path, kind, owner, name, line) of stubs: class, method (last line wins), member (first wins), function."""

    def run(text: str):
        for node in ast.parse(text).body:
            if isinstance(node, ast.ClassDef):
                yield "class", None, node.name, node.lineno
                methods, members = {}, {}
                for s in node.body:
                    if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                        methods[s.name] = s.lineno
                    else:
                        for t in s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []:
                            if isinstance(t, ast.Name):
                                members.setdefault(t.id, s.lineno)
                for kind, found in (("method", methods), ("member", members)):
                    for name, line in found.items():
                        yield kind, node.name, name, line
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield "function", None, node.name, node.lineno

    return _per_text(files, run, "rel_path string, kind string, owner string, name string, line long")


_ATTRIBUTE = re.compile(r"#\[\s*(?:\w+::)*(pyclass|pymethods|pyfunction|new|getter|setter|staticmethod|classmethod|pyo3)\b(.*?)\]\s*$")
_NAMED = re.compile(r"\bname\s*=\s*\"([^\"]+)\"")
_MODULE = re.compile(r"\bmodule\s*=\s*\"([^\"]+)\"")
_ITEM = re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(struct|enum)\s+(\w+)")
_FN = re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)")


def rust_bindings(files: DataFrame) -> DataFrame:
    """(rel_path, kind, owner, name, exposed, module, method_kind, renamed, line) of exported classes, methods, fields, variants and functions.

    Line-based: attributes wait for the next item; impl bodies end where their braces close (strings aren't looked into).
    """

    def run(text: str):
        waiting: dict[str, str] = {}
        block, depth, owner, get_all = "", 0, "", False
        for no, line in enumerate(text.split("\n"), 1):
            if m := _ATTRIBUTE.match(line.strip()):
                waiting[m[1]] = waiting.get(m[1], "") + m[2]
                continue
            args = "".join(waiting.values())
            named = _NAMED.search(args)
            if not block:
                if (m := _ITEM.match(line)) and "pyclass" in waiting:
                    module = _MODULE.search(args)
                    yield "class", None, m[2], named[1] if named else m[2], module[1] if module else None, m[1], bool(named), no
                    block, owner, get_all = m[1], m[2], "get_all" in args or "from_py_object" in args
                elif "pymethods" in waiting and (m := re.match(r"\s*impl(?:<[^>]*>)?\s+(\w+)", line)):
                    block, owner = "impl", m[1]
                elif (m := _FN.match(line)) and "pyfunction" in waiting:
                    module = _MODULE.search(args)
                    yield "function", None, m[1], named[1] if named else m[1], module[1] if module else None, "function", bool(named), no
                depth = 0
            elif depth == 1:
                if block == "impl" and (m := _FN.match(line)):
                    kind = next((k for k in ("new", "getter", "setter", "staticmethod", "classmethod") if k in waiting), "dunder" if re.fullmatch("__\\w+__", m[1]) else "method")
                    exposed = named[1] if named else re.sub("^[gs]et_", "", m[1]) if kind in ("getter", "setter") else m[1]
                    yield "method", owner, m[1], exposed, None, kind, bool(named), no
                elif block == "enum" and (m := re.match(r"\s*([A-Z]\w*)\s*(?:=[^,]*)?[,({]?", line)):
                    exposed = named[1] if named else re.sub("([a-z0-9])([A-Z])", r"\1_\2", m[1]).upper()
                    yield "method", owner, m[1], exposed, None, "variant", False, no
                elif block == "struct" and get_all and (m := re.match(r"\s*pub\s+(\w+)\s*:", line)):
                    yield "method", owner, m[1], m[1], None, "field_property", False, no
            if line.strip() and not line.strip().startswith("//"):
                waiting = {}
            if block:
                depth += line.count("{") - line.count("}")
                if depth <= 0 and ("}" in line or line.rstrip().endswith(";")):
                    block = ""

    return _per_text(files, run, "rel_path string, kind string, owner string, name string, exposed string, module string, method_kind string, renamed boolean, line long")


def impl_functions(files: DataFrame) -> DataFrame:
    """(rel_path, type, block, name, line) of functions in impl blocks."""

    def run(text: str):
        block, kind, depth = 0, "", 0
        for no, line in enumerate(text.split("\n"), 1):
            if not kind and (m := re.match(r"\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", line)):
                block, kind, depth = block + 1, m[1], 0
            elif kind and depth == 1 and (m := _FN.match(line)):
                yield kind, block, m[1], no
            if kind:
                depth += line.count("{") - line.count("}")
                if depth <= 0 and "}" in line:
                    kind = ""

    return _per_text(files, run, "rel_path string, type string, block long, name string, line long")


def duplicate_methods(functions: DataFrame) -> DataFrame:
    """(rel_path, type, names): methods that several impl blocks of a type in one file have."""
    d = functions.groupBy("rel_path", "type", "name").agg(F.count_distinct("block").alias("n")).filter("n > 1")
    return d.groupBy("rel_path", "type").agg(F.sort_array(F.collect_set("name")).alias("names"))


def text_lines(files: DataFrame, extensions: Sequence[str] = ("py", "yaml", "yml", "json", "toml"), excluded: Sequence[str] = ()) -> DataFrame:
    """(path, line_no, text) of files of the kinds that a text scan reads, below no excluded prefix."""
    rows = files.filter(extension("rel").isin(*extensions) & ~is_excluded("rel", excluded))
    return rows.select(F.col("rel").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def chain_frames(blocks: DataFrame) -> DataFrame:
    """(block_id, ord, depth, text) of call trees drawn with box characters (block_id, text); a line is below the nearest line above it that is indented less."""
    from ..operators.resolve import tree_depths

    b = blocks.select("block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    b = b.withColumn("indent", F.length(F.regexp_extract("line", r"^([\s│├└─]*)", 1)))
    return tree_depths(b, "block_id").select("block_id", F.col("pos").alias("ord"), F.col("depth").cast("int").alias("depth"), F.trim(F.regexp_replace("line", r"^[\s│├└─]*", "")).alias("text"))
