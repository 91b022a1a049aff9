"""Repository files as DataFrames: build inputs, diffs, tours, manifests, call chains, inventories; and the files written back.

One repository's files are listed on the driver (they are its own), their contents are read by tasks.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import language_of
from .texts import diff_ranges

SAFE_REF = re.compile(r"^[A-Za-z0-9_.~^/@{}\-]+$")
CONFIG = ("rust-toolchain", "rust-toolchain.toml", ".cargo/config", ".cargo/config.toml")
#: Folders of tours that aren't part of the corpus.
TOURS_APART = ("delta", "dev-fixture")


def _walk(top: str, skipped: Sequence[str] = ("target",)) -> list[str]:
    out = []
    for folder, dirs, names in os.walk(top):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in skipped)
        out += [os.path.join(folder, n) for n in sorted(names)]
    return out


def cargo_inputs(spark: SparkSession, repo: str, roots: Sequence[str], mode: str = "workspace") -> tuple[DataFrame, DataFrame]:
    """(rel, size, mtime) of what governs a Cargo build, and its topology (key, value).

    Inputs are every Cargo.toml below a root, and toolchain and Cargo settings of the roots and the folders above them up
    to the repository. Topology has the mode, the sorted roots and which of those settings are absent.
    """
    found, topology, absent = {}, [("mode", mode)], set()
    for i, root in enumerate(sorted(roots)):
        topology.append((f"root[{i}]", root))
        for path in _walk(os.path.join(repo, root)):
            if os.path.basename(path) == "Cargo.toml":
                found[os.path.relpath(path, repo)] = path
        at = os.path.normpath(os.path.join(repo, root))
        while True:
            for name in (*CONFIG, *(("Cargo.lock",) if at == os.path.normpath(os.path.join(repo, root)) else ())):
                path = os.path.join(at, name)
                rel = os.path.relpath(path, repo)
                if os.path.isfile(path):
                    found[rel] = path
                else:
                    absent.add(rel)
            if at == os.path.normpath(repo) or not at.startswith(os.path.normpath(repo)):
                break
            at = os.path.dirname(at)
    rows = [(rel, os.stat(p).st_size, os.stat(p).st_mtime_ns) for rel, p in sorted(found.items())]
    topology += [(f"absent:{x}", "") for x in sorted(absent)]
    return spark.createDataFrame(rows, "rel string, size long, mtime long"), spark.createDataFrame(topology, "key string, value string")


def git_diff(spark: SparkSession, repo: str, base: str, timeout: float = 30) -> DataFrame:
    """path, start, end of lines changed since a ref, which must be a plain one."""
    if not SAFE_REF.match(base) or base.startswith("-"):
        raise ValueError(f"not a safe ref: {base!r}")
    text = subprocess.run(["git", "-C", repo, "diff", "--unified=0", base, "--"], capture_output=True, timeout=timeout, check=True).stdout.decode(errors="replace")
    return diff_ranges(spark.createDataFrame([(0, i, x) for i, x in enumerate(text.split("\n"))], "diff_id int, line_no long, value string"))


def glob_files(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    """path, length, modified of files below a root whose name fits a pattern; contents aren't read."""
    frames = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select("path", "length", F.col("modificationTime").alias("modified")) for p in patterns]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def read_tours(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """rel, title, n_steps, json of *.tour files; those in the folders apart only with `everything`. A file that isn't JSON is an error."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tour").text(root, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"))
    base = F.regexp_extract("path", f"^(?:file:(?://)?)?{re.escape(root.rstrip('/'))}/(.*)$", 1)
    t = t.withColumn("rel", base)
    if not everything:
        dirs = F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
        t = t.filter(~F.arrays_overlap(dirs, F.array(*map(F.lit, TOURS_APART))))
    parsed = t.withColumn("t", F.from_json("json", "title string, steps array<struct<file string, line long, pattern string, description string>>", {"mode": "FAILFAST"}))
    return parsed.select("rel", F.col("t.title").alias("title"), F.coalesce(F.size("t.steps"), F.lit(0)).alias("n_steps"), F.col("t.steps").alias("steps"), "json")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows of a TOML tour manifest (rel, row as JSON) and its other keys. No file is an empty manifest; a known key of the wrong kind is an error."""
    data = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = tomllib.load(f)
    tours = data.pop("tour", {})
    if not isinstance(tours, dict) or not all(isinstance(r, dict) for r in tours.values()):
        raise ValueError(f"{path}: tour and its rows must be tables")
    if not isinstance(data.get("delta_arc", []), list):
        raise ValueError(f"{path}: delta_arc must be an array")
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(tours.items())], "rel string, row string"), data


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(str(value), ensure_ascii=False)


def write_manifest(rows: DataFrame, other: dict, path: str) -> None:
    """A TOML manifest, rows by path, through a file beside it and a rename."""
    lines = [f"{k} = {_toml(v)}" for k, v in other.items() if k != "delta_arc"]
    for r in rows.orderBy("rel").collect():  # one manifest's rows
        lines += ["", f"[tour.{json.dumps(r['rel'], ensure_ascii=False)}]", *(f"{k} = {_toml(v)}" for k, v in json.loads(r["row"]).items() if v is not None)]
    for arc in other.get("delta_arc", []):
        lines += ["", "[[delta_arc]]", *(f"{k} = {_toml(v)}" for k, v in arc.items())]
    _replace(path, "\n".join(lines).strip() + "\n")


def _replace(path: str, text: str) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def write_runtime_edges(stats: DataFrame, path: str) -> str:
    """`<stem>.edges.json` beside a trace: rows by count, ties to the first seen."""
    target = f"{os.path.splitext(path)[0]}.edges.json"
    rows = [r.asDict() for r in stats.orderBy(F.desc("count"), "first_seen").collect()]  # distinct pairs of one trace
    _replace(target, json.dumps(rows, indent=1, ensure_ascii=False))
    return target


def runtime_rows(stats: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs of a trace by count, ties to the first seen; the first `top` if given."""
    out = stats.orderBy(F.desc("count"), "first_seen")
    return out if top is None else out.limit(top)


def chain_blocks(texts: DataFrame) -> DataFrame:
    """doc, block, heading, pos, line of fenced blocks of Markdown (doc, text) that draw a tree, with the nearest heading above. A text is read in its row."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    start = F.struct(F.lit(False).alias("code"), F.lit("").alias("heading"), F.lit(0).alias("block"), F.array().cast("array<struct<block:int,heading:string,pos:int,line:string>>").alias("out"))

    def step(a, x):
        bare = F.regexp_replace(x["line"], r"^\s+", "")
        fence, title = bare.startswith("```"), bare.startswith("#") & ~a["code"]
        row = F.struct(a["block"].alias("block"), a["heading"].alias("heading"), x["pos"].alias("pos"), x["line"].alias("line"))
        return F.struct(
            F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"), F.when(title, F.trim(F.regexp_replace(bare, "^[# ]+", ""))).otherwise(a["heading"]).alias("heading"),
            F.when(fence & ~a["code"], a["block"] + 1).otherwise(a["block"]).alias("block"), F.when(a["code"] & ~fence, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"),
        )

    rows = texts.select("doc", F.explode(F.aggregate(lines, start, step)["out"]).alias("r")).select("doc", "r.*")
    drawn = rows.groupBy("doc", "block").agg(F.max(F.col("line").rlike("[├└]")).alias("tree")).filter("tree").drop("tree")
    return rows.join(drawn, ["doc", "block"])


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """How many sources each language has (JavaScript and TypeScript are one family)."""
    language = language_of(path)
    return files.select(F.when(language.isin("JavaScript", "TypeScript"), "JavaScript/TypeScript").otherwise(language).alias("family")).filter("family is not null").groupBy("family").agg(F.count("*").alias("n"))


def newest(files: DataFrame, languages: Sequence[str] | None = None, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """The newest modification of each language, or of those given."""
    f = files.select(language_of(path).alias("language"), F.col(mtime).alias("mtime")).filter("language is not null")
    return (f if languages is None else f.filter(F.col("language").isin(*languages))).groupBy("language").agg(F.max("mtime").alias("newest"))


def fingerprints(files: DataFrame) -> DataFrame:
    """face, fingerprint: FNV-1a (64 bits) over the sorted names of each face, each name after its face. A running hash is in order by nature; a face's names are one repository's files."""
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        face, h = group["face"][0].as_py(), 0xCBF29CE484222325
        for rel in sorted(set(group["rel"].to_pylist())):
            for b in f"{face}\0{rel}\0".encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return pa.table({"face": pa.array([face]), "fingerprint": pa.array([f"{h:016x}"])})

    return files.select("face", "rel").groupBy("face").applyInArrow(run, "face string, fingerprint string")


def concat_indexes(paths: Sequence[str], target: str, order: Sequence[str] = ("python", "rust", "javascript", "typescript")) -> str:
    """Index files of several families as one: messages of a protobuf may follow each other, so bytes are put together, families in a fixed order. Streams in pieces, then renames."""
    rank = {k: i for i, k in enumerate(order)}
    family = lambda p: rank.get(os.path.basename(p).split(".")[0].split("-")[0], len(rank))
    with open(f"{target}.tmp", "wb") as out:
        for p in sorted(paths, key=lambda p: (family(p), p)):
            with open(p, "rb") as f:
                while piece := f.read(1 << 20):
                    out.write(piece)
    os.replace(f"{target}.tmp", target)
    return target
