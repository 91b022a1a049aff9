"""From occurrences to the graph, and its publication."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import graph as G
from ..operators.iteration import cut
from ..operators.relational import first_of, innermost, nearest_preceding


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def site_edges(occ: DataFrame, spans: DataFrame | None) -> DataFrame:
    """References to defined symbols with their caller: the innermost span's symbol, or without spans the nearest definition before."""
    defs = occ.filter("is_def").select("symbol").distinct()
    refs = occ.filter("not is_def").join(defs, "symbol", "left_semi")
    if spans is not None:
        found = innermost(refs, spans).withColumn("caller", F.col("span.symbol")).drop("span")
    else:
        found = nearest_preceding(refs, occ.filter("is_def")).withColumnRenamed("nearest", "caller")
    return found.filter("caller is not null")


def build_graph(occ: DataFrame, spans: DataFrame | None = None, marks: DataFrame | None = None, root: str = "") -> Graph:
    """Nodes by first definition in (path, line, seq); an edge for each site, CALLS where a call mark names the callee there, else REFERENCES."""
    ends = spans.groupBy("symbol", "rel_path").agg(F.max("end_line").alias("line_end")) if spans is not None else None
    d = first_of(occ.filter("is_def"), ["symbol"], ["rel_path", "line", "seq"])
    d = d.join(ends, ["symbol", "rel_path"], "left") if ends is not None else d.withColumn("line_end", F.lit(None).cast("long"))
    d = d.withColumn("kind", E.ingest_kind("symbol", "rel_path")).withColumn("name", F.coalesce(E.fn_tail("symbol"), E.class_tail("symbol")))
    path = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), "rel_path")
    # Ids follow (path, line): ranks within a path, shifted by the counts of earlier paths.
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("rel_path").orderBy("line", "symbol"))
    sizes = d.groupBy("rel_path").agg(F.count("*").alias("n")).select("rel_path", (F.sum("n").over(Window.orderBy("rel_path")) - F.col("n")).alias("before"))
    nodes = d.withColumn("w", within).join(sizes, "rel_path").select(
        (F.col("before") + F.col("w")).cast("long").alias("id"), "symbol", "kind", "name", F.concat(path, F.lit("::"), "name").alias("qname"), path.alias("file_path"), F.col("line").alias("line_start"),
        F.coalesce("line_end", "line").alias("line_end"), E.language_of("rel_path", "symbol").alias("language"), E.class_segment("symbol").alias("parent_name"), E.is_test_path("rel_path").alias("is_test"),
        F.lit('{"producer":"index"}').alias("extra"), F.lit(None).cast("long").alias("community_id"),
    )
    s = site_edges(occ, spans)
    called = F.lit(False)
    if marks is not None:
        m = marks.select("rel_path", "line", F.col("name").alias("_n"), F.col("col").alias("_c")).distinct().withColumn("_hit", F.lit(True))
        s = s.withColumn("_n", F.coalesce(E.fn_tail("symbol"), E.class_tail("symbol"))).withColumn("_owner", E.class_segment("symbol"))
        keyed = s.withColumn("_n", F.explode(F.array_distinct(F.array_compact(F.array("_n", "_owner")))))
        hit = keyed.join(m, ["rel_path", "line", "_n"]).filter((F.col("_c") == -1) | (F.col("_c") == F.col("col"))).select("seq").distinct().withColumn("_called", F.lit(True))
        s, called = s.join(hit, "seq", "left"), F.coalesce("_called", F.lit(False))
    kind = F.when(called, "CALLS").otherwise("REFERENCES")
    e = s.select(kind.alias("kind"), F.col("caller").alias("caller_symbol"), F.col("symbol").alias("callee_symbol"), path.alias("file_path"), "line", "seq")
    e = e.groupBy("kind", "caller_symbol", "callee_symbol", "file_path", "line").agg(F.min("seq").alias("id"))
    return Graph(nodes, e.select("id", "kind", "caller_symbol", "callee_symbol", "file_path", "line", F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("confidence_tier")))


def derived(g: Graph, max_depth: int = 15) -> dict[str, DataFrame]:
    """nodes with their community, edges, communities, flows, memberships, metadata."""
    members = cut(G.directory_groups(g.nodes))
    found = cut(G.communities(members, g.edges))
    home = members.select("id", "group").join(found.select("group", F.col("id").alias("_c")), "group").select("id", "_c")
    nodes = g.nodes.join(home, "id", "left").withColumn("community_id", F.col("_c")).drop("_c")
    flows = G.trace_flows(g.nodes, g.edges, max_depth)
    return {"nodes": nodes, "edges": g.edges, "communities": found.drop("group"), "flows": flows, "flow_memberships": G.flow_memberships(flows), "tokens": G.token_table(g.nodes)}


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, meta: dict[str, str] | None = None) -> str:
    """Writes a new generation, then switches the pointer `CURRENT` in one rename; readers keep the generation they opened. Edges are sorted by both ends for pruning."""
    name = f"gen-{uuid.uuid4().hex}"
    for k, df in tables.items():
        if k == "edges":
            df = df.repartition("caller_symbol").sortWithinPartitions("caller_symbol", "callee_symbol")
        if k == "tokens":
            df = df.repartitionByRange("token").sortWithinPartitions("token", "id")
        df.write.parquet(f"{root}/{name}/{k}")
    spark.createDataFrame([(k, v) for k, v in (meta or {}).items()], "key string, value string").write.parquet(f"{root}/{name}/metadata")
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path(f"{root}/.{name}"), True)
    out.write(bytearray(json.dumps({"generation": name}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{root}/.{name}"), path(f"{root}/CURRENT"), rename)
    return name


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    text = spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0]
    at = f"{root}/{json.loads(text)['generation']}"
    return {k: spark.read.parquet(f"{at}/{k}") for k in ("nodes", "edges", "communities", "flows", "flow_memberships", "tokens", "metadata")}


def module_export(nodes: DataFrame, edges: DataFrame, root: str, rules=(), excluded=(), kinds=("CALLS", "IMPORTS_FROM", "INHERITS")) -> dict[str, DataFrame]:
    """files of edges of any kind, and module_edges (src, dst, kind) of structural kinds across modules, below root and not excluded."""
    where = nodes.select("symbol", "file_path")
    e = edges.select("kind", "caller_symbol", "callee_symbol").join(where.toDF("caller_symbol", "f1"), "caller_symbol", "left").join(where.toDF("callee_symbol", "f2"), "callee_symbol", "left")
    rel = lambda f, s: E.repo_relative(F.coalesce(f, F.substring_index(s, "::", 1)), root)
    e = e.select("kind", rel("f1", "caller_symbol").alias("a"), rel("f2", "callee_symbol").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & ~E.is_excluded("a", excluded) & ~E.is_excluded("b", excluded))
    m = e.filter(F.col("kind").isin(*kinds)).select(E.module_of("a", rules).alias("src"), E.module_of("b", rules).alias("dst"), "kind").filter("src <> dst").distinct()
    return {"files": e.select(F.explode(F.array("a", "b")).alias("file")).distinct(), "module_edges": m}




def containment(occ: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: function definitions, those with a span, and their share (null without definitions)."""
    d = occ.filter("is_def").filter(E.ingest_kind("symbol", "rel_path") == "Function").select("symbol", "rel_path").distinct()
    has = spans.select("symbol", "rel_path").distinct().withColumn("_s", F.lit(True))
    return d.join(has, ["symbol", "rel_path"], "left").agg(F.count("*").alias("functions"), F.count("_s").alias("spanned")).withColumn("ratio", F.col("spanned") / F.nullif("functions", F.lit(0)))
