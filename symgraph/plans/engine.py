"""The query surface: one method for each operator over an opened graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import graph as G
from ..operators import reconcile as C
from ..operators import relational as R
from ..operators import transition as T
from . import build, freshness

TASKS = (("review", ("detect_changes", "affected_flows", "review_context")), ("debug", ("search", "callers", "flows")), ("refactor", ("impact_radius", "closure", "bridge")), ("onboard", ("architecture_overview", "communities", "hub")))


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], occurrences: DataFrame | None = None, spans: DataFrame | None = None):
        self.spark, self.tables, self.occurrences, self.spans = spark, tables, occurrences, spans
        self.nodes, self.edges = tables["nodes"], tables["edges"]

    @classmethod
    def open(cls, spark: SparkSession, root: str, **inputs) -> Engine:
        return cls(spark, build.opened(spark, root), **inputs)

    @classmethod
    def build(cls, spark: SparkSession, root: str, occurrences: DataFrame, spans: DataFrame | None = None, marks: DataFrame | None = None, source_root: str = "", meta: dict[str, str] | None = None) -> Engine:
        """Builds and publishes a new generation below root and opens it."""
        g = build.build_graph(occurrences, spans, marks, source_root)
        build.publish(spark, build.derived(g), root, meta)
        return cls.open(spark, root, occurrences=occurrences, spans=spans)

    def project(self, extra: DataFrame, extra_spans: DataFrame, targets: DataFrame) -> DataFrame:
        """Claims on the graph with further occurrences put over it."""
        return C.overlay(self.occurrences, self.spans, extra, extra_spans, targets)

    def snapshot(self, root: str, rules: Sequence[tuple[str, int]] = ()) -> dict[str, DataFrame]:
        """files and module_edges of the graph below root."""
        return build.module_export(self.nodes, self.edges, root, rules)

    def delta_tour(self, before: dict[str, DataFrame], after: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
        """Steps through what changed between two snapshots."""
        d = T.transition(before, after)
        return C.delta_steps({"changed": d["modules"]}, d["files"], lines)

    def freshness(self, current: DataFrame | None, manifest: DataFrame | None) -> freshness.Verdict:
        """How far answers may be trusted, by the stamp of the opened generation."""
        stamp = {r["key"]: r["value"] for r in self.tables["metadata"].collect()} if "metadata" in self.tables else None
        return freshness.verdict(stamp, manifest, current)

    def _paths(self, files: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in files], "path string")

    def refs(self, query: str) -> tuple[DataFrame, DataFrame]:
        d = R.definitions(self.occurrences, query)
        return d, R.references(self.occurrences, d)

    def callers(self, query: str) -> tuple[DataFrame, DataFrame]:
        return R.callers(self.refs(query)[1], self.spans)

    def closure(self, query: str, depth: int = 2) -> tuple[DataFrame, int]:
        return G.closure(R.derive_edges(self.occurrences, self.spans), R.definitions(self.occurrences, query), depth)

    def hub(self, top: int = 10) -> DataFrame:
        return G.hub_nodes(self.nodes, self.edges, top)

    def bridge(self, top: int = 10) -> DataFrame:
        return G.bridge_nodes(self.nodes, self.edges, top)

    def flows(self, limit: int = 50) -> DataFrame:
        return self._flows().orderBy(F.desc("criticality"), "entry_point_id").limit(limit)

    def _flows(self) -> DataFrame:
        if "flows" not in self.tables:
            self.tables["flows"] = G.trace_flows(self.nodes, self.edges)
        return self.tables["flows"]

    def affected_flows(self, files: Sequence[str]) -> DataFrame:
        return G.affected_flows(self._flows(), self._paths(files))

    def impact_radius(self, files: Sequence[str], depth: int = 2, most: int = 500) -> dict:
        return G.impact_radius(self.nodes, self.edges, self._paths(files), depth, most)

    def detect_changes(self, files: Sequence[str], ranges: DataFrame | None = None, churn: DataFrame | None = None) -> dict:
        return G.detect_changes(self.nodes, self.edges, self._flows(), self._paths(files), ranges, churn)

    def communities(self, method: str = "directory") -> DataFrame:
        members = G.directory_groups(self.nodes) if method == "directory" else G.leiden_groups(self.nodes, self.edges)
        return G.communities(members, self.edges, "Directory-based community: " if method == "directory" else "Modularity community ")

    def community(self, name: str) -> tuple[str, DataFrame]:
        hit = self.communities().filter(F.lower("name").contains(name.lower()))
        n = hit.limit(2).count()
        return ("none", "one", "many")[n], hit

    def architecture_overview(self, most: int = 20) -> dict[str, DataFrame]:
        members = G.directory_groups(self.nodes)
        found = G.communities(members, self.edges)
        placed = members.drop("community_id").join(found.select("group", F.col("id").alias("community_id")), "group")
        cross = G.cross_edges(placed, self.edges)
        return {"communities": found, "cross_community_edges": cross.orderBy(F.desc("n"), "first"), "warnings": G.coupling_warnings(cross, found, most)}

    def minimal_context(self, task: str = "", files: Sequence[str] = ()) -> dict:
        n, f = self.nodes.agg(F.count("*"), F.count_if(F.col("kind") == "File")).first()
        out = {"nodes": n, "edges": self.edges.count(), "files": f, "risk": "unknown", "suggestions": next((list(t) for k, t in TASKS if k in task.lower()), ["search", "hub", "flows"])}
        if files:
            got = self.detect_changes(files)
            score = got["changed_functions"].agg(F.coalesce(F.max("risk_score"), F.lit(0.0))).first()[0]
            band = self.spark.range(1).select(E.risk_band(F.lit(score))).first()[0]
            out |= {"risk": band, "risk_score": score, "key_entities": [r["name"] for r in got["changed_functions"].orderBy("id").limit(5).collect()], "test_gaps": got["test_gaps"].count()}
        out["flows"] = [r["name"] for r in self.flows(3).collect()]
        return out

    def review_context(self, files: Sequence[str], depth: int = 2) -> dict:
        return {"impact": self.impact_radius(files, depth), "changes": self.detect_changes(files)}

    def search(self, query: str, limit: int = 20) -> tuple[DataFrame, str]:
        return G.search(self.nodes, query, limit)

    def symbols(self, file: str) -> DataFrame:
        return self.nodes.filter(E.path_matches(F.col("file_path"), F.lit(file))).orderBy("line_start", "id")

    def hub_refs(self, query: str, root: str, excluded: Sequence[str] = (), top: int = 10) -> dict:
        state, hit = R.resolve(self.nodes, query)
        if state != "one":
            return {"state": state, "candidates": hit}
        rows = C.hub_references(self.nodes, self.edges, hit.first()["symbol"])
        rel = E.repo_relative("file_path", root)
        spots, totals = R.hotspots(rows, rel, F.col("is_test"), E.is_excluded(rel, excluded), "id", top)
        return {"state": state, "hotspots": spots, "totals": totals}

    def graph_audit(self, expected: DataFrame) -> DataFrame:
        return C.audit(self.nodes, expected)

    def snapshot(self, root: str, rules=(), excluded=()) -> dict[str, DataFrame]:
        return build.module_export(self.nodes, self.edges, root, rules, excluded)

    def certified(self, op: str, rows: DataFrame, verdict: freshness.Verdict) -> dict:
        return freshness.envelope(op, rows, verdict)
