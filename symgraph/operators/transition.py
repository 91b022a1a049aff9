"""From one snapshot to the next: files, edges, guards, claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import module_of
from .relational import compare_claims, edge_diff


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change: new or gone."""
    b, a = before.select("file").distinct(), after.select("file").distinct()
    return a.exceptAll(b).withColumn("change", F.lit("new")).unionByName(b.exceptAll(a).withColumn("change", F.lit("gone")))


def changed_modules(diff: dict[str, DataFrame], files: DataFrame, rules: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Modules at the ends of changed edges, and owners of new and gone files."""
    return diff["changed"].select(F.col("module").cast("string").alias("module")).union(files.select(module_of("file", rules).alias("module"))).distinct()


def guards(before: Mapping[str, str | int | None], after: Mapping[str, str | int | None]) -> list[str]:
    """What forbids or weakens a comparison of two snapshots, in fixed order.

    meta: n_files, files_face, generation. An empty side makes file lists worthless; different faces (one unknown counts)
    make files incomparable, though not edges; different generations (both known) may fake deletions.
    """
    out = []
    empty = (not before.get("n_files"), not after.get("n_files"))
    if any(empty):
        out.append({(True, True): "both_empty", (True, False): "before_empty", (False, True): "after_empty"}[empty])
    if before.get("files_face") != after.get("files_face"):
        out.append("face_mismatch")
    if before.get("generation") and after.get("generation") and before["generation"] != after["generation"]:
        out.append("generation_mismatch")
    return out


def guard_rows(pairs: DataFrame) -> DataFrame:
    """pairs (before, after: structs of n_files, files_face, generation) with `guards`, as guards() gives them, for a table of pairs at once."""
    b, a = (lambda c: F.col(f"before.{c}")), (lambda c: F.col(f"after.{c}"))
    no = lambda x: F.coalesce(x("n_files"), F.lit(0)) == 0
    empty = F.when(no(b) & no(a), "both_empty").when(no(b), "before_empty").when(no(a), "after_empty")
    face = F.when(~b("files_face").eqNullSafe(a("files_face")), "face_mismatch")
    generation = F.when(b("generation") != a("generation"), "generation_mismatch")
    return pairs.withColumn("guards", F.array_compact(F.array(empty, face, generation)))


def transition(before: dict[str, DataFrame], after: dict[str, DataFrame], claimed: DataFrame | None = None, rules: Sequence[tuple[str, int]] = ()) -> dict[str, DataFrame]:
    """added, removed, reversed edges, files (new, gone), modules and, with claims, their verdicts. Snapshots: files, module_edges."""
    diff = edge_diff(before["module_edges"], after["module_edges"])
    files = file_changes(before["files"], after["files"])
    modules = changed_modules(diff, files, rules)
    out = {**{k: diff[k] for k in ("added", "removed", "reversed")}, "files": files, "modules": modules}
    return out if claimed is None else out | {"claims": compare_claims(claimed, modules)}


def path_claims(text: DataFrame, rules: Sequence[tuple[str, int]], directories: DataFrame, column: str = "text") -> DataFrame:
    """Modules that texts name by path tokens: tokens below a rule's prefix, or below it once the prefix is put in front of an existing directory (path)."""
    token = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z0-9_][\w./+-]*\.[A-Za-z0-9]+"), F.lit(0)))
    t = text.select(token.alias("token")).filter(F.contains("token", F.lit("/"))).distinct()
    direct = F.lit(False)
    for p, _ in rules:
        direct = direct | F.col("token").startswith(p)
    # The first rule whose prefix holds a directory named as the token's first part.
    order = text.sparkSession.createDataFrame([(i, p) for i, (p, _) in enumerate(rules)], "rule int, prefix string")
    known = F.broadcast(order).join(directories.select("path").distinct(), F.col("path").startswith(F.col("prefix"))).select("rule", "prefix", F.expr("substring(path, length(prefix) + 1)").alias("seg"))
    loose = t.filter(~direct).withColumn("seg", F.substring_index("token", "/", 1)).join(known, "seg").groupBy("token").agg(F.min(F.struct("rule", "prefix")).alias("r")).select(F.concat("r.prefix", "token").alias("path"))
    found = t.filter(direct).select(F.col("token").alias("path")).union(loose)
    return found.select(module_of("path", rules).alias("module")).filter("module <> ''").distinct()
