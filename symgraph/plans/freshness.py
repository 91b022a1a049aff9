"""Certified answers: how far a result may be trusted given the state of the sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import identity_hash, manifest_delta

#: Operators whose empty answer on stale sources is refused: null, not empty.
GATED = frozenset({"affected_flows", "callers", "closure", "impact_radius", "search"})
REASONS = ("identity_algorithm_changed", "no_manifest", "manifest_missing", "binding_audit_failed")


@dataclass
class Verdict:
    tier: str
    reasons: list[str] = field(default_factory=list)
    changed: int | None = None
    added: int | None = None
    removed: int | None = None
    examples: dict[str, list[str]] = field(default_factory=dict)


def binding_audit(stamp: dict[str, str], manifest: DataFrame | None, header: str = "") -> str | None:
    """The first reason, in fixed order, why a stamped manifest can't be compared, or None."""
    if stamp.get("identity_algo") not in (None, "sha256-v1"):
        return REASONS[0]
    if "source_identity" not in stamp:
        return REASONS[1]
    if manifest is None:
        return REASONS[2]
    return None if identity_hash(manifest, header).first()["identity"] == stamp["source_identity"] else REASONS[3]


def verdict(stamp: dict[str, str] | None, manifest: DataFrame | None, current: DataFrame | None, covered: bool = True, examples: int = 50, header: str = "") -> Verdict:
    """exact, possibly-stale, no-coverage or indeterminate; counts are None where a reason is set."""
    if not covered:
        return Verdict("no-coverage")
    if stamp is None or current is None:
        return Verdict("indeterminate", ["no_stamp" if stamp is None else "no_sources"])
    reason = binding_audit(stamp, manifest, header)
    if reason:
        return Verdict("indeterminate" if reason == REASONS[1] else "possibly-stale", [reason])
    rows = manifest_delta(manifest, current).groupBy("change").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("rel")), 1, examples).alias("paths")).collect()
    found = {r["change"]: r for r in rows}
    n = {k: found[k]["n"] if k in found else 0 for k in ("changed", "added", "removed")}
    stale = any(n.values())
    return Verdict("possibly-stale" if stale else "exact", [k for k in n if n[k]], **n, examples={k: found[k]["paths"] for k in found})


def envelope(op: str, rows: DataFrame, v: Verdict) -> dict:
    """The result with its verdict. A gated operator with an empty result on stale sources has results None: unavailable, not zero."""
    got = [r.asDict(recursive=True) for r in rows.collect()]
    refused = not got and op in GATED and v.tier != "exact"
    negative = None if got else "unavailable" if refused else "authoritative" if v.tier == "exact" else "unverified"
    return {"op": op, "tier": v.tier, "reasons": v.reasons, "negative_verdict": negative, "results": None if refused else got}
