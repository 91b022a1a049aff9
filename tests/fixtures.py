"""Small graphs with hand-computed values."""

from symgraph import schema


def graph(spark, nodes, edges):
    """nodes: (symbol, kind, file, start, end, community, test); edges: (kind, caller, callee)."""
    n = [(i + 1, s, kind, s.split("::")[-1], s, f, a, b, "rust", None, t, "{}", c) for i, (s, kind, f, a, b, c, t) in enumerate(nodes)]
    e = [(i + 1, k, a, b, "f", i, 1.0, "EXTRACTED") for i, (k, a, b) in enumerate(edges)]
    return spark.createDataFrame(n, schema.NODES), spark.createDataFrame(e, schema.EDGES)


def plain(names, file):
    return [(f"{file}::{n}", "Function", file, 1, 2, None, False) for n in names]


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")
