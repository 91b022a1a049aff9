"""Schemas of the relations. Column order is the contract; ids and seq are explicit ordinals."""

OCCURRENCES = "seq long, symbol string, rel_path string, line long, is_def boolean, col long"
SPANS = "seq long, symbol string, rel_path string, start_line long, end_line long"
NODES = "id long, symbol string, kind string, name string, qname string, file_path string, line_start long, line_end long, language string, parent_name string, is_test boolean, extra string, community_id long"
EDGES = "id long, kind string, caller_symbol string, callee_symbol string, file_path string, line long, confidence double, confidence_tier string"
CALL_MARKS = "rel_path string, line long, col long, name string"
RANGES = "path string, start long, end long"
TRACE = "cat string, ph string, pid string, tid string, ts long, dur long, name string"
MODULE_EDGES = "src string, dst string, kind string"
MANIFEST = "face string, rel string, size long, hash string"
INDEX = "struct<documents:array<struct<relative_path:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int,enclosing_range:array<int>>>>>>"
EDGE_KINDS = ("CALLS", "IMPORTS_FROM", "INHERITS")
