"""Columns of the catalog tables, and a check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "files": "id long, path string, hash long, language string, mtime long, indexed_at long, repo_label string",
    "scopes": "id long, file_id long, parent_id long, owner_symbol_id long, kind string, line_start long, line_end long",
    "symbols": "id long, file_id long, name string, qualified_name string, kind string, line long, col long, is_exported boolean, scope_id long, owner_symbol_id long",
    "imports": "id long, file_id long, source string, imported_name string, local_name string, resolved_file_id long, confidence double",
    "exports": "id long, file_id long, exported_name string, symbol_id long, is_default boolean",
    "heritage": "id long, file_id long, child_symbol_id long, parent_symbol_id long, parent_name string, heritage_kind string, confidence double, line long",
    "calls": "id long, file_id long, caller_scope_id long, callee_name string, receiver string, resolved_symbol_id long, confidence double, line long, col long",
    "edges": "id long, src_id long, dst_id long, edge_kind string, confidence double, file_id long, line long",
    "data_flows": "id long, file_id long, src_symbol_id long, dst_symbol_id long, flow_kind string, var_name string, line long, col long, confidence double",
    "routes": "id long, method string, path string, file_path string, framework string, line long, handler_symbol_id long",
    "commits": "hash string, author_name string, author_email string, timestamp long, message string",
    "file_commits": "file_path string, commit_hash string, lines_added long, lines_removed long, is_creation boolean",
    "blame_lines": "file_id long, line_number long, commit_hash string, author_name string, last_changed_at long",
    "evidence": "id string, kind string, file string, start_line long, start_col long, end_line long, end_col long, target_ref string, raw string, normalized string, extractor string, confidence double, stability double, entropy double, timestamp_ms long, state string",
    "evidence_edges": "from_id string, to_id string, edge_type string",
    "community_memberships": "symbol_id long, community_id string",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a table, missing ones null, others left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(name)))


def stable_id(*columns):
    """A surrogate key that is the same wherever it is computed."""
    return F.xxhash64(*columns)
