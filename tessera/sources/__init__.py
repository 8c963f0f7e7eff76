"""Scans and sinks (S1 to S18): every input becomes a DataFrame, lazily, through Spark's readers."""

from tessera.sources.documents import (
    account_of,
    json_documents,
    json_lines,
    latest_snapshot,
    rejected,
    rejected_lines,
    run_logs,
    text_files,
    with_account,
)
from tessera.sources.json_maps import json_map
from tessera.sources.tables import (
    PRESETS,
    append_log,
    discover_parts,
    file_statistics,
    new_files,
    read_index,
    read_parts,
    read_table,
    register_views,
    unify,
    write_table,
)
from tessera.sources.trees import tree_texts, write_files

__all__ = [
    "PRESETS", "account_of", "append_log", "discover_parts", "file_statistics", "json_documents", "json_lines", "json_map",
    "latest_snapshot", "new_files", "read_index", "read_parts", "read_table", "register_views", "rejected", "rejected_lines", "run_logs", "text_files",
    "tree_texts", "unify", "with_account", "write_files", "write_table",
]
